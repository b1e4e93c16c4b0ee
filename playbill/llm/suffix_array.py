"""Order of the suffixes of many strings of symbols, by a distributed difference cover.

Each chunk holds a string of numbers from 1 on that ends with a symbol found nowhere else. Suffixes at
places not divisible by three are the sample. Their triples of symbols are sorted over buckets and
named; the names are the next, shorter string of the chunk (those of places 1, 4, ..., then those of
2, 5, ...), whose suffixes are put in order in the same way, until all names are distinct. Then the
other suffixes are merged in by their first symbols and the rank of the sample suffix behind them.
Ranks are 1, 2, ... in the order of suffixes.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .packed import OWN, arrays_of, ask, column, cut_by, each_chunk, each_row, joined, offsets_of, packed, total

#: Rows of a sort that go to one bucket, about.
BUCKET_ROWS = 200_000
#: Strings of fewer symbols in all are ordered in one task: a bound that no input moves.
SMALL = 1 << 18
#: Rows sampled for each bucket's lower bound.
OVERSAMPLE = 32


class Splitters:
    """Lower bounds of all buckets but the first, as columns sorted together."""

    def __init__(self, rows: list[tuple[int, ...]], buckets: int, width: int):
        rows = sorted(rows)
        step = max(len(rows) / max(buckets, 1), 1)
        picked = sorted({rows[int(i * step)] for i in range(1, buckets) if int(i * step) < len(rows)})
        self.columns = [np.array([r[c] for r in picked], np.int64) for c in range(width)]

    def __len__(self) -> int:
        return len(self.columns[0])

    def bucket(self, rows: list[np.ndarray], first: int = 0) -> np.ndarray:
        """The bucket of each row, whose columns are those of the bounds from the `first` on: how many bounds are not above it."""
        bounds = self.columns[first : first + len(rows)]
        low, high = np.zeros(len(rows[0]), np.int64), np.full(len(rows[0]), len(self))
        while len(i := np.flatnonzero(low < high)):
            middle = (low[i] + high[i]) // 2
            ok = np.ones(len(i), bool)
            for bound, row in zip(bounds[::-1], rows[::-1], strict=True):
                b, r = bound[middle], row[i]
                ok = (b < r) | (b == r) & ok
            low[i], high[i] = np.where(ok, middle + 1, low[i]), np.where(ok, high[i], middle)
        return low


def not_above(low: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """For each row (columns, the first counts most), how many of the rows of `low` are equal or less."""
    if len(rows) == 1:
        return np.searchsorted(np.sort(low[0]), rows[0], "right")
    n = len(low[0])
    both = [np.concatenate([a, b]) for a, b in zip(low, rows, strict=True)]
    order = np.lexsort((np.arange(n + len(rows[0])), *both[::-1]))
    less = np.cumsum(order < n)
    out = np.empty(n + len(rows[0]), np.int64)
    out[order] = less
    return out[n:]


def _sample_places(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(1, n, 3), np.arange(2, n, 3)


def _triples(x: np.ndarray):
    """Distinct triples of the sample's places in order, and the number of each place's triple."""
    y = np.r_[x, 0, 0]
    at = np.concatenate(_sample_places(len(x)))
    a, b, c = y[at], y[at + 1], y[at + 2]
    order = np.lexsort((c, b, a))
    a, b, c = a[order], b[order], c[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])] if len(a) else np.zeros(0, bool)
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    return [a[new], b[new], c[new]], number


def _picked(chunk: int, n: int, rate: float) -> np.ndarray:
    """Some of n rows, the same ones whenever the chunk is read."""
    return np.flatnonzero(np.random.default_rng(chunk).random(n) < rate)


def _sample_triples(chunk: int, arrays: list, rate: float):
    columns, _ = _triples(arrays[0])
    at = _picked(chunk, len(columns[0]), rate)
    yield OWN, packed(*[c[at] for c in columns])


def _send_triples(chunk: int, arrays: list, splitters: Splitters):
    columns, _ = _triples(arrays[0])
    yield from cut_by(splitters.bucket(columns), columns)


def _name(bucket: int, rows: list[bytes]) -> tuple[list[bytes], int]:
    """Numbers (from 1 on) of the distinct triples of a bucket in order, and how many there are."""
    parts = [arrays_of(r) for r in rows]
    a, b, c = (joined(parts, i) for i in range(3))
    order = np.lexsort((c, b, a))
    a, b, c = a[order], b[order], c[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new)
    ends = np.cumsum([len(p[0]) for p in parts])
    return [packed(x) for x in np.split(number, ends[:-1])], int(new.sum())


def _shorter(chunk: int, parts: dict, offsets: dict[int, int]):
    """The chunk's string of names."""
    _, number = _triples(parts["string"][0].arrays[0])
    names = column(parts["names"], 0, offsets)
    yield OWN, packed(names[number]), len(number)


def _whole(chunk: int, arrays: list):
    yield 0, packed(arrays[0])


def ranks_of(x: np.ndarray) -> np.ndarray:
    """Ranks (from 0) of all suffixes of a string, by doubling."""
    _, rank = np.unique(x, return_inverse=True)
    n, k = len(x), 1
    while n and int(rank.max()) < n - 1:
        ahead = np.zeros(n, np.int64)
        ahead[: max(n - k, 0)] = rank[k:] + 1
        _, rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)
        k *= 2
    return rank.astype(np.int64)


def _order_small(bucket: int, rows: list[bytes]) -> tuple[list[bytes], int]:
    strings = [arrays_of(r)[0] for r in rows]
    rank = ranks_of(np.concatenate(strings)) + 1
    return [packed(r) for r in np.split(rank, np.cumsum([len(s) for s in strings])[:-1])], 0


class Level:
    """A chunk's string, with the ranks of its sample suffixes from the level below: what merging compares."""

    def __init__(self, x: np.ndarray, below: np.ndarray, last: int | None = None):
        n = len(x)
        one, two = _sample_places(n)
        rank = np.zeros(n + 2, np.int64)
        rank[one], rank[two] = below[: len(one)], below[len(one) :]
        sym = np.r_[x, 0, 0]
        self.x = x
        self.places = [np.arange(0, n, 3), one, two]
        if last is not None:  # symbols from `last` on are ends, whose suffixes nobody asks for
            self.places = [p[x[p] < last] for p in self.places]
        z, one, two = self.places
        self.zero = [sym[z], rank[z + 1], sym[z + 1], rank[z + 2]]
        self.one = [rank[one], sym[one], rank[one + 1]]
        self.two = [rank[two], sym[two], sym[two + 1], rank[two + 2]]

    def send(self, splitters: Splitters, extra=None):
        """(bucket, packed columns of its suffixes), and the places in the order they are sent."""
        cuts = [
            splitters.bucket(self.zero[:2], first=1),
            splitters.bucket(self.one[:1]),
            splitters.bucket(self.two[:1]),
        ]
        orders = [np.argsort(c, kind="stable") for c in cuts]
        used = np.unique(np.concatenate(cuts))
        lows, highs = ([np.searchsorted(c[o], used, side) for c, o in zip(cuts, orders, strict=True)] for side in ("left", "right"))
        rows, sent = [], []
        for i, b in enumerate(used.tolist()):
            own = [o[low[i] : high[i]] for o, low, high in zip(orders, lows, highs, strict=True)]
            columns = [c[at] for group, at in zip((self.zero, self.one, self.two), own, strict=True) for c in group]
            places = np.concatenate([p[at] for p, at in zip(self.places, own, strict=True)])
            rows.append((b, packed(*columns, *(extra(places) if extra else ()))))
            sent.append(places)
        return rows, np.concatenate([*sent, np.zeros(0, np.int64)])


def with_ranks(chunk: int, parts: dict):
    """A chunk's string, beside the ranks of its sample suffixes."""
    yield OWN, packed(parts["string"][0].arrays[0], column(parts["ranks"]))


def _sample_suffixes(chunk: int, arrays: list, rate: float, last: int | None):
    rank, sym, ahead = Level(arrays[0], arrays[1], last).one
    at = _picked(chunk, len(rank), rate)
    yield OWN, packed(rank[at], sym[at], ahead[at])


def merged(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Places (from 0) in suffix order of the suffixes sent to a bucket, in the order sent; and which part sent each."""
    s, r1, s1, r2 = (joined(parts, i) for i in range(4))
    k1, t, q1 = (joined(parts, i) for i in range(4, 7))
    k2, u, u1, q2 = (joined(parts, i) for i in range(7, 11))
    zero, one, two = np.lexsort((r1, s)), np.argsort(k1), np.argsort(k2)
    zero_one = [s[zero], r1[zero]], [t[one], q1[one]]
    zero_two = [s[zero], s1[zero], r2[zero]], [u[two], u1[two], q2[two]]
    out = [np.empty(len(x), np.int64) for x in (zero, one, two)]
    out[0][zero] = np.arange(len(zero)) + not_above(zero_one[1], zero_one[0]) + not_above(zero_two[1], zero_two[0])
    out[1][one] = np.arange(len(one)) + np.searchsorted(k2[two], k1[one]) + not_above(zero_one[0], zero_one[1])
    out[2][two] = np.arange(len(two)) + np.searchsorted(k1[one], k2[two]) + not_above(zero_two[0], zero_two[1])
    owner = np.concatenate([np.repeat(np.arange(len(parts)), [len(p[i]) for p in parts]) for i in (0, 4, 7)])
    # From all of class 0, 1, 2 to those of the first part, the second, ...
    by_part = np.argsort(owner, kind="stable")
    return np.concatenate(out)[by_part], owner[by_part]


def _rank(bucket: int, rows: list[bytes]) -> tuple[list[bytes], int]:
    parts = [arrays_of(r) for r in rows]
    place, owner = merged(parts)
    ends = np.cumsum(np.bincount(owner, minlength=len(parts)))
    return [packed(x + 1) for x in np.split(place, ends[:-1])], len(place)


def _send_suffixes(chunk: int, arrays: list, splitters: Splitters):
    yield from Level(*arrays).send(splitters)[0]


def _ranked(chunk: int, parts: dict, splitters: Splitters, offsets: dict[int, int]):
    """The ranks of all suffixes of the chunk's string, by place."""
    level = Level(*parts["level"][0].arrays)
    _, places = level.send(splitters)
    rank = np.zeros(len(level.x), np.int64)
    rank[places] = column(parts["got"], 0, offsets)
    yield OWN, packed(rank)


def ranked(level: DataFrame, n: int, ws: Workspace, bucket_rows: int, label: str) -> DataFrame:
    """Ranks of all suffixes, from strings with the ranks of their sample suffixes."""
    splitters = suffix_splitters(level, n, bucket_rows=bucket_rows)
    got = ask(each_row(level, partial(_send_suffixes, splitters=splitters)), _rank, ws, f"{label}-g")
    return ws.save(each_chunk({"level": level, "got": got}, partial(_ranked, splitters=splitters, offsets=offsets_of(got))), f"{label}-r")


def _splitters(table: DataFrame, work, n: int, width: int, bucket_rows: int, **more) -> Splitters:
    """Bounds of buckets from a sample of OVERSAMPLE rows for each bucket, as Spark's range sort takes them."""
    buckets = max(1, -(-n // bucket_rows))
    if buckets == 1:
        return Splitters([], 1, width)
    sample = each_row(table, partial(work, rate=min(1.0, OVERSAMPLE * buckets / n), **more))
    rows = [arrays_of(r["data"]) for r in sample.select("data").collect()]
    return Splitters([t for r in rows for t in zip(*[c.tolist() for c in r], strict=True)], buckets, width)


def suffix_splitters(level: DataFrame, n: int, last: int | None = None, bucket_rows: int = BUCKET_ROWS) -> Splitters:
    """Bounds of buckets of suffixes: each is a suffix of the sample, as (rank, symbol, rank behind)."""
    return _splitters(level, _sample_suffixes, n, 3, bucket_rows, last=last)


def sample_ranks(string: DataFrame, ws: Workspace, small: int = SMALL, bucket_rows: int = BUCKET_ROWS, label: str = "sa") -> DataFrame:
    """Ranks of each chunk's sample suffixes (places 1, 4, ..., then 2, 5, ...); `number` is each string's length."""
    sampled = string.agg(F.sum(F.col("number") - F.ceil(F.col("number") / 3))).first()[0] or 0
    splitters = _splitters(string, _sample_triples, sampled, 3, bucket_rows)
    names = ask(each_row(string, partial(_send_triples, splitters=splitters)), _name, ws, f"{label}-n")
    offsets, distinct = offsets_of(names), total(names)
    shorter = ws.save(each_chunk({"string": string, "names": names}, partial(_shorter, offsets=offsets)), f"{label}-s")
    ws.tidy(f"{label}-n")
    if distinct == sampled:
        return shorter
    if sampled <= small:
        out = ask(each_row(shorter, _whole), _order_small, ws, f"{label}-o")
    else:
        below = sample_ranks(shorter, ws, small, bucket_rows, f"{label}-d")
        level = ws.save(each_chunk({"string": shorter, "ranks": below}, with_ranks), f"{label}-l")
        for done in "sor":
            ws.drop(f"{label}-d-{done}")
        out = ranked(level, sampled, ws, bucket_rows, label)
        for done in "lg":
            ws.drop(f"{label}-{done}")
    ws.tidy(f"{label}-s")
    return out
