"""Removal of bytes that lie in strings found elsewhere too, by the order of suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import DOUBLED, LATER, Answers, Chunks, as_answers, bucket_of, by_bucket, each_row, found_twice, mix, unpacked, wanted
from .common import Workspace
from .packed import OWN, SCHEMA, arrays_of, ask, binary, column, cut_by, each_chunk, joined, offsets_of, packed, packed_binary, ragged, texts_of, total
from .packed import each_row as each_packed
from .suffix_array import BUCKET_ROWS, SMALL, Level, Splitters, merged, sample_ranks, suffix_splitters

#: Bytes of a gram. Grams whose hash is low are anchors, so that equal bytes have equal anchors.
GRAM = 8
#: Anchors that a string has on average.
ANCHORS = 12
#: Grams that repeat with a period up to this are no anchors: they come in long runs.
PERIOD = 4
#: Bits of phrases' hashes that are kept: what they can't tell apart is only looked at longer.
HASH_BITS = np.uint64(((1 << 48) - 1) << 16)
#: Bytes hashed at a time, so that they stay near the processor.
SEGMENT = 1 << 17
#: Strings of no phrase that are looked at together, and compared byte by byte together.
BLOCK_STARTS, COMPARED = 1 << 16, 1 << 12
#: Bytes of text in a chunk, unless one text is longer.
CHUNK_BYTES = 2 << 20
#: Classes are numbered by the place of their first suffix in its bucket, with the bucket in the bits from this one on.
SHIFT = 32
#: Levels of answers: phrases found twice, runs of a chunk, matches, classes wanted, strings without phrases found twice, strings to compare, flags of these.
PHRASES, RUNS, MATCHES, CLASSES, BARE, STRINGS, FLAGS = range(7)
ORDER_SCHEMA = "bucket int, first array<long>, last array<long>, breaks array<long>, chunks array<long>, data binary"


def words_at(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    return np.ndarray((max(len(data) - GRAM + 1, 0),), "<u8", data, 0, (1,))


def anchors_of(data: bytes, length: int) -> np.ndarray:
    """Places of anchors."""
    limit, all_words, out = np.uint64((1 << 64) // max(4, length // ANCHORS)), words_at(data), []
    for low in range(0, len(all_words), SEGMENT):
        x = all_words[low : low + SEGMENT].copy()
        h = x * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        at = np.flatnonzero(h < limit)
        x, plain = x[at], np.ones(len(at), bool)
        for period in range(1, PERIOD + 1):
            shift = np.uint64(8 * period)
            plain &= (x >> shift) != (x & np.uint64((1 << 8 * (GRAM - period)) - 1))
        out.append(at[plain] + low)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def phrase_hashes(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from each begin to the gram at its end, that gram included."""
    words, h, i, step = words_at(data), mix((end - begin).astype(np.uint64)), np.arange(len(begin)), 0
    while len(i):
        at = np.minimum(begin[i] + step, end[i])
        h[i] = mix(h[i] * np.uint64(0x9E3779B97F4A7C15) ^ words[at])
        i, step = i[at < end[i]], step + GRAM
    return h & HASH_BITS


class Places:
    """Where texts and anchors of a chunk are. A phrase goes from an anchor to the end of the next one's gram."""

    def __init__(self, sizes, anchors: np.ndarray, length: int):
        self.ends = np.cumsum(np.array(sizes, np.int64))
        self.starts = self.ends - np.array(sizes, np.int64)
        doc = np.searchsorted(self.ends, anchors, "right")
        inside = anchors + GRAM <= np.r_[self.ends, 0][doc]
        self.at, self.doc = anchors[inside], doc[inside]
        self.same = np.r_[self.doc[1:] == self.doc[:-1], False][: len(self.at)]  # the next anchor is of the same text
        after = np.r_[self.at[1:], 0][: len(self.at)]
        self.phrase = np.flatnonzero(self.same & (after + GRAM - self.at <= length))


def describe(texts: list[bytes], length: int):
    """Of each text: bytes, sha256, the hashes of its phrases; and the places of anchors."""
    data = b"".join(texts)
    p = Places([len(t) for t in texts], anchors_of(data, length), length)
    h = phrase_hashes(data, p.at[p.phrase], p.at[p.phrase + 1])
    counts = np.bincount(p.doc[p.phrase], minlength=len(texts)).tolist()
    return [len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in texts], h, counts, zstandard.ZstdCompressor(level=1).compress(packed(np.diff(p.at, prepend=0)))


def places_of(data: bytes) -> np.ndarray:
    return np.cumsum(arrays_of(unpacked(data))[0])


def _ask_phrases(batches, buckets: int):
    for row in each_row(batches):
        doc = np.repeat(np.arange(len(row["anchor_counts"])), row["anchor_counts"])
        live = ~np.isin(doc, Answers(row["answers"]).places[LATER])
        hashes, counts = np.unique(np.array(row["anchors"], np.int64).view(np.uint64)[live], return_counts=True)
        out = by_bucket(row["chunk"], hashes, buckets, lambda a, b: np.packbits(counts[a:b] > 1).tobytes(), skip=2)  # noqa: B023
        if out:
            yield out


class Runs:
    """Runs of phrases found twice that are long enough for a string, and the strings with no whole phrase.

    Run r has phrases u[r], ..., v[r] (numbers of their first anchors); strings that begin with one of these
    anchors and have two of them or more start from low[r] to high[r]. Strings of one anchor or
    none start in the intervals from bare_low to bare_high.
    """

    def __init__(self, p: Places, again: np.ndarray, live: np.ndarray, length: int):
        n, self.length = len(p.at), length
        found = np.zeros(n + 1, bool)
        found[p.phrase[again]] = True
        u = np.flatnonzero(found[:-1] & ~np.r_[False, found[:-2]][:n]) if n else np.zeros(0, np.int64)
        v = np.flatnonzero(found[:-1] & ~found[1:]) if n else np.zeros(0, np.int64)
        at = np.r_[p.at, 0, 0]
        before = lambda i: np.where((i > 0) & np.r_[False, p.same][i], at[i - 1] + 1, p.starts[p.doc[i]])
        low = before(u)
        more = np.r_[p.same, False][np.minimum(v + 1, n)]
        high = np.where(more, at[np.minimum(v + 2, n)] + GRAM - length - 1, p.ends[p.doc[u]] - length)
        high = np.minimum(high, at[v])
        fits = at[u + 1] + GRAM - length <= high  # some string has its first two anchors
        low = np.maximum(low, at[u + 1] + GRAM - length)
        ok = fits & (low <= high)
        self.low, self.high, self.u, self.v = low[ok], high[ok], u[ok], v[ok]
        i = np.flatnonzero(live[p.doc]) if n else np.zeros(0, np.int64)
        last = p.ends[p.doc[i]] - length
        bare_high = np.minimum(np.minimum(at[i], last), np.where(p.same[i], at[i + 1] + GRAM - length - 1, last))
        docs = np.flatnonzero(live)
        tail = p.starts.copy()
        tail[p.doc] = p.at + 1  # after the last anchor
        self.bare_low, self.bare_high = np.r_[before(i), tail[docs]], np.r_[bare_high, p.ends[docs] - length]
        some = self.bare_low <= self.bare_high
        self.bare_low, self.bare_high = self.bare_low[some], self.bare_high[some]

    def needs(self, p: Places):
        """Of each phrase of a run: its number, how many phrases its strings may reach over, and the least and most
        that lie between the first and the last anchor of a string of which it has the first."""
        count = self.v - self.u + 1
        i, end = ragged(self.u, count), np.repeat(self.v + 1, count)
        low, high = np.repeat(self.low, count), np.repeat(self.high, count)
        first = np.where(i > np.repeat(self.u, count), p.at[i - 1] + 1, low)
        last_anchor = lambda start: np.searchsorted(p.at, start + self.length - GRAM, "right") - 1
        least = np.clip(last_anchor(np.maximum(first, low)) - i, 1, end - i)
        most = np.clip(last_anchor(np.minimum(p.at[i], high)) - i, 1, end - i)
        reach = np.clip(np.searchsorted(p.at, p.at[i + 1] - 1 + self.length - GRAM) - i, 1, end - i)
        return i, reach, least, np.maximum(most, least)


def _runs(batches, length: int, buckets: int):
    """Phrases of a chunk's runs, sent to be named, and what the chunk has to remember of its runs."""
    for row in each_row(batches):
        data, answers = unpacked(row["data"]), Answers(row["answers"])
        p = Places(row["sizes"], places_of(row["places"]), length)
        live = ~np.isin(np.arange(len(row["sizes"])), answers.places[LATER])
        h = np.array(row["anchors"], np.int64).view(np.uint64)
        own = live[p.doc[p.phrase]]
        hashes, counts = np.unique(h[own], return_counts=True)
        twice = (counts > 1) | answers.of(PHRASES, hashes, buckets)
        again = np.zeros(len(h), bool)
        again[own] = twice[np.searchsorted(hashes, h[own])]
        runs = Runs(p, again, live, length)
        i, reach, least, most = runs.needs(p)
        size = p.at[i + 1] + GRAM - p.at[i]
        phrases = binary(np.frombuffer(data, np.uint8)[ragged(p.at[i], size)], size).dictionary_encode()
        own = phrases.indices.to_numpy().astype(np.int64)
        first = np.zeros(len(phrases.dictionary), np.int64)
        first[own[::-1]] = i[::-1]
        bucket = bucket_of(h[np.searchsorted(p.phrase, first)], buckets)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ends = np.cumsum(runs.v - runs.u + 2) - 1  # places of ends of runs in the string
        inside = np.ones(len(i) + len(ends), bool)
        inside[ends] = False
        spread = lambda x: np.bincount(np.flatnonzero(inside), x, len(inside)).astype(np.int64)
        bare = one_of_each(data, runs.bare_low, runs.bare_high, length)
        rows = [(OWN, packed(*map(spread, (place[own] + 1, reach, least, most)), runs.low, runs.high, runs.u, runs.v, *bare), len(ends))]
        rows += _cut_texts(phrases.dictionary, bucket, order)
        _, h, counts, _ = _bare(data, bare[0], bare[1], length)
        rows += [(buckets + b, d) for b, d in cut_by(bucket_of(h, buckets), [(h >> np.uint64(1)).astype(np.int64), (counts > 1).astype(np.int64)])]
        yield _batch(row["chunk"], rows)


def _bare(data: bytes, low: np.ndarray, high: np.ndarray, length: int):
    """Starts of strings of no phrase; their distinct hashes in order with counts; and the number of each one's hash."""
    starts = ragged(low, high - low + 1)
    h, number, counts = np.unique(phrase_hashes(data, starts, starts + length - GRAM), return_inverse=True, return_counts=True)
    return starts, h, counts, number


def _intervals(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places as intervals, ends included."""
    if not len(at):
        return at, at
    new = np.flatnonzero(np.diff(at) != 1) + 1
    return at[np.r_[0, new]], at[np.r_[new, len(at)] - 1]


def _blocks(low: np.ndarray, high: np.ndarray) -> Iterator[np.ndarray]:
    """The places of intervals, some at a time."""
    upto = np.cumsum(high - low + 1)
    for first in range(0, int(upto[-1]) if len(upto) else 0, BLOCK_STARTS):
        n = np.arange(first, min(first + BLOCK_STARTS, int(upto[-1])))
        i = np.searchsorted(upto, n, "right")
        yield low[i] + n - (upto[i] - (high - low + 1)[i])


def one_of_each(data: bytes, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of starts of strings of no phrase that stand for all equal ones of the chunk, and intervals of the starts that are thereby
    known to be repeated. In a stretch with a period, such as a ruler or padding, there are no more distinct strings than
    the period has bytes, so that all else is settled here. Hashes find a string's first equal, its bytes decide."""
    windows, firsts, stay, again = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), length) if len(data) >= length else None, {}, [], []
    for starts in _blocks(low, high):
        h, one, which = np.unique(phrase_hashes(data, starts, starts + length - GRAM), return_index=True, return_inverse=True)
        first = np.array([firsts.setdefault(x, y) for x, y in zip(h.tolist(), starts[one].tolist(), strict=True)], np.int64)[which]
        other = np.flatnonzero(first != starts)
        equal = np.concatenate([(windows[starts[i]] == windows[first[i]]).all(axis=1) for i in np.array_split(other, len(other) // COMPARED + 1)]) if len(other) else np.zeros(0, bool)
        alone = np.ones(len(starts), bool)
        alone[other[equal]] = False
        stay.append(np.stack(_intervals(np.sort(starts[alone]))))
        again += [np.stack(_intervals(np.sort(starts[~alone]))), np.stack([np.unique(first[~alone])] * 2)]
    none = np.zeros((2, 0), np.int64)
    return *np.concatenate([none, *stay], axis=1), *np.concatenate([none, *again], axis=1)


def _bare_twice(bucket: int, rows: list[bytes]) -> tuple[list[bytes], int]:
    """Which hashes of a bucket are found twice."""
    parts = [arrays_of(r) for r in rows]
    _, number, counts = np.unique(joined(parts, 0), return_inverse=True, return_counts=True)
    twice = ((counts > 1) | (np.bincount(number, joined(parts, 1), len(counts)) > 0))[number].astype(np.int64)
    return [packed(x) for x in np.split(twice, np.cumsum([len(p[0]) for p in parts])[:-1])], 0


def _cut_texts(texts: pa.Array, bucket: np.ndarray, order: np.ndarray, *arrays: np.ndarray):
    """(bucket, packed texts and arrays) for each bucket; order puts the texts in that of buckets, the arrays are in it."""
    texts, at = texts.take(pa.array(order)), 0
    for b, n in zip(*np.unique(bucket, return_counts=True), strict=True):
        yield int(b), packed_binary(texts.slice(at, n), *[a[at : at + n] for a in arrays])
        at += n


def _batch(chunk: int, rows: list[tuple]) -> pa.RecordBatch:
    numbers = [r[2] if len(r) > 2 else 0 for r in rows]
    columns = [pa.array([chunk] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array(numbers, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["chunk", "bucket", "data", "number"])


def _named(bucket: int, rows: list[bytes]) -> tuple[list[bytes], int]:
    """Numbers of a bucket's distinct phrases."""
    texts = [texts_of(r)[0] for r in rows]
    number = pc.dictionary_encode(pa.concat_arrays(texts)).indices.to_numpy().astype(np.int64)
    return [packed(x + 1) for x in np.split(number, np.cumsum([len(t) for t in texts])[:-1])], int(number.max()) + 1


def _ends_before(runs: DataFrame) -> DataFrame:
    """For each chunk, as `number`, how many ends of runs the chunks before it have: added up for each partition that made
    chunks, and over partitions."""
    own = runs.select("chunk", "number", F.shiftright("chunk", 32).alias("p"))
    totals = own.groupBy("p").agg(F.sum("number").alias("n")).selectExpr("p", "sum(n) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before")
    inside = own.selectExpr("chunk", "p", "sum(number) OVER (PARTITION BY p ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside")
    number = (F.coalesce("before", F.lit(0)) + F.coalesce("inside", F.lit(0))).alias("number")
    return inside.join(totals, "p").select("chunk", F.lit(OWN).alias("bucket"), F.lit(None).cast("binary").alias("data"), number)


def _string(chunk: int, parts: dict, offsets: dict[int, int], end: int):
    """A chunk's string: the names of its runs' phrases, with an end of its own kind, from the number `end` on, after each run."""
    sym = parts["runs"][0].arrays[0]
    if len(sym):
        x, ends = np.r_[0, column(parts["names"], 0, offsets)][sym], np.flatnonzero(sym == 0)
        x[ends] = end + parts["ends"][0].number + np.arange(len(ends))
        yield OWN, packed(x), len(x)


def _with_needs(chunk: int, parts: dict):
    """A chunk's string, the ranks of its sample suffixes, and how far its strings reach."""
    if parts["string"]:
        yield OWN, packed(parts["string"][0].arrays[0], column(parts["ranks"]), *parts["runs"][0].arrays[1:4])


def _send_order(chunk: int, arrays: list, splitters: Splitters, end: int):
    """All suffixes that begin with a phrase, with the phrases they need to be compared by."""
    x, ranks, reach, least, most = arrays
    level = Level(x, ranks, end)
    yield from level.send(splitters, lambda at: (reach[at], least[at], most[at], level.x[ragged(at, reach[at])]))[0]


def _common(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each suffix in order, how many symbols it has in common with the one before."""
    out = np.zeros(len(order), np.int64)
    a, b = starts[order[:-1]], starts[order[1:]]
    room, i, t = np.minimum(counts[order[:-1]], counts[order[1:]]), np.arange(len(order) - 1), 0
    while len(i := i[room[i] > t]):
        i = i[flat[a[i] + t] == flat[b[i] + t]]
        out[i + 1] += 1
        t += 1
    return out


def _ordered(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """The suffixes of a bucket in order, compared with their neighbours there."""
    rows = rows.sort_values("chunk", ignore_index=True)
    bucket, parts = int(rows["bucket"].iat[0]), [arrays_of(d) for d in rows["data"]]
    place, owner = merged(parts)
    reach, least, most, flat = (joined(parts, i) for i in range(11, 15))
    order = np.argsort(place)
    starts = np.cumsum(reach) - reach
    common = _common(flat, starts, reach, order)
    ahead = lambda i: flat[starts[i] : starts[i] + reach[i]].tolist()
    least_from = np.minimum.accumulate(common[1:][::-1])[::-1] if len(order) > 1 else np.zeros(0, np.int64)  # of each and all later
    breaks = np.searchsorted(least_from, np.arange(1, length + 1))  # how many places, from the second on, have one below later
    return pd.DataFrame([[bucket, ahead(order[0]), ahead(order[-1]), breaks.tolist(), rows["chunk"].tolist(), packed(place, np.bincount(owner, minlength=len(parts)), common, least, most)]], columns=["bucket", "first", "last", "breaks", "chunks", "data"])


def _matches(bucket: int, common: np.ndarray, after: int, carry: np.ndarray, place: np.ndarray, least: np.ndarray, most: np.ndarray):
    """Of each suffix: how many symbols it shares with a neighbour, and with the one before; and the numbers of the classes of
    suffixes that share the first `least`, `least` + 1, ... symbols with it, as far as it shares them with any."""
    shared = np.maximum(common, np.r_[common[1:], after])[place]
    counts = np.maximum(np.minimum(most, shared) - least + 1, 0)
    out, starts = np.zeros(counts.sum(), np.int64), np.cumsum(counts) - counts
    for s in range(int(least.min(initial=1)), int(most.max(initial=0)) + 1):
        i = np.flatnonzero((least <= s) & (s - least < counts))
        if len(i):
            first = np.maximum.accumulate(np.where(common < s, np.arange(len(common)), -1))[place[i]]
            out[starts[i] + s - least[i]] = np.where(first >= 0, (bucket << SHIFT) + first, carry[s - 1])
    return shared, common[place], counts, out


def _tell(batches):
    for row in each_row(batches):
        place, sizes, common, least, most = arrays_of(row["data"])
        common[0] = row["common"]
        carry = np.array([x or 0 for x in row["carry"]], np.int64)
        shared, before, counts, classes = _matches(row["bucket"], common, row["after"], carry, place, least, most)
        ends = np.cumsum(sizes)
        cuts = np.r_[0, np.cumsum(counts)][np.r_[0, ends]]
        for i, (chunk, low, high) in enumerate(zip(row["chunks"], ends - sizes, ends, strict=True)):
            yield _batch(chunk, [(row["bucket"], packed(shared[low:high], before[low:high], counts[low:high], classes[cuts[i] : cuts[i + 1]]))])


def _compared(sent: DataFrame, length: int, ws: Workspace) -> DataFrame:
    """Answers to the chunks that sent suffixes: matches with neighbours in the order of all suffixes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _ordered(rows, length)

    order = ws.save(sent.groupBy("bucket").applyInPandas(run, ORDER_SCHEMA), "order")
    ends = order.select("bucket", "first", "last", "breaks")
    before = order.select((F.col("bucket") + 1).alias("bucket"), F.col("last").alias("before"))
    same = F.zip_with("before", "first", lambda a, b: F.coalesce(a == b, F.lit(False)))
    common = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size("first"))
    edges = ws.save(ends.join(before, "bucket", "left").withColumn("common", F.when(F.col("before").isNull(), 0).otherwise(common).cast("long")).select("bucket", "common", "breaks"), "edges")
    each = edges.select("bucket", "common", F.posexplode("breaks").alias("s", "at"))
    number = (F.col("bucket").cast("long") * F.lit(1 << SHIFT)) + F.col("at")
    broken = F.when((F.col("at") > 0) | (F.col("common") <= F.col("s")), number)
    carried = _carried(each.withColumn("broken", broken))
    after = edges.select((F.col("bucket") - 1).alias("bucket"), F.col("common").alias("after"))
    told = order.select("bucket", "chunks", "data").join(edges.select("bucket", "common"), "bucket").join(after, "bucket", "left").join(carried, "bucket")
    return ws.save(told.withColumn("after", F.coalesce("after", F.lit(0).cast("long"))).mapInArrow(_tell, SCHEMA), "told")


def _carried(each: DataFrame) -> DataFrame:
    """For each bucket and number s of symbols: the class, by s symbols, of the last suffix of the buckets before."""
    before = "last(broken, true) OVER (PARTITION BY s ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    found = each.selectExpr("bucket", "s", f"{before} AS carry")
    return found.groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "carry"))), lambda x: x["carry"]).alias("carry"))


def _by_place(chunk: int, parts: dict, splitters: Splitters, end: int):
    """Matches by the place of their phrase in the chunk's string."""
    level = Level(*parts["level"][0].arrays[:2], end)
    _, places = level.send(splitters)
    shared, before, counts, classes = (column(parts["told"], i) for i in range(4))
    by_place = lambda x: np.bincount(places, x, len(level.x)).astype(np.int64)
    yield OWN, packed(by_place(shared), by_place(before), by_place(np.cumsum(counts) - counts), classes)


class Inside:
    """The strings of a chunk's runs that the order of suffixes settles, as intervals of starts (low to high); and, of those that it
    doesn't and of one for each class of settled ones that are equal, the start, and the class of the phrases inside."""

    def __init__(self, p: Places, runs: list[np.ndarray], matches: list[bytes], length: int):
        _, _, least, _, low, high, u, v = runs[:8]
        empty = np.zeros(0, np.int64)
        self.low = self.high = self.starts = self.first = self.last = self.cls = empty
        self.settled = np.zeros(0, bool)
        if not len(u):
            return
        shared, before, offsets, classes = arrays_of(matches[0])
        count = v - u + 1
        run, c = np.repeat(np.arange(len(u)), count), ragged(u, count)
        base = np.cumsum(count + 1) - (count + 1) - u  # from a phrase's number to its place in the string
        place = c + base[run]
        begin, end = p.at[c], np.minimum(p.at[c + 1] - 1, high[run])
        covered = lambda n: p.at[np.minimum(c + n[place], v[run] + 1)] + GRAM - length  # noqa: E731 (the last start within n phrases)
        upto = np.minimum(end, covered(shared))
        some = upto >= begin
        self.low, self.high = begin[some], upto[some]
        # Strings within phrases that the suffix before in order has too are not the first of their kind.
        own = np.maximum(begin, covered(before) + 1)
        from_ = np.where(own <= upto, own, np.maximum(upto + 1, begin))
        n = np.maximum(end - from_ + 1, 0)
        head = np.maximum(np.minimum(p.at[u] - 1, high) - low + 1, 0)  # strings that begin before the first anchor of the run
        self.starts = starts = np.r_[ragged(low, head), ragged(from_, n)]
        self.settled = np.r_[np.zeros(head.sum(), bool), starts[head.sum() :] <= np.repeat(upto, n)]
        inner = np.repeat(c, n)
        self.first = np.r_[np.repeat(u, head), inner + (starts[head.sum() :] > p.at[inner])]
        self.last = np.searchsorted(p.at, starts + length - GRAM, "right") - 1
        at, s = self.first + base[np.r_[np.repeat(np.arange(len(u)), head), np.repeat(run, n)]], self.last - self.first
        self.cls = np.full(len(starts), -1)  # no other place has these phrases, or there are none
        ok = np.flatnonzero(s > 0)
        ok = ok[shared[at[ok]] >= s[ok]]
        self.cls[ok] = classes[offsets[at[ok]] + s[ok] - least[at[ok]]]

    def classes(self):
        """Distinct hashes of classes, whether a string that is not settled has them, and the strings with a class and the numbers of theirs."""
        i = np.flatnonzero(self.cls >= 0)
        h, place = np.unique(mix(self.cls[i].astype(np.uint64)), return_inverse=True)
        return h, np.bincount(place, ~self.settled[i], len(h)) > 0, i, place


def _ask_classes(batches, length: int, buckets: int):
    for row in each_row(batches):
        answers = Answers(row["answers"])
        if answers.packed(MATCHES):
            p = Places(row["sizes"], places_of(row["places"]), length)
            h, open_, _, _ = Inside(p, arrays_of(answers.packed(RUNS)[0]), answers.packed(MATCHES), length).classes()
            out = by_bucket(row["chunk"], h, buckets, lambda a, b: np.packbits(open_[a:b]).tobytes())  # noqa: B023
            if out:
                yield out


def _strings(batches, length: int, buckets: int):
    """Strings that the order of suffixes settles, as intervals; and, to be compared whole, strings of classes in which
    some begin or end amid a phrase, each with its class and its bytes outside the phrases; and strings of no phrase."""
    for row in each_row(batches):
        answers = Answers(row["answers"])
        if not answers.packed(RUNS):
            continue
        data, p = unpacked(row["data"]), Places(row["sizes"], places_of(row["places"]), length)
        runs = arrays_of(answers.packed(RUNS)[0])
        x = Inside(p, runs, answers.packed(MATCHES), length)
        h, _, i, place = x.classes()
        i = i[answers.of(CLASSES, h, buckets)[place]]
        compared = x.starts[i]
        bare, h, _, number_of = _bare(data, runs[8], runs[9], length)
        bare = bare[np.r_[column_of(answers.packed(BARE)), 0][number_of] > 0] if len(bare) else bare
        keys = _keys(np.frombuffer(data, np.uint8), compared, p.at[x.first[i]], p.at[x.last[i]] + GRAM, x.cls[i], bare, length).dictionary_encode()
        starts, own = np.r_[compared, bare], keys.indices.to_numpy().astype(np.int64)
        one = np.zeros(len(keys.dictionary), np.int64)
        one[own] = starts
        bucket = bucket_of(phrase_hashes(data, one, one + length - GRAM), buckets)  # equal strings have equal keys
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        many = (np.bincount(own, minlength=len(order)) > 1).astype(np.int64)[order]
        rows = [(OWN, packed(np.r_[x.low, runs[10]], np.r_[x.high, runs[11]], starts, place[own])), *_cut_texts(keys.dictionary, bucket, order, many)]
        yield _batch(row["chunk"], rows)


def _keys(data: np.ndarray, starts: np.ndarray, first: np.ndarray, last: np.ndarray, cls: np.ndarray, bare: np.ndarray, length: int) -> pa.Array:
    """What strings are compared by: 1, the class of the phrases from `first` to `last`, the bytes before and behind these; or 0 and all bytes."""
    head, tail = first - starts, starts + length - last
    sizes = np.r_[13 + head + tail, np.full(len(bare), length + 1)]
    at = np.cumsum(sizes) - sizes
    out = np.zeros(sizes.sum(), np.uint8)
    own = at[: len(starts)]
    fixed = np.ones((len(starts), 13), np.uint8)
    fixed[:, 1:9] = np.ascontiguousarray(cls, "<i8").view(np.uint8).reshape(-1, 8)
    fixed[:, 9:] = np.ascontiguousarray(head, "<i4").view(np.uint8).reshape(-1, 4)
    out[own[:, None] + np.arange(13)] = fixed
    out[ragged(own + 13, head)] = data[ragged(starts, head)]
    out[ragged(own + 13 + head, tail)] = data[ragged(last, tail)]
    out[(at[len(starts) :, None] + np.arange(1, length + 1)).ravel()] = data[(bare[:, None] + np.arange(length)).ravel()]
    return binary(out, sizes)


def column_of(rows: list[bytes]) -> np.ndarray:
    return joined([arrays_of(d) for d in rows], 0)


def _twice(bucket: int, rows: list[bytes]) -> tuple[list[bytes], int]:
    """Which strings of a bucket are found twice."""
    parts = [texts_of(r) for r in rows]
    number = pc.dictionary_encode(pa.concat_arrays([t for t, _ in parts])).indices.to_numpy()
    many = np.concatenate([x[0] for _, x in parts])
    twice = ((np.bincount(number) > 1) | (np.bincount(number, many) > 0))[number]
    return [packed(x.astype(np.int64)) for x in np.split(twice, np.cumsum([len(t) for t, _ in parts])[:-1])], 0


def _spans(batches, length: int) -> Iterator[pa.RecordBatch]:
    for row in each_row(batches):
        answers, sizes = Answers(row["answers"]), np.array(row["sizes"], np.int64)
        ends = np.cumsum(sizes)
        low = high = np.zeros(0, np.int64)
        if own := answers.packed(STRINGS):
            low, high, compared, number = arrays_of(own[0])
            flags = np.r_[column_of(answers.packed(FLAGS)), 0]
            found = compared[flags[number] > 0]
            low, high = np.r_[low, found], np.r_[high, found]
        whole = answers.places[DOUBLED]
        whole = whole[sizes[whole] >= length]
        low, high = np.r_[low, ends[whole] - sizes[whole]], np.r_[high, ends[whole] - length]
        order = np.argsort(low, kind="stable")
        low, high = low[order], np.maximum.accumulate(high[order] + length) if len(order) else high
        # A span ends where the next string starts beyond all before it, or in another text.
        doc = np.searchsorted(ends, low, "right")
        new = np.flatnonzero(np.r_[True, (low[1:] > high[:-1]) | (doc[1:] != doc[:-1])]) if len(low) else np.zeros(0, np.int64)
        begin, end, doc = low[new], high[np.r_[new[1:] - 1, len(low) - 1]] if len(new) else low, doc[new]
        removed = np.bincount(doc, end - begin, len(sizes)).astype(np.int64)
        counts = np.bincount(doc, minlength=len(sizes))
        first = np.cumsum(counts) - counts
        sha, data = list(row["sha"]), None
        for d in np.flatnonzero(removed).tolist():
            data = data or unpacked(row["data"])
            at, kept = int(ends[d] - sizes[d]), hashlib.sha256()
            for a, b in zip(begin[first[d] : first[d] + counts[d]].tolist(), end[first[d] : first[d] + counts[d]].tolist(), strict=True):
                kept.update(data[at:a])
                at = b
            kept.update(data[at : int(ends[d])])
            sha[d] = kept.hexdigest()
        base = np.repeat(ends - sizes, counts)
        spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], ["start", "end"]))
        columns = [pa.array(row["keys"], pa.int64()), pa.array(sizes), pa.array(removed), spans, pa.array(sha, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["_k", "n_bytes", "n_removed", "spans", "kept_sha256"])


def remove_common_bytes(
    docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, small: int = SMALL, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """One row for each input row: key, n_bytes, n_removed, spans (removed, as places from 0 on), kept_sha256 (of the bytes that stay).

    A byte goes if a string of `length` bytes (16 or more) that covers it starts anywhere else too. Some grams of eight
    bytes are anchors, by their bytes alone, so equal strings have equal anchors; a phrase goes from an anchor to the
    next. Phrases that no other place has can't be in a repeated string. What they leave are runs of
    phrases, named by their bytes: the symbols whose suffixes a difference cover puts in order, down to distinct
    names. Each suffix is compared with its neighbours in that order. What their common prefixes cover is
    repeated. Other strings begin before their first anchor or end behind their last one: two of them are
    equal if their phrases inside are of one class in the order and their other bytes agree. Strings
    with no two anchors are compared whole, one of each kind for a chunk, so that stretches of a short period, which have few kinds, stay
    few. Nothing is settled by a hash.

    Texts equal to others go as a whole; one of them stays to be compared with the rest. Null and empty texts have no bytes,
    repeated rows and null keys are rows like others; keys are integers; an empty table gives no rows; other
    columns, whatever their names, are ignored. A text longer than a chunk is a chunk of its own, and takes some
    three times its bytes of memory.
    """
    if length < 2 * GRAM:
        raise ValueError(f"strings must have {2 * GRAM} bytes or more")
    ws = Workspace(docs.sparkSession, "bytes")
    chunks = Chunks(docs, ws, key, text, partial(describe, length=length), chunk_bytes)
    b, columns = chunks.buckets, ["sizes", "places", "data"]
    chunks.ask(PHRASES, ["anchors", "anchor_counts"], partial(_ask_phrases, buckets=b), found_twice, skip=2)
    sent = ws.save(chunks.each(["anchors", *columns], partial(_runs, length=length, buckets=b), SCHEMA), "runs")
    names = ask(sent.filter(F.col("bucket") < b), _named, ws, "names")
    bare = ask(sent.filter(F.col("bucket") >= b), _bare_twice, ws, "bare")
    runs = ws.save(sent.filter(F.col("bucket") == OWN), "own")
    ws.tidy("runs")  # with the bytes of all phrases
    end = total(names) + 1
    string = ws.save(each_chunk({"runs": runs, "names": names, "ends": _ends_before(runs)}, partial(_string, offsets=offsets_of(names), end=end)), "string")
    below = sample_ranks(string, ws, small, bucket_rows)
    level = ws.save(each_chunk({"string": string, "ranks": below, "runs": runs}, _with_needs), "level")
    n = total(string)
    ws.tidy("names", "string", "sa-s", "sa-o", "sa-r")
    splitters = suffix_splitters(level, n, end, bucket_rows)
    told = _compared(each_packed(level, partial(_send_order, splitters=splitters, end=end)), length, ws)
    matches = ws.save(each_chunk({"level": level, "told": told}, partial(_by_place, splitters=splitters, end=end)), "matches")
    ws.tidy("level", "order", "edges", "told")
    known = as_answers(runs, RUNS).unionByName(as_answers(matches, MATCHES))
    known = known.unionByName(chunks.ask(CLASSES, ["sizes", "places"], partial(_ask_classes, length=length, buckets=b), wanted, known))
    known = known.unionByName(as_answers(bare, BARE))
    strings = ws.save(chunks.each(columns, partial(_strings, length=length, buckets=b), SCHEMA, known), "strings")
    flags = ask(strings, _twice, ws, "flags")
    known = as_answers(strings.filter(F.col("bucket") == OWN), STRINGS).unionByName(as_answers(flags, FLAGS)).unionByName(chunks.answers.filter(F.col("level") == DOUBLED))
    spans = "spans array<struct<start: long, end: long>>"
    out = chunks.each(["keys", "sha", "sizes", "data"], partial(_spans, length=length), f"_k long, n_bytes long, n_removed long, {spans}, kept_sha256 string", known)
    kind = docs.schema[key].dataType.simpleString()
    return chunks.finish(out.select(F.col("_k").cast(kind).alias(key), "n_bytes", "n_removed", "spans", "kept_sha256"))


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_common_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
