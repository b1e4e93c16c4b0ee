"""Runs of words that repeat with a period, found by minimizers at several scales and by direct scans."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import least_in_window, mix

#: Periods up to this are found by comparing words at that distance, longer ones by minimizers.
SHORT = 8
#: A run has at least this many words, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of texts looked at together, unless one text is longer, and words compared at once to extend a seed.
TOGETHER_BYTES, STRIDE = 1 << 20, 256
#: Words as the contract splits them.
WORD = r"[^\x20\x09-\x0D]+"


def _least_length(period: int) -> int:
    return max(LEAST_WORDS, LEAST_PERIODS * period)


def _short(ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Stretches (start, end, period) of each period up to SHORT, by comparing each word with that one behind."""
    for q in range(1, min(SHORT, len(ids) // 2) + 1):
        edge = np.flatnonzero(np.diff(np.r_[False, ids[q:] == ids[:-q], False].view(np.int8)))
        starts, ends = edge[::2], edge[1::2] + q
        long = ends - starts >= _least_length(q)
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            yield a, b, q


def _doubled(at: np.ndarray, name: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and names of sequences of 2k words that occur twice or more, from those of k words. Names are exact: no hash decides."""
    place = np.searchsorted(at, at + k)
    place[place == len(at)] = 0
    both = at[place] == at + k if len(at) else np.zeros(0, bool)
    at, both_names = at[both], name[both] * np.int64(len(name) + 1) + name[place[both]]
    _, name, n = np.unique(both_names, return_inverse=True, return_counts=True)
    twice = n[name] > 1
    at, (_, name) = at[twice], np.unique(name[twice], return_inverse=True)
    return at, name


def _seeds(at: np.ndarray, name: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of equal neighbouring minimizers at distances of over half the scale, up to it.

    Sequences of `scale` words inside a run of such a period are equal at its multiples only. All of a run's sequences occur twice, at
    2 * period + 2 neighbouring places at least, so shorter stretches of places are left out. A window of scale / 2 + 1 places is no longer
    than the period: the least sequence of the run's first one is the least again one period on, and both are neighbours among equal ones.
    """
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    low, high = np.r_[0, cut], np.r_[cut, len(at)]
    long = np.repeat(high - low >= scale + 4, high - low)
    at, name = at[long], name[long]
    _, chosen = least_in_window(mix(name.astype(np.uint64)), scale // 2 + 1)
    chosen = np.unique(chosen)
    at, name = at[chosen], name[chosen]
    order = np.lexsort((at, name))
    at, name = at[order], name[order]
    gap = np.diff(at)
    ok = (name[1:] == name[:-1]) & (gap > scale // 2) & (gap <= scale)
    return at[:-1][ok], gap[ok]


def _agreeing(ids: np.ndarray, start: int, period: int, step: int) -> int:
    """How many words from start on, forwards or backwards, equal those a period behind."""
    n, width = 0, STRIDE
    while True:
        if step > 0:
            low, high = start + n, min(start + n + width, len(ids) - period)
            differ = np.flatnonzero(ids[low:high] != ids[low + period : high + period])
            first = differ[0] if len(differ) else high - low
        else:
            low, high = max(start - n - width + 1, 0), start - n + 1
            differ = np.flatnonzero(ids[low:high] != ids[low + period : high + period])
            first = high - low - 1 - differ[-1] if len(differ) else high - low
        n += int(first)
        if len(differ) or high - low < width:
            return n
        width *= 2


def _long(ids: np.ndarray, own: np.ndarray, longest: int) -> Iterator[tuple[int, int, int]]:
    """Stretches of periods over SHORT: seeds of each scale, extended on both sides.

    own: ids that no two texts share. A seed is a square of its distance already (its sequences are longer than it), so there are at
    most about as many to extend as words, and one extension serves all seeds inside it.
    """
    _, name, n = np.unique(own, return_inverse=True, return_counts=True)
    at = np.flatnonzero(n[name] > 1)
    name, k = name[at], 1
    while k < 2 * SHORT and len(at):
        at, name = _doubled(at, name, k)
        k *= 2
    while len(at) and _least_length(k // 2 + 1) <= longest:
        places, gaps = _seeds(at, name, k)
        order = np.lexsort((places, gaps))
        places, gaps = places[order], gaps[order]
        i = 0
        while i < len(places):
            p, d = int(places[i]), int(gaps[i])
            a, b = p - _agreeing(ids, p - 1, d, -1), p + d + _agreeing(ids, p, d, 1)
            if b - a >= _least_length(d):
                yield a, b, d
            i += int(np.searchsorted(places[i : i + int(np.searchsorted(gaps[i:], d, "right"))], b - d)) or 1
        at, name = _doubled(at, name, k)
        k *= 2


def runs_of(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """Of each list of words its runs (start, length, period), by start, then period."""
    number = {w: i for i, w in enumerate(dict.fromkeys(w for words in texts for w in words))}
    sizes = np.array([len(w) for w in texts], np.int64)
    ends = np.cumsum(sizes + 1)  # behind each text one word that no other equals, so that nothing periodic crosses it
    starts = ends - sizes - 1
    ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    inside = np.ones(len(ids), bool)
    inside[ends - 1] = False
    ids[inside] = np.fromiter((number[w] for words in texts for w in words), np.int64, int(sizes.sum()))
    ids[~inside] = -1 - np.arange(len(texts))
    doc = np.repeat(np.arange(len(texts)), sizes + 1)
    least: dict[tuple[int, int], int] = {}
    for a, b, q in _short(ids):
        least[a, b] = min(q, least.get((a, b), q))
    if len(sizes) and sizes.max() >= _least_length(SHORT + 1):
        far = np.repeat(sizes >= _least_length(SHORT + 1), sizes + 1)
        # Only texts that have room for long periods are named; each keeps its end mark, which is found once.
        for a, b, q in _long(ids[far], (doc * np.int64(len(number) + 1) + np.where(inside, ids, len(number)))[far], int(sizes.max())):
            shift = np.flatnonzero(far)[a] - a
            key = (int(a + shift), int(b + shift))
            least[key] = min(q, least.get(key, q))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (a, b), q in sorted(least.items(), key=lambda x: (x[0][0], x[1])):
        i = int(doc[a])
        out[i].append((a - int(starts[i]), b - a, q))
    return out


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    low = total = 0
    for i, size in enumerate(sizes):
        if i > low and total + size > TOGETHER_BYTES:
            yield low, i
            low, total = i, 0
        total += size
    if low < len(sizes):
        yield low, len(sizes)


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        for low, high in _parts(sizes):
            part = batch.slice(low, high - low)
            words = [(x or b"").split() for x in part.column(1).cast(pa.binary()).to_pylist()]
            found = runs_of(words)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[{"start": a, "length": n, "period": p} for a, n, p in x] for x in found], pa.list_(run)),
                    pa.array([b" ".join(collapsed(w, x)) for w, x in zip(words, found, strict=True)], pa.binary()).cast(pa.string()),
                ],
                ["_k", "n_words", "runs", "collapsed"],
            )


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: key, n_words, runs (array of start, length, period, by start, then period), collapsed (the kept words joined by a space).

    A run is a stretch of words whose smallest period is `period` (words so far apart are equal), of four
    periods and six words at least, which no word beside it extends. Words of a run after its first period are dropped. Periods up
    to 8 are found by comparing words at each such distance. For periods of over s/2 up to s (s = 16, 32, ...) all sequences of
    s words that occur twice in a text get exact names, doubled from scale to scale; the least of each window of s/2 + 1 is a minimizer,
    and equal neighbouring minimizers at such a distance seed a stretch, which is extended word by word on both sides. Stretches that are
    found with several periods keep the smallest.
    Null texts have no words, so no runs and an empty text; keys, null ones too, are handed through; repeated rows are judged alike; an
    empty table gives no rows; other columns, whatever their names, are ignored. A text is judged whole, in one task, with some 200 bytes a
    word meanwhile. Nothing is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))
    return rows.mapInArrow(_collapse, f"_k {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("_k", key)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period (ties: smallest start, then period), or null."""
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(better(x, best), x).otherwise(best))


def run_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """From rows of `collapse_runs`: key, n_runs, the strongest run with its exponent, and sha256 of all runs and of the kept words."""
    best = strongest(F.col("runs"))
    lines = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    return found.withColumn("_best", best).select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{x}").alias(x) for x in ("start", "length", "period")],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.concat_ws("\n", lines), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and text, in which each tenth text by the key's checksum ends in words repeated with a period that the checksum gives; a null key changes nothing."""
    h = F.crc32(F.col(key).cast("string")).cast("long")
    g = F.floor(h / 10).cast("long")
    words, n = F.col("_w"), F.size("_w").cast("long")
    a = F.pmod(F.col("_g"), n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(F.col("_g"), F.lit(8)))).cast("long")
    # Each repeats the p words from place a on; place, period and words are worked out once a row.
    planted = F.concat(F.slice(words, 1, F.col("_a").cast("int")), F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - F.col("_a") - 1, F.lit(0))), lambda i: F.get("_w", (F.col("_a") + F.pmod(i, F.col("_p"))).cast("int"))))
    chosen = docs.select(F.col(key), F.col(text).alias("_t"), h.alias("_h"), g.alias("_g"))
    chosen = chosen.withColumn("_w", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all(F.coalesce("_t", F.lit("")), F.lit(WORD), F.lit(0))))
    chosen = chosen.withColumn("_a", F.when(F.size("_w") > 0, a)).withColumn("_p", F.when(F.size("_w") > 0, p))
    return chosen.select(key, F.when(F.size("_w") > 0, F.concat_ws(" ", planted)).otherwise(F.col("_t")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return run_digests(collapse_runs(with_planted_runs(docs)))
