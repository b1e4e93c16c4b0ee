"""Removal of word sequences that occurred before, found by doubling window lengths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import LATER, Answers, Chunks, by_bucket, found_twice, least_in_window, pair, unpacked
from .common import Workspace

#: Length of the first level's windows, in words.
BASE = 5
#: Seed of the second hash of words, so that windows are told apart by 128 bits.
OTHER_SEED = 0x5BD1E995


def levels(window: int, base: int = BASE) -> list[int]:
    """Window lengths: base, doubled as long as it is less than window, then window."""
    out = [min(base, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


class Texts:
    """Words of the texts of a chunk, and hashes of their windows."""

    def __init__(self, texts: list[bytes]):
        own = [t.split() for t in texts]
        self.counts = np.array([len(w) for w in own], np.int64)
        self.words = [w for words in own for w in words]
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        self.doc = np.repeat(np.arange(len(own)), self.counts)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))

    def whole(self, length: int) -> np.ndarray:
        """At which words a window of this length starts that ends in the same text."""
        n = max(len(self.words) - length + 1, 0)
        return np.arange(n) + length <= self.ends[self.doc[:n]]

    def other_hashes(self, starts: np.ndarray, window: int) -> np.ndarray:
        """Hashes of words by another seed, of those in the windows that start there (else 0)."""
        edge = np.zeros(len(self.words) + 1, np.int64)
        edge[starts] += 1
        edge[starts + window] -= 1
        at, out = np.flatnonzero(np.cumsum(edge[:-1]) > 0), np.zeros(len(self.words), np.uint64)
        out[at] = np.fromiter((xxhash.xxh64_intdigest(self.words[i], seed=OTHER_SEED) for i in at.tolist()), np.uint64, len(at))
        return out

    def windows(self, lengths: list[int], hashes: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """For each length, the hash of the window at each word, made of two of the length before."""
        h = self.hashes if hashes is None else hashes
        now = h[: max(len(h) - lengths[0] + 1, 0)]
        for k in range(1, lengths[0]):
            now = pair(now, h[k : k + len(now)])
        yield now
        for short, long in zip(lengths, lengths[1:], strict=False):
            n = max(len(h) - long + 1, 0)
            now = pair(now[:n], now[long - short : long - short + n])
            yield now


def describe(texts: list[bytes], window: int):
    """Of each text: words, sha256 of its words, and the hashes of the first level's least windows."""
    t = Texts(texts)
    sha = [hashlib.sha256(b" ".join(t.words[a:b])).hexdigest() for a, b in zip(t.starts, t.ends, strict=True)]
    first = levels(window)[0]
    h = next(t.windows([first]))
    value, at = least_in_window(h, window - first + 1)
    ok = t.whole(window)
    places = np.unique(at[ok])
    return t.counts.tolist(), sha, h[places], np.bincount(t.doc[places], minlength=len(texts)).tolist()


def _least(t: Texts, h: np.ndarray, length: int, window: int, alive: np.ndarray):
    """Windows that are alive, the place of the least part of each, and the distinct hashes of those places with their counts."""
    _, at = least_in_window(h, window - length + 1)
    starts = np.flatnonzero(alive)
    places = at[starts]
    distinct = np.unique(places)
    hashes, counts = np.unique(h[distinct], return_counts=True)
    return starts, places, hashes, counts


def _survivors(t: Texts, answers: Answers, window: int, upto: int, buckets: int) -> np.ndarray:
    """Windows of full length whose least part at each of the first `upto` levels is found twice."""
    lengths = levels(window)
    alive = t.whole(window) & ~np.isin(t.doc[: len(t.whole(window))], answers.places[LATER])
    for i, h in zip(range(upto), t.windows(lengths), strict=False):
        starts, places, hashes, counts = _least(t, h, lengths[i], window, alive)
        twice = (counts > 1) | answers.of(i, hashes, buckets)
        alive = np.zeros(len(alive), bool)
        alive[starts] = twice[np.searchsorted(hashes, h[places])]
    return alive


def _split(data: bytes, sizes: list[int]) -> list[bytes]:
    ends = np.cumsum([0, *sizes])
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _ask_anchors(batches, buckets: int):
    for batch in batches:
        for row in batch.to_pylist():
            later = Answers(row["answers"]).places[LATER]
            doc = np.repeat(np.arange(len(row["anchor_counts"])), row["anchor_counts"])
            h = np.array(row["anchors"], np.int64).view(np.uint64)[~np.isin(doc, later)]
            hashes, counts = np.unique(h, return_counts=True)
            out = by_bucket(row["chunk"], hashes, buckets, lambda a, b: np.packbits(counts[a:b] > 1).tobytes())  # noqa: B023
            if out:
                yield out


def _ask_level(batches, level: int, window: int, buckets: int):
    lengths = levels(window)
    for batch in batches:
        for row in batch.to_pylist():
            t = Texts(_split(unpacked(row["data"]), row["sizes"]))
            alive = _survivors(t, Answers(row["answers"]), window, level, buckets)
            h = list(t.windows(lengths[: level + 1]))[-1]
            _, _, hashes, counts = _least(t, h, lengths[level], window, alive)
            out = by_bucket(row["chunk"], hashes, buckets, lambda a, b: np.packbits(counts[a:b] > 1).tobytes())  # noqa: B023
            if out:
                yield out


def _keys(row: dict) -> np.ndarray:
    return np.array([-(1 << 63) if k is None else k for k in row["keys"]], np.int64)


def _firsts(t: Texts, row: dict, window: int, buckets: int):
    """Windows alive after the levels: starts, the number of each one's sequence, and of each sequence its hashes and first window."""
    lengths = levels(window)
    alive = _survivors(t, Answers(row["answers"]), window, len(lengths) - 1, buckets)
    starts = np.flatnonzero(alive)
    h = list(t.windows(lengths))[-1][starts]
    g = list(t.windows(lengths, t.other_hashes(starts, window)))[-1][starts]
    keys = _keys(row)[t.doc[starts]]
    order = np.lexsort((starts, t.doc[starts], keys, g, h))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])] if len(order) else np.zeros(0, bool)
    number = np.empty(len(starts), np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    return starts, number, h[first], g[first], keys[first], first


def _ask_first(batches, window: int, buckets: int):
    for batch in batches:
        for row in batch.to_pylist():
            t = Texts(_split(unpacked(row["data"]), row["sizes"]))
            _, _, h, g, keys, _ = _firsts(t, row, window, buckets)
            out = by_bucket(row["chunk"], h, buckets, lambda a, b: g[a:b].tobytes() + keys[a:b].tobytes())  # noqa: B023
            if out:
                yield out


def _not_first(hashes: np.ndarray, owner: np.ndarray, extra: list[bytes]) -> np.ndarray:
    """Which sequences an earlier key (or chunk) has too."""
    halves = [np.frombuffer(x, np.int64).reshape(2, -1) for x in extra]
    g, keys = np.concatenate([x[0] for x in halves]).view(np.uint64), np.concatenate([x[1] for x in halves])
    order = np.lexsort((owner, keys, g, hashes))
    same = (hashes[order][1:] == hashes[order][:-1]) & (g[order][1:] == g[order][:-1])
    out = np.zeros(len(hashes), bool)
    out[order[1:][same]] = True
    return out


def _remove(batches, window: int, buckets: int):
    last = len(levels(window)) - 1
    for batch in batches:
        for row in batch.to_pylist():
            answers = Answers(row["answers"])
            t = Texts(_split(unpacked(row["data"]), row["sizes"]))
            starts, number, h, _, _, first = _firsts(t, row, window, buckets)
            gone = np.ones(len(starts), bool)
            gone[first] = answers.of(last, h, buckets)
            edge = np.zeros(len(t.words) + 1, np.int64)
            np.add.at(edge, starts[gone], 1)
            np.add.at(edge, starts[gone] + window, -1)
            keep = np.cumsum(edge[:-1]) == 0
            later = set(answers.places[LATER].tolist())
            n, removed, sha = row["n"], [], list(row["sha"])
            kept_before = np.r_[0, np.cumsum(keep)]
            for i, (a, b) in enumerate(zip(t.starts.tolist(), t.ends.tolist(), strict=True)):
                if i in later and n[i] >= window:
                    removed.append(n[i])
                    sha[i] = hashlib.sha256(b"").hexdigest()
                    continue
                removed.append(int(b - a - kept_before[b] + kept_before[a]))
                if removed[-1]:
                    sha[i] = hashlib.sha256(b" ".join(compress(t.words[a:b], keep[a:b]))).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["keys"], pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["_k", "n_words", "n_removed", "kept_sha256"]
            )


def remove_repeats(docs: DataFrame, window: int = 20, key: str = "doc_id", text: str = "text", chunk_bytes: int | None = None) -> DataFrame:
    """One row for each input row: key, n_words, n_removed, kept_sha256 (of the kept words, joined by a space).

    A word goes if a window of `window` words that covers it starts earlier too: in a text with a
    smaller key, or in the same text. Level by level, with lengths 5, 10, ... up to `window`: a
    full window stays a candidate if the part of that length with the least hash in it is found at
    two places or more; its repeats have the same part at the same place, so none is lost, and only
    candidates are extended to twice the length. The last level compares whole windows by 128 bits
    and finds each one's first place. Copies of an earlier text go as a whole before that.
    Null texts have no words; keys are integers, null before all others; among repeated rows the first in
    the table's chunks stays; an empty table gives no rows; other columns, whatever their names, are ignored. A text longer
    than a chunk is a chunk of its own, and takes some hundred bytes a word meanwhile.
    """
    ws = Workspace(docs.sparkSession, "substrings")
    more = {} if chunk_bytes is None else {"chunk_bytes": chunk_bytes}
    chunks = Chunks(docs, ws, key, text, partial(describe, window=window), **more)
    lengths, b = levels(window), chunks.buckets
    if len(lengths) > 1:
        chunks.ask(0, ["anchors", "anchor_counts"], partial(_ask_anchors, buckets=b), found_twice)
    for level in range(1, len(lengths) - 1):
        chunks.ask(level, ["sizes", "data"], partial(_ask_level, level=level, window=window, buckets=b), found_twice)
    chunks.ask(len(lengths) - 1, ["keys", "sizes", "data"], partial(_ask_first, window=window, buckets=b), _not_first)
    kind = docs.schema[key].dataType.simpleString()
    out = chunks.each(["keys", "sizes", "n", "sha", "data"], partial(_remove, window=window, buckets=b), "_k long, n_words long, n_removed long, kept_sha256 string")
    return chunks.finish(out.select(F.col("_k").cast(kind).alias(key), "n_words", "n_removed", "kept_sha256"))


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS t FROM d, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS i)
), r AS (
  SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, i) > 1
), c AS (
  SELECT DISTINCT doc_id, i + k AS p FROM r, range(20) x(k)
), g AS (
  SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
