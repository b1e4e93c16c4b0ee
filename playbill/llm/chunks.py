"""Texts in chunks of a few MB, and exchanges of packed hashes between them.

The chunks are written once, bucketed by their number. A pass over them computes hashes with numpy;
what must be compared across chunks goes as arrays, split by hash into buckets; the answers, a bit
for each hash, come back to the chunk. Texts are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, attach, shuffled

#: Bytes of text in a chunk, unless one text is longer.
CHUNK_BYTES = 4 << 20
#: Hashes in a bucket, about.
BUCKET_HASHES = 500_000
#: Answers to a chunk that are no bits of hashes: texts equal to an earlier one, and to any other.
LATER, DOUBLED = -1, -2
CHUNK_SCHEMA = "chunk long, keys array<long>, sizes array<int>, n array<int>, sha array<string>, anchors array<long>, anchor_counts array<int>, places binary, data binary"


def mix(x: np.ndarray) -> np.ndarray:
    return _mixed(x.copy())


def _mixed(x: np.ndarray) -> np.ndarray:
    """mix, in place: large arrays are slow to make."""
    t = x >> np.uint64(33)
    for factor in (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)):
        x ^= t
        x *= factor
        np.right_shift(x, np.uint64(33), out=t)
    x ^= t
    return x


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two parts, from their hashes."""
    x = left * np.uint64(0x9E3779B97F4A7C15)
    x += right
    x += np.uint64(1)
    return _mixed(x)


def least_in_window(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start: the least of the next `width` hashes, and the first place that has it."""
    value, at, span = h, np.arange(len(h)), 1
    while span < width:
        step = min(span, width - span)
        a, b = value[:-step] if step else value, value[step:]
        if not len(b):
            return h[:0], at[:0]
        later = b < a
        value, at, span = np.where(later, b, a), np.where(later, at[step:], at[: len(a)]), span + step
    return value, at


def _pack(batches: Iterator[pa.RecordBatch], describe: Callable, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 32
    schema = pa.schema([
        ("chunk", pa.int64()), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("sha", pa.list_(pa.string())),
        ("anchors", pa.list_(pa.int64())), ("anchor_counts", pa.list_(pa.int32())), ("places", pa.binary()), ("data", pa.binary()),
    ])
    keys, texts, size, number = [], [], 0, 0

    def packed():
        n, sha, anchors, counts, *places = describe(texts)
        row = [first + number, keys, [len(t) for t in texts], n, sha, anchors.view(np.int64), counts, places[0] if places else None, zstandard.ZstdCompressor(level=3).compress(b"".join(texts))]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if texts and size + len(data) > chunk_bytes:
                yield packed()
                keys, texts, size, number = [], [], 0, number + 1
            keys.append(key)
            texts.append(data)
            size += len(data)
    if texts:
        yield packed()


class Chunks:
    """The chunk table of some documents, and the answers sent to its chunks so far."""

    def __init__(self, docs: DataFrame, ws: Workspace, key: str, text: str, describe: Callable, chunk_bytes: int = CHUNK_BYTES):
        self.ws, spark = ws, docs.sparkSession
        rows = docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(partial(_pack, describe=describe, chunk_bytes=chunk_bytes), CHUNK_SCHEMA)
        # As many buckets as a shuffle has partitions, so that answers come to the chunks and not the reverse.
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"chunks_{uuid.uuid4().hex}"
        rows.write.bucketBy(buckets, "chunk").option("path", f"{ws.root}/chunks").option("compression", "zstd").saveAsTable(self.name)
        self.table = spark.table(self.name)
        self.answers = self._copies()
        hashes = self.table.agg(F.sum(F.size("anchors"))).first()[0] or 0
        self.buckets = max(buckets, hashes // BUCKET_HASHES + 1)

    def finish(self, result: DataFrame) -> DataFrame:
        """The result, saved, after which the chunks and all answers are dropped."""
        out = self.ws.save(result, "result")
        result.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.ws.keep("result")
        return out

    def _copies(self) -> DataFrame:
        """Which texts of a chunk equal an earlier one (by key, then chunk and place) or any other."""
        each = self.table.select("chunk", F.posexplode(F.arrays_zip("keys", "sha")).alias("i", "x")).select("chunk", "i", F.col("x.keys").alias("k"), F.col("x.sha").alias("sha"))
        firsts = each.groupBy("sha").agg(F.min(F.struct("k", "chunk", "i")).alias("f"), F.count("*").alias("c")).filter("c > 1").select("sha", "f.chunk", "f.i")
        firsts = self.ws.save(firsts.select("sha", F.col("chunk").alias("fc"), F.col("i").alias("fi")), "firsts")
        found = attach(each, firsts, "sha", F.col("k")).filter("fc is not null")
        later = (F.col("chunk") != F.col("fc")) | (F.col("i") != F.col("fi"))
        kinds = F.explode(F.when(later, F.array(F.lit(LATER), F.lit(DOUBLED))).otherwise(F.array(F.lit(DOUBLED))))
        rows = found.select("chunk", kinds.alias("level"), "i").groupBy("chunk", "level").agg(F.array_sort(F.collect_list("i")).alias("places"))
        return self.ws.save(rows.select("chunk", "level", F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("flags"), "places"), "copies")

    def each(self, columns: list[str], work: Callable, schema: str, answers: DataFrame | None = None) -> DataFrame:
        """work(batches) over rows of the columns and `answers` (all, unless some are given), one row for each chunk."""
        answers = (self.answers if answers is None else answers).groupBy("chunk").agg(F.collect_list(F.struct("level", "bucket", "flags", "places")).alias("answers"))
        rows = self.table.select("chunk", *columns).join(shuffled(answers), "chunk", "left")
        return rows.select("chunk", *columns, "answers").mapInArrow(work, schema)

    def ask(self, level: int, columns: list[str], work: Callable, judge: Callable, answers: DataFrame | None = None, skip: int = 0) -> DataFrame:
        """Sends what work yields (bucket, chunk, hashes, extra) to judge by bucket; keeps its answers, and returns them.
        The lowest `skip` bytes of the hashes are zero, and not sent (`by_bucket`)."""
        sent = self.each(columns, work, "bucket int, chunk long, hashes binary, extra binary", answers)

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            return _judged(rows, judge, skip)

        got = sent.groupBy("bucket").applyInPandas(run, "chunk long, bucket int, flags binary")
        rows = got.select("chunk", F.lit(level).alias("level"), "bucket", "flags", F.lit(None).cast("array<int>").alias("places"))
        saved = self.ws.save(rows, f"level{level}")
        self.answers = self.answers.unionByName(saved)
        return saved


def _long(data: bytes, skip: int) -> np.ndarray:
    out = np.zeros((len(data) // (8 - skip), 8), np.uint8)
    out[:, skip:] = np.frombuffer(data, np.uint8).reshape(-1, 8 - skip)
    return out.view(np.uint64).ravel()


def _judged(rows: pd.DataFrame, judge: Callable, skip: int) -> pd.DataFrame:
    rows = rows.sort_values("chunk", ignore_index=True)
    hashes = [_long(x, skip) for x in rows["hashes"]]
    ends = np.cumsum([0, *map(len, hashes)])
    owner = np.repeat(np.arange(len(hashes)), np.diff(ends))
    flags = judge(np.concatenate(hashes), owner, list(rows["extra"]))
    return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "flags": [np.packbits(flags[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]})


def _bits(owner: np.ndarray, extra: list[bytes]) -> np.ndarray:
    counts = np.bincount(owner, minlength=len(extra))
    return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:c] for x, c in zip(extra, counts, strict=True)]).astype(bool)


def found_twice(hashes: np.ndarray, owner: np.ndarray, extra: list[bytes]) -> np.ndarray:
    """Which hashes two chunks sent, or one that has them twice (the extra bits)."""
    _, place, n = np.unique(hashes, return_inverse=True, return_counts=True)
    return (n[place] > 1) | (np.bincount(place, _bits(owner, extra), len(n))[place] > 0)


def wanted(hashes: np.ndarray, owner: np.ndarray, extra: list[bytes]) -> np.ndarray:
    """Which hashes some chunk marks (by the extra bits)."""
    _, place = np.unique(hashes, return_inverse=True)
    return np.bincount(place, _bits(owner, extra))[place] > 0


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _cuts(hashes: np.ndarray, buckets: int):
    """Buckets in use by sorted hashes, and where each one's begin and end."""
    own = bucket_of(hashes, buckets)
    low = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    return own[low], low, np.r_[low[1:], len(own)][: len(low)]


def by_bucket(chunk: int, hashes: np.ndarray, buckets: int, extra: Callable, skip: int = 0) -> pa.RecordBatch | None:
    """Rows for `ask` of sorted hashes, less their lowest `skip` bytes: extra(low, high) gives the bytes beside hashes[low:high]."""
    if not len(hashes):
        return None
    used, lows, highs = _cuts(hashes, buckets)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(used, pa.int32()),
            pa.array(np.full(len(used), chunk), pa.int64()),
            pa.array([hashes[a:b].view(np.uint8).reshape(-1, 8)[:, skip:].tobytes() for a, b in zip(lows, highs, strict=True)], pa.binary()),
            pa.array([extra(a, b) for a, b in zip(lows, highs, strict=True)], pa.binary()),
        ],
        ["bucket", "chunk", "hashes", "extra"],
    )


class Answers:
    """A chunk's answers, by level: bits of hashes, places, or packed arrays in the order of buckets."""

    def __init__(self, rows: list[dict] | None):
        self.rows = rows or []
        self.places = {LATER: np.zeros(0, np.int64), DOUBLED: np.zeros(0, np.int64)}
        for x in self.rows:
            if x["places"] is not None:
                self.places[x["level"]] = np.array(x["places"], np.int64)

    def of(self, level: int, hashes: np.ndarray, buckets: int) -> np.ndarray:
        """The bits for the sorted hashes that were asked about at this level."""
        flags = {x["bucket"]: x["flags"] for x in self.rows if x["level"] == level}
        out = np.zeros(len(hashes), bool)
        for b, low, high in zip(*_cuts(hashes, buckets), strict=True):
            out[low:high] = np.unpackbits(np.frombuffer(flags[int(b)], np.uint8))[: high - low]
        return out

    def packed(self, level: int) -> list[bytes]:
        return [x["flags"] for x in sorted((x for x in self.rows if x["level"] == level), key=lambda x: x["bucket"])]


def as_answers(table: DataFrame, level: int) -> DataFrame:
    """Packed arrays of chunks, as answers of a level."""
    return table.select("chunk", F.lit(level).alias("level"), "bucket", F.col("data").alias("flags"), F.lit(None).cast("array<int>").alias("places"))


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, with arrays of numbers as numpy arrays unless there are nulls in them."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: _value(c[i]) for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def _value(x: pa.Scalar):
    if x.is_valid and pa.types.is_list(x.type) and pa.types.is_integer(x.type.value_type) and not x.values.null_count:
        return x.values.to_numpy()
    return x.as_py()


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)
