"""Packed arrays that go between chunks and buckets, and the exchange of them."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: A row of a table of packed arrays, with a number to add up. Bucket OWN holds what a chunk keeps for itself.
SCHEMA = "chunk long, bucket int, data binary, number long"
OWN = -1


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on, each in as few bytes a number as its greatest one needs."""
    out = []
    for x in arrays:
        x = np.ascontiguousarray(x, "<i8")
        width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
        out += [struct.pack("<qB", len(x), width), x.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()]
    return b"".join(out)


def arrays_of(data: bytes) -> list[np.ndarray]:
    """The arrays, from what `packed` made of them."""
    out, at = [], 0
    while at < len(data):
        n, width = struct.unpack_from("<qB", data, at)
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 9).reshape(n, width)
        out.append(x.view("<i8").ravel())
        at += 9 + n * width
    return out


def texts_of(data: bytes) -> tuple[pa.Array, list[np.ndarray]]:
    """The byte strings as an Arrow array, and the arrays, from what `packed_binary` made of them."""
    (n,) = struct.unpack_from("<q", data)
    sizes, *arrays = arrays_of(data[8 : 8 + n])
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[8 + n :])]), arrays


def packed_binary(texts: pa.Array, *arrays: np.ndarray) -> bytes:
    """An Arrow array of byte strings, with arrays beside them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    head = packed(np.diff(offsets), *arrays)
    data = texts.buffers()[2]
    return struct.pack("<q", len(head)) + head + (data[int(offsets[0]) : int(offsets[-1])].to_pybytes() if data else b"")


def binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Byte strings of these sizes, end to end, as an Arrow array."""
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def joined(parts: list[list[np.ndarray]], i: int) -> np.ndarray:
    """The i-th arrays of all parts, end to end."""
    return np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then those from starts[1] on, and so forth."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def cut_by(bucket: np.ndarray, arrays: list[np.ndarray]) -> Iterable[tuple[int, bytes]]:
    """(bucket, packed arrays) for each bucket in use; bucket numbers must rise."""
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    for low, high in zip(at.tolist(), np.r_[at[1:], len(bucket)].tolist(), strict=False):
        yield int(bucket[low]), packed(*[a[low:high] for a in arrays])


COLUMNS = ["chunk", "bucket", "data", "number"]


def _row(chunk: int, bucket: int, data: bytes, number: int = 0) -> tuple:
    return chunk, bucket, data, number


def each_row(table: DataFrame, work: Callable) -> DataFrame:
    """work(chunk, arrays) gives (bucket, packed arrays[, number]), for each row of a table of one row a chunk; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for chunk, data in zip(rows["chunk"].tolist(), rows["data"], strict=True):
                yield pd.DataFrame([_row(chunk, *x) for x in work(chunk, arrays_of(data))], columns=COLUMNS)

    return table.select("chunk", "data").mapInPandas(run, SCHEMA)


class Piece(NamedTuple):
    """A row of a table, at its chunk."""

    bucket: int
    arrays: list[np.ndarray]
    number: int


def column(pieces: list[Piece], i: int = 0, offsets: dict[int, int] | None = None) -> np.ndarray:
    """The i-th arrays of all pieces, end to end; with offsets, each raised by that of its bucket."""
    return joined([[p.arrays[i] + (offsets[p.bucket] if offsets else 0)] for p in pieces], 0)


def offsets_of(table: DataFrame) -> dict[int, int]:
    """What the numbers of the buckets before add up to, for each bucket: one row a bucket, as are the bounds of a range sort."""
    rows = sorted(table.filter(F.col("bucket") >= 0).groupBy("bucket").agg(F.sum("number")).collect())
    return dict(zip([b for b, _ in rows], np.cumsum([0, *[n for _, n in rows]]).tolist(), strict=False))


def each_chunk(tables: dict[str, DataFrame], work: Callable) -> DataFrame:
    """work(chunk, {name: pieces in the order of buckets}) gives (bucket, packed arrays[, number]), for each chunk."""
    kinds = list(tables)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        chunk = int(rows["chunk"].iat[0])
        rows = rows.sort_values("bucket")
        own = list(zip(rows["kind"], rows["bucket"], rows["data"], rows["number"], strict=True))
        parts = {k: [Piece(int(b), arrays_of(d or b""), int(n)) for j, b, d, n in own if j == i] for i, k in enumerate(kinds)}
        return pd.DataFrame([_row(chunk, *x) for x in work(chunk, parts)], columns=COLUMNS)

    rows = reduce(DataFrame.unionByName, [t.select("chunk", "bucket", "data", "number", F.lit(i).alias("kind")) for i, t in enumerate(tables.values())])
    return rows.groupBy("chunk").applyInPandas(run, SCHEMA)


def _judged(rows: pd.DataFrame, judge: Callable) -> pd.DataFrame:
    rows = rows.sort_values("chunk", ignore_index=True)
    bucket = int(rows["bucket"].iat[0])
    answers, number = judge(bucket, list(rows["data"]))
    return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "data": answers, "number": [number if i == 0 else 0 for i in range(len(rows))]})


def total(table: DataFrame) -> int:
    return table.agg(F.sum("number")).first()[0] or 0


def ask(sent: DataFrame, judge: Callable, ws: Workspace, label: str) -> DataFrame:
    """Answers of judge(bucket, packed rows in the order of chunks), one for each row sent to a bucket, and its number; saved."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _judged(rows, judge)

    got = sent.filter(F.col("bucket") >= 0).groupBy("bucket").applyInPandas(run, SCHEMA)
    return ws.save(got, label)
