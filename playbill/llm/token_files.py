"""Token ids in binary files of directly addressable codes: encoding, writing, and reading from any token on."""

from __future__ import annotations

import os
import re
import sys
import types
from collections.abc import Iterator
from functools import partial
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_HASHES, Workspace, attach

#: Ids of a file, unless one document has more, and bytes of text that are encoded together.
FILE_IDS, TOGETHER_BYTES = 1 << 22, 1 << 20
#: Places of a bitmap between two entries of its rank directory.
BLOCK = 512
#: What files begin with.
MAGIC = b"DACIDS01"
#: Bytes of pieces beyond which an encoder forgets the rarer ones.
REMEMBERED = 4 << 20


class Codes:
    """A sequence of ids below 2**32, cut into bytes, lowest first.

    Level 0 has the lowest byte of each id, level 1 the second byte of those that have one, and so on. A level's
    bitmap says which of its entries go on, a directory how many did before each block of the bitmap: the rank of an entry is its place in the next
    level. So an id, or any stretch of ids, is read from a few bytes of each level, and nothing before it is decoded.
    """

    def __init__(self, data: memoryview):
        self.n, levels = (int(x) for x in np.frombuffer(data, "<u8", 2))
        self.chunks, self.bits, self.ranks = [], [], []
        at, n = 16, self.n
        for level in range(levels):
            self.chunks.append(np.frombuffer(data, np.uint8, n, at))
            at += n
            if level == levels - 1:
                break
            self.bits.append(np.frombuffer(data, np.uint8, -(-n // 8), at))
            at += len(self.bits[-1])
            self.ranks.append(np.frombuffer(data, "<u8", n // BLOCK + 1, at))
            at += 8 * len(self.ranks[-1])
            n = self._rank(level, n)
        self.size = at

    @staticmethod
    def pack(ids: np.ndarray) -> bytes:
        rest = ids.astype(np.uint32)
        levels = max((int(rest.max()).bit_length() + 7) // 8, 1) if len(rest) else 1
        out = [np.array([len(rest), levels], "<u8").tobytes()]
        for level in range(levels):
            out.append((rest & np.uint32(255)).astype(np.uint8).tobytes())
            if level == levels - 1:
                break
            rest >>= np.uint32(8)
            more = rest > 0
            counts = np.bincount(np.flatnonzero(more) // BLOCK + 1, minlength=len(more) // BLOCK + 2)[: len(more) // BLOCK + 1]
            out += [np.packbits(more, bitorder="little").tobytes(), np.cumsum(counts).astype("<u8").tobytes()]
            rest = rest[more]
        return b"".join(out)

    def _rank(self, level: int, i: int) -> int:
        """How many of the first i entries of a level go on."""
        block, bits = i // BLOCK, self.bits[level]
        low, high = block * (BLOCK // 8), i // 8
        n = int(self.ranks[level][block]) + int.from_bytes(bits[low:high].tobytes(), "little").bit_count()
        return n + (int(bits[high]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level, chunk in enumerate(self.chunks):
            out |= int(chunk[i]) << 8 * level
            if level == len(self.bits) or not self.bits[level][i // 8] >> i % 8 & 1:
                return out
            i = self._rank(level, i)
        return out

    def stretch(self, low: int, high: int) -> np.ndarray:
        """The ids from low up to high."""
        out = self.chunks[0][low:high].astype("<u4")
        where = None
        for level, bits in enumerate(self.bits):
            more = np.flatnonzero(np.unpackbits(bits[low // 8 : -(-high // 8)], bitorder="little")[low % 8 : low % 8 + high - low])
            if not len(more):
                break
            where = more if where is None else where[more]
            low = self._rank(level, low)
            high = low + len(more)
            out[where] |= self.chunks[level + 1][low:high].astype(np.uint32) << np.uint32(8 * (level + 1))
        return out


class TokenFile:
    """One file: which part of the order and which file of it, its documents' keys, where each one's ids end, and the codes of all ids."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a file of token ids")
        self.part, self.number, n = (int(x) for x in np.frombuffer(view, "<u8", 3, 8))
        self.keys = np.frombuffer(view, "<i8", n, 32)
        self.ends = np.frombuffer(view, "<u8", n, 32 + 8 * n).astype(np.int64)
        self.null = np.frombuffer(view, np.uint8, n, 32 + 16 * n).astype(bool)
        self.ids = Codes(view[32 + 17 * n :])

    @staticmethod
    def pack(part: int, number: int, keys: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
        null = np.array([k is None for k in keys], np.uint8)
        head = [MAGIC, np.array([part, number, len(keys)], "<u8"), np.array([k or 0 for k in keys], "<i8"), np.cumsum(counts).astype("<u8"), null]
        return b"".join([x if isinstance(x, bytes) else x.tobytes() for x in head] + [Codes.pack(ids)])

    def document(self, i: int) -> np.ndarray:
        return self.ids.stretch(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


class _Numbers(dict):
    """Numbers of pieces in the order in which they are first asked for."""

    def __missing__(self, piece: bytes) -> int:
        self[piece] = n = len(self)
        return n


class Encoder:
    """Ids of whole texts by a byte-level tokenizer that cuts texts at white space before it merges.

    Such a tokenizer never lets a token reach from a character that is no white space into white space behind it, and looks at nothing before
    a token; nor from an ASCII letter into punctuation behind it. So a text's ids are those of its pieces (white space, then other characters, cut before such punctuation), one after another. Each distinct piece is encoded
    once as long as it is remembered; where too many are, the half that was met most often stays. Pieces are told apart by hashes and then by
    their bytes. Texts with white space beyond ASCII or a special token's name are cut one by one, at white space alone; those with separators U+001C to U+001F, on which notions of white space differ, are not cut.
    """

    PIECES, JOINED = re.compile(r"\s*\S+|\s+"), 1000
    RARE, UNSURE = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", re.compile("[\x1c-\x1f]")
    SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
    LETTER, MARK = (np.array([chr(i).isascii() and test(chr(i)) for i in range(256)]) for test in (str.isalpha, lambda c: c.isprintable() and not c.isalnum() and c != " "))

    def __init__(self, tokenizer: str):
        # A task has one core; threads of the library's own would each keep memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer)
        self.rare = re.compile("|".join([self.RARE, *(re.escape(x.content) for x in self.library.get_added_tokens_decoder().values())]))
        vocabulary = self.library.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = [len(x) for x in vocabulary]  # a character stands for a byte
        self.number, self.held = _Numbers(), 0
        self.flat, self.ends, self.met = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _forget(self) -> None:
        """Keeps those pieces that were met most often, up to half of what may be remembered."""
        pieces, sizes = list(self.number), np.diff(self.ends[: len(self.number)], prepend=0)
        order = np.argsort(-self.met[: len(pieces)], kind="stable")
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))[order]
        stay = np.sort(order[np.cumsum(lengths) <= REMEMBERED // 2])
        begins = self.ends[stay] - sizes[stay]
        stops = np.cumsum(sizes[stay])
        self.flat[: stops[-1] if len(stops) else 0] = self.flat[np.repeat(begins - (stops - sizes[stay]), sizes[stay]) + np.arange(stops[-1] if len(stops) else 0)]
        self.ends[: len(stay)], self.met[: len(stay)] = stops, self.met[stay]
        self.number = _Numbers((pieces[i], n) for n, i in enumerate(stay.tolist()))
        self.held = sum(map(len, self.number))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, and how many each has: pieces that begin with white space and end without are joined, which takes half the time, and told
        apart by their bytes."""
        fits = np.array([p[0].isspace() and not p[-1].isspace() and not self.UNSURE.search(p) for p in pieces], bool)
        alone = self._ids([p for p, f in zip(pieces, fits, strict=True) if not f])
        joined = [p for p, f in zip(pieces, fits, strict=True) if f]
        own = self._ids(["".join(joined[i : i + self.JOINED]) for i in range(0, len(joined), self.JOINED)])
        ids = np.fromiter(chain.from_iterable(own), np.uint32, sum(map(len, own)))
        stops, cuts = np.cumsum(self.sizes[ids]), np.cumsum([len(p.encode()) for p in joined], dtype=np.int64)
        last = np.searchsorted(stops, cuts)
        if len(cuts) and not np.array_equal(stops[np.minimum(last, len(stops) - 1)], cuts):
            raise ValueError("this tokenizer merges over white space")
        counts = np.zeros(len(pieces), np.int64)
        counts[fits], counts[~fits] = np.diff(last, prepend=-1), [len(x) for x in alone]
        out, owner = np.empty(int(counts.sum()), np.uint32), np.repeat(fits, counts)
        out[owner], out[~owner] = ids, np.fromiter(chain.from_iterable(alone), np.uint32)
        return out, counts

    def _learn(self, known: int) -> None:
        """Encodes the pieces that have numbers from `known` on."""
        pieces = list(islice(reversed(self.number), len(self.number) - known))[::-1]
        begin = int(self.ends[known - 1]) if known else 0
        ids, counts = self._of_pieces([p.decode() for p in pieces])
        while len(self.flat) < begin + len(ids):
            self.flat = np.r_[self.flat, np.zeros(len(self.flat), np.uint32)]
        while len(self.ends) < len(self.number):
            self.ends, self.met = np.r_[self.ends, np.zeros(len(self.ends), np.int64)], np.r_[self.met, np.zeros(len(self.met), np.int64)]
        self.flat[begin : begin + len(ids)] = ids
        self.ends[known : len(self.number)] = begin + np.cumsum(counts)
        self.met[known : len(self.number)] = 0
        self.held += sum(map(len, pieces))

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """Numbers of the pieces of texts, cut one by one, and how many each text has."""
        own = [[t] if self.UNSURE.search(t) else self.PIECES.findall(t) for t in texts]
        return np.fromiter((self.number[p.encode()] for pieces in own for p in pieces), np.int64, sum(map(len, own))), list(map(len, own))

    def _cut_together(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """The same for texts with white space of ASCII only."""
        each = [t.encode() for t in texts]
        data, sizes = b"".join(each), np.array([len(x) for x in each], np.int64)
        if not data:
            return np.zeros(0, np.int64), [0] * len(texts)
        b = np.frombuffer(data, np.uint8)
        space = self.SPACE[b]
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[1:] |= self.LETTER[b[:-1]] & self.MARK[b[1:]]
        start[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        first = np.flatnonzero(start)
        length = np.diff(first, append=len(b))
        inside = np.arange(len(b)) - np.repeat(first, length)
        power = np.cumprod(np.full(int(length.max()), 0x9E3779B97F4A7C15, np.uint64))
        hashes = np.add.reduceat((b + np.uint64(1)) * power[inside], first)
        _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        if not (np.array_equal(length[one][which], length) and np.array_equal(b[np.repeat(first[one][which], length) + inside], b)):
            return self._cut(texts)
        numbers = np.fromiter((self.number[data[a : a + n]] for a, n in zip(first[one].tolist(), length[one].tolist(), strict=True)), np.int64, len(one))
        return numbers[which], np.diff(np.searchsorted(first, np.cumsum(sizes)), prepend=0).tolist()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        if self.held > REMEMBERED:
            self._forget()
        known, parts, counts = len(self.number), [np.zeros(0, np.int64)], []
        for rare, some in groupby(texts, lambda t: bool(self.rare.search(t))):
            used, n = self._cut(list(some)) if rare else self._cut_together(list(some))
            parts.append(used)
            counts += n
        used = np.concatenate(parts)
        if len(self.number) > known:
            self._learn(known)
        self.met[: len(self.number)] += np.bincount(used, minlength=len(self.number))
        begins = np.r_[0, self.ends[: len(self.number)]]
        sizes = begins[used + 1] - begins[used]
        stops = np.cumsum(sizes)
        out = self.flat[np.repeat(begins[used] - (stops - sizes), sizes) + np.arange(int(stops[-1]) if len(stops) else 0)]
        upto = np.r_[0, stops][np.cumsum([0, *counts])]
        return out, np.diff(upto)


def _encoder(tokenizer: str) -> Encoder:
    """The encoder that this process made for an earlier task, or a new one: what it remembers serves the next tasks too."""
    made = sys.modules.setdefault("_token_file_encoders", types.ModuleType("_token_file_encoders")).__dict__
    if made.get("tokenizer") != tokenizer:
        made.update(tokenizer=tokenizer, encoder=Encoder(tokenizer))
    return made["encoder"]


def _together(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    out, size = [], 0
    for key, text in rows:
        if out and size + len(text) > TOGETHER_BYTES:
            yield out
            out, size = [], 0
        out.append((key, text))
        size += len(text)
    if out:
        yield out


def _write(batches: Iterator[pa.RecordBatch], tokenizer, end_id: int, file_ids: int) -> Iterator[pa.RecordBatch]:
    encoder, part, number = _encoder(tokenizer.value), TaskContext.get().partitionId(), 0
    keys, counts, held, total = [], [], [], 0

    def packed():
        return pa.RecordBatch.from_arrays([pa.array([TokenFile.pack(part, number, keys, counts, np.concatenate(held))], pa.binary())], ["data"])

    parts = (batch.slice(low, 256) for batch in batches for low in range(0, batch.num_rows, 256))
    rows = ((k, t or "") for x in parts for k, t in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True))
    for some in _together(rows):
        ids, sizes = encoder.encode([t for _, t in some])
        ends = np.cumsum(sizes)
        for (key, _), low, high in zip(some, (ends - sizes).tolist(), ends.tolist(), strict=True):
            if keys and total + high - low + 1 > file_ids:
                yield packed()
                keys, counts, held, total, number = [], [], [], 0, number + 1
            keys.append(key)
            counts.append(high - low + 1)
            held += [ids[low:high], np.array([end_id], np.uint32)]
            total += high - low + 1
    if keys:
        yield packed()


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 0, file_ids: int = FILE_IDS) -> None:
    """Writes the ids of all whole texts, each followed by end_id, in ascending order of the (integer) key, to {path}/ids; {path}/index lists the files.

    Each file (see TokenFile; Spark's writer ends it with a newline) holds whole documents, of up to file_ids ids in all unless one document has more,
    as directly addressable codes, with their keys and ends. The index has each file's part and number in the order, its first id's place among
    all, and its numbers of ids and documents. Null texts are empty ones, so their end_id alone; null keys come before all others;
    rows of equal keys are ordered by their texts, and repeated rows, in no order that shows, each get a place. An empty table gives an empty index.
    Other columns, whatever their names, are ignored. Texts are shuffled once, by ranges of (key, hash of the text, part of the input), so that a hot
    key is spread; each is encoded whole, in memory. Files appear by Spark's commit, so lost executors leave none behind.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())  # of fixed size, under 2 MB
    rows = docs.select(F.col(key).cast("long").alias("_k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    rows = rows.withColumn("_h", F.xxhash64("_t")).withColumn("_p", F.spark_partition_id())
    dealt = rows.repartitionByRange("_k", "_h", "_p").sortWithinPartitions("_k", "_h", "_t").select("_k", "_t")
    files = dealt.mapInArrow(partial(_write, tokenizer=tokenizer, end_id=end_id, file_ids=file_ids), "data binary")
    # As text, which Spark writes byte for byte, a row to a file.
    files.select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(f"{path}/ids")
    found = _files(spark, path).mapInArrow(_heads, "file long, part long, number long, n_ids long, n_docs long")
    found.write.parquet(f"{path}/index_parts")
    found = spark.read.schema(found.schema).parquet(f"{path}/index_parts")
    parts = found.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    # One row for each partition of the shuffle, a number that is set and does not grow with the documents.
    parts = parts.select("part", F.coalesce(F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    inside = W.partitionBy("part").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    index = found.withColumn("_before", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    index.select("file", "part", "number", (F.col("_first") + F.col("_before")).alias("first_id"), "n_ids", "n_docs").write.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(f"{path}/ids").select("content")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[TokenFile]:
    for batch in batches:
        for x in batch.column(0):
            if len(x.as_buffer()) > 8:  # not the empty file that Spark writes for an empty table
                yield TokenFile(x.as_buffer())


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in _opened(batches):
        row = {"file": x.part << 32 | x.number, "part": x.part, "number": x.number, "n_ids": len(x.ids), "n_docs": len(x.keys)}
        yield pa.RecordBatch.from_pylist([row])


def _documents(batches: Iterator[pa.RecordBatch], some: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    for x in _opened(batches):
        low = 0
        while low < len(x.keys):
            begin = int(x.ends[low - 1]) if low else 0
            high = max(int(np.searchsorted(x.ends, begin + some, "right")), low + 1)
            begins = np.r_[begin, x.ends[low : high - 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(high - low, x.part << 32 | x.number)),
                    pa.array(x.keys[low:high], mask=x.null[low:high]),
                    pa.array(begins),
                    pa.array(x.ends[low:high] - begins),
                    pa.array([x.document(i).tobytes() for i in range(low, high)], pa.binary()),
                ],
                ["file", "_k", "begin", "n_tokens", "ids"],
            )
            low = high


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """From files of `write_tokens`, one row for each document: file, key, begin (its first id's place in the file), n_tokens, ids (unsigned
    32-bit little-endian numbers), read document by document through the files' directories. `starts` adds the place among all ids."""
    return _files(spark, path).mapInArrow(_documents, "file long, _k long, begin long, n_tokens long, ids binary").withColumnRenamed("_k", key)


def starts(rows: DataFrame, path: str) -> DataFrame:
    """Rows of `read_tokens` with start, their first id's place among all files' ids, in place of file and begin."""
    index = rows.sparkSession.read.parquet(f"{path}/index").select("file", "first_id")
    out = attach(rows, index, "file", F.col("begin"), "inner", BROADCAST_HASHES)
    return out.withColumn("start", F.col("first_id") + F.col("begin")).drop("file", "first_id", "begin")


def default_tokenizer() -> str:
    """The tokenizer that the query takes: 50,257 byte-level ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_token_files(spark, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "token_files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), ws.root, default_tokenizer())
    rows = read_tokens(spark, ws.root).withColumn("ids_crc32", F.crc32("ids").cast("long")).drop("ids")
    return starts(rows, ws.root).select("doc_id", "start", "n_tokens", "ids_crc32")
