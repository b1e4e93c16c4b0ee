"""Words that are spelling variants of commoner ones: one-edit neighbourhoods over a reduced alphabet, verified on the words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import mix
from .common import Workspace, shuffled

#: Letters of words: A-Z, a-z and U+00C0 to U+00FF, each a byte of Latin-1. A-Z become a-z, all else a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Words that a task counts before it hands the counts on.
HELD = 200_000
#: Fewest and most symbols of the reduced alphabet, and neighbours made at once.
SYMBOLS, NEIGHBOURS = (4, 32), 1 << 19
#: Base of the hashes of reduced words. They overflow for long words, which adds candidates and loses none.
BASE = np.uint64(0x9E3779B97F4A7C15)


def _count(batches: Iterator[pa.RecordBatch], least: int, slip: int) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = (text.as_py() or "").encode("latin-1", "replace").translate(LETTERS).split()
            own = Counter([w for w in words if len(w) >= least])
            if slip and key is not None:
                seed = crc32(f"{key}:".encode())
                slips = [w for w in own if crc32(w if w.isascii() else w.decode("latin-1").encode(), seed) % slip == 0]
                for w in slips:
                    i = crc32(w if w.isascii() else w.decode("latin-1").encode(), seed) % len(w)
                    n, short = own.pop(w), w[:i] + w[i + 1 :]
                    if len(short) >= least:
                        held[short] += n
            held.update(own)
            if len(held) > HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 6, slip: int = 0) -> DataFrame:
    """word, n: how often each word of least_length letters or more occurs in all whole texts.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. With `slip`, one (key, word) in so many, by their checksum,
    loses the letter that the checksum says; rows without a key lose none. Counts are summed in each task before they are shuffled, so a common word is
    no hot key. Null and empty texts have no words; repeated rows count each time; a text is one value, of any length; an empty table gives no rows; other columns,
    whatever their names, are ignored.
    """
    rows = docs.select(F.col(key).cast("string").alias("_k"), F.col(text).cast("string").alias("_t"))
    return rows.mapInArrow(partial(_count, least=least_length, slip=slip), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _symbols(words: list[str], symbols: int) -> np.ndarray:
    """Words of one length as rows of symbols, 1 to `symbols`."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64).reshape(len(words), -1)
    return mix(points.ravel()).reshape(points.shape) % np.uint64(symbols) + np.uint64(1)


def _prefixes(s: np.ndarray) -> list[np.ndarray]:
    out = [np.ones(len(s), np.uint64)]
    for i in range(s.shape[1]):
        out.append(out[-1] * BASE + s[:, i])
    return out


def _neighbourhoods(s: np.ndarray, symbols: int) -> np.ndarray:
    """A row for each reduced word: hashes of itself and of all that one deleted, replaced or inserted symbol makes of it."""
    length = s.shape[1]
    with np.errstate(over="ignore"):
        power = [np.uint64(1)]
        for _ in range(length + 1):
            power.append(power[-1] * BASE)
        before, behind = _prefixes(s), [np.zeros(len(s), np.uint64)]
        for i in reversed(range(length)):
            behind.append(behind[-1] + s[:, i] * power[length - 1 - i])
        behind = behind[::-1]  # of the symbols from i on
        out = [before[-1]]
        for i in range(length + 1):
            if i < length:
                out.append(before[i] * power[length - 1 - i] + behind[i + 1])
            for c in range(1, symbols + 1):
                put = before[i] * BASE + np.uint64(c)
                out.append(put * power[length - i] + behind[i])
                if i < length:
                    out.append(put * power[length - 1 - i] + behind[i + 1])
    return np.stack(out, axis=1)


def _by_length(batch: pa.RecordBatch, symbols: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batch with words of one length each, and their symbols, a bounded number of neighbours at a time."""
    sizes = pc.utf8_length(batch.column(0)).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        step = max(NEIGHBOURS // ((2 * size + 1) * (symbols + 1)), 1)
        for low in range(0, len(at), step):
            part = batch.take(pa.array(at[low : low + step]))
            yield part, _symbols(part.column(0).to_pylist(), symbols) if size else np.zeros((part.num_rows, 0), np.uint64)


def _reduced(batches: Iterator[pa.RecordBatch], symbols: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, s in _by_length(batch, symbols):
            yield pa.RecordBatch.from_arrays([pa.array(_prefixes(s)[-1].view(np.int64)), *part.columns], ["key", "near", "near_n"])


def _probes(batches: Iterator[pa.RecordBatch], symbols: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, s in _by_length(batch, symbols):
            keys = np.sort(_neighbourhoods(s, symbols), axis=1)
            new = np.ones(keys.shape, bool)
            new[:, 1:] = keys[:, 1:] != keys[:, :-1]
            owner = np.repeat(np.arange(part.num_rows), new.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), part.column(0).take(pa.array(owner))], ["key", "word"])


def alphabet_size(words: int, least_length: int) -> int:
    """Symbols with which the shortest words have about as many reduced forms as there are words."""
    return min(max(math.ceil(max(words, 1) ** (1 / max(least_length, 1))), SYMBOLS[0]), SYMBOLS[1])


def near_words(words: DataFrame, symbols: int) -> DataFrame:
    """word, near, near_n: of words (word, n, each word once) all pairs, both ways round, that one inserted, deleted or replaced code point sets apart.

    Letters are hashed to `symbols` symbols. Two words at one edit have reduced forms at one edit or none, so each
    word's whole neighbourhood of reduced forms is joined with the reduced vocabulary, which meets each such pair once, and the words themselves are compared.
    """
    reduced = words.select("word", "n").mapInArrow(partial(_reduced, symbols=symbols), "key long, near string, near_n long")
    probes = words.select("word").mapInArrow(partial(_probes, symbols=symbols), "key long, word string")
    met = probes.join(shuffled(reduced), "key").filter(F.col("word") != F.col("near"))
    return met.filter(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def _roots(forms: DataFrame, ws: Workspace) -> DataFrame:
    """word, root: where following forms ends, by going twice as far each time; counts grow on the way, so there are no rings."""
    now, step = forms.select("word", F.col("form").alias("root")), 0
    while True:
        further = now.join(shuffled(now.select(F.col("word").alias("root"), F.col("root").alias("next"))), "root", "left")
        now = ws.save(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots{step}")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now, step = now.select("word", "root"), step + 1


def spelling_variants(counts: DataFrame, least_count: int = 5, least_length: int = 6, ratio: int = 5) -> DataFrame:
    """From (word, n), each word once: word, form, root, n, n_near, form_n of words of at least least_count occurrences and least_length letters.

    n_near counts the words one edit away; form is that of them with the greatest n (ties: the first in code-point order), if it occurs `ratio` times
    as often as the word or more, form_n its n; root is where following forms ends, the word itself without a form. The neighbours of a word are counted and compared by
    partial aggregates, never listed. Null words are ignored; repeated words are summed; no words give no rows; other columns are ignored. `ratio` must be over 1.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1, or forms could go round in rings")
    ws = Workspace(counts.sparkSession, "spelling")
    words = counts.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)
    words = ws.save(words, "words")
    near = near_words(words, alphabet_size(words.count(), least_length))
    near = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("b"))
    taken = -F.col("b.m") >= ratio * F.col("n")
    judged = words.join(shuffled(near), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("b.w")).alias("form"), F.when(taken, -F.col("b.m")).alias("form_n")
    )
    judged = ws.save(judged, "judged")
    roots = _roots(judged.filter("form is not null"), ws)
    return judged.join(shuffled(roots), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), slip=199))


_UPPER, _LOWER = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
_HIGH = "".join(map(chr, range(0xC0, 0x100)))
#: As many single bytes that no word has, for a distance that counts bytes.
_BYTES = "".join(chr(i) for i in range(1, 97) if i not in (34, 39, 92))[: len(_HIGH)]

OP11_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS n FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n + 1 FROM bits WHERE n < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE n = 8
), runs AS (
  SELECT doc_id, translate(run, '{_UPPER}', '{_LOWER}') AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL
), hexed AS (
  SELECT run, c, hex(encode(doc_id || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda s, b: xor(s // 256, t[xor(s % 256, b) + 1]))) AS h
  FROM hexed, crc
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(c)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(c) >= 5
), plain AS (
  SELECT word, n, translate(word, '{_HIGH}', '{"".join(_BYTES)}') AS b FROM words
), keyed AS (
  SELECT word, n, b, unnest(list_append(list_transform(range(length(b)), lambda i: left(b, i::INT) || substr(b, i::INT + 2)), b)) AS k FROM plain
), near AS (
  SELECT DISTINCT x.word, y.word AS other, y.n FROM keyed x JOIN keyed y USING (k) WHERE x.word <> y.word AND levenshtein(x.b, y.b) = 1
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-n, encode(other))) AS form, max(n) AS form_n FROM near GROUP BY word
), forms AS (
  SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), follow AS (
  SELECT word, form AS root, 1 AS step FROM forms WHERE form IS NOT NULL
  UNION ALL
  SELECT follow.word, f.form, step + 1 FROM follow JOIN forms f ON f.word = follow.root WHERE f.form IS NOT NULL
), roots AS (
  SELECT word, arg_max(root, step) AS root FROM follow GROUP BY word
)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN roots USING (word)
"""
