"""Toxicity by multiple-instance learning: sentences are scored, documents carry the labels."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace

#: The model is fitted on at most so many labelled rows, those of least hash of their key.
TRAINING_ROWS = 8_000
#: Numbers (a word's and its beginnings', of every word) of the rows that it is fitted on, about 0.5 GB, and the share of them that one row may have:
#: of a longer text the sentences of least hash take part, up to that many numbers.
TRAINING_NUMBERS, ROW_SHARE = 40_000_000, 64
#: Parts of words are hashed to so many weights, the first of which stays zero; a further one is the bias.
WIDTH = 1 << 20
#: A word counts as itself and by its beginnings of these lengths.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Parts whose words are in fewer training documents (one that has two counts twice) are not learnt.
LEAST_DOCUMENTS = 3
EPOCHS = 150
RATE = 0.1
#: Weight of half the sum of squares beside the mean log loss.
RIDGE = 2e-5
#: Sentences from this score on are reported as offending.
OFFENDING = 0.5
#: Words remembered.
REMEMBERED = 250_000

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


def parts(word: str) -> list[int]:
    """Numbers of a word and its beginnings; 0 where the word is no longer than that."""
    pieces = [word, *(word[:k] + "~" if len(word) > k else "" for k in BEGINNINGS)]
    return [1 + zlib.crc32(x.encode("utf-8", "surrogatepass")) % (WIDTH - 1) if x else 0 for x in pieces]


class Remembered(dict):
    """Values of words by a function, as far as they fit."""

    def __init__(self, value):
        super().__init__()
        self.value = value

    def __missing__(self, word: str):
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = self.value(word)
        return out


def sentences(text: str) -> list[tuple[list[str], tuple[int, int]]]:
    """Lower-case words of each sentence, and where it stands in the text."""
    found = [(WORD.findall(m.group().lower()), m.span()) for m in SENTENCE.finditer(text)]
    return [x for x in found if x[0]]


def _part(own: list, most: int) -> list:
    """All sentences, or of those of a text that has too many words the ones of least hash, in their order, of which the words are fewer than `most` beside the first's."""
    if sum(len(words) for words, _ in own) <= most:
        return own
    order = sorted(range(len(own)), key=lambda i: (zlib.crc32(" ".join(own[i][0]).encode("utf-8", "surrogatepass")), i))
    upto = np.cumsum([min(len(own[i][0]), most) for i in order])
    return [(own[i][0][:most], own[i][1]) for i in sorted(order[: max(int(np.searchsorted(upto, most, "right")), 1)])]


#: Words of the texts that are handed on together.
WORDS_TOGETHER = 1 << 20


def _bags(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """All words of each text, sentence by sentence, for training, and the numbers of its distinct words; of a text of more than `most` words those of some sentences."""
    known = Remembered(parts)
    for batch in batches:
        low, words, table, counts, total = 0, [], [], [], 0
        for at, text in enumerate(batch.column(1), 1):
            own = _part(sentences(text.as_py() or ""), most)
            numbers = np.array([known[w] for words_, _ in own for w in words_], np.int32).reshape(-1, 1 + len(BEGINNINGS))
            words.append(numbers[:, 0].copy())
            table.append(numbers[np.unique(words[-1], return_index=True)[1]].ravel())
            counts.append([len(words_) for words_, _ in own])
            total += len(words[-1])
            if total >= WORDS_TOGETHER or at == batch.num_rows:
                lists = [pa.array(x, pa.list_(pa.int32())) for x in (words, table, counts)]
                yield pa.RecordBatch.from_arrays([*lists, batch.column(2).slice(low, at - low)], ["words", "parts", "counts", "label"])
                low, words, table, counts, total = at, [], [], [], 0


def fit_noisy_or(numbers: np.ndarray, sentence: np.ndarray, document: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights and bias (last) under which 1 - prod(1 - p) over a document's sentences fits labels.

    numbers: a row of part numbers for each word; sentence: the sentence each word is in; document:
    the document of each sentence. p is the logistic function of the bias plus the sum of the
    weights of a sentence's words. Adam on the mean log loss and a ridge.
    """
    _, first, word = np.unique(numbers[:, 0], return_index=True, return_inverse=True)
    table = numbers[first]
    pairs = np.unique(document[sentence] * len(first) + word) % max(len(first), 1)
    return _descend(table, word, np.bincount(pairs, minlength=len(first)), sentence, document, labels)


def _descend(table: np.ndarray, word: np.ndarray, found: np.ndarray, sentence: np.ndarray, document: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """As `fit_noisy_or`, of distinct words' part numbers (table), how many documents have each (found) and the word at each place."""
    n_docs, n_sent = len(labels), len(document)
    enough = np.bincount(table.ravel(), np.repeat(found, table.shape[1]), WIDTH) >= LEAST_DOCUMENTS
    enough[0] = False
    used, compact = np.unique(np.where(enough[table], table, 0), return_inverse=True)
    compact = compact.reshape(table.shape)
    learnt = used != 0
    w, bias = np.zeros(len(used)), -5.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    positive = labels == 1
    for t in range(1, EPOCHS + 1):
        s = np.bincount(sentence, w[compact].sum(axis=1)[word], n_sent) + bias
        p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        clean = np.bincount(document, -np.logaddexp(0, s), n_docs)  # log of the chance that none offends
        toxic = np.maximum(-np.expm1(clean), 1e-9)
        slope = np.where(positive, -np.exp(clean) / toxic, 1.0)[document] * p / n_docs
        by_word = np.bincount(word, slope[sentence], len(table))
        g = np.bincount(compact.ravel(), np.repeat(by_word, table.shape[1]), len(used)) * learnt + RIDGE * w
        gb = slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        w -= RATE * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= RATE * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    out = np.zeros(WIDTH + 1, np.float32)
    out[used], out[-1] = w * learnt, bias
    return out


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows. The numbers of a word are held once, as its first row has them, so that a place takes 4 bytes here and some 40 in the fit."""
    width = 1 + len(BEGINNINGS)
    table, earliest, found = np.zeros((WIDTH, width), np.int32), np.full(WIDTH, np.iinfo(np.int64).max), np.zeros(WIDTH, np.int64)
    rows = []
    for batch in batches:
        for words, own, counts, label, i in zip(*(batch.column(c) for c in ("words", "parts", "counts")), *(batch.column(c).to_pylist() for c in ("label", "i")), strict=True):
            own = np.array(own.values, np.int32).reshape(-1, width)
            found[own[:, 0]] += 1
            own = own[i < earliest[own[:, 0]]]
            earliest[own[:, 0]], table[own[:, 0]] = i, own
            rows.append((i, np.array(words.values, np.int32), np.array(counts.values, np.int64), label))
        del batch, words, own, counts
    rows.sort(key=lambda r: r[0])
    words = np.concatenate([np.zeros(0, np.int32), *(r[1] for r in rows)])
    if not len(words):
        yield pa.RecordBatch.from_arrays([pa.array([_blank()], pa.binary())], ["weights"])
        return
    counts = np.concatenate([r[2] for r in rows])
    document, labels = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows]), np.array([r[3] for r in rows])
    del rows, earliest
    known = np.flatnonzero(found)
    table, place = table[known], np.zeros(WIDTH, np.int64)
    place[known] = np.arange(len(known))
    weights = _descend(table, place[words], found[known], np.repeat(np.arange(len(counts), dtype=np.int32), counts), document, labels)
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])


def _blank() -> bytes:
    weights = np.zeros(WIDTH + 1, np.float32)
    weights[-1] = -30.0
    return weights.tobytes()


def fitting(sizes: list[int], most: int) -> list[int]:
    """Places of the rows that are taken, in order: each that still fits beside those taken before."""
    out, total = [], 0
    for i, size in enumerate(sizes):
        if total + size <= most:
            out.append(i)
            total += size
    return out


def train_toxicity(
    docs: DataFrame, labels: DataFrame, ws: Workspace, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAINING_ROWS, numbers: int = TRAINING_NUMBERS
) -> bytes:
    """The model: WIDTH + 1 float32 (4 MB). Fitted in one task on a bounded sample: at most `rows` labelled rows in the order of their keys' hash, of at most
    `numbers` numbers in all (some 12 bytes each). A row that would go beyond that is left out and the next ones are tried; of a text
    that alone has more than a ROW_SHARE-th of them, some sentences take part, so that no text keeps others out."""
    width = 1 + len(BEGINNINGS)
    known = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("label")).dropna().dropDuplicates(["_k"])
    chosen = known.orderBy(F.xxhash64("_k"), "_k").limit(rows)
    bags = (
        docs.select(F.col(key).alias("_k"), F.col(text).alias("text"))
        .join(F.broadcast(ws.save(chosen, "chosen")), "_k")  # at most `rows` pairs of numbers
        .select(F.xxhash64("_k").alias("k"), "text", F.struct("label", F.xxhash64("_k").alias("k")).alias("label"))
        .mapInArrow(partial(_bags, most=max(numbers // ROW_SHARE // width, 1)), "words array<int>, parts array<int>, counts array<int>, label struct<label:int,k:long>")
        .select("words", "parts", "counts", "label.label", "label.k", F.xxhash64("words", "parts", "counts").alias("h"))
    )
    # Repeated rows may not lift the bound, nor long texts that of what the one task holds.
    bags = ws.save(bags, "bags").withColumn("i", F.row_number().over(W.orderBy("k", "h"))).filter(F.col("i") <= rows)
    bags = ws.save(bags, "ordered")
    sizes = [n for _, n in sorted((r[0], r[1]) for r in bags.select("i", F.size("words") * width).collect())]  # at most `rows` pairs of numbers
    taken = fitting(sizes, numbers)
    if len(taken) < len(sizes):
        bags = bags.join(F.broadcast(docs.sparkSession.createDataFrame([(i + 1,) for i in taken], "i int")), "i")
    fitted = bags.select("words", "parts", "counts", "label", "i").coalesce(1).mapInArrow(_fit, "weights binary").first()
    return _blank() if fitted is None else bytes(fitted[0])


def score_text(text: str, values: Remembered, bias: float) -> tuple[float, np.ndarray, list[tuple[int, int]]]:
    """The document's score, and the scores and places of its sentences."""
    own = sentences(text)
    if not own:
        return 0.0, np.zeros(0), []
    s = np.array([sum(map(values.__getitem__, words)) for words, _ in own]) + bias
    return float(-np.expm1(-np.logaddexp(0, s).sum())), 1 / (1 + np.exp(-np.clip(s, -30, 30))), [span for _, span in own]


def _scores(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    weights = np.frombuffer(model.value, np.float32)
    values, bias = Remembered(lambda word: float(weights[parts(word)].sum(dtype=np.float64))), float(weights[-1])
    place = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    for batch in batches:
        scores, counts, found = [], [], []
        for text in batch.column(1):
            score, each, spans = score_text(text.as_py() or "", values, bias)
            scores.append(score)
            counts.append(len(spans))
            found.append([{"start": spans[i][0], "end": spans[i][1], "score": float(each[i])} for i in np.flatnonzero(each >= OFFENDING)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int32()), pa.array(found, pa.list_(place))], ["_k", "score", "n_sentences", "offending"]
        )


def score_toxicity(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row for each input row: key, score, predicted, n_sentences, offending (start, end, score).

    Sentences (runs without . ! ? or line end that hold a word) have the logistic score of their words'
    weights; the document's is the noisy-or of them. Weights are learnt from document labels alone.
    offending lists the sentences of score OFFENDING or more by their places in the text, in
    characters. Null and empty texts score 0; without labels all texts score about 0; repeated rows
    score alike; an empty table gives no rows; other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "toxicity")
    weights = train_toxicity(docs if train_docs is None else train_docs, labels, ws, key, text, label)
    model = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInArrow(
        partial(_scores, model=model), f"_k {kind}, score double, n_sentences int, offending array<struct<start:int,end:int,score:double>>"
    )
    return scored.select(F.col("_k").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "offending")


def _clean(batches: Iterator[pa.RecordBatch], model, position: int) -> Iterator[pa.RecordBatch]:
    weights = np.frombuffer(model.value, np.float32)
    values, bias = Remembered(lambda word: float(weights[parts(word)].sum(dtype=np.float64))), float(weights[-1])
    for batch in batches:
        keep = [score_text(t.as_py() or "", values, bias)[0] < 0.5 for t in batch.column(position)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of docs, all columns, with a score under 0.5; rows stay where they are.

    Null and empty texts score 0 and stay, as does all where there are no labels; repeated rows stay or go alike; a text of any
    length is scored whole, sentence by sentence; an empty table gives no rows; columns of any names come back as they are.
    """
    weights = train_toxicity(docs, labels, Workspace(docs.sparkSession, "toxicity"), key, text, label)
    model = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.mapInArrow(partial(_clean, model=model, position=docs.columns.index(text)), docs.schema)


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the key as text divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id")))
    return score_toxicity(docs, labels).withColumn("held_out", held_out(F.col("doc_id")))
