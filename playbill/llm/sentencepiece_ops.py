"""SentencePiece encoding to sampled segmentations, and decoding."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .segmentation import Lattices, sample_segmentations

#: Rows segmented together, and bytes of their texts, unless one text is longer.
TOGETHER, TOGETHER_BYTES = 64, 1 << 20


def _together(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where groups of rows begin, and how many rows they have."""
    low = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > low and (i - low == TOGETHER or total + size > TOGETHER_BYTES):
            yield low, i - low
            low, total = i, 0
        total += size
    if low < len(sizes):
        yield low, len(sizes) - low


def _encode(batches: Iterator[pa.RecordBatch], model, k: int, alpha: float, rank_scores: bool, seed: int) -> Iterator[pa.RecordBatch]:
    lat = Lattices(model.value, alpha, rank_scores)
    for batch in batches:
        for low, n in _together(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)):
            part = batch.slice(low, n)
            rows, ids, facts = [], [], []
            texts = [(x or "").encode("utf-8", "replace") for x in part.column(1).to_pylist()]
            keys = [str(x) if s is None else f"{x}:{s}" for x, s in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)]
            drawn = sample_segmentations(lat, texts, keys, k, seed)
            for i, (data, (samples, bound)) in enumerate(zip(texts, drawn, strict=True)):
                for rank, (own, log_prob, perturbed) in enumerate(samples):
                    share = 1.0 if math.isinf(bound) else -math.expm1(-math.exp(min(log_prob - bound, 50.0)))
                    rows.append(i)
                    ids.append(own)
                    facts.append((rank, log_prob, perturbed, share, lat.gives(own, data)))
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)
            cols = list(zip(*facts, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(cols[0], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                    *[pa.array(c, pa.float64()) for c in cols[1:4]],
                    pa.array(cols[4], pa.bool_()),
                ],
                ["_k", "sample", "ids", "log_prob", "perturbed", "inclusion", "round_trip"],
            )


def encode(docs: DataFrame, model_path: str, k: int = 2, alpha: float = 0.5, seed: int = 0, rank_scores: bool = True, key: str = "doc_id", text: str = "text", stream: Column | None = None) -> DataFrame:
    """Up to k distinct segmentations of each whole text, drawn without replacement.

    Columns: key, sample (0: first drawn), ids, log_prob (of the segmentation among all of the text's),
    perturbed (log_prob with its Gumbel number), inclusion (chance to be drawn above the (k+1)th's
    number; 1 where the text has no further segmentation), round_trip (ids decode to the text).
    A segmentation's probability is in proportion to the product of its pieces' probabilities to the power alpha. Draws
    depend on (seed, key, text, and the stream where one is given) alone, bit for bit, so rows in which these are equal get equal samples. Null
    and empty texts have one segmentation, of no pieces. Characters that are no piece become bytes.
    A text's own mark of spaces (U+2581) becomes bytes too, so every text decodes to itself. A text's lattice is kept
    whole in memory, some hundred bytes a character, whatever its length. An empty table gives no rows; other columns are ignored.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # of fixed size, half a MB
    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"), (F.lit(None) if stream is None else stream).cast("string").alias("_s"))
        .mapInArrow(
            partial(_encode, model=model, k=k, alpha=alpha, rank_scores=rank_scores, seed=seed),
            f"_k {kind}, sample int, ids array<int>, log_prob double, perturbed double, inclusion double, round_trip boolean",
        )
        .withColumnRenamed("_k", key)
    )


def _decode(batches: Iterator[pa.RecordBatch], model, position: int, column: str) -> Iterator[pa.RecordBatch]:
    lat = Lattices(model.value, 1.0, True)
    for batch in batches:
        texts = [None if x.as_py() is None else lat.decode(np.asarray(x.as_py(), np.int64)) for x in batch.column(position)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, column])


def decode(df: DataFrame, model_path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """df with one more column (no other may have its name): the text of its ids; null for null, empty for no ids."""
    if column.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the rows have a column {column}; name another one for the text")
    with open(model_path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([*df.schema.fields, T.StructField(column, T.StringType())])
    return df.mapInArrow(partial(_decode, model=model, position=df.columns.index(ids), column=column), schema)


def default_model() -> str:
    """The model that the query takes: 32,000 pieces made by merges, with bytes for what is no piece."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, default_model()).withColumn("n_pieces", F.size("ids"))
