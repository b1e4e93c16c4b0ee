"""Weighted rendezvous hashing of record keys over shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, unit_hash

#: Digits of the key's md5 that number rows inside a shard: 16 ** 3 groups a shard.
GROUP_DIGITS = 3
#: Shards up to which the groups' offsets (16 ** 3 short rows a shard, 10 MB in all) are broadcast.
BROADCAST_SHARDS = 64


def record_key(key: Column, text: Column) -> Column:
    """The string that is hashed: the key, or for a null key the text's checksum."""
    return F.coalesce(key.cast("string"), F.concat(F.lit("null:"), F.crc32(F.coalesce(text, F.lit(""))).cast("string")))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0, 1, ...) with the least -ln(u)/weight, u a hash of key and shard.

    A shard wins a share of the keys in proportion to its weight. A further shard takes keys
    from the others and moves none between them.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights: one positive number for each shard")
    scores = [F.struct((-F.ln(unit_hash(key, F.lit(i))) / F.lit(float(w))).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights)]
    return F.array_min(F.array(*scores))["i"]


def assign_shards(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown_weight: float = 1.0) -> DataFrame:
    """One row for each input row: key, size, text_crc32, shard, slot, grown_shard.

    size is the text's bytes plus one (null: one); text_crc32 that of the text (null: of the
    empty one). slot numbers a shard's rows from 0 without gaps, by (first digits of the key's md5,
    key, size, checksum): groups of rows are counted, their offsets summed, and rows numbered
    inside their group, so no task sees a whole shard. grown_shard is the shard with one more.
    Repeated rows get slots of their own; null keys are placed by their text; texts of any length are only
    measured and summed; an empty table gives no rows. Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "shards")
    k = record_key(F.col(key), F.col(text))
    rows = docs.select(
        F.col(key),
        (F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("text_crc32"),
        rendezvous(k, weights).alias("shard"),
        rendezvous(k, [*weights, grown_weight]).alias("grown_shard"),
        F.substring(F.md5(k), 1, GROUP_DIGITS).alias("_group"),
    )
    rows = ws.save(rows, "rows")
    counts = rows.groupBy("shard", "_group").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    # At most 16 ** GROUP_DIGITS rows for each shard, however many records there are.
    offsets = counts.select("shard", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("shard", "_group").orderBy(key, "size", "text_crc32")
    return (
        rows.join(F.broadcast(offsets) if len(weights) <= BROADCAST_SHARDS else offsets, ["shard", "_group"])
        .withColumn("slot", F.col("_offset") + F.row_number().over(inside) - 1)
        .select(key, "size", "text_crc32", "shard", "slot", "grown_shard")
    )


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], key: str = "doc_id", text: str = "text", column: str = "shard") -> None:
    """Writes the rows to one folder for each shard, named by `column`, which must be no column of the rows."""
    if column.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the rows have a column {column}; name another one for the shards")
    docs.withColumn(column, rendezvous(record_key(F.col(key), F.col(text)), weights)).write.partitionBy(column).parquet(path)


N_SHARDS = 16


def op8_rendezvous_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign_shards(docs, [1.0] * N_SHARDS).withColumn("law", F.lit("key"))


#: DuckDB has no crc32: its table is worked out bit by bit, then folded over each text's bytes.
OP8_SQL = """
WITH RECURSIVE bits AS (
  SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS n FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n + 1 FROM bits WHERE n < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE n = 8
), k AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(doc_id AS VARCHAR) AS key FROM documents
), u AS (
  SELECT doc_id, i, -ln((CAST('0x' || left(md5(key || ':' || i), 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS s
  FROM k, range(17) r(i)
), w AS (
  SELECT doc_id, arg_min(i, s) FILTER (WHERE i < 16) AS shard, arg_min(i, s) AS grown_shard FROM u GROUP BY doc_id
), r AS (
  SELECT k.doc_id, strlen(text) + 1 AS size, hex(encode(text)) AS h, CAST(shard AS INTEGER) AS shard,
    CAST(grown_shard AS INTEGER) AS grown_shard, left(md5(key), 3) AS g
  FROM k JOIN w USING (doc_id)
)
SELECT doc_id, CAST(size AS BIGINT) AS size, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY g, doc_id) - 1 AS slot, grown_shard,
  xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(size - 1), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS text_crc32
FROM r, crc
"""
