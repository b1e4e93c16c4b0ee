"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, attach, let, unit_hash

#: A rate above this is drawn as a sum of equal parts, each inverted from a hash of its own.
PART_RATE = 32.0


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson of this mean, as far as a 52-bit number can tell."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["c"]


def source_rates(docs: DataFrame, weights: Mapping[str, float], default_weight: float, epochs: float, source: str, text: str) -> DataFrame:
    """For each source: its mean number of copies, and the inverted distribution of a part.

    A source's share of the output's bytes is its weight over the sum of those of the sources
    present; all together are epochs times the input's bytes (a text counts its bytes plus one).
    """
    weight = F.lit(float(default_weight))
    for name, w in weights.items():
        weight = F.when(F.col(source).eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    ws = Workspace(docs.sparkSession, "mixing")
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 1
    sizes = ws.save(docs.select(source, size.alias("_b")).groupBy(source).agg(F.sum("_b").alias("_bytes")).withColumn("_w", weight), "sizes")
    total, all_weights = sizes.agg(F.sum("_bytes"), F.sum("_w")).first()
    if not total:
        return sizes.select(source, F.lit(0.0).alias("rate"), F.lit(1).alias("_parts"), F.array(F.lit(1.0)).alias("_cdf"))
    if not all_weights:
        raise ValueError("no source that is present has a weight above 0")
    rate = F.lit(float(epochs) * total) * F.col("_w") / F.lit(float(all_weights)) / F.col("_bytes")
    parts = sizes.select(source, rate.alias("rate")).withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE).cast("int")))
    return ws.save(parts.withColumn("_cdf", poisson_cdf(F.col("rate") / F.col("_parts"))), "rates")


def mix_sources(
    docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, epochs: float = 1.0, seed: int = 0, key: str = "doc_id", source: str = "source", text: str = "text"
) -> DataFrame:
    """The rows of docs, each as often as a Poisson draw says, in random order.

    Columns: row (a struct of all of the input's columns), copy_no from 0, mix_key. The draw inverts
    the distribution at a hash of (seed, key), so a run again gives the same copies; rows with
    equal keys get equal counts. Sources that no weight names, null among them, have the default
    weight. A rate below one leaves documents out: that is the sampling asked for. Rows are dealt
    out by a hash of (seed, key, copy) and sorted by it inside each partition. Null texts count one
    byte; an empty table gives no rows.
    """
    rates = source_rates(docs, weights, default_weight, epochs, source, text)
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("_source"), F.col(key).cast("string").alias("_key"))
    rows = attach(rows, rates.withColumnRenamed(source, "_source"), "_source", F.col("_key"))
    k = F.coalesce(F.col("_key"), F.lit("null"))
    draws = F.transform(
        F.sequence(F.lit(1), F.col("_parts")),
        lambda j: let(unit_hash(F.lit(seed), k, j), lambda u: F.size(F.filter(F.col("_cdf"), lambda c: c <= u))),
    )
    count = F.aggregate(draws, F.lit(0), lambda a, x: a + x)
    copies = rows.withColumn("_n", count).filter("_n > 0").select("row", "_key", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("copy_no"))
    mixed = copies.select("row", "copy_no", F.md5(F.concat_ws(":", F.lit(f"mix{seed}"), F.coalesce(F.col("_key"), F.lit("null")), "copy_no")).alias("mix_key"))
    return mixed.repartition("mix_key").sortWithinPartitions("mix_key")


#: Production weights: the two named sources are of known quality, the rest count alike.
TARGET_WEIGHTS = {"src0": 2.0, "src1": 1.5}


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), TARGET_WEIGHTS)
    return mixed.select("row.doc_id", "row.source", "row.text", "copy_no", "mix_key")


OP1_SQL = """
WITH b AS (
  SELECT source, sum(strlen(coalesce(text, '')) + 1) AS bytes,
    CASE WHEN source = 'src0' THEN 2.0 WHEN source = 'src1' THEN 1.5 ELSE 1.0 END::DOUBLE AS w
  FROM documents GROUP BY source
), r AS (
  SELECT source, (SELECT sum(bytes) FROM b)::DOUBLE * w / (SELECT sum(w) FROM b) / bytes AS rate FROM b
), p AS (
  SELECT source, rate, greatest(1, ceil(rate / 32.0)::INT) AS parts FROM r
), c AS (
  SELECT source, k, sum(exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM p, range(0, 120) t(k)
), d AS (
  SELECT doc_id, d.source, j,
    (CAST('0x' || left(md5('0:' || doc_id || ':' || j), 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, p.parts + 1)) AS j)
), n AS (
  SELECT doc_id, count(*) AS n FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND c.cdf <= d.u GROUP BY doc_id
)
SELECT doc_id, source, text, i::INT AS copy_no, md5('mix0:' || doc_id || ':' || i) AS mix_key
FROM documents JOIN n USING (doc_id), LATERAL (SELECT unnest(range(0, n.n)) AS i)
"""
