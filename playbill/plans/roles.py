"""The given tables in the roles of a listing catalog, for Spark and for DuckDB."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reference time of all queries on `events`, and of those on `orders` and `lineitem`.
NOW = datetime(2024, 1, 15, 12)
NOW_LONG = datetime(1998, 7, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def screenings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a film (user) shown in one of 20 rooms, part of a programme or not."""
    k = F.get_json_object("props", "$.k").cast("int")
    tags = F.expr("CASE k % 4 WHEN 0 THEN array('premiere') WHEN 1 THEN array('cycle', 'vos') WHEN 2 THEN cast(array() AS array<string>) ELSE array('restored') END")
    return table(spark, sf_dir, "events").withColumn("k", k).select(
        F.col("event_id").alias("id"), F.col("user_id").alias("film_id"), (F.col("k") % 20).alias("venue_id"), F.col("ts").alias("starts_at"), "k",
        F.col("event_type").alias("kind"), F.expr("CASE WHEN k % 5 = 0 THEN NULL ELSE concat('Ciclo Ñ ', k % 9) END").alias("program_name"), tags.alias("tags"),
    )


def films(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer and nation, with attributes that follow from the key."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.expr("c_nationkey = n_nationkey"))
    return c.selectExpr(
        "c_custkey AS id", "c_name AS title", "n_name AS country", "c_acctbal AS popularity", "c_custkey * 7 % 2500 AS vote_count",
        "cast(1950 + c_custkey % 76 AS int) AS year", "cast(CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 60 + c_custkey % 90 END AS int) AS runtime",
        "c_mktsegment AS segment", "c_custkey % 17 = 0 AS hidden", "c_custkey % 11 = 0 AS skip",
        "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE concat('poster/', c_custkey) END AS poster",
        "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 500 END AS ext_id",
        "CASE c_custkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'none-attempted' WHEN 2 THEN 'auto' WHEN 3 THEN 'manual' ELSE 'override' END AS match_source",
        "cast(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 4 END AS int) AS match_version",
        "date_add(DATE'2023-12-01', cast(c_custkey % 45 AS int)) AS created_on",
        "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('Dir ', c_custkey % 50) END AS director",
    )


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.expr("s_nationkey = n_nationkey"))
    return s.selectExpr("s_suppkey AS id", "s_name AS name", "n_name AS neighborhood", "CASE WHEN s_acctbal < 0 THEN 'chain' ELSE 'indie' END AS type", "n_regionkey AS region")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: runs of 13 sources."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey % 13 AS source", "o_orderdate AS started_at",
        "CASE o_orderstatus WHEN 'F' THEN 'failure' WHEN 'O' THEN 'success' ELSE 'in-progress' END AS status", "cast(o_totalprice AS int) AS scraped", "o_orderpriority AS warning",
    )


#: The same roles as common table expressions: s, f, v, r.
SQL = """
WITH s AS (
  SELECT event_id AS id, user_id AS film_id, k % 20 AS venue_id, ts AS starts_at, k, event_type AS kind,
    CASE WHEN k % 5 = 0 THEN NULL ELSE 'Ciclo Ñ ' || (k % 9) END AS program_name,
    CASE k % 4 WHEN 0 THEN ['premiere'] WHEN 1 THEN ['cycle', 'vos'] WHEN 2 THEN CAST([] AS VARCHAR[]) ELSE ['restored'] END AS tags
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)
), f AS (
  SELECT c_custkey AS id, c_name AS title, n_name AS country, c_acctbal AS popularity, c_custkey * 7 % 2500 AS vote_count,
    CAST(1950 + c_custkey % 76 AS INT) AS year, CAST(CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 60 + c_custkey % 90 END AS INT) AS runtime,
    c_mktsegment AS segment, c_custkey % 17 = 0 AS hidden, c_custkey % 11 = 0 AS skip,
    CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'poster/' || c_custkey END AS poster,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 500 END AS ext_id,
    CASE c_custkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'none-attempted' WHEN 2 THEN 'auto' WHEN 3 THEN 'manual' ELSE 'override' END AS match_source,
    CAST(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 4 END AS INT) AS match_version,
    DATE '2023-12-01' + CAST(c_custkey % 45 AS INT) AS created_on,
    CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'Dir ' || (c_custkey % 50) END AS director
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), v AS (
  SELECT s_suppkey AS id, s_name AS name, n_name AS neighborhood, CASE WHEN s_acctbal < 0 THEN 'chain' ELSE 'indie' END AS type, n_regionkey AS region
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
), r AS (
  SELECT o_orderkey AS id, o_custkey % 13 AS source, o_orderdate AS started_at,
    CASE o_orderstatus WHEN 'F' THEN 'failure' WHEN 'O' THEN 'success' ELSE 'in-progress' END AS status,
    CAST(floor(o_totalprice) AS INT) AS scraped, o_orderpriority AS warning
  FROM orders
)
"""
