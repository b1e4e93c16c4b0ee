"""Continuous jobs run over the events that there are; each equals its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import feeds as S
from ..streaming import jobs as J
from .roles import NOW

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__], COVERS[f.__name__] = f, covers
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _events(spark, sf_dir):
    return J.file_stream(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("at", F.col("ts").cast("timestamp"))


@query("K-2", "SELECT event_type AS kind, count(DISTINCT (user_id, date_trunc('day', ts))) AS n FROM events GROUP BY 1")
def stream_distinct(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_type", F.date_trunc("day", "ts").alias("day"), "at")
    rows = J.run_available(spark, J.without_duplicates(e, ["user_id", "event_type", "day"]), "distinct")
    return rows.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


@query("K-4", """
SELECT event_type AS kind, CAST(ts - INTERVAL 3 HOURS AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2
HAVING CAST(ts - INTERVAL 3 HOURS AS DATE) + INTERVAL 27 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""".replace("HAVING CAST(ts - INTERVAL 3 HOURS AS DATE)", "HAVING day"))
def stream_day_counts(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_type").alias("kind"), "at")
    return J.run_available(spark, J.day_counts(e, "kind"), "days")


RUNS = """WITH e AS (SELECT event_id // 2 AS run_id, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'finish' END AS event, ts FROM events WHERE event_id % 2 = 0 OR CAST(json_extract(props, '$.k') AS INT) % 10 > 0),
g AS (SELECT run_id, min(ts) FILTER (WHERE event = 'start') AS a, min(ts) FILTER (WHERE event = 'finish') AS b FROM e GROUP BY 1)
"""


@query("K-3", RUNS + "SELECT run_id, epoch_us(a) // 1000 AS started_ms FROM g WHERE a IS NOT NULL AND (b - a > INTERVAL 30 MINUTES OR (b IS NULL AND a + INTERVAL 30 MINUTES < (SELECT max(ts) FROM e)))")
def stream_stuck_runs(spark, sf_dir):
    e = _events(spark, sf_dir).filter("event_id % 2 = 0 OR k % 10 > 0")
    e = e.select(F.expr("event_id DIV 2").alias("run_id"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("finish").alias("event"), "at")
    return J.run_available(spark, J.stuck_runs(e), "stuck")


@query("K-5", """WITH l AS (SELECT event_type AS source, epoch_us(ts) // 1000 AS t, lag(epoch_us(ts) // 1000) OVER (PARTITION BY event_type ORDER BY ts) AS b FROM events)
SELECT source, b AS from_ms, t AS to_ms FROM l WHERE t - b > 120 * 60000""")
def stream_silences(spark, sf_dir):
    return J.run_available(spark, J.silences(_events(spark, sf_dir).select(F.col("event_type").alias("source"), "at")), "silent")


@query("K-1 R-6", """
WITH e AS (SELECT 'film ' || user_id AS title, event_type AS venue_id, date_trunc('second', ts) + to_hours(i + 3) AS starts_at, i FROM events, (VALUES (0), (2)) t(i) WHERE (event_id + i) % 4 <> 0)
SELECT DISTINCT title AS film, venue_id, starts_at FROM e""")
def stream_ingest(spark, sf_dir):
    """Payloads of a film with three showtimes, some hidden and some over, land in a stream; its snapshots of films and screenings are joined."""
    show = lambda i: F.struct(F.date_format(F.date_trunc("second", "ts").cast("timestamp_ntz") + F.make_interval(hours=F.lit(i)), "yyyy-MM-dd HH:mm:ss").alias("at"), F.when((F.col("event_id") + i) % 4 == 0, "0").otherwise("1").alias("shown"), F.lit(i == 1).alias("expired"))
    body = F.to_json(F.struct(F.concat(F.lit("film "), "user_id").alias("title"), (F.col("user_id") % 2).cast("int").alias("release"), F.lit(90).alias("minutes"), F.array(*[show(i) for i in range(3)]).alias("showtimes")))
    landed = _events(spark, sf_dir).select(F.col("event_type").alias("source"), body.alias("body"))
    out = J.ingest_stream(spark, landed, S.SOURCES["nested"], NOW, J.shared_folder(spark, "ingest"))
    films = out["films"].select(F.col("id").alias("film_id"), F.col("scraped_title").alias("film"))
    return out["screenings"].join(films, "film_id").select("film", "venue_id", "starts_at")
