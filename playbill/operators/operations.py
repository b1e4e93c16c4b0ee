"""Run audits, freshness, shape statistics, quality gates and evaluation."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, times

STALE_HOURS, FRESH_HOURS, STUCK_MINUTES = 26, 8, 30


def r6(c: Column) -> Column:
    return F.round(c, 6)


def latest_per_key(df: DataFrame, key: str, order: str, id_: str = "id") -> DataFrame:
    """Each key's last row; of equal times the lowest id."""
    return df.withColumn("_i", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc(), id_))).filter("_i = 1").drop("_i")


def shape(rows: DataFrame) -> DataFrame:
    """One row on a set of screenings (film_id, venue_id, day): counts, shares, mean, median, maximum and buckets of showings a film."""
    film = rows.groupBy("film_id").agg(F.count("*").alias("n"), F.countDistinct("venue_id").alias("v"))
    one, single = F.count_if(F.col("v") == 1), F.count_if(F.col("n") == 1)
    buckets = {"b1": (1, 1), "b2_3": (2, 3), "b4_6": (4, 6), "b7_10": (7, 10), "b11": (11, 1 << 40)}
    return film.agg(
        F.sum("n").alias("screenings"), F.count("*").alias("films"), one.alias("single_venue"), single.alias("single_showtime"),
        r6(text.try_percent(one, F.count("*"))).alias("single_venue_pct"), r6(text.try_percent(single, F.count("*"))).alias("single_showtime_pct"),
        r6(F.avg("n")).alias("mean_n"), F.median("n").alias("median_n"), F.max("n").alias("max_n"),
        *[F.count_if(F.col("n").between(*b)).alias(k) for k, b in buckets.items()],
    )


def repetition(rows: DataFrame, cell: list[str]) -> DataFrame:
    """How many cells (film, venue, day) have one showing, and how many two or more."""
    return rows.groupBy(*cell).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") > 1).alias("more"))


#: Rows of a venue's films that one task takes, so that its memory does not grow with the table.
ROWS_A_TASK = 500_000


def redundancy(rows: DataFrame) -> DataFrame:
    """Of each venue: screenings by film, its most repeated film, days of the longest run, films on three days or more."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))
    film = rows.repartition(tasks, "venue_id", "film_id").groupBy("venue_id", "film_id").agg(F.count("*").alias("n"), F.countDistinct("day").alias("d"))
    return film.groupBy("venue_id").agg(
        F.sum("n").alias("screenings"), F.count("*").alias("films"), r6(F.sum("n") / F.count("*")).alias("ratio"),
        F.max_by("film_id", F.struct("n", -F.col("film_id"))).alias("top_film"), F.max("n").alias("top_n"), F.max("d").alias("max_days"), F.count_if(F.col("d") >= 3).alias("films_3_days"),
    )


def top_values(df: DataFrame, value: Column, limit: int = 15) -> DataFrame:
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value").limit(limit)


def alerts(runs: DataFrame, now: datetime) -> DataFrame:
    """From each source's last run of the day before now: failures, runs that hang, and warnings of a breaker."""
    day = runs.filter((F.col("started_at") < times.lit(now)) & (F.col("started_at") >= times.lit(now - timedelta(hours=24))))
    last = latest_per_key(day, "source", "started_at")
    failed = last.filter("status = 'failure'").select("source", "id", F.lit("failure").alias("alert"))
    hung = last.filter((F.col("status") == "in-progress") & (F.col("started_at") < times.lit(now - timedelta(minutes=STUCK_MINUTES)))).select("source", "id", F.lit("stuck").alias("alert"))
    warned = last.select("source", "id", F.explode("warnings").alias("w")).filter(F.lower("w").contains("circuit breaker")).select("source", "id", F.concat(F.lit("warning: "), "w").alias("alert"))
    return failed.unionByName(hung).unionByName(warned)


def freshness(runs: DataFrame, now: datetime, key: str = "source") -> DataFrame:
    """Of each source: age of its last success in hours, stale (none, or too old), and whether a new run may be skipped."""
    last = runs.groupBy(key).agg(F.max(F.when(F.col("status") == "success", F.col("started_at"))).alias("last"))
    age = F.timestamp_diff("SECOND", F.col("last"), times.lit(now)) / 3600.0
    return last.select(key, r6(age).alias("age_hours"), F.coalesce(age > STALE_HOURS, F.lit(True)).alias("stale"), F.coalesce(age < FRESH_HOURS, F.lit(False)).alias("skip"))


def trailing(metrics: DataFrame, now: datetime, columns: list[str], days: int = 7) -> DataFrame:
    """Sums over the last days, up to and with now; zero where there is nothing."""
    near = metrics.filter((F.col("ran_at") >= times.lit(now - timedelta(days=days))) & (F.col("ran_at") < times.lit(now + timedelta(seconds=1))))
    return near.agg(F.count("*").alias("n_runs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def pending_pool(films: DataFrame, screenings: DataFrame, now: datetime, version: int) -> DataFrame:
    """Films to look up (again): shown, not skipped, with a showing to come, in one of four states."""
    coming = screenings.filter(F.col("starts_at") >= times.lit(now)).select(F.col("film_id").alias("id"))
    tried = F.col("match_source") == "none-attempted"
    state = (
        (F.col("match_source") == "none")
        | (tried & F.col("ext_id").isNotNull())
        | (tried & (F.col("match_version").isNull() | (F.col("match_version") < version)))
        | ((F.col("match_source") == "manual") & F.col("ext_id").isNotNull() & F.col("poster").isNull())
    )
    return films.filter(~F.col("skip") & ~F.col("hidden") & state).join(coming, "id", "left_semi")


def stuck_list(films: DataFrame, screenings: DataFrame, venues: DataFrame, now: datetime) -> DataFrame:
    """Shown films without an external id: showings to come and the sorted names of their venues."""
    open_ = films.filter("ext_id IS NULL AND NOT skip AND NOT hidden").select(F.col("id").alias("film_id"), "title")
    coming = screenings.filter(F.col("starts_at") > times.lit(now)).join(open_, "film_id").join(venues.select(F.col("id").alias("venue_id"), "name"), "venue_id")
    out = coming.groupBy("film_id", "title").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("name")), "|").alias("venues"))
    return out.orderBy(F.col("n").desc(), "title")


def miss_causes(misses: DataFrame) -> DataFrame:
    """(cause, id, n): films whose cause a rule could mend and two films or more share, and how many do. The causes are a fixed few, so their counts are broadcast."""
    causes = misses.withColumn("cause", text.miss_cause(F.col("title"), F.col("director"))).filter("cause <> 'unfixable'")
    shared = causes.groupBy("cause").agg(F.count("*").alias("n")).filter("n >= 2")
    return causes.join(F.broadcast(shared), "cause").select("cause", "id", "n")


def evaluate(cases: DataFrame) -> DataFrame:
    """One row: reachable cases, picks, correct ones, precision and recall (1 where empty), confident errors."""
    right, picked = F.col("reachable") & F.col("predicted").eqNullSafe(F.col("expected")), F.col("reachable") & F.col("predicted").isNotNull()
    n, picks, correct = F.count_if("reachable"), F.count_if(picked), F.count_if(right)
    wrong = F.count_if(picked & (F.col("predicted") != F.col("expected")) & (F.col("confidence") >= 0.85))
    ratio = lambda a, b: r6(F.coalesce(F.try_divide(a, b), F.lit(1.0)))
    return cases.agg(n.alias("reachable"), F.count_if(~F.col("reachable")).alias("unreachable"), picks.alias("picks"), correct.alias("correct"),
                     ratio(correct, picks).alias("precision"), ratio(correct, n).alias("recall"), wrong.alias("confident_errors"))


def regressions(result: DataFrame, precision: float, recall: float, errors: int, margin: float = 0.05) -> DataFrame:
    return result.select((F.col("precision") < precision - margin).alias("precision_fell"), (F.col("recall") < recall - margin).alias("recall_fell"), (F.col("confident_errors") > errors).alias("errors_rose"))


def repeated_days(rows: DataFrame) -> DataFrame:
    """Days of a source that list exactly the same ids."""
    day = rows.groupBy("source", "day").agg(F.array_join(F.array_sort(F.collect_set("item")), ",").alias("print"))
    return day.groupBy("source", "print").agg(F.count("*").alias("n_days"), F.min("day").alias("first_day")).filter("n_days > 1")


def batch_verdict(rows: DataFrame, key: str) -> DataFrame:
    """Of each source's batch: rows, rows with a readable time, films, shares, and why it fails or is quiet."""
    g = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if("readable").alias("n_read"), F.countDistinct("film").alias("n_films"),
        r6(F.avg((~F.col("readable")).cast("int"))).alias("unread_share"), r6(F.avg(F.col("year").isNull().cast("int"))).alias("no_year_share"), F.count_if("linked").alias("n_linked"),
    )
    why = (
        F.when(F.col("n_films") == 0, "no films").when(F.col("n_read") == 0, "no readable times").when(F.col("unread_share") > 0.5, "mostly unreadable")
        .when(F.col("n_linked") == 0, "selector may be broken").when(F.col("no_year_share") > 0.5, "mostly without year")
    )
    return g.withColumn("why", why).withColumn("ok", F.col("why").isNull())


def date_gap_ok(first: Column, last: Column, low: int = 4, high: int = 14) -> Column:
    return (F.datediff(last, first) + 1).between(low, high)
