"""Listing views: windows over screenings, grouped, filled and ranked."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, times


def visible(films: DataFrame) -> DataFrame:
    """The one place that hides films."""
    return films.filter(~F.col("hidden"))


def in_window(screenings: DataFrame, lower: datetime, upper: datetime | None = None, film: int | None = None, venue: int | None = None) -> DataFrame:
    """Screenings from lower on, up to before upper, of a film or venue."""
    out = screenings.filter(F.col("starts_at") >= times.lit(lower))
    if upper is not None:
        out = out.filter(F.col("starts_at") < times.lit(upper))
    if film is not None:
        out = out.filter(F.col("film_id") == film)
    return out if venue is None else out.filter(F.col("venue_id") == venue)


def star(screenings: DataFrame, films: DataFrame, venues: DataFrame) -> DataFrame:
    """Screenings with their visible film and their venue; both dimensions stay small enough for Spark to choose the join."""
    f = visible(films).withColumnRenamed("id", "film_id")
    v = venues.select(F.col("id").alias("venue_id"), F.col("name").alias("venue"), "neighborhood")
    return screenings.join(f, "film_id").join(v, "venue_id")


def by_film(rows: DataFrame, now: datetime) -> DataFrame:
    """Films of a window: screenings, venues, first and last start, next catchable start."""
    return rows.groupBy("film_id", "title").agg(
        F.count("*").alias("n"), F.countDistinct("venue_id").alias("n_venues"),
        F.min(F.when(times.catchable(F.col("starts_at"), now), F.col("starts_at"))).alias("next_at"), F.max("starts_at").alias("last_at"),
    )


def film_order(df: DataFrame) -> DataFrame:
    """Films with a showing to catch by its start, then the rest, latest first."""
    return df.orderBy(F.col("next_at").asc_nulls_last(), F.when(F.col("next_at").isNull(), F.col("last_at")).desc(), "film_id")


def film_venues(rows: DataFrame) -> DataFrame:
    """For each film and venue its starts in order, and the venue's place by first start."""
    lists = rows.groupBy("film_id", "venue_id").agg(F.min("starts_at").alias("first_at"), F.count("*").alias("n"), F.array_sort(F.collect_list("starts_at")).alias("starts"))
    return lists.withColumn("place", F.row_number().over(W.partitionBy("film_id").orderBy("first_at", "venue_id")))


def last_future(screenings: DataFrame, now: datetime) -> DataFrame:
    return screenings.filter(F.col("starts_at") > times.lit(now)).groupBy("film_id").agg(F.max("starts_at").alias("last_at"))


def with_last_flag(screenings: DataFrame, lower: datetime, upper: datetime, now: datetime) -> DataFrame:
    """Rows of a window, marked where they are their film's last; the last is of all rows, not of the window."""
    return in_window(screenings, lower, upper).join(last_future(screenings, now), "film_id", "left").withColumn("is_last", F.coalesce(F.col("starts_at") == F.col("last_at"), F.lit(False)))


def by_day(rows: DataFrame, now: datetime) -> DataFrame:
    """Local days: screenings, those over, whether all are, and today."""
    today = F.lit(f"{now - timedelta(hours=times.OFFSET_HOURS):%Y-%m-%d}").cast("date")
    over = F.count_if(~times.catchable(F.col("starts_at"), now))
    days = rows.groupBy(times.local_day(F.col("starts_at")).alias("day")).agg(F.count("*").alias("n"), over.alias("n_over"))
    return days.withColumn("all_over", F.col("n") == F.col("n_over")).withColumn("is_today", F.col("day") == today)


def calendar(screenings: DataFrame, now: datetime, days: int = 14) -> DataFrame:
    """So many local days from today on, empty ones too."""
    lower = times.today_start(now)
    spine = screenings.sparkSession.range(days).select(F.date_add(F.lit(f"{lower:%Y-%m-%d}").cast("date"), F.col("id").cast("int")).alias("day"))
    counts = by_day(in_window(screenings, lower, lower + timedelta(days=days)), now).select("day", "n", "n_over")
    joined = spine.join(counts, "day", "left").fillna(0, ["n", "n_over"])
    return joined.select("day", "n", "n_over", times.day_chip(F.col("day"), now).alias("chip"), F.dayofweek("day").isin(1, 7).alias("weekend"), (F.col("n") == 0).alias("empty"))


def by_week(rows: DataFrame) -> DataFrame:
    monday = F.to_date(F.date_trunc("week", times.local(F.col("starts_at"))))
    weeks = rows.groupBy(monday.alias("monday")).agg(F.count("*").alias("n"), F.countDistinct("film_id").alias("n_films"), F.countDistinct("venue_id").alias("n_venues"))
    return weeks.withColumn("label", times.week_label(F.col("monday")))


def programmes(rows: DataFrame) -> DataFrame:
    """Programmes of each venue by the slug of their name; blank names are none."""
    named = rows.filter(F.trim("program_name") != "").withColumn("slug", F.coalesce(F.nullif(text.slug(F.col("program_name")), F.lit("")), F.lit("ciclo")))
    first = F.struct("starts_at", "id")
    return named.groupBy("venue_id", "slug").agg(
        F.countDistinct("film_id").alias("n_films"), F.min("starts_at").alias("first_at"), F.max("starts_at").alias("last_at"),
        F.min_by("id", first).alias("first_id"), F.min_by("program_name", first).alias("name"),
    )


def search(rows: DataFrame, query: str, now: datetime, limit: int = 20) -> DataFrame:
    """Films with something to catch whose title or country holds the query, soonest first; of 2 letters or more."""
    if len(query.strip()) < 2:
        return search(rows, "\0\0", now, limit)
    needle = text.search_fold(F.lit(query))
    hay = text.search_fold(F.concat_ws(" ", "title", "country"))
    hits = rows.filter(times.catchable(F.col("starts_at"), now)).filter(F.contains(hay, needle))
    found = hits.groupBy("film_id", "title").agg(F.min("starts_at").alias("soonest"), F.countDistinct("venue_id").alias("n_venues"), F.count("*").alias("n"))
    return found.orderBy("soonest", "film_id").limit(max(1, min(50, limit)))


def day_rows(rows: DataFrame) -> DataFrame:
    """A film's day: times by the cinema's clock, all tags, first programme."""
    at = F.col("starts_at")
    item = F.struct(times.cinema_clock(times.local(at)).alias("m"), F.date_format(times.local(at), "HH:mm").alias("t"))
    return rows.groupBy("film_id", times.local_day(at).alias("day")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(item)), lambda x: x["t"]), " ").alias("times"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))), ",").alias("tags"),
        F.min_by("program_name", F.when(F.col("program_name").isNotNull(), F.struct("starts_at", "id"))).alias("program"),
    )


def weekly_runs(rows: DataFrame) -> DataFrame:
    """Days of a film with equal times as one signature: weekdays and times, to the minute and by the cinema's clock; uniform if there is one."""
    local = times.local(F.col("starts_at"))
    shows = F.array_sort(F.collect_set(F.struct(times.cinema_clock(local).alias("m"), F.date_format(local, "HH:mm").alias("t"))))
    day = rows.groupBy("film_id", times.local_day(F.col("starts_at")).alias("day")).agg(F.array_join(F.transform(shows, lambda x: x["t"]), " ").alias("times"))
    sig = day.groupBy("film_id", "times").agg(F.array_sort(F.collect_set(F.weekday("day"))).alias("days"), F.count("*").alias("n_days"), F.min("day").alias("first"), F.max("day").alias("last"))
    uniform = F.count("*").over(W.partitionBy("film_id")) == 1
    return sig.select("film_id", "times", times.weekday_set_label(F.col("days")).alias("label"), "n_days", times.date_range_label(F.col("first"), F.col("last")).alias("dates"), uniform.alias("uniform"))


def first_days(rows: DataFrame, days: int = 4) -> DataFrame:
    """Each venue's first days, with the number of those left out."""
    each = rows.groupBy("venue_id", times.local_day(F.col("starts_at")).alias("day")).agg(F.count("*").alias("n"))
    by = W.partitionBy("venue_id")
    ranked = each.withColumn("rank", F.dense_rank().over(by.orderBy("day"))).withColumn("omitted", F.greatest(F.count("*").over(by) - days, F.lit(0)))
    return ranked.filter(F.col("rank") <= days)


def next_showing(rows: DataFrame, now: datetime) -> DataFrame:
    """A film's first start from now on, or else its first of all."""
    key = F.struct("starts_at", "id")
    future = F.when(F.col("starts_at") >= times.lit(now), key)
    return rows.groupBy("film_id").agg(F.coalesce(F.min_by("id", future), F.min_by("id", key)).alias("id"))


def truncated(df: DataFrame, limit: int, order: list[Column | str]) -> DataFrame:
    """The first rows by the order, each saying whether there were more."""
    kept = df.orderBy(*order).limit(limit + 1).withColumn("_i", F.row_number().over(W.orderBy(*order)))
    return kept.withColumn("truncated", F.count("*").over(W.partitionBy(F.lit(1))) > limit).filter(F.col("_i") <= limit).drop("_i")


#: Slots of the featured band: name, who may fill it, by what. Tried in order, each film once; `last_at` is the film's last future start.
FIXED_SLOTS = (
    ("local", lambda now, upper: F.col("country") == "ARGENTINA", "popularity"),
    ("premiere", lambda now, upper: F.col("premiere") | (F.col("year") == now.year), "popularity"),
    ("classic", lambda now, upper: (F.col("year") <= 2000) & (F.col("vote_count") >= 1000), "vote_count"),
)
WILDCARDS = (
    ("last", lambda now, upper: F.col("last_at") < times.lit(upper), "popularity"),
    ("new", lambda now, upper: F.col("created_on") > F.lit(f"{now - timedelta(days=14):%Y-%m-%d}").cast("date"), "popularity"),
    ("world", lambda now, upper: ~F.col("country").isin("ARGENTINA", "UNITED STATES"), "popularity"),
    ("any", lambda now, upper: F.lit(True), "popularity"),
)


def featured(rows: DataFrame, screenings: DataFrame, now: datetime, upper: datetime, slots: int = 4) -> DataFrame:
    """At most `slots` films with a poster and a future showing.

    The fixed slots take their best film in turn. The rest comes from the wildcards: a film's rule is
    the first it fits, and they are taken by (rule, popularity); as a film that is taken changes no
    other's rule, that is the same as trying the rules again for each place. Ranks are limited to
    the few rows of each rule, so no sort sees all films at once.
    """
    films = rows.groupBy("film_id", "title", "country", "year", "vote_count", "popularity", "created_on", "poster").agg(F.max(F.array_contains("tags", "premiere")).alias("premiere"))
    pool = films.filter("poster IS NOT NULL").join(last_future(screenings, now), "film_id")
    picks = None
    for place, (name, rule, rank) in enumerate(FIXED_SLOTS):
        left = pool if picks is None else pool.join(picks.select("film_id"), "film_id", "left_anti")
        best = left.filter(rule(now, upper)).orderBy(F.col(rank).desc(), "film_id").limit(1).select("film_id", "title", F.lit(name).alias("reason"), F.lit(place).alias("place"))
        picks = best if picks is None else picks.unionByName(best)
    first = F.lit(None).cast("int")
    for i, (_, rule, _) in reversed(list(enumerate(WILDCARDS))):
        first = F.when(rule(now, upper), i).otherwise(first)
    rest = pool.join(picks.select("film_id"), "film_id", "left_anti").withColumn("i", first)
    names = F.array(*[F.lit(n) for n, _, _ in WILDCARDS])
    wild = rest.orderBy("i", F.col("popularity").desc(), "film_id").limit(slots)
    wild = wild.select("film_id", "title", names[F.col("i")].alias("reason"), (F.lit(10) + F.row_number().over(W.orderBy("i", F.col("popularity").desc(), "film_id"))).alias("place"))
    return picks.unionByName(wild).orderBy("place").limit(slots).select("film_id", "title", "reason")
