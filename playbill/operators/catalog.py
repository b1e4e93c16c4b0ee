"""Catalog maintenance: each job is a pure (current, incoming) -> next snapshot."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, times
from ..storage import saved

#: States in which a match is settled, so that a feed may not change what it rests on.
SETTLED = ("manual", "auto", "override")


def first_seen(incoming: DataFrame, keys: list[str], pos: str = "feed_pos") -> DataFrame:
    return incoming.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(pos))).filter("_i = 1").drop("_i")


#: Fields of a film that the feed may not change once its match is settled, and one that it always may.
GATED, OPEN = ("director", "title_original", "runtime"), ("synopsis",)


def upsert_films(current: DataFrame, incoming: DataFrame, top: int | None = None) -> DataFrame:
    """Films by (scraped_title, scraped_year), null years equal.

    current: id, scraped_title, scraped_year, director, runtime, synopsis, skip, match_source and any others, title_original among them; incoming
    without id and match_source, with feed_pos. A field changes only where the feed has it;
    director, original title and runtime stay where the match is settled; the synopsis is always taken. A real change
    opens a tried film again. skip is set on insert only. New ids follow the greatest (or `top`), in feed order.
    """
    new = first_seen(incoming, ["scraped_title", "scraped_year"])
    c, n = current.alias("c"), new.alias("n")
    same = (F.col("c.scraped_title") == F.col("n.scraped_title")) & F.col("c.scraped_year").eqNullSafe(F.col("n.scraped_year"))
    joined = c.join(n, same, "full_outer")
    locked = F.coalesce(F.col("c.match_source").isin(*SETTLED), F.lit(False))
    told = [f for f in (*GATED, *OPEN) if f in current.columns and f in incoming.columns]
    taken = {f: F.when(locked if f in GATED else F.lit(False), F.col(f"c.{f}")).otherwise(F.coalesce(f"n.{f}", f"c.{f}")) for f in told}
    changed = F.lit(False)
    for f, value in taken.items():
        changed = changed | ~value.eqNullSafe(F.col(f"c.{f}"))
    source = F.when(F.col("c.id").isNull(), "none").when((F.col("c.match_source") == "none-attempted") & changed, "none").otherwise(F.col("c.match_source"))
    own = {
        "scraped_title": F.coalesce("c.scraped_title", "n.scraped_title"), "scraped_year": F.coalesce("c.scraped_year", "n.scraped_year"), "skip": F.coalesce("c.skip", "n.skip"), "match_source": source,
    } | taken
    merged = joined.select(*[own[x].alias(x) if x in own else F.col(f"c.`{x}`") for x in current.columns], F.col("n.feed_pos").alias("feed_pos"))
    return with_new_ids(merged, current, ["feed_pos", "scraped_title", "scraped_year"], top).drop("feed_pos")


def numbered(df: DataFrame, order: list[str], after: DataFrame | None = None) -> DataFrame:
    """df with `_i`: 1, 2, ... in an order that tells rows apart, or what follows the one number of `after`. Rows are dealt out by ranges of the whole order and saved with
    the number of theirs; they are counted by range and numbered inside it, so that no task sees all of them, whatever they have in common. The counts of ranges, a row for each, are added
    up in order, with that number before the first."""
    rows = saved(df.repartitionByRange(*order).withColumn("_g", F.spark_partition_id()), "ranges")
    counts = rows.groupBy("_g").agg(F.count("*").alias("_n")).select(F.lit(1).alias("_s"), "_g", "_n")
    if after is not None:
        counts = counts.unionByName(after.select(F.lit(0).alias("_s"), F.lit(None).cast("int").alias("_g"), F.col(after.columns[0]).cast("long").alias("_n")))
    before = F.sum("_n").over(W.orderBy("_s", "_g").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("_s", F.col("_g").alias("_h"), F.coalesce(before, F.lit(0)).alias("_o")).filter("_s = 1").drop("_s")
    inside = rows.withColumn("_i", F.row_number().over(W.partitionBy("_g").orderBy(*order)))
    return inside.join(offsets, F.col("_g") == F.col("_h")).withColumn("_i", F.col("_i") + F.col("_o")).drop("_g", "_h", "_o")


def with_new_ids(df: DataFrame, current: DataFrame, order: list[str], top: int | None = None) -> DataFrame:
    """Rows without id get the numbers after the greatest (or after `top`), in order."""
    after = current.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top")) if top is None else None
    fresh = numbered(df.filter("id IS NULL"), order, after)
    return df.filter("id IS NOT NULL").unionByName(fresh.withColumn("id", F.col("_i") + F.lit(top or 0)).drop("_i"))


def replace_future(current: DataFrame, incoming: DataFrame, now: datetime, top: int | None = None) -> DataFrame:
    """Screenings (id, film_id, venue_id, starts_at, program_name and any others) after a batch: past rows stay, future
    rows of the batch's venues are replaced.

    A venue whose batch is empty (a row without film) keeps its future rows if it has any: the breaker. On
    (film, venue, start) a later row of the batch wins over an earlier and over one that stayed: that one keeps its id and takes
    all else from the batch. Other rows of the batch get new ids in feed order. Columns that the batch lacks are null.
    """
    key = ["film_id", "venue_id", "starts_at"]
    venues = incoming.groupBy("venue_id").agg(F.count("film_id").alias("_n"))
    marked = current.join(venues, "venue_id", "left")
    keep = (F.col("starts_at") < times.lit(now)) | F.coalesce(F.col("_n") == 0, F.lit(True))
    old = marked.filter(keep).select(*current.columns, F.lit(-1).cast("long").alias("_pos"))
    types = dict(current.dtypes)
    batch = [F.col(c).cast(types[c]).alias(c) if c in incoming.columns and c != "id" else F.lit(None).cast(types[c]).alias(c) for c in current.columns]
    new = incoming.filter("film_id IS NOT NULL").select(*batch, F.col("feed_pos").cast("long").alias("_pos"))
    last = W.partitionBy(*key).orderBy(F.col("_pos").desc(), "program_name", "id")
    rows = old.unionByName(new).withColumns({"_i": F.row_number().over(last), "_id": F.max("id").over(W.partitionBy(*key))})
    rows = rows.filter("_i = 1").withColumn("id", F.col("_id")).drop("_i", "_id")
    return with_new_ids(rows, current, ["_pos", *key], top).drop("_pos")


def refused_venues(current: DataFrame, incoming: DataFrame, now: datetime) -> DataFrame:
    """Venues that the breaker holds, with the future rows kept."""
    empty = incoming.groupBy("venue_id").agg(F.count("film_id").alias("n")).filter("n = 0").select("venue_id")
    return current.filter(F.col("starts_at") >= times.lit(now)).join(empty, "venue_id", "left_semi").groupBy("venue_id").agg(F.count("*").alias("kept"))


def winners(films: DataFrame, by: list[str]) -> DataFrame:
    """Loser -> winner: films of one external id, of which the lowest id wins."""
    w = films.dropna(subset=by).withColumn("winner", F.min("id").over(W.partitionBy(*by)))
    return w.filter("id <> winner").select(F.col("id").alias("film_id"), "winner")


def merge_duplicates(screenings: DataFrame, losers: DataFrame) -> DataFrame:
    """Screenings of losers go to their winners; those that then collide go, the winner's own first."""
    moved = screenings.join(losers, "film_id", "left")
    target = moved.select(F.coalesce("winner", "film_id").alias("film_id"), F.col("winner").isNotNull().alias("_moved"), *[c for c in screenings.columns if c != "film_id"])
    keep = W.partitionBy("film_id", "venue_id", "starts_at").orderBy("_moved", "id")
    return target.withColumn("_i", F.row_number().over(keep)).filter("_i = 1").drop("_i", "_moved")


def assign_slugs(films: DataFrame) -> DataFrame:
    """The base slug for the first film that has it (one with a slug before, then the lowest id); others get their id added."""
    base = films.withColumn("base", text.slug(F.col("title")))
    i = F.row_number().over(W.partitionBy("base").orderBy(F.col("slug").isNull(), "id"))
    return base.withColumn("slug", F.coalesce("slug", F.when(i == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("id").cast("string"))))).drop("base")


def upsert_keyed(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by null-safe keys, those of incoming before those of current; of several incoming ones of a key the one whose other columns come first in their order."""
    both = current.withColumn("_p", F.lit(1)).unionByName(incoming.withColumn("_p", F.lit(0)))
    rest = [c for c in current.columns if c not in keys]
    return both.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy("_p", *rest))).filter("_i = 1").drop("_i", "_p")


def with_precedence(*sources: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union of sources of which the earlier one wins for each key."""
    both = None
    for i, s in enumerate(sources):
        s = s.withColumn("_p", F.lit(i))
        both = s if both is None else both.unionByName(s)
    return both.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy("_p", order))).filter("_i = 1").drop("_i", "_p")


def lookup_override(films: DataFrame, overrides: DataFrame) -> DataFrame:
    """The override of exactly (title, year), else that of the title for any year."""
    exact = overrides.filter("year IS NOT NULL").select(F.col("title").alias("_t"), F.col("year").alias("_y"), F.col("ext_id").alias("_exact"))
    loose = overrides.filter("year IS NULL").select(F.col("title").alias("_t2"), F.col("ext_id").alias("_loose"))
    out = films.join(exact, (F.col("title") == F.col("_t")) & (F.col("year") == F.col("_y")), "left").join(loose, F.col("title") == F.col("_t2"), "left")
    return out.withColumn("override_id", F.coalesce("_exact", "_loose")).drop("_t", "_y", "_exact", "_t2", "_loose")


def write_matches(films: DataFrame, found: DataFrame) -> DataFrame:
    """Films, with all their columns, after a resolution (id, ext_id and any catalog columns: title, original title, director, country, cast, genres, poster, ...).

    What the catalog has overwrites what the film had, also in columns that the film lacked; what it has not stays, so its year wins over ours only if it has one. A
    venue's synopsis stays if it isn't blank. The match is automatic unless `found` names its source.
    """
    extra = [c for c in found.columns if c not in films.columns]
    f = found.select("id", *[F.col(c).alias(f"_{c}") for c in found.columns if c != "id"])
    j = films.withColumns({c: F.lit(None).cast(found.schema[c].dataType) for c in extra}).join(f, "id", "left")
    hit = F.col("_ext_id").isNotNull()
    new = {c: F.when(hit, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in found.columns if c != "id"}
    if "synopsis" in new:
        new["synopsis"] = F.coalesce(F.nullif(F.trim("synopsis"), F.lit("")), F.when(hit, F.col("_synopsis")))
    new.setdefault("match_source", F.when(hit, "auto").otherwise(F.col("match_source")))
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in [*films.columns, *extra]])


def write_misses(films: DataFrame, outcomes: DataFrame, version: int) -> DataFrame:
    """Looked up and not found: tried, with the matcher's version; errors leave a film as it is."""
    j = films.join(outcomes.select("id", F.col("reason").alias("_r")), "id", "left")
    missed = F.coalesce(F.col("_r").isin("no-candidates", "low-confidence"), F.lit(False))
    return j.withColumns({"match_source": F.when(missed, "none-attempted").otherwise(F.col("match_source")), "match_version": F.when(missed, version).otherwise(F.col("match_version"))}).drop("_r")


def reopen(films: DataFrame, chosen: Column) -> DataFrame:
    again = (F.col("match_source") == "none-attempted") & chosen
    return films.withColumn("match_version", F.when(~again, F.col("match_version")))


def set_flag(films: DataFrame, decisions: DataFrame, flag: str) -> DataFrame:
    """The flag as the decisions (id, value) say; other films as they are."""
    return films.join(decisions.select("id", F.col("value").alias("_v")), "id", "left").withColumn(flag, F.coalesce("_v", flag)).drop("_v")


def assign_by_hand(films: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, ext_id) decisions for films that are open; of films that then share an id the lowest takes it, and the others are gone."""
    d = decisions.select("id", F.col("ext_id").alias("_e"))
    j = films.join(d, "id", "left").withColumn("_e", F.when(F.col("match_source").isin("none", "none-attempted"), F.col("_e")))
    j = j.withColumns({"ext_id": F.coalesce("_e", "ext_id"), "match_source": F.when(F.col("_e").isNotNull(), "manual").otherwise(F.col("match_source"))})
    touched = F.max(F.col("_e").isNotNull()).over(W.partitionBy("ext_id"))
    lowest = F.min("id").over(W.partitionBy("ext_id"))
    kept = j.withColumn("_gone", F.col("ext_id").isNotNull() & touched & (F.col("id") != lowest))
    kept = kept.withColumn("match_source", F.when(F.col("ext_id").isNotNull() & touched, "manual").otherwise(F.col("match_source")))
    return kept.filter(~F.col("_gone")).drop("_e", "_gone")


def latest_state(runs: DataFrame) -> DataFrame:
    """Each source's state from its run log: last run, last success with its counts, error unless the last succeeded."""
    key, ok = F.struct("started_at", "id"), F.col("status") == "success"
    return runs.groupBy("source").agg(
        F.max("started_at").alias("last_run_at"), F.max(F.when(ok, F.col("started_at"))).alias("last_success_at"), F.max_by("scraped", F.when(ok, key)).alias("screening_count"),
        F.when(F.max_by("status", key) == "failure", F.max_by("warning", key)).alias("last_error"),
    )


def fold_run_events(events: DataFrame) -> DataFrame:
    """start / finish / fail events of runs as one row for each run."""
    first = F.min(F.when(F.col("event") == "start", F.col("at")))
    last = F.max(F.when(F.col("event") != "start", F.col("at")))
    status = F.coalesce(F.max_by(F.when(F.col("event") == "finish", "success").otherwise("failure"), F.when(F.col("event") != "start", F.struct("at", "event"))), F.lit("in-progress"))
    return events.groupBy("run_id").agg(first.alias("started_at"), last.alias("finished_at"), status.alias("status"), F.timestamp_diff("SECOND", first, last).alias("seconds"))


def catalog_delta(details: DataFrame) -> DataFrame:
    """An external detail record as catalog columns."""
    return details.select(
        "id", F.get("countries", F.lit(0))["code"].alias("country"),
        F.nullif(F.concat_ws(", ", F.transform(F.filter("crew", lambda c: c["job"] == "Director"), lambda c: c["name"])), F.lit("")).alias("director"),
        F.substring("released", 1, 4).try_cast("int").alias("year"), F.concat(F.lit("/w500"), "poster").alias("poster_url"), F.coalesce(F.nullif(F.trim("overview"), F.lit("")), "overview_en").alias("synopsis"),
        F.nullif(F.trim("tagline"), F.lit("")).alias("tagline"), F.transform(F.slice(F.array_sort(F.transform("cast", lambda c: F.struct(c["order"].alias("o"), c["name"].alias("n")))), 1, 8), lambda c: c["n"]).alias("billed"),
    )


def seed_if_absent(current: DataFrame, seeds: DataFrame, key: str = "id") -> DataFrame:
    return current.unionByName(seeds.join(current, key, "left_anti"))


#: Snapshots that hold the programme, and those that outlive it.
PROGRAMME, STANDING = ("films", "screenings", "runs"), ("venues", "sources", "overrides")


def reset_programme(snapshots: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The next snapshots after a reset: films, screenings and runs without rows, all others as they are."""
    return {name: s.filter(F.lit(False)) if name in PROGRAMME else s for name, s in snapshots.items()}


#: Why a listing has no match, other than an error.
MISSES = ("no-candidates", "low-confidence")


def enrich(films: DataFrame, outcomes: DataFrame, version: int) -> DataFrame:
    """Films after a resolution: outcomes (scraped_title, scraped_year, ext_id, and a reason and catalog columns, if there are any) that have an id are written as matches, misses
    as tried by this version of the matcher; errors leave a film as it is."""
    o = outcomes.withColumnsRenamed({"scraped_title": "_t", "scraped_year": "_y"})
    o = o if "reason" in o.columns else o.withColumn("reason", F.when(F.col("ext_id").isNotNull(), "ok"))
    same = (F.col("scraped_title") == F.col("_t")) & F.col("scraped_year").eqNullSafe(F.col("_y"))
    known = o.join(films.select("id", "scraped_title", "scraped_year"), same).drop("_t", "_y", "scraped_title", "scraped_year")
    known = known.withColumn("_i", F.row_number().over(W.partitionBy("id").orderBy(F.col("ext_id").asc_nulls_last(), "reason"))).filter("_i = 1").drop("_i")
    out = write_matches(films, known.filter("ext_id IS NOT NULL").drop("reason"))
    if "match_version" not in out.columns:
        return out
    return write_misses(out, known.filter("ext_id IS NULL").select("id", "reason"), version)


def ingest(
    films: DataFrame,
    screenings: DataFrame,
    batch: DataFrame,
    now: datetime,
    found: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    version: int = 1,
    top: dict[str, int] | None = None,
) -> dict[str, DataFrame]:
    """A batch of canonical rows (scraped_title, scraped_year, venue_id, starts_at, program_name, ..., feed_pos) into the next
    snapshots, in this order: films; screenings, whose films are found by null-safe key; the resolution; films of one ext_id merged, and their screenings moved, which
    comes last so that ids stay valid until then. A second run of the batch changes nothing.

    `found` has the outcomes of a resolution (see `enrich`), or makes them from the films that wait for one: those neither matched nor skipped, and not tried by this `version` of the
    matcher. `top` has the greatest ids of films and screenings where the frames are parts of the snapshots.

    Returns films, screenings, summary (of each venue: scraped, distinct_rows, inserted, upserted), enrichment (one row: enriched, merged, skipped) and runs
    (of each venue: status, finished_at, scraped, warning; a venue that the breaker holds has failed).
    """
    top = top or {}
    key = lambda a: (F.col("scraped_title") == F.col(f"{a}._t")) & F.col("scraped_year").eqNullSafe(F.col(f"{a}._y"))
    fields = [c for c in ("director", "title_original", "runtime", "synopsis", "skip") if c in batch.columns]
    listed = batch.filter("scraped_title IS NOT NULL").select("scraped_title", "scraped_year", *fields, "feed_pos")
    next_films = saved(upsert_films(films, listed, top.get("films")), "films")  # read by all that follows
    ids = next_films.select(F.col("id").alias("film_id"), F.col("scraped_title").alias("_t"), F.col("scraped_year").alias("_y"))
    resolved = batch.join(ids.alias("i"), key("i"), "left").drop("_t", "_y")
    resolved = resolved.withColumn("program_name", text.drop_echo(F.col("program_name"), F.col("scraped_title")))
    next_screenings = replace_future(screenings, resolved, now, top.get("screenings"))
    counts = {c: F.lit(0).cast("long") for c in ("enriched", "merged", "skipped")}
    if found is not None:
        waits = F.col("match_source") == "none"
        if "match_version" in next_films.columns:
            waits = waits | ((F.col("match_source") == "none-attempted") & (F.coalesce("match_version", F.lit(-1)) < version))
        pending = next_films.filter(waits & ~F.coalesce("skip", F.lit(False)))
        next_films = saved(enrich(next_films, found(pending) if callable(found) else found, version), "enriched")
        asked = pending.select("id").join(next_films.select("id", "match_source"), "id")
        passed = asked.agg(F.count_if(F.col("match_source") == "auto").alias("enriched"), F.count_if(F.col("match_source") != "auto").alias("skipped")).first()
        counts |= {c: F.lit(passed[c]) for c in ("enriched", "skipped")}
    if "ext_id" in next_films.columns:
        losers = saved(winners(next_films, ["ext_id"]), "losers")
        next_screenings = merge_duplicates(next_screenings, losers)
        next_films = next_films.join(losers.select(F.col("film_id").alias("id")), "id", "left_anti")
        counts["merged"] = F.lit(losers.count())
    refused = refused_venues(screenings, resolved, now)
    by_venue = resolved.groupBy("venue_id").agg(
        F.count("scraped_title").alias("scraped"), F.countDistinct("scraped_title", "starts_at").alias("distinct_rows"), F.count("film_id").alias("inserted"), F.countDistinct("film_id").alias("upserted")
    )
    held = F.col("kept").isNotNull()
    warning = F.when(held, F.concat(F.lit("empty batch, kept "), "kept", F.lit(" future rows")))
    runs = by_venue.join(refused, "venue_id", "left").select("venue_id", F.when(held, "failure").otherwise("success").alias("status"), times.lit(now).alias("finished_at"), "scraped", warning.alias("warning"))
    enrichment = batch.sparkSession.range(1).select(*[v.alias(c) for c, v in counts.items()])
    return {"films": next_films, "screenings": next_screenings, "summary": by_venue, "enrichment": enrichment, "runs": runs}
