"""Snapshot maintenance on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from .roles import NOW, SQL, films, runs, screenings, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}
FUTURE = "starts_at >= TIMESTAMP '2024-01-15 12:00:00'"


def query(covers: str, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__], COVERS[f.__name__] = f, covers
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _current(spark, sf_dir):
    return films(spark, sf_dir).filter("id % 3 <> 1").selectExpr("id", "title AS scraped_title", "CASE WHEN id % 6 = 0 THEN NULL ELSE year END AS scraped_year", "director", "concat('Orig ', id) AS title_original", "runtime", "concat('old ', id) AS synopsis", "skip", "match_source")


def _incoming(spark, sf_dir):
    return films(spark, sf_dir).filter("id % 2 = 0").selectExpr("title AS scraped_title", "CASE WHEN id % 6 = 0 THEN NULL ELSE year END AS scraped_year", "CASE WHEN id % 4 = 0 THEN 'New Dir' END AS director", "CASE WHEN id % 10 = 0 THEN 'New Orig' END AS title_original",
                                                               "cast(NULL AS int) AS runtime", "CASE WHEN id % 5 = 0 THEN concat('new ', id) END AS synopsis", "true AS skip", "cast(id AS int) AS feed_pos")


UPSERT = SQL + """
, c AS (SELECT id, title, CASE WHEN id % 6 = 0 THEN NULL ELSE year END AS y, director, 'Orig ' || id AS original, runtime, 'old ' || id AS synopsis, skip, match_source FROM f WHERE id % 3 <> 1),
n AS (SELECT id AS pos, title, CASE WHEN id % 6 = 0 THEN NULL ELSE year END AS y, CASE WHEN id % 4 = 0 THEN 'New Dir' END AS director, CASE WHEN id % 10 = 0 THEN 'New Orig' END AS original, CASE WHEN id % 5 = 0 THEN 'new ' || id END AS synopsis FROM f WHERE id % 2 = 0),
j AS (SELECT c.id, coalesce(c.title, n.title) AS scraped_title, coalesce(c.y, n.y) AS scraped_year, CASE WHEN c.match_source IN ('manual', 'auto', 'override') THEN c.director ELSE coalesce(n.director, c.director) END AS director,
  CASE WHEN c.match_source IN ('manual', 'auto', 'override') THEN c.original ELSE coalesce(n.original, c.original) END AS title_original, c.original AS oo,
  c.runtime, coalesce(n.synopsis, c.synopsis) AS synopsis, coalesce(c.skip, true) AS skip, c.director AS od, c.synopsis AS os, c.match_source AS ms, n.pos FROM c FULL JOIN n ON c.title = n.title AND c.y IS NOT DISTINCT FROM n.y),
u AS (SELECT coalesce(id, (SELECT max(id) FROM c) + row_number() OVER (PARTITION BY id IS NULL ORDER BY pos)) AS id, scraped_title, scraped_year, director, title_original, runtime, synopsis, skip,
  CASE WHEN id IS NULL THEN 'none' WHEN ms = 'none-attempted' AND (director IS DISTINCT FROM od OR title_original IS DISTINCT FROM oo OR synopsis IS DISTINCT FROM os) THEN 'none' ELSE ms END AS match_source FROM j)
"""


@query("M-1 M-2 M-3 J-6 J-7 W-2", UPSERT + "SELECT * FROM u")
def gated_upsert(spark, sf_dir):
    return C.upsert_films(_current(spark, sf_dir), _incoming(spark, sf_dir))


@query("M-1 M-2 A-30", UPSERT + "SELECT count(*) AS films, count(DISTINCT id) AS ids, count_if(match_source = 'none') AS open FROM u")
def upsert_twice(spark, sf_dir):
    once = C.upsert_films(_current(spark, sf_dir), _incoming(spark, sf_dir))
    twice = C.upsert_films(once, _incoming(spark, sf_dir))
    return twice.agg(F.count("*").alias("films"), F.countDistinct("id").alias("ids"), F.count_if(F.col("match_source") == "none").alias("open"))


def _batch(spark, sf_dir):
    """Half of some venues' showings an hour later, one programme twice; venue 5's batch is empty."""
    s = screenings(spark, sf_dir).filter("venue_id % 4 = 1 AND venue_id <> 5 AND k % 3 = 0").selectExpr("film_id", "venue_id", "starts_at + INTERVAL 1 HOUR AS starts_at", "program_name", "id AS feed_pos")
    again = s.selectExpr("film_id", "venue_id", "starts_at", "'Again' AS program_name", "feed_pos + 1000000000 AS feed_pos").filter("feed_pos % 10 = 0")
    empty = spark.range(1).selectExpr("cast(NULL AS long) AS film_id", "5 AS venue_id", "cast(NULL AS timestamp_ntz) AS starts_at", "cast(NULL AS string) AS program_name", "0L AS feed_pos")
    return s.unionByName(again).unionByName(empty)


BATCH = SQL + """, b AS (SELECT film_id, venue_id, starts_at + INTERVAL 1 HOUR AS starts_at, program_name, id AS pos FROM s WHERE venue_id % 4 = 1 AND venue_id <> 5 AND k % 3 = 0),
i AS (SELECT * FROM b UNION ALL SELECT film_id, venue_id, starts_at, 'Again', pos + 1000000000 FROM b WHERE (pos + 1000000000) % 10 = 0)
"""


REPLACED = """
, o AS (SELECT id, film_id, venue_id, starts_at, program_name, tags, -1 AS pos FROM s WHERE starts_at < TIMESTAMP '2024-01-15 12:00:00' OR venue_id NOT IN (SELECT venue_id FROM i)),
a AS (SELECT max(id) OVER k AS id, film_id, venue_id, starts_at, program_name, tags, pos FROM (SELECT * FROM o UNION ALL SELECT NULL, film_id, venue_id, starts_at, program_name, tags, pos FROM i)
  WINDOW k AS (PARTITION BY film_id, venue_id, starts_at) QUALIFY row_number() OVER (PARTITION BY film_id, venue_id, starts_at ORDER BY pos DESC, program_name NULLS FIRST, id NULLS FIRST) = 1),
x AS (SELECT coalesce(id, (SELECT max(id) FROM s) + row_number() OVER (PARTITION BY id IS NULL ORDER BY pos, film_id, venue_id, starts_at)) AS id, film_id, venue_id, starts_at, program_name, tags FROM a)
"""


@query("M-4 M-5", BATCH.replace("program_name, id AS pos", "program_name, ['new'] AS tags, id AS pos").replace("'Again', pos", "'Again', tags, pos") + REPLACED + "SELECT id, film_id, venue_id, starts_at, program_name, array_to_string(tags, ',') AS tags FROM x")
def replace_future_snapshot(spark, sf_dir):
    current = screenings(spark, sf_dir).select("id", "film_id", "venue_id", "starts_at", "program_name", "tags")
    batch = _batch(spark, sf_dir).withColumn("tags", F.array(F.lit("new")))
    return C.replace_future(current, batch, NOW).withColumn("tags", F.array_join("tags", ","))


@query("M-5", BATCH + f"SELECT venue_id, count(*) AS kept FROM s WHERE venue_id = 5 AND {FUTURE} GROUP BY 1")
def breaker(spark, sf_dir):
    return C.refused_venues(screenings(spark, sf_dir), _batch(spark, sf_dir), NOW)


@query("W-14 M-6 M-7 A-22 J-12", """
WITH p AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS winner FROM part), l AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, l_suppkey AS venue_id, l_shipdate AS starts_at FROM lineitem)
SELECT l.id, winner AS film_id, venue_id, starts_at FROM l JOIN p ON l_partkey = p.id QUALIFY row_number() OVER (PARTITION BY winner, venue_id, starts_at ORDER BY winner <> l_partkey, l.id) = 1""")
def merge_duplicates(spark, sf_dir):
    losers = C.winners(table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name", "p_brand"), ["p_name", "p_brand"])
    facts = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", "l_partkey AS film_id", "l_suppkey AS venue_id", "l_shipdate AS starts_at")
    return C.merge_duplicates(facts, losers).select("id", "film_id", "venue_id", "starts_at")


@query("A-22", "SELECT p_name, p_brand, min(p_partkey) AS winner, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_clusters(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("winner"), F.count("*").alias("n")).filter("n > 1")


@query("W-5 S-5 M-21", """
WITH p AS (SELECT p_partkey AS id, replace(p_name, ' ', '-') AS base, CASE WHEN p_partkey % 50 = 7 THEN 'kept-' || p_partkey END AS slug FROM part)
SELECT id, coalesce(slug, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY slug IS NULL, id) = 1 THEN base ELSE base || '-' || id END) AS slug FROM p""")
def slug_collision(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS title", "CASE WHEN p_partkey % 50 = 7 THEN concat('kept-', p_partkey) END AS slug")
    return C.assign_slugs(p).select("id", "slug")


OVERRIDES = SQL + """, h AS (SELECT segment AS title, CASE WHEN id % 2 = 0 THEN year END AS year, id AS ext_id FROM f WHERE id % 40 = 2), m AS (SELECT segment AS title, CASE WHEN id % 2 = 0 THEN year END AS year, id AS ext_id FROM f WHERE id % 5 = 1),
o AS (SELECT title, year, ext_id FROM (SELECT *, 0 AS p FROM h UNION ALL SELECT *, 1 FROM m) QUALIFY row_number() OVER (PARTITION BY title, year ORDER BY p, ext_id) = 1)
"""


def _overrides(spark, sf_dir):
    f = films(spark, sf_dir).selectExpr("segment AS title", "CASE WHEN id % 2 = 0 THEN year END AS year", "id AS ext_id", "id")
    return C.with_precedence(f.filter("id % 40 = 2").drop("id"), f.filter("id % 5 = 1").drop("id"), keys=["title", "year"], order="ext_id")


@query("U-1 M-12 M-13", OVERRIDES + "SELECT * FROM o")
def override_precedence(spark, sf_dir):
    return _overrides(spark, sf_dir)


@query("J-8", OVERRIDES + "SELECT f.id, coalesce(a.ext_id, b.ext_id) AS override_id FROM f LEFT JOIN o a ON a.title = f.segment AND a.year = f.year LEFT JOIN o b ON b.title = f.segment AND b.year IS NULL")
def override_lookup(spark, sf_dir):
    f = films(spark, sf_dir).selectExpr("id", "segment AS title", "year")
    return C.lookup_override(f, _overrides(spark, sf_dir)).select("id", "override_id")


@query("M-12", SQL + "SELECT segment AS title, CASE WHEN id % 7 = 0 THEN NULL ELSE year END AS year, max(id + (CASE WHEN id % 2 = 0 THEN 1000000 ELSE 0 END)) % 1000000 AS ext_id FROM f GROUP BY 1, 2")
def override_upsert(spark, sf_dir):
    f = films(spark, sf_dir).selectExpr("segment AS title", "CASE WHEN id % 7 = 0 THEN NULL ELSE year END AS year", "id")
    side = lambda rest: f.filter(f"id % 2 = {rest}").groupBy("title", "year").agg(F.max("id").alias("ext_id"))
    return C.upsert_keyed(side(1), side(0), ["title", "year"])


@query("M-8 M-11", SQL + """
SELECT f.id, coalesce(CASE WHEN id % 4 = 1 THEN id + 5000 END, ext_id) AS ext_id, CASE WHEN id % 4 = 1 THEN 'Cat ' || id ELSE title END AS title, CASE WHEN id % 8 = 1 THEN 2001 ELSE year END::INT AS year,
  CASE WHEN id % 3 = 0 THEN 'venue ' || id WHEN id % 4 = 1 THEN 'cat ' || id ELSE NULL END AS synopsis, CASE WHEN id % 4 = 1 THEN 99 ELSE runtime END::INT AS runtime, CASE WHEN id % 4 = 1 THEN 'auto' ELSE match_source END AS match_source,
  CASE WHEN id % 12 = 1 THEN 'Cat Dir' ELSE director END AS director, country, hidden, skip, CASE WHEN id % 4 = 1 THEN '/w500/' || id ELSE poster END AS poster, CASE WHEN id % 4 = 1 THEN 7.5 ELSE popularity END::DOUBLE AS popularity,
  CASE WHEN id % 4 = 1 THEN 4242 ELSE vote_count END::BIGINT AS vote_count, CASE WHEN id % 4 = 1 THEN 'Line' END AS tagline, CASE WHEN id % 4 = 1 THEN 'Ana|Eva' END AS cast_names, CASE WHEN id % 4 = 1 THEN '18,35' END AS genres FROM f""")
def enrichment_write(spark, sf_dir):
    f = films(spark, sf_dir).withColumn("synopsis", F.expr("CASE WHEN id % 3 = 0 THEN concat('venue ', id) ELSE '  ' END"))
    found = f.filter("id % 4 = 1").selectExpr(
        "id", "id + 5000 AS ext_id", "concat('Cat ', id) AS title", "CASE WHEN id % 8 = 1 THEN 2001 END AS year", "concat('cat ', id) AS synopsis", "99 AS runtime", "CASE WHEN id % 12 = 1 THEN 'Cat Dir' END AS director",
        "concat('/w500/', id) AS poster", "7.5D AS popularity", "4242L AS vote_count", "'Line' AS tagline", "array('Ana', 'Eva') AS cast_names", "array(18, 35) AS genres",
    )
    out = C.write_matches(f, found).withColumns({"cast_names": F.array_join("cast_names", "|"), "genres": F.array_join("genres", ",")})
    return out.select("id", "ext_id", "title", "year", "synopsis", "runtime", "match_source", "director", "country", "hidden", "skip", "poster", "popularity", "vote_count", "tagline", "cast_names", "genres")


@query("M-9 M-10", SQL + """
SELECT id, CASE WHEN id % 3 = 0 THEN 'none-attempted' ELSE match_source END AS match_source, CASE WHEN (id % 3 = 0 OR match_source = 'none-attempted') AND country = 'PERU' THEN NULL WHEN id % 3 = 0 THEN 7 ELSE match_version END::INT AS match_version FROM f""")
def miss_write_and_reopen(spark, sf_dir):
    f = films(spark, sf_dir)
    outcomes = f.filter("id % 3 < 2").selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'low-confidence' ELSE 'error' END AS reason")
    return C.reopen(C.write_misses(f, outcomes, 7), F.col("country") == "PERU").select("id", "match_source", "match_version")


@query("M-14", SQL + """
, d AS (SELECT *, CASE WHEN match_source IN ('none', 'none-attempted') AND id % 6 = 1 THEN id % 20 END AS e FROM f), x AS (SELECT id, coalesce(e, ext_id) AS ext_id, CASE WHEN e IS NOT NULL THEN 'manual' ELSE match_source END AS ms, e FROM d),
y AS (SELECT *, bool_or(e IS NOT NULL) OVER (PARTITION BY ext_id) AS t, min(id) OVER (PARTITION BY ext_id) AS l FROM x)
SELECT id, ext_id, CASE WHEN ext_id IS NOT NULL AND t THEN 'manual' ELSE ms END AS match_source FROM y WHERE NOT (ext_id IS NOT NULL AND t AND id <> l)""")
def manual_assign(spark, sf_dir):
    f = films(spark, sf_dir)
    decisions = f.filter("id % 6 = 1").selectExpr("id", "id % 20 AS ext_id")
    return C.assign_by_hand(f, decisions).select("id", "ext_id", "match_source")


@query("M-15 M-16", SQL + "SELECT id, CASE WHEN id % 5 = 0 THEN id % 2 = 0 ELSE hidden END AS hidden, CASE WHEN id % 9 = 0 THEN true ELSE skip END AS skip FROM f")
def hide_and_skip(spark, sf_dir):
    f = films(spark, sf_dir)
    hidden = C.set_flag(f, f.filter("id % 5 = 0").selectExpr("id", "id % 2 = 0 AS value"), "hidden")
    return C.set_flag(hidden, f.filter("id % 9 = 0").selectExpr("id", "true AS value"), "skip").select("id", "hidden", "skip")


@query("M-17", SQL + """
SELECT source, max(started_at) AS last_run_at, max(started_at) FILTER (WHERE status = 'success') AS last_success_at, arg_max(scraped, (started_at, id)) FILTER (WHERE status = 'success') AS screening_count,
  CASE WHEN arg_max(status, (started_at, id)) = 'failure' THEN arg_max(warning, (started_at, id)) END AS last_error FROM r GROUP BY source""")
def source_state(spark, sf_dir):
    return C.latest_state(runs(spark, sf_dir))


@query("M-18", """
WITH e AS (SELECT l_orderkey AS run_id, CASE WHEN l_linenumber = 1 THEN 'start' WHEN l_linenumber % 2 = 0 THEN 'finish' ELSE 'fail' END AS event, l_shipdate + to_minutes(l_linenumber) AS t FROM lineitem)
SELECT run_id, min(t) FILTER (WHERE event = 'start') AS started_at, max(t) FILTER (WHERE event <> 'start') AS finished_at,
  coalesce(CASE arg_max(event, (t, event)) FILTER (WHERE event <> 'start') WHEN 'finish' THEN 'success' WHEN 'fail' THEN 'failure' END, 'in-progress') AS status,
  epoch(max(t) FILTER (WHERE event <> 'start') - min(t) FILTER (WHERE event = 'start'))::BIGINT AS seconds FROM e GROUP BY run_id""")
def run_log_fold(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS run_id", "CASE WHEN l_linenumber = 1 THEN 'start' WHEN l_linenumber % 2 = 0 THEN 'finish' ELSE 'fail' END AS event", "l_shipdate + make_interval(0, 0, 0, 0, 0, l_linenumber) AS at")
    return C.fold_run_events(e)


@query("J-16", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def seed_venues(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name")
    return C.seed_if_absent(s.filter("id % 2 = 0"), s.withColumn("name", F.expr("CASE WHEN id % 2 = 0 THEN 'seed' ELSE name END")))


@query("M-22 T-9", SQL + """
SELECT id, country, CASE WHEN id % 2 = 0 THEN 'Ana, Eva' END AS director, year, '/w500' || poster AS poster_url, CASE WHEN id % 3 = 0 THEN 'es ' || id ELSE 'en' END AS synopsis, NULL::VARCHAR AS tagline, 'A|B' AS billed FROM f""")
def catalog_projection(spark, sf_dir):
    d = films(spark, sf_dir).selectExpr(
        "id", "array(named_struct('code', country)) AS countries", "CASE WHEN id % 2 = 0 THEN array(named_struct('job', 'Director', 'name', 'Ana'), named_struct('job', 'Editor', 'name', 'X'), named_struct('job', 'Director', 'name', 'Eva')) ELSE array(named_struct('job', 'Editor', 'name', 'X')) END AS crew",
        "concat(year, '-05-01') AS released", "poster", "CASE WHEN id % 3 = 0 THEN concat('es ', id) ELSE ' ' END AS overview", "'en' AS overview_en", "' ' AS tagline", "array(named_struct('order', 2, 'name', 'B'), named_struct('order', 1, 'name', 'A')) AS cast")
    return C.catalog_delta(d).withColumn("billed", F.array_join("billed", "|"))


INGEST = SQL + """
, b AS (SELECT f.id AS fid, title, CASE WHEN f.id % 6 = 0 THEN NULL ELSE year END AS y, venue_id, starts_at, program_name, s.tags, s.id AS pos FROM s JOIN f ON film_id = f.id WHERE venue_id % 4 = 1 AND venue_id <> 5 AND k % 3 = 0),
c AS (SELECT id, title, CASE WHEN id % 6 = 0 THEN NULL ELSE year END AS y, CASE WHEN id % 4 = 0 THEN id % 50 END AS ext FROM f WHERE id % 3 <> 1), n AS (SELECT title, y, min(pos) AS pos FROM b GROUP BY 1, 2),
u AS (SELECT coalesce(c.id, (SELECT max(id) FROM c) + row_number() OVER (PARTITION BY c.id IS NULL ORDER BY n.pos)) AS id, coalesce(c.title, n.title) AS title, coalesce(c.y, n.y) AS y, ext FROM c FULL JOIN n ON c.title = n.title AND c.y IS NOT DISTINCT FROM n.y),
m AS (SELECT u.id, u.title, u.y, coalesce(CASE WHEN f.id % 5 = 0 THEN f.id % 50 END, ext) AS ext_id FROM u JOIN f ON f.title = u.title), w AS (SELECT *, CASE WHEN ext_id IS NULL THEN id ELSE min(id) OVER (PARTITION BY ext_id) END AS winner FROM m),
i AS (SELECT u.id AS film_id, venue_id, starts_at, program_name, b.tags, pos FROM b JOIN u ON b.title = u.title)
""" + REPLACED + """
, z AS (SELECT x.id, coalesce(winner, film_id) AS film_id, venue_id, starts_at, program_name, coalesce(winner <> film_id, false) AS moved FROM x LEFT JOIN w ON w.id = film_id)
"""


def _ingested(spark, sf_dir):
    """A batch of some venues, of known and of new films, with an empty one of venue 5; and ids for every fifth film."""
    f = films(spark, sf_dir).selectExpr("id AS fid", "title AS scraped_title", "CASE WHEN id % 6 = 0 THEN NULL ELSE year END AS scraped_year")
    s = screenings(spark, sf_dir).filter("venue_id % 4 = 1 AND venue_id <> 5 AND k % 3 = 0").select("film_id", "venue_id", "starts_at", "program_name", "tags", F.col("id").cast("int").alias("feed_pos"))
    none = {c: F.lit(None).cast(t) for c, t in (("director", "string"), ("runtime", "int"), ("synopsis", "string"))}
    batch = s.join(f, F.expr("film_id = fid")).drop("film_id", "fid").withColumns({**none, "skip": F.lit(False)})
    empty = spark.range(1).selectExpr("5 AS venue_id", "0 AS feed_pos", "false AS skip")
    current = _current(spark, sf_dir).withColumn("ext_id", F.expr("CASE WHEN id % 4 = 0 THEN id % 50 END"))
    found = f.filter("fid % 5 = 0").selectExpr("scraped_title", "scraped_year", "fid % 50 AS ext_id")
    shows = screenings(spark, sf_dir).select("id", "film_id", "venue_id", "starts_at", "program_name", "tags")
    return C.ingest(current, shows, batch.unionByName(empty, allowMissingColumns=True), NOW, found)


@query("R-6 J-6 M-7", INGEST + "SELECT id, title AS scraped_title, y AS scraped_year, ext_id FROM w WHERE id = winner")
def ingest_films(spark, sf_dir):
    return _ingested(spark, sf_dir)["films"].select("id", "scraped_title", "scraped_year", "ext_id")


@query("R-6 M-6 S-15", INGEST + "SELECT id, film_id, venue_id, starts_at, program_name FROM z QUALIFY row_number() OVER (PARTITION BY film_id, venue_id, starts_at ORDER BY moved, id) = 1")
def ingest_screenings(spark, sf_dir):
    return _ingested(spark, sf_dir)["screenings"].select("id", "film_id", "venue_id", "starts_at", "program_name")


@query("R-6 A-30", INGEST + """
, p AS (SELECT f.id FROM m JOIN f ON f.title = m.title WHERE f.id % 3 = 1 OR (f.match_source = 'none' AND NOT f.skip)),
g AS (SELECT venue_id, count(*) AS scraped, count(DISTINCT (title, starts_at)) AS distinct_rows, count(*) AS inserted, count(DISTINCT (title, y)) AS upserted FROM b GROUP BY 1 UNION ALL SELECT 5, 0, 0, 0, 0)
SELECT *, (SELECT count_if(id % 5 = 0) FROM p) AS enriched, (SELECT count(*) FROM w WHERE id <> winner) AS merged, (SELECT count_if(id % 5 > 0) FROM p) AS skipped FROM g""")
def ingest_summary(spark, sf_dir):
    out = _ingested(spark, sf_dir)
    return out["summary"].withColumns({c: out["enrichment"].select(c).scalar() for c in ("enriched", "merged", "skipped")})


@query("R-6 M-18 M-5", INGEST + f"""SELECT venue_id, 'success' AS status, TIMESTAMP '2024-01-15 12:00:00' AS finished_at, count(*) AS scraped, NULL AS warning FROM b GROUP BY 1
UNION ALL SELECT 5, CASE WHEN n > 0 THEN 'failure' ELSE 'success' END, TIMESTAMP '2024-01-15 12:00:00', 0, CASE WHEN n > 0 THEN 'empty batch, kept ' || n || ' future rows' END FROM (SELECT count(*) AS n FROM s WHERE venue_id = 5 AND {FUTURE})""")
def ingest_runs(spark, sf_dir):
    return _ingested(spark, sf_dir)["runs"]
