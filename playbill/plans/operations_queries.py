"""Audit, statistics and evaluation queries on the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import operations as O
from .roles import NOW, NOW_LONG, SQL, films, runs, screenings, table, venues

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}
FUTURE = "starts_at > TIMESTAMP '2024-01-15 12:00:00'"
LOCAL_DAY = "CAST(starts_at - INTERVAL 3 HOURS AS DATE)"


def query(covers: str, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__], COVERS[f.__name__] = f, covers
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def facts(spark, sf_dir):
    """lineitem as a large table of screenings by day."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS film_id", "l_suppkey AS venue_id", "to_date(l_shipdate) AS day")


@query("A-8 A-10 N-1", """
WITH x AS (SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS v FROM lineitem GROUP BY 1)
SELECT sum(n)::BIGINT AS screenings, count(*) AS films, count_if(v = 1) AS single_venue, count_if(n = 1) AS single_showtime, round(100.0 * count_if(v = 1) / count(*), 6) AS single_venue_pct,
  round(100.0 * count_if(n = 1) / count(*), 6) AS single_showtime_pct, round(avg(n), 6) AS mean_n, median(n) AS median_n, max(n) AS max_n, count_if(n = 1) AS b1,
  count_if(n BETWEEN 2 AND 3) AS b2_3, count_if(n BETWEEN 4 AND 6) AS b4_6, count_if(n BETWEEN 7 AND 10) AS b7_10, count_if(n > 10) AS b11 FROM x""")
def shape_report(spark, sf_dir):
    return O.shape(facts(spark, sf_dir))


@query("A-9", "SELECT n_venues, count(*) AS n FROM (SELECT l_partkey, count(DISTINCT l_suppkey) AS n_venues FROM lineitem GROUP BY 1) GROUP BY 1")
def venues_per_film_hist(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("film_id").agg(F.countDistinct("venue_id").alias("n_venues")).groupBy("n_venues").agg(F.count("*").alias("n"))


@query("A-11", SQL + f"SELECT count_if(n = 1) AS once, count_if(n > 1) AS more FROM (SELECT film_id, kind, {LOCAL_DAY} AS day, count(*) AS n FROM s GROUP BY 1, 2, 3)")
def within_day_repetition(spark, sf_dir):
    return O.repetition(screenings(spark, sf_dir).withColumn("day", times.local_day(F.col("starts_at"))), ["film_id", "kind", "day"])


@query("A-12", """
WITH x AS (SELECT l_suppkey AS venue_id, l_partkey AS film_id, count(*) AS n, count(DISTINCT l_shipdate) AS d FROM lineitem GROUP BY 1, 2)
SELECT venue_id, sum(n)::BIGINT AS screenings, count(*) AS films, round(sum(n) / count(*), 6) AS ratio, arg_max(film_id, (n, -film_id)) AS top_film, max(n) AS top_n, max(d) AS max_days, count_if(d >= 3) AS films_3_days
FROM x GROUP BY venue_id""")
def venue_redundancy(spark, sf_dir):
    return O.redundancy(facts(spark, sf_dir)).orderBy(F.col("ratio").desc(), "venue_id")


@query("A-13", SQL + "SELECT count(*) AS n, count_if(list_contains(tags, 'premiere')) AS premiere, count_if(list_contains(tags, 'vos')) AS vos, count_if(len(tags) = 0) AS untagged FROM s")
def tag_coverage(spark, sf_dir):
    has = lambda t: F.count_if(F.array_contains("tags", t)).alias(t)
    return screenings(spark, sf_dir).agg(F.count("*").alias("n"), has("premiere"), has("vos"), F.count_if(F.size("tags") == 0).alias("untagged"))


@query("A-14 T-6", SQL + "".join(
    f"{' UNION ALL ' if i else ''}SELECT * FROM (SELECT '{k}' AS profile, {v} AS value, count(*) AS n FROM {t} GROUP BY 2 ORDER BY n DESC, value LIMIT 15)"
    for i, (k, v, t) in enumerate((("country", "country", "f"), ("decade", "(year // 10 * 10)::VARCHAR", "f"), ("director", "director", "(SELECT * FROM f WHERE director IS NOT NULL)"), ("genre", "w", "(SELECT unnest(string_split(p_name, ' ')) AS w FROM part)")))))
def catalog_profile(spark, sf_dir):
    f, out = films(spark, sf_dir), None
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w"))
    for name, df, value in (("country", f, F.col("country")), ("decade", f, (F.floor(F.col("year") / 10) * 10).cast("string")), ("director", f.filter("director IS NOT NULL"), F.col("director")), ("genre", words, F.col("w"))):
        part = O.top_values(df, value).select(F.lit(name).alias("profile"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("A-14", SQL + "SELECT round(avg((country = 'ARGENTINA')::INT), 6) AS local_share, round(avg((year < 1980)::INT), 6) AS old_share FROM f")
def catalog_shares(spark, sf_dir):
    share = lambda c: O.r6(F.avg(c.cast("int")))
    return films(spark, sf_dir).agg(share(F.col("country") == "ARGENTINA").alias("local_share"), share(F.col("year") < 1980).alias("old_share"))


@query("A-17", SQL + "SELECT match_source, count(*) AS n, count_if(ext_id IS NULL) AS missing FROM f GROUP BY 1")
def state_distribution(spark, sf_dir):
    return films(spark, sf_dir).groupBy("match_source").agg(F.count("*").alias("n"), F.count_if(F.col("ext_id").isNull()).alias("missing"))


PENDING = SQL + """, p AS (SELECT f.* FROM f WHERE NOT skip AND NOT hidden AND EXISTS (SELECT 1 FROM s WHERE s.film_id = f.id AND starts_at >= TIMESTAMP '2024-01-15 12:00:00') AND (
  match_source = 'none' OR (match_source = 'none-attempted' AND (ext_id IS NOT NULL OR match_version IS NULL OR match_version < 2)) OR (match_source = 'manual' AND ext_id IS NOT NULL AND poster IS NULL)))
"""


@query("P-5 J-3 A-16", PENDING + "SELECT id, title, match_source FROM p")
def pending_pool(spark, sf_dir):
    return O.pending_pool(films(spark, sf_dir), screenings(spark, sf_dir), NOW, 2).select("id", "title", "match_source")


@query("A-16", PENDING + "SELECT count(DISTINCT id) AS n FROM p")
def pending_count(spark, sf_dir):
    return O.pending_pool(films(spark, sf_dir), screenings(spark, sf_dir), NOW, 2).agg(F.countDistinct("id").alias("n"))


@query("A-18 J-5", SQL + """
, p AS (SELECT f.id, match_source, EXISTS (SELECT 1 FROM s WHERE s.film_id = f.id AND starts_at >= TIMESTAMP '2024-01-15 12:00:00') AS active FROM f WHERE match_source IN ('none', 'none-attempted'))
SELECT active, match_source, count(*) AS n FROM p GROUP BY 1, 2""")
def pool_split(spark, sf_dir):
    coming = screenings(spark, sf_dir).filter(F.col("starts_at") >= times.lit(NOW)).select(F.col("film_id").alias("id"), F.lit(True).alias("active")).distinct()
    pool = films(spark, sf_dir).filter(F.col("match_source").isin("none", "none-attempted")).join(coming, "id", "left").fillna(False, ["active"])
    return pool.groupBy("active", "match_source").agg(F.count("*").alias("n"))


@query("A-15 P-6 R-5", SQL + f"""
SELECT film_id, f.title, count(*) AS n, string_agg(DISTINCT v.name, '|' ORDER BY v.name) AS venues FROM s JOIN f ON film_id = f.id JOIN v ON venue_id = v.id
WHERE {FUTURE} AND ext_id IS NULL AND NOT skip AND NOT hidden GROUP BY ALL""")
def stuck_list(spark, sf_dir):
    return O.stuck_list(films(spark, sf_dir), screenings(spark, sf_dir), venues(spark, sf_dir), NOW)


@query("P-11", SQL + "SELECT count_if(ext_id IS NOT NULL) AS matched, count_if(skip) AS skipped, count_if(ext_id IS NULL AND match_source = 'auto') AS orphans, count_if(popularity < 0) AS low FROM f")
def match_predicates(spark, sf_dir):
    c = lambda e, n: F.count_if(F.expr(e)).alias(n)
    return films(spark, sf_dir).agg(c("ext_id IS NOT NULL", "matched"), c("skip", "skipped"), c("ext_id IS NULL AND match_source = 'auto'", "orphans"), c("popularity < 0", "low"))


@query("W-1 J-2", SQL + """
SELECT x.source, l.id, l.status FROM (SELECT unnest(range(15)) AS source) x LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id) AS i FROM r) l ON l.source = x.source AND l.i = 1""")
def latest_run_per_source(spark, sf_dir):
    last = O.latest_per_key(runs(spark, sf_dir), "source", "started_at")
    return spark.range(15).withColumnRenamed("id", "source").join(last.select("source", "id", "status"), "source", "left")


@query("A-21 R-5 Q-8", SQL + """
, d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id) AS i FROM r WHERE started_at < TIMESTAMP '1998-07-01' AND started_at >= TIMESTAMP '1998-06-30'),
l AS (SELECT * FROM d WHERE i = 1)
SELECT source, id, 'failure' AS alert FROM l WHERE status = 'failure'
UNION ALL SELECT source, id, 'stuck' FROM l WHERE status = 'in-progress' AND started_at < TIMESTAMP '1998-06-30 23:30:00'
UNION ALL SELECT source, id, 'warning: Circuit breaker: ' || warning FROM l WHERE warning LIKE '1%' OR warning LIKE '2%'""")
def run_alerts(spark, sf_dir):
    warned = F.when(F.col("warning").rlike("^[12]"), F.array(F.concat(F.lit("Circuit breaker: "), "warning"), F.lit("slow"))).otherwise(F.array(F.lit("slow")))
    return O.alerts(runs(spark, sf_dir).withColumn("warnings", warned), NOW_LONG)


@query("Q-8", SQL + "SELECT source, count_if(status = 'success') AS ok, count(*) AS n, count_if(status = 'success') || ' of ' || count(*) || ' ok' AS summary FROM r GROUP BY source")
def batch_summary(spark, sf_dir):
    g = runs(spark, sf_dir).groupBy("source").agg(F.count_if(F.col("status") == "success").alias("ok"), F.count("*").alias("n"))
    return g.withColumn("summary", F.concat("ok", F.lit(" of "), "n", F.lit(" ok")))


@query("A-20 K-5", SQL + """
, l AS (SELECT source, max(started_at) FILTER (WHERE status = 'success') AS last FROM r WHERE started_at < TIMESTAMP '1998-07-01' GROUP BY 1)
SELECT source, round(epoch(TIMESTAMP '1998-07-01' - last) / 3600.0, 6) AS age_hours, coalesce(epoch(TIMESTAMP '1998-07-01' - last) / 3600.0 > 26, true) AS stale, coalesce(epoch(TIMESTAMP '1998-07-01' - last) / 3600.0 < 8, false) AS skip FROM l""")
def freshness(spark, sf_dir):
    return O.freshness(runs(spark, sf_dir).filter(F.col("started_at") < times.lit(NOW_LONG)), NOW_LONG)


@query("A-19 M-19", "SELECT count(*) AS n_runs, coalesce(sum(CAST(json_extract(props, '$.k') AS INT)), 0)::BIGINT AS stuck, coalesce(sum(user_id), 0)::BIGINT AS applied FROM events WHERE ts >= TIMESTAMP '2024-01-08 12:00:00' AND ts < TIMESTAMP '2024-01-15 12:00:01'")
def trailing_trend(spark, sf_dir):
    m = screenings(spark, sf_dir).selectExpr("starts_at AS ran_at", "cast(k AS long) AS stuck", "film_id AS applied")
    return O.trailing(m, NOW, ["stuck", "applied"])


@query("A-23 S-22", """
WITH m AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'FESTIVAL NORTE: ' || p_name WHEN 1 THEN p_name || ' - CORTOS GANADORES' WHEN 2 THEN 'Función sorpresa ' || p_name ELSE p_name END AS title,
  CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN NULL ELSE 'Dir' END AS director FROM part),
c AS (SELECT id, CASE WHEN id % 6 < 3 THEN 'container-or-placeholder' WHEN length(director) > 0 THEN 'localized-title-miss' ELSE 'unfixable' END AS cause FROM m)
SELECT cause, id, count(*) OVER (PARTITION BY cause) AS n FROM c WHERE cause <> 'unfixable' QUALIFY n >= 2""")
def miss_causes(spark, sf_dir):
    m = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "CASE p_partkey % 6 WHEN 0 THEN concat('FESTIVAL NORTE: ', p_name) WHEN 1 THEN concat(p_name, ' - CORTOS GANADORES') WHEN 2 THEN concat('Función sorpresa ', p_name) ELSE p_name END AS title",
        "CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN NULL ELSE 'Dir' END AS director")
    return O.miss_causes(m)


CASES = "WITH c AS (SELECT doc_id, quality::BIGINT AS expected, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE toxic::BIGINT END AS predicted, doc_id % 7 > 0 AS reachable, doc_id % 10 / 10.0 AS confidence FROM labels)"
EVAL = CASES + """, e AS (SELECT count_if(reachable) AS reachable, count_if(NOT reachable) AS unreachable, count_if(reachable AND predicted IS NOT NULL) AS picks, count_if(reachable AND predicted = expected) AS correct,
  count_if(reachable AND predicted <> expected AND confidence >= 0.85) AS confident_errors FROM c)
"""


def _cases(spark, sf_dir):
    return table(spark, sf_dir, "labels").selectExpr("doc_id", "cast(quality AS long) AS expected", "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE cast(toxic AS long) END AS predicted", "doc_id % 7 > 0 AS reachable", "doc_id % 10 / 10.0 AS confidence")


@query("A-24", EVAL + "SELECT reachable, unreachable, picks, correct, round(coalesce(correct / nullif(picks, 0), 1), 6) AS precision, round(coalesce(correct / nullif(reachable, 0), 1), 6) AS recall, confident_errors FROM e")
def eval_metrics(spark, sf_dir):
    return O.evaluate(_cases(spark, sf_dir))


@query("A-25", EVAL + "SELECT correct / picks < 0.98 - 0.05 AS precision_fell, correct / reachable < 0.952 - 0.05 AS recall_fell, confident_errors > 1 AS errors_rose FROM e")
def eval_regression(spark, sf_dir):
    return O.regressions(O.evaluate(_cases(spark, sf_dir)), 0.98, 0.952, 1)


@query("A-31 A-32 P-12 S-9 S-8", """
WITH t AS (SELECT ['Cine MUESTRA norte', 'SEMANA vasca', 'Ciclo ruso', 'La sorpresa', 'Gran semana', 'FESTIVAL'][1 + p_partkey % 6] AS title FROM part)
SELECT DISTINCT CASE title WHEN 'Cine MUESTRA norte' THEN 'MUESTRA' WHEN 'SEMANA vasca' THEN 'SEMANA' WHEN 'Gran semana' THEN 'SEMANA' END AS keyword FROM t WHERE title IN ('Cine MUESTRA norte', 'SEMANA vasca', 'Gran semana')""")
def title_pattern_suggestions(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("Cine MUESTRA norte", "SEMANA vasca", "Ciclo ruso", "La sorpresa", "Gran semana", "FESTIVAL")])
    t = table(spark, sf_dir, "part").select(F.element_at(names, (F.col("p_partkey") % 6 + 1).cast("int")).alias("title"))
    return t.filter(~text.is_container(F.col("title"))).select(text.suggested_keyword(F.col("title")).alias("keyword")).dropna().distinct()


@query("A-32", "SELECT count(*) AS flipped FROM part WHERE p_name LIKE '%ring%' AND p_size > 25")
def rule_safety_check(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_size > 25")
    return p.filter(F.col("p_name").contains("ring") & ~text.is_container(F.col("p_name"))).agg(F.count("*").alias("flipped"))


@query("Q-1", SQL + f"""
, d AS (SELECT film_id AS source, {LOCAL_DAY} AS day, string_agg(DISTINCT kind, ',' ORDER BY kind) AS print FROM s GROUP BY 1, 2)
SELECT source, print, count(*) AS n_days, min(day) AS first_day FROM d GROUP BY 1, 2 HAVING count(*) > 1""")
def repeated_day_fingerprint(spark, sf_dir):
    s = screenings(spark, sf_dir)
    return O.repeated_days(s.select(F.col("film_id").alias("source"), times.local_day(F.col("starts_at")).alias("day"), F.col("kind").alias("item")))


@query("Q-2 Q-3 Q-5 Q-6", r"""
WITH x AS (SELECT page_id % 7 AS source, html LIKE '%<p>%' AND page_id % 7 <> 3 AS readable, regexp_extract(html, '<h1>([^<]*)', 1) AS film, try_cast(nullif(regexp_extract(url, '/(\d{2,4})(?:[/.?#]|$)', 1), '') AS INT) AS year, url LIKE 'https%' AS linked FROM pages),
g AS (SELECT source, count(*) AS n, count_if(readable) AS n_read, count(DISTINCT film) AS n_films, round(avg((NOT readable)::INT), 6) AS unread_share, round(avg((year IS NULL)::INT), 6) AS no_year_share, count_if(linked) AS n_linked FROM x GROUP BY 1)
SELECT *, CASE WHEN n_films = 0 THEN 'no films' WHEN n_read = 0 THEN 'no readable times' WHEN unread_share > 0.5 THEN 'mostly unreadable' WHEN n_linked = 0 THEN 'selector may be broken' WHEN no_year_share > 0.5 THEN 'mostly without year' END AS why, why IS NULL AS ok FROM g""")
def quality_shares(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(
        (F.col("page_id") % 7).alias("source"), (F.col("html").contains("<p>") & (F.col("page_id") % 7 != 3)).alias("readable"), F.regexp_extract("html", "<h1>([^<]*)", 1).alias("film"),
        F.nullif(F.regexp_extract("url", r"/(\d{2,4})(?:[/.?#]|$)", 1), F.lit("")).cast("int").alias("year"), F.col("url").startswith("https").alias("linked"))
    return O.batch_verdict(p, "source")


@query("Q-4", "SELECT l_partkey AS film_id, datediff('day', min(l_shipdate), max(l_shipdate)) + 1 BETWEEN 4 AND 14 AS ok FROM lineitem GROUP BY 1")
def validity_span(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    return r.select(F.col("l_partkey").alias("film_id"), O.date_gap_ok(F.col("a"), F.col("b")).alias("ok"))


@query("Q-7", """
WITH x AS (SELECT l_orderkey, list(l_quantity) AS q, max(year(l_shipdate)) AS y FROM lineitem GROUP BY 1)
SELECT l_orderkey AS batch, len(q) <= 5 AND y BETWEEN 1990 AND 2050 AND len(list_filter(q, lambda t: t > 45)) = 0 AS ok FROM x""")
def payload_caps(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"), F.max(F.year("l_shipdate")).alias("y"))
    ok = (F.size("q") <= 5) & F.col("y").between(1990, 2050) & F.forall("q", lambda t: t <= 45)
    return g.select(F.col("l_orderkey").alias("batch"), ok.alias("ok"))


@query("J-14", SQL + """
, i AS (SELECT 'sig' || (id % 40) AS signature, CASE WHEN id % 2 = 0 THEN 'open' ELSE 'closed' END AS state, started_at AS closed_at FROM r WHERE id % 2 = 0 OR id % 40 < 30)
SELECT DISTINCT 'sig' || (id % 40) AS signature FROM r WHERE 'sig' || (id % 40) NOT IN (SELECT signature FROM i WHERE state = 'open' OR closed_at >= TIMESTAMP '1998-06-17')""")
def new_issue_signatures(spark, sf_dir):
    r = runs(spark, sf_dir)
    sig = F.concat(F.lit("sig"), (F.col("id") % 40).cast("string"))
    ledger = r.filter("id % 2 = 0 OR id % 40 < 30").select(sig.alias("signature"), F.expr("id % 2 = 0").alias("open"), F.col("started_at").alias("closed_at"))
    known = ledger.filter(F.col("open") | (F.col("closed_at") >= times.lit(datetime(1998, 6, 17))))
    return r.select(sig.alias("signature")).distinct().join(known, "signature", "left_anti")
