"""Event feeds, detail pages and printed lines on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import catalog as C
from ..sources import feeds as S
from ..sources import pages as P
from .roles import NOW, SQL, films, screenings, table, venues

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


@query("F-4", """
WITH e AS (SELECT event_id % 700 AS id, event_type AS area, 'T' || user_id AS title, CASE WHEN user_id % 3 = 0 THEN ' ' ELSE 's' || user_id END AS short, strftime(ts, '%Y-%m-%d %H:%M') AS start FROM events),
o AS (SELECT * FROM e WHERE area = 'click' QUALIFY row_number() OVER (PARTITION BY id ORDER BY start, title, short) = 1)
SELECT o.id::VARCHAR AS id, title, start, coalesce(CASE WHEN o.id % 2 = 0 THEN n END, nullif(trim(short), '')) AS synopsis FROM o LEFT JOIN (SELECT c_custkey AS id, max(c_name) AS n FROM customer GROUP BY 1) USING (id)""")
def month_feed(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id % 100 AS month", "cast(event_id % 700 AS string) AS id", "event_type AS area", "concat('T', user_id) AS title", "CASE WHEN user_id % 3 = 0 THEN ' ' ELSE concat('s', user_id) END AS short", "date_format(ts, 'yyyy-MM-dd HH:mm') AS start")
    landed = e.groupBy("month").agg(F.to_json(F.collect_list(F.struct("id", "area", "title", "short", "start"))).alias("body"))
    details = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey AS string) AS id", "CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS long")
    return P.month_feed(landed, details, "click")


@query("F-5 F-11 F-16", """
WITH e AS (SELECT event_id AS id, user_id AS u, ts, event_id % 6 AS m, event_id % 7 AS z FROM events WHERE event_id % 4 <> 1)
SELECT id, date_trunc('second', ts) + INTERVAL 3 HOURS AS starts_at, CASE m WHEN 4 THEN 'Alita ' || u WHEN 5 THEN 'SOMBRAS ' || u ELSE 'Film ' || u END AS title, CASE m WHEN 4 THEN 'Gunnm' END AS original,
  CASE m WHEN 0 THEN 'Ana Ruiz' WHEN 1 THEN 'Eva Paz' WHEN 2 THEN 'MEL BROOKS' WHEN 5 THEN 'Juan Sosa' END AS director, CASE m WHEN 0 THEN 1950 + u % 70 WHEN 1 THEN 1990 WHEN 4 THEN NULL END::INT AS year,
  CASE m WHEN 4 THEN 'Noche rara' WHEN 5 THEN 'Ciclo SUR' END AS program
FROM e WHERE z <> 3 AND m <> 3 AND date_trunc('second', ts) + INTERVAL 3 HOURS > TIMESTAMP '2024-01-15 12:00:00'""")
def event_feed(spark, sf_dir):
    """Events land as a feed: some of another format, abroad, a series, over; names carry programme, credits and original title."""
    name = F.expr(
        "CASE event_id % 6 WHEN 0 THEN concat('Film ', user_id, ' (Ana Ruiz, ', 1950 + user_id % 70, ')') WHEN 1 THEN concat('Film ', user_id, ' Dir. Eva Paz · País · 1990 · 97 min') WHEN 2 THEN concat('Film ', user_id, ' - MEL BROOKS') "
        "WHEN 3 THEN concat('Film ', user_id, ' temporada 2') WHEN 4 THEN concat('Noche rara: “Alita ', user_id, '” (Gunnm)') ELSE concat('Ciclo SUR: SOMBRAS ', user_id, ' de Juan Sosa') END"
    )
    tags = F.array(F.struct(F.lit("Other").alias("prefix"), F.lit("Other/7").alias("tag")), F.struct(F.lit("EventbriteFormat").alias("prefix"), F.expr("concat('EventbriteFormat/', CASE WHEN event_id % 4 = 1 THEN 9 ELSE 7 END)").alias("tag")))
    zone = F.expr("CASE WHEN event_id % 7 = 3 THEN 'Europe/Madrid' WHEN event_id % 7 > 3 THEN 'America/Argentina/Buenos_Aires' END")
    body = F.to_json(F.struct(name.alias("name"), zone.alias("timezone"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("start"), tags.alias("tags")))
    landed = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("source"), body.alias("body"))
    return P.event_feed(landed, NOW).select(F.col("source").cast("long").alias("id"), "starts_at", "title", "original", "director", "year", "program")


@query("F-7", """
WITH e AS (SELECT event_id AS id, user_id AS u, event_id % 5 = 0 AS versus, CASE WHEN event_id % 4 = 0 THEN 'A VS. B' ELSE 'Show ' || event_id END AS title, CASE WHEN event_id % 3 = 0 THEN 'Zoom' END AS program FROM events),
j AS (SELECT e.*, c_custkey IS NOT NULL AS page, c_custkey % 3 = 0 AS several FROM e LEFT JOIN customer ON c_custkey = u),
d AS (SELECT *, coalesce(several, false) AS s, CASE WHEN versus THEN title LIKE '% VS. %' OR coalesce(several, false) ELSE title LIKE '% VS. %' AND (NOT page OR several) END AS duel FROM j)
SELECT id, CASE WHEN s AND NOT duel THEN 'F' || k || ' of ' || u ELSE title END AS film_title, CASE WHEN page AND NOT duel THEN 'Dir ' || k END AS director, CASE WHEN page AND NOT duel THEN 1990 + k END::INT AS year,
  CASE WHEN s AND NOT duel THEN title ELSE program END AS program_name, duel AS skip FROM d, LATERAL (SELECT unnest(CASE WHEN s AND NOT duel THEN [1, 2] ELSE [1] END) AS k)""")
def detail_pages(spark, sf_dir):
    """Events of one series share the page of their film; every third page has two films."""
    e = table(spark, sf_dir, "events").selectExpr("event_id AS id", "concat('https://v.org/sala/film-', char(97 + cast(user_id % 26 AS int)), user_id, 'x/', date_format(ts, 'yyyy-MM-dd'), '/') AS url",
                                                  "event_id % 5 = 0 AS versus", "CASE WHEN event_id % 4 = 0 THEN 'A VS. B' ELSE concat('Show ', event_id) END AS title", "CASE WHEN event_id % 3 = 0 THEN 'Zoom' END AS program")
    one = lambda k: f"named_struct('title', concat('F{k} of ', c_custkey), 'director', 'Dir {k}', 'year', 1990 + {k})"
    d = table(spark, sf_dir, "customer").selectExpr("concat('https://v.org/sala/film-', char(97 + cast(c_custkey % 26 AS int)), c_custkey, 'x/2023-05-06/') AS url", f"CASE WHEN c_custkey % 3 = 0 THEN array({one(1)}, {one(2)}) ELSE array({one(1)}) END AS films")
    return P.with_details(e, d).select("id", "film_title", "director", "year", "program_name", "skip")


@query("F-37", """
SELECT p_partkey AS id, k AS film_pos, CASE WHEN p_partkey % 3 = 0 THEN 'Whole' WHEN k = 0 THEN p_name ELSE 'Second' END AS film_title, CASE WHEN p_partkey % 3 > 0 AND k = 1 THEN 'Eva Paz' ELSE p_brand END AS director,
  CASE WHEN p_partkey % 3 > 0 AND k = 0 THEN 'Peru' ELSE 'Chile' END AS country, CASE WHEN p_partkey % 3 > 0 AND k = 0 THEN 1950 + p_size END::INT AS year, CASE WHEN p_partkey % 3 > 0 AND k = 0 THEN 6 END::INT AS runtime,
  CASE WHEN p_partkey % 3 = 0 THEN 'About all.' WHEN k = 0 THEN 'First text.' || chr(10) || chr(10) || 'More of it.' END AS synopsis
FROM part, LATERAL (SELECT unnest(CASE WHEN p_partkey % 3 = 0 THEN [0] ELSE [0, 1] END)::INT AS k)""")
def film_pages(spark, sf_dir):
    two = "'<h2>', p_name, '</h2><p>First text.</p><h2> </h2><p>More of <b>it</b>.</p><p><em>Drama / 6’ / Peru ', 1950 + p_size, '</em></p><p>***</p><p>After it.</p><h2>Second</h2><p>DIRECCIÓN: Eva Paz</p><p>***</p>'"
    pages = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"CASE WHEN p_partkey % 3 = 0 THEN '<p>About all.</p><p>***</p><p>Note</p>' ELSE concat({two}) END AS body", "'Whole' AS title", "p_brand AS director", "'Chile' AS country")
    return P.film_blocks(pages, "body", "title", "director", "country")


@query("F-34", """
WITH o AS (SELECT o_orderkey AS id, o_orderdate AS d, o_orderkey % 5 AS k FROM orders), t(h, m) AS (VALUES (20, 30), (22, 0))
SELECT id, p::INT AS day_pos, day(CASE WHEN p = 0 THEN d ELSE d + INTERVAL 1 DAY END)::INT AS day, CASE WHEN k = 4 THEN NULL ELSE month(d + INTERVAL 1 DAY) END::INT AS month, h::INT AS hour, m::INT AS minute
FROM o, (VALUES (0), (1)) x(p), t WHERE k NOT IN (2, 3)""")
def printed_showtimes(spark, sf_dir):
    """Two days and two times a line; every fifth line names no month, one a month there isn't, one is no showtime."""
    d = F.to_date("o_orderdate")
    n = F.date_add(d, 1)
    k = F.col("o_orderkey") % 5
    month = F.when(k == 4, "").when(k == 3, " de brumario").otherwise(F.concat(F.lit(" de "), times.month_name(n)))
    line = F.when(k == 2, "FICHA TÉCNICA").otherwise(F.concat(F.lit("Lunes "), F.dayofmonth(d), F.lit("° y martes "), F.dayofmonth(n), month, F.lit(", 20.30 y 22 y 31 horas")))
    return P.showtime_days(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), line.alias("line")), "line").select("id", "day_pos", "day", "month", "hour", "minute")


@query("F-19", "SELECT o_orderkey AS id, (o_orderdate::DATE + ((o_orderkey % 7 - (isodow(o_orderdate) - 1) + 6) % 7 + 1)::INT)::DATE AS day FROM orders")
def next_weekdays(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), P.next_weekday(F.to_date("o_orderdate"), F.col("o_orderkey") % 7).alias("day"))


@query("F-9", """
SELECT p_partkey AS page_id, k::INT AS pos, '2024-01-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') AS date, '/film/' || CASE WHEN k = 4 THEN 2 ELSE k END AS href, p_name AS title
FROM part, (VALUES (0), (2)) t(k) WHERE k = 2 OR p_partkey % 2 = 0""")
def agenda_cards(spark, sf_dir):
    """Five cards a page: of this venue or another, a talk, one without date, one address twice."""
    card = lambda kind, places, date, k: f"concat('<article class=\"card ', '{kind}', '\" data-event=\"1\" data-date=\"', {date}, '\" data-locations=\"[&quot;', {places}, '&quot;]\">\n<a href=\"/film/{k}\"><h3 class=\"t\"> ', p_name, ' </h3></a></article>')"
    day = "concat('2024-01-', lpad(p_size % 28 + 1, 2, '0'))"
    html = ", ".join([card("screening", "CASE WHEN p_partkey % 2 = 0 THEN 'here' ELSE 'there' END", day, 0), card("talk", "'here'", day, 1), card("screening", "'other&quot;,&quot;here'", day, 2), card("screening", "'here'", "'soon'", 3), card("screening", "'here'", day, 2)])
    pages = table(spark, sf_dir, "part").selectExpr("p_partkey AS page_id", f"concat({html}) AS html", "p_name")
    return S.agenda(pages, "here", "screening")


@query("F-33", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 < 2 THEN year(o_orderdate) END::INT AS year FROM orders""")
def anchor_years(spark, sf_dir):
    linked = "concat('<script type=\"application/ld+json\">{\"datePublished\": \"', date_format(o_orderdate, 'yyyy-MM-dd'), '\"}</script><meta property=\"article:published_time\" content=\"1900-01-01\">')"
    meta = "concat('<script>x</script><meta property=\"article:published_time\" content=\"', date_format(o_orderdate, 'yyyy-MM-dd'), '\">')"
    html = F.expr(f"CASE o_orderkey % 3 WHEN 0 THEN {linked} WHEN 1 THEN {meta} ELSE '<p>2001-01-01</p>' END")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.anchor_year(html).alias("year"))


@query("F-12 S-19", """
SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 5 THEN 'CICLO ' || p_brand WHEN 6 THEN p_name || ' - The Final Cut' ELSE p_name END AS title,
  CASE p_partkey % 7 WHEN 0 THEN 'CICLO ' || p_brand WHEN 1 THEN 'Retrospectiva ' || p_brand WHEN 2 THEN 'FOCO - ' || p_brand WHEN 3 THEN 'muestra' END AS program,
  CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN 'Ana' ELSE '黒澤明' END AS director FROM part""")
def suffixes_and_latin_names(spark, sf_dir):
    """A programme behind a dash of any kind, a title that is one, a dash that no programme follows."""
    raw = F.expr("CASE p_partkey % 7 WHEN 0 THEN concat(p_name, ' - CICLO ', p_brand) WHEN 1 THEN concat(p_name, ' — Retrospectiva ', p_brand) WHEN 2 THEN concat(p_name, '–FOCO - ', p_brand) "
                 "WHEN 3 THEN concat(p_name, ' - muestra') WHEN 5 THEN concat('CICLO ', p_brand) WHEN 6 THEN concat(p_name, ' - The Final Cut') ELSE p_name END")  # fmt: skip
    name, other = F.expr("CASE WHEN p_partkey % 3 = 1 THEN 'Ana' ELSE '黒澤明' END"), F.expr("CASE WHEN p_partkey % 3 < 2 THEN p_brand ELSE '溝口' END")
    s = S.programme_suffix(raw)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), s["title"].alias("title"), s["program"].alias("program"), text.latin_name(name, other).alias("director"))


@query("M-20", SQL + """
SELECT 'films' AS name, 0 AS n UNION ALL SELECT 'screenings', 0 UNION ALL SELECT 'runs', 0 UNION ALL SELECT 'venues', count(*) FROM v UNION ALL SELECT 'sources', count(DISTINCT source) FROM r UNION ALL SELECT 'overrides', count(*) FROM f WHERE match_source = 'override'""")
def programme_reset(spark, sf_dir):
    """All snapshots of the catalog, each with its rows after a reset of the programme."""
    f = films(spark, sf_dir)
    runs = table(spark, sf_dir, "orders").selectExpr("o_custkey % 13 AS source")
    snapshots = {"films": f, "screenings": screenings(spark, sf_dir), "runs": runs, "venues": venues(spark, sf_dir), "sources": runs.distinct(), "overrides": f.filter("match_source = 'override'").select("id")}
    counts = [s.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, s in C.reset_programme(snapshots).items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
