"""Listing queries on the given tables, each with its SQL and the operators it covers."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import listings as L
from .roles import NOW, SQL, films, screenings, table, venues

WEEK = times.window_bounds("semana", NOW)
IN_WEEK = "starts_at >= TIMESTAMP '2024-01-15 03:00:00' AND starts_at < TIMESTAMP '2024-01-22 03:00:00'"
CATCHABLE = "starts_at >= TIMESTAMP '2024-01-15 11:45:00'"
FUTURE = "starts_at > TIMESTAMP '2024-01-15 12:00:00'"
LOCAL_DAY = "CAST(starts_at - INTERVAL 3 HOURS AS DATE)"
#: The star of a week's screenings, visible films and venues.
STAR = SQL + f""", w AS (
  SELECT s.*, f.title, f.country, f.year, f.runtime, f.popularity, f.vote_count, f.created_on, f.poster, f.director, v.name AS venue, v.neighborhood
  FROM s JOIN f ON s.film_id = f.id AND NOT f.hidden JOIN v ON s.venue_id = v.id WHERE {IN_WEEK}
)
"""
WEEKDAYS_SQL = "['lunes', 'martes', 'miércoles', 'jueves', 'viernes', 'sábado', 'domingo']"
MONTHS_SQL = "['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre']"
SHORT_SQL = "['ene', 'feb', 'mar', 'abr', 'may', 'jun', 'jul', 'ago', 'sept', 'oct', 'nov', 'dic']"

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


def week_star(spark, sf_dir):
    return L.star(L.in_window(screenings(spark, sf_dir), *WEEK), films(spark, sf_dir), venues(spark, sf_dir))


@query("F-1 P-1 P-2 P-3 J-1 A-2 W-4 T-2 V-6 D-3", STAR + f"""
SELECT film_id, title, count(*) AS n, count(DISTINCT venue_id) AS n_venues, min(starts_at) FILTER (WHERE {CATCHABLE}) AS next_at, max(starts_at) AS last_at
FROM w GROUP BY ALL HAVING next_at IS NOT NULL""")
def window_by_film(spark, sf_dir):
    return L.film_order(L.by_film(week_star(spark, sf_dir), NOW).filter("next_at IS NOT NULL"))


@query("T-2 A-2", STAR + f"""
, g AS (SELECT film_id, min(starts_at) FILTER (WHERE {CATCHABLE}) AS next_at, max(starts_at) AS last_at FROM w GROUP BY film_id)
SELECT film_id, row_number() OVER (ORDER BY next_at NULLS LAST, CASE WHEN next_at IS NULL THEN last_at END DESC, film_id) AS place FROM g ORDER BY place LIMIT 50""")
def film_order_top(spark, sf_dir):
    g = L.film_order(L.by_film(week_star(spark, sf_dir), NOW)).limit(50)
    order = [F.col("next_at").asc_nulls_last(), F.when(F.col("next_at").isNull(), F.col("last_at")).desc(), F.col("film_id")]
    return g.select("film_id", F.row_number().over(W.orderBy(*order)).cast("long").alias("place"))


@query("T-1 P-1 P-8 P-7 D-5 S-25", STAR + """
SELECT id, film_id, venue, starts_at, starts_at + to_minutes(coalesce(nullif(runtime, 0), 120)) AS ends_at,
  strftime(starts_at - INTERVAL 3 HOURS, '%Y-%m-%dT%H:%M:%S') || '-03:00' AS local_iso,
  concat_ws(' · ', year, country, nullif(runtime, 0) || ' min') AS meta
FROM w""")
def chronological(spark, sf_dir):
    w = week_star(spark, sf_dir)
    at = F.col("starts_at")
    return w.select("id", "film_id", "venue", "starts_at", times.end_time(at, F.col("runtime")).alias("ends_at"), times.local_iso(at).alias("local_iso"),
                    text.meta_line(F.col("year"), F.col("country"), F.col("runtime")).alias("meta")).orderBy("starts_at", "id")


@query("A-3", STAR + """
SELECT film_id, venue_id, min(starts_at) AS first_at, count(*) AS n, string_agg(strftime(starts_at, '%d %H:%M'), ' ' ORDER BY starts_at) AS starts,
  row_number() OVER (PARTITION BY film_id ORDER BY min(starts_at), venue_id) AS place
FROM w GROUP BY film_id, venue_id""")
def film_venues(spark, sf_dir):
    out = L.film_venues(week_star(spark, sf_dir))
    return out.withColumn("starts", F.array_join(F.transform("starts", lambda t: F.date_format(t, "dd HH:mm")), " ")).withColumn("place", F.col("place").cast("long"))


@query("A-1 W-3", SQL + f"""
, l AS (SELECT film_id, max(starts_at) AS last_at FROM s WHERE {FUTURE} GROUP BY film_id)
SELECT s.id, s.film_id, coalesce(starts_at = last_at, false) AS is_last FROM s LEFT JOIN l USING (film_id) WHERE {IN_WEEK}""")
def last_showing_flag(spark, sf_dir):
    return L.with_last_flag(screenings(spark, sf_dir), *WEEK, NOW).select("id", "film_id", "is_last")


@query("W-4 W-17", SQL + """
SELECT film_id, coalesce(arg_min(id, (starts_at, id)) FILTER (WHERE starts_at >= TIMESTAMP '2024-01-15 12:00:00'), arg_min(id, (starts_at, id))) AS id FROM s GROUP BY film_id""")
def next_showing(spark, sf_dir):
    return L.next_showing(screenings(spark, sf_dir), NOW)


@query("U-4 A-4 A-29 F-38 D-1 D-9 V-5", SQL + f"""
, d AS (SELECT CAST(range AS DATE) AS day FROM range(DATE '2024-01-15', DATE '2024-01-29', INTERVAL 1 DAY)), c AS (
  SELECT {LOCAL_DAY} AS day, count(*) AS n, count(*) FILTER (WHERE NOT {CATCHABLE}) AS n_over FROM s
  WHERE starts_at >= TIMESTAMP '2024-01-15 03:00:00' AND starts_at < TIMESTAMP '2024-01-29 03:00:00' GROUP BY 1)
SELECT day, coalesce(n, 0) AS n, coalesce(n_over, 0) AS n_over,
  CASE WHEN day = DATE '2024-01-15' THEN 'Hoy' ELSE ['Lun', 'Mar', 'Mié', 'Jue', 'Vie', 'Sáb', 'Dom'][isodow(day)] || ' ' || day(day) END AS chip,
  isodow(day) IN (6, 7) AS weekend, coalesce(n, 0) = 0 AS empty
FROM d LEFT JOIN c USING (day)""")
def calendar_fill_14d(spark, sf_dir):
    return L.calendar(screenings(spark, sf_dir), NOW)


@query("A-4 A-29 U-5 D-6", SQL + f"""
SELECT {LOCAL_DAY} AS day, count(*) AS n, count(*) FILTER (WHERE NOT {CATCHABLE}) AS n_over, n = n_over AS all_over,
  {WEEKDAYS_SQL}[isodow({LOCAL_DAY})] || ' ' || day({LOCAL_DAY}) || ' de ' || {MONTHS_SQL}[month({LOCAL_DAY})] AS label,
  day({LOCAL_DAY}) || ' ' || ['Ene', 'Feb', 'Mar', 'Abr', 'May', 'Jun', 'Jul', 'Ago', 'Sept', 'Oct', 'Nov', 'Dic'][month({LOCAL_DAY})] AS short
FROM s GROUP BY {LOCAL_DAY}""")
def day_banners(spark, sf_dir):
    days = L.by_day(screenings(spark, sf_dir), NOW).drop("is_today")
    return days.withColumns({"label": times.day_label(F.col("day")), "short": times.day_short(F.col("day"))})


@query("U-5", SQL + f"SELECT {LOCAL_DAY} AS day, count(*) AS n FROM s WHERE {CATCHABLE} AND venue_id = 3 GROUP BY 1")
def venue_agenda(spark, sf_dir):
    rows = screenings(spark, sf_dir).filter(times.catchable(F.col("starts_at"), NOW)).filter("venue_id = 3")
    return L.by_day(rows, NOW).select("day", "n")


@query("A-5 D-2 D-6 V-5", SQL + f"""
, g AS (SELECT CAST(date_trunc('week', starts_at - INTERVAL 3 HOURS) AS DATE) AS monday, count(*) AS n, count(DISTINCT film_id) AS n_films, count(DISTINCT venue_id) AS n_venues
  FROM s WHERE starts_at >= TIMESTAMP '2024-01-22 03:00:00' GROUP BY 1)
SELECT *, CASE WHEN month(monday) = month(monday + 6) THEN 'Semana del ' || day(monday) || ' al ' || day(monday + 6) || ' de ' || {MONTHS_SQL}[month(monday)]
  ELSE 'Semana del ' || day(monday) || ' de ' || {MONTHS_SQL}[month(monday)] || ' al ' || day(monday + 6) || ' de ' || {MONTHS_SQL}[month(monday + 6)] END AS label FROM g""")
def upcoming_by_week(spark, sf_dir):
    return L.by_week(L.in_window(screenings(spark, sf_dir), times.next_monday(NOW)))


@query("U-3 P-1", SQL + """
SELECT CASE WHEN starts_at < TIMESTAMP '2024-01-29 03:00:00' THEN 'near' ELSE 'far' END AS tier, count(*) AS n
FROM s WHERE starts_at >= TIMESTAMP '2024-01-15 03:00:00' GROUP BY 1""")
def disjoint_tiers(spark, sf_dir):
    lower = times.today_start(NOW)
    cut = lower + timedelta(days=14)
    s = screenings(spark, sf_dir)
    near, far = L.in_window(s, lower, cut).select(F.lit("near").alias("tier")), L.in_window(s, cut).select(F.lit("far").alias("tier"))
    return near.unionByName(far).groupBy("tier").agg(F.count("*").alias("n"))


@query("D-3 X-3", SQL + "".join(f"{' UNION ALL ' if i else ''}SELECT '{k}' AS win, count(*) AS n FROM s WHERE starts_at >= TIMESTAMP '{times.WINDOWS[k](NOW)[0]}' AND starts_at < TIMESTAMP '{times.WINDOWS[k](NOW)[1]}'" for i, k in enumerate(times.WINDOWS)))
def named_windows(spark, sf_dir):
    s, out = screenings(spark, sf_dir), None
    for name in times.WINDOWS:
        n = L.in_window(s, *times.window_bounds(name, NOW)).agg(F.count("*").alias("n")).select(F.lit(name).alias("win"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("A-27 T-3 U-7 W-13", SQL + f"""
, t AS (SELECT film_id, {LOCAL_DAY} AS day, starts_at, id, program_name, tags, starts_at - INTERVAL 3 HOURS AS l FROM s),
m AS (SELECT DISTINCT film_id, day, strftime(l, '%H:%M') AS hm, (CASE WHEN hour(l) < 5 THEN hour(l) + 24 ELSE hour(l) END) * 60 + minute(l) AS c FROM t),
a AS (SELECT film_id, day, string_agg(hm, ' ' ORDER BY c) AS times FROM m GROUP BY ALL),
g AS (SELECT film_id, day, string_agg(DISTINCT x, ',' ORDER BY x) AS tags FROM (SELECT film_id, day, unnest(tags) AS x FROM t) GROUP BY ALL),
p AS (SELECT film_id, day, arg_min(program_name, (starts_at, id)) FILTER (WHERE program_name IS NOT NULL) AS program FROM t GROUP BY ALL)
SELECT film_id, day, times, coalesce(tags, '') AS tags, program FROM a JOIN p USING (film_id, day) LEFT JOIN g USING (film_id, day)""")
def day_hour_collapse(spark, sf_dir):
    return L.day_rows(screenings(spark, sf_dir))


@query("A-6 S-4 V-7", SQL + """
, n AS (SELECT *, trim(regexp_replace(lower(strip_accents(program_name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM s WHERE program_name IS NOT NULL)
SELECT venue_id, slug, count(DISTINCT film_id) AS n_films, min(starts_at) AS first_at, max(starts_at) AS last_at, arg_min(id, (starts_at, id)) AS first_id,
  arg_min(program_name, (starts_at, id)) AS name FROM n GROUP BY venue_id, slug""")
def venue_programmes(spark, sf_dir):
    return L.programmes(screenings(spark, sf_dir))


@query("A-26 D-7 D-8 T-5 V-7", SQL + f"""
, t AS (SELECT DISTINCT film_id, {LOCAL_DAY} AS day, strftime(starts_at - INTERVAL 3 HOURS, '%H:%M') AS hm, (hour(starts_at - INTERVAL 3 HOURS) + 19) % 24 * 60 + minute(starts_at) AS clock FROM s),
d AS (SELECT film_id, day, string_agg(hm, ' ' ORDER BY clock) AS times FROM t GROUP BY 1, 2),
g AS (SELECT film_id, times, list_sort(list_distinct(list(isodow(day)))) AS d, count(*) AS n_days, min(day) AS a, max(day) AS b FROM d GROUP BY 1, 2),
x AS (SELECT *, {WEEKDAYS_SQL} AS w, {SHORT_SQL} AS m, len(d) AS n FROM g)
SELECT film_id, times, n_days, count(*) OVER (PARTITION BY film_id) = 1 AS uniform,
  CASE WHEN n = 7 THEN 'Todos los días' WHEN n = 5 AND d[5] = 5 THEN 'De lunes a viernes'
    WHEN n = 1 THEN 'Los ' || ['lunes', 'martes', 'miércoles', 'jueves', 'viernes', 'sábados', 'domingos'][d[1]]
    WHEN n = 2 THEN upper(left(w[d[1]], 1)) || w[d[1]][2:] || ' y ' || w[d[2]]
    WHEN d[n] - d[1] = n - 1 THEN 'De ' || w[d[1]] || ' a ' || w[d[n]]
    ELSE upper(left(w[d[1]], 1)) || w[d[1]][2:] || ', ' || array_to_string(list_transform(d[2:n - 1], lambda i: w[i]), ', ') || ' y ' || w[d[n]] END AS label,
  CASE WHEN a = b THEN day(a) || ' ' || m[month(a)] WHEN month(a) = month(b) THEN day(a) || '–' || day(b) || ' ' || m[month(a)]
    ELSE day(a) || ' ' || m[month(a)] || ' – ' || day(b) || ' ' || m[month(b)] END AS dates
FROM x""")
def weekly_run_signature(spark, sf_dir):
    return L.weekly_runs(screenings(spark, sf_dir))


@query("A-7 S-3 P-9 T-7 V-2", SQL + f"""
SELECT film_id, title, min(starts_at) AS soonest, count(DISTINCT venue_id) AS n_venues, count(*) AS n
FROM s JOIN f ON s.film_id = f.id AND NOT f.hidden JOIN v ON s.venue_id = v.id
WHERE {CATCHABLE} AND contains(lower(strip_accents(title || ' ' || country)), 'omer#00000001') GROUP BY ALL ORDER BY soonest, film_id LIMIT 20""")
def search_films(spark, sf_dir):
    rows = L.star(screenings(spark, sf_dir), films(spark, sf_dir), venues(spark, sf_dir))
    return L.search(rows, "Ómer#00000001", NOW)


@query("V-1 T-8 P-9 D-3", STAR + f"""
, g AS (SELECT film_id, title, count(*) AS n, min(starts_at) AS next_at FROM w WHERE {CATCHABLE} AND contains(lower(strip_accents(neighborhood)), 'a') GROUP BY ALL)
SELECT *, (SELECT count(*) FROM g) > 40 AS truncated FROM g ORDER BY next_at, film_id LIMIT 40""")
def whats_on(spark, sf_dir):
    rows = week_star(spark, sf_dir).filter(times.catchable(F.col("starts_at"), NOW)).filter(F.contains(text.search_fold(F.col("neighborhood")), text.search_fold(F.lit("Á"))))
    g = rows.groupBy("film_id", "title").agg(F.count("*").alias("n"), F.min("starts_at").alias("next_at"))
    return L.truncated(g, 40, ["next_at", "film_id"])


@query("V-3 P-4", SQL + f"""
, x AS (SELECT unnest([3, 17, 1400, 999999999]) AS film_id)
SELECT x.film_id, CASE WHEN f.id IS NULL OR f.hidden THEN 'unknown' WHEN count(s.id) = 0 THEN 'nothing' ELSE 'found' END AS state, count(s.id) AS n
FROM x LEFT JOIN f ON x.film_id = f.id LEFT JOIN s ON s.film_id = f.id AND NOT f.hidden AND {CATCHABLE} GROUP BY x.film_id, f.id, f.hidden""")
def film_lookup(spark, sf_dir):
    asked = spark.createDataFrame([(i,) for i in (3, 17, 1400, 999999999)], "film_id long")
    f = L.visible(films(spark, sf_dir)).select(F.col("id").alias("film_id"), F.lit(True).alias("known"))
    s = screenings(spark, sf_dir).filter(times.catchable(F.col("starts_at"), NOW)).select("film_id", "id")
    found = asked.join(f, "film_id", "left").join(s, "film_id", "left").groupBy("film_id", "known").agg(F.count(F.when(F.col("known"), F.col("id"))).alias("n"))
    return found.select("film_id", F.when(F.col("known").isNull(), "unknown").when(F.col("n") == 0, "nothing").otherwise("found").alias("state"), "n")


@query("V-4 J-4 S-26", SQL + ", d AS (SELECT v.*, r_name FROM v JOIN region ON region = r_regionkey) SELECT id, name, neighborhood, type, r_name AS region, CASE WHEN neighborhood = 'PERU' THEN 'Lima' ELSE 'Home' END AS city FROM d")
def venue_directory(spark, sf_dir):
    v = venues(spark, sf_dir).join(F.broadcast(table(spark, sf_dir, "region")), F.expr("region = r_regionkey"))
    return v.select("id", "name", "neighborhood", "type", F.col("r_name").alias("region"), text.city(F.col("neighborhood"), {"PERU": "Lima"}, "Home").alias("city")).orderBy("name")


@query("W-12", SQL + f"""
, d AS (SELECT venue_id, {LOCAL_DAY} AS day, count(*) AS n FROM s GROUP BY 1, 2)
SELECT venue_id, day, n, dense_rank() OVER p AS rank, greatest(count(*) OVER (PARTITION BY venue_id) - 4, 0) AS omitted FROM d
WINDOW p AS (PARTITION BY venue_id ORDER BY day) QUALIFY rank <= 4""")
def first_days_per_venue(spark, sf_dir):
    return L.first_days(screenings(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query("A-28 D-4", STAR + """
SELECT count(*) AS n, count(DISTINCT venue_id) AS n_venues, 1 AS edition,
  'Edición número 1. ' || count(*) || ' funciones en ' || count(DISTINCT venue_id) || ' salas.' AS sentence FROM w""")
def header_counts(spark, sf_dir):
    c = week_star(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("venue_id").alias("n_venues"))
    number = times.edition(times.lit(times.week_start(NOW)))
    return c.withColumns({"edition": number, "sentence": times.edition_sentence(number, F.col("n"), F.col("n_venues"))})


@query("U-6 V-10 S-5", SQL + f"""
SELECT DISTINCT trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') || '-' || year AS slug
FROM s JOIN f ON s.film_id = f.id WHERE NOT hidden AND {FUTURE}""")
def live_slugs(spark, sf_dir):
    s = screenings(spark, sf_dir).filter(F.col("starts_at") > times.lit(NOW)).select(F.col("film_id").alias("id"))
    live = L.visible(films(spark, sf_dir)).join(s, "id", "left_semi")
    return live.select(text.film_slug(F.col("title"), F.col("year"), F.col("id")).alias("slug")).distinct()


@query("V-9 F-30", STAR + """
SELECT id, json_object('name', title, 'location', venue, 'startDate', strftime(starts_at - INTERVAL 3 HOURS, '%Y-%m-%dT%H:%M:%S') || '-03:00',
  'endDate', strftime(starts_at - INTERVAL 3 HOURS + to_minutes(coalesce(nullif(runtime, 0), 120)), '%Y-%m-%dT%H:%M:%S') || '-03:00')::VARCHAR AS event FROM w""")
def seven_day_feed(spark, sf_dir):
    at, end = F.col("starts_at"), times.end_time(F.col("starts_at"), F.col("runtime"))
    event = F.to_json(F.struct(F.col("title").alias("name"), F.col("venue").alias("location"), times.local_iso(at).alias("startDate"), times.local_iso(end).alias("endDate")))
    return week_star(spark, sf_dir).select("id", event.alias("event"))


def _pick(place: int, name: str, rule: str, rank: str) -> str:
    before = "".join(f" AND film_id NOT IN (SELECT film_id FROM p{i})" for i in range(place))
    return f", p{place} AS (SELECT film_id, title, '{name}' AS reason FROM c WHERE {rule}{before} ORDER BY {rank} DESC, film_id LIMIT 1)"


FEATURED_SQL = (
    STAR
    + f"""
, c AS (SELECT film_id, title, any_value(country) AS country, any_value(year) AS year, any_value(vote_count) AS vote_count, any_value(popularity) AS popularity,
    any_value(created_on) AS created_on, bool_or(list_contains(tags, 'premiere')) AS premiere, (SELECT max(starts_at) FROM s WHERE s.film_id = w.film_id AND {FUTURE}) AS last_at
  FROM w WHERE poster IS NOT NULL GROUP BY film_id, title HAVING last_at IS NOT NULL)
"""
    + _pick(0, "local", "country = 'ARGENTINA'", "popularity")
    + _pick(1, "premiere", "(premiere OR year = 2024)", "popularity")
    + _pick(2, "classic", "year <= 2000 AND vote_count >= 1000", "vote_count")
    + """
, x AS (SELECT *, CASE WHEN last_at < TIMESTAMP '2024-01-22 03:00:00' THEN 0 WHEN created_on > DATE '2024-01-01' THEN 1 WHEN country NOT IN ('ARGENTINA', 'UNITED STATES') THEN 2 ELSE 3 END AS i
  FROM c WHERE film_id NOT IN (SELECT film_id FROM p0 UNION SELECT film_id FROM p1 UNION SELECT film_id FROM p2)),
a AS (SELECT *, 0 AS place FROM p0 UNION ALL SELECT *, 1 FROM p1 UNION ALL SELECT *, 2 FROM p2
  UNION ALL SELECT film_id, title, ['last', 'new', 'world', 'any'][i + 1], 10 + row_number() OVER (ORDER BY i, popularity DESC, film_id) FROM x)
SELECT film_id, title, reason FROM a ORDER BY place LIMIT 4"""
)


@query("W-11 X-4 V-8", FEATURED_SQL)
def featured_band(spark, sf_dir):
    return L.featured(week_star(spark, sf_dir), screenings(spark, sf_dir), NOW, WEEK[1])


@query("P-10 S-24", SQL + """
SELECT id, array_to_string(list_transform(list_filter(tags, lambda t: t <> 'cycle'), lambda t: CASE t WHEN 'premiere' THEN 'ESTRENO' WHEN 'vos' THEN 'VOS' WHEN 'restored' THEN 'COPIA RESTAURADA' ELSE t END), ',') AS labels,
  array_to_string(list_filter([CASE WHEN k = 28 THEN 'Acción' WHEN k = 35 THEN 'Comedia' WHEN k = 18 THEN 'Drama' WHEN k = 12 THEN 'Aventura' WHEN k = 14 THEN 'Fantasía' WHEN k = 16 THEN 'Animación'
    WHEN k = 27 THEN 'Terror' WHEN k = 36 THEN 'Historia' WHEN k = 37 THEN 'Western' WHEN k = 53 THEN 'Suspense' WHEN k = 80 THEN 'Crimen' WHEN k = 99 THEN 'Documental' END, 'Drama'], lambda x: x IS NOT NULL), ',') AS genres
FROM s""")
def tag_and_genre_labels(spark, sf_dir):
    s = screenings(spark, sf_dir)
    genres = text.genre_labels(F.array("k", F.lit(18)))
    return s.select("id", F.array_join(text.tag_labels(F.array_remove("tags", "cycle")), ",").alias("labels"), F.array_join(genres, ",").alias("genres"))


@query("T-4 S-28", SQL + "SELECT id, name, id IN (3, 5) AS by_day FROM v")
def venues_in_locale_order(spark, sf_dir):
    return venues(spark, sf_dir).select("id", "name", F.col("id").isin(3, 5).alias("by_day")).orderBy(F.collate("name", "es"), "id")


@query("T-9 S-13", "SELECT s_nationkey, string_agg(s_name, '|' ORDER BY s_acctbal DESC, s_suppkey) AS billed FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS i FROM supplier) WHERE i <= 8 GROUP BY s_nationkey")
def top_billing(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    cast = F.array_sort(F.collect_list(F.struct((-F.col("s_acctbal")).alias("o"), "s_suppkey", "s_name")))
    return s.groupBy("s_nationkey").agg(F.array_join(F.transform(F.slice(cast, 1, 8), lambda x: x["s_name"]), "|").alias("billed"))
