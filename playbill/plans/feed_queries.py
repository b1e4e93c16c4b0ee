"""Text functions and feed flattening on the given tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import resolve as R
from ..sources import feeds as S
from .roles import NOW, SQL, films, screenings, table

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


#: Titles of screenings as venues print them: the customer's name in one of eight shapes.
SHAPES = (
    "concat('FESTIVAL SUR: ', n)", "concat(n, ' - DOC BSAS')", "concat(n, ' (subtitulada)')", "concat('Árbol «', n, '» Ñandú')", "upper(n)", "concat(n, ', la película')", "concat('¿', n, '? ¡sí!')", "n",
)
TITLE = "CASE id % 8 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(SHAPES)) + " END"
TITLE_SQL = SQL + f", t AS (SELECT id, n, {TITLE} AS title, country FROM (SELECT id, replace(title, '#', ' ') AS n, country FROM f))\n"


def titles(spark, sf_dir):
    return films(spark, sf_dir).selectExpr("id", "replace(title, '#', ' ') AS n", "country").selectExpr("id", "n", f"{TITLE} AS title", "country")


@query("S-1 S-2 S-3 S-4", TITLE_SQL + r"""
SELECT id, strip_accents(title) AS folded, trim(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')) AS key,
  trim(lower(strip_accents(title))) AS search_key, trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM t""")
def title_keys(spark, sf_dir):
    c = F.col("title")
    return titles(spark, sf_dir).select("id", text.fold(c).alias("folded"), text.title_key(c).alias("key"), text.search_fold(c).alias("search_key"), text.slug(c).alias("slug"))


@query("S-1 S-2", r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(replace(strip_accents(lower(text)), 'ß', 'ss')), '[^\w\s]', '', 'g'), '\s+', ' ', 'g'))) AS key FROM documents""")
def document_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.title_key(F.col("text"))).alias("key"))


@query("S-8 S-9 S-10 P-12", TITLE_SQL + r"""
SELECT id, CASE id % 8 WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN n ELSE title END AS stripped, false AS container,
  CASE id % 8 WHEN 0 THEN title || '|FESTIVAL SUR' WHEN 1 THEN title || '|' || n WHEN 5 THEN title || '|' || n ELSE title END AS forms FROM t""")
def noise_and_forms(spark, sf_dir):
    c = F.col("title")
    return titles(spark, sf_dir).select("id", text.strip_noise(c).alias("stripped"), text.is_container(c).alias("container"), F.array_join(text.title_forms(c), "|").alias("forms"))


@query("S-11 S-12", TITLE_SQL + """
SELECT id, CASE id % 8 WHEN 4 THEN upper(left(n, 1)) || lower(n[2:]) ELSE title END AS cased,
  CASE WHEN id % 3 = 0 AND id % 8 IN (4, 7) THEN n WHEN id % 8 = 4 THEN upper(left(n, 1)) || lower(n[2:]) WHEN id % 3 = 0 AND trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '-', 'g'), '-') = trim(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '-') THEN n ELSE title END AS display FROM t""")
def sentence_case_titles(spark, sf_dir):
    c = F.col("title")
    return titles(spark, sf_dir).select("id", text.case_if_all_caps(c).alias("cased"), text.display_title(c, F.col("n"), F.col("id") % 3 == 0).alias("display"))


@query("S-14 S-15", TITLE_SQL + r"""
SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE n || ', ' || country END AS clean, CASE WHEN id % 8 IN (4, 7) THEN NULL ELSE title END AS program
FROM t""")
def clean_and_echo(spark, sf_dir):
    raw = F.when(F.col("id") % 5 == 0, F.lit(" x ")).otherwise(F.concat("n", F.lit("  (+13) ,"), "country"))
    return titles(spark, sf_dir).select("id", text.clean_text(raw).alias("clean"), text.drop_echo(F.col("title"), F.col("n")).alias("program"))


@query("S-16 S-17 S-18", SQL + """
SELECT id, CASE id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false ELSE true END AS same, id % 5 <> 3 AS comparable FROM f""")
def director_match(spark, sf_dir):
    listed = F.expr("CASE id % 5 WHEN 0 THEN 'Ana Ruiz y José Peña' WHEN 1 THEN 'Charlie Chaplin' WHEN 2 THEN 'Dzigha Vertov' WHEN 3 THEN '黒澤明' ELSE 'JOSE PENA' END")
    names = F.array(F.lit("José Peña"), F.lit("Charles Chaplin"), F.lit("Dziga Vertov"), F.lit("Akira Kurosawa"))
    return films(spark, sf_dir).select("id", text.directors_match(listed, names).alias("same"), text.comparable_scripts(listed, names[0]).alias("comparable"))


@query("S-13", SQL + "SELECT id, CASE WHEN director IS NULL THEN NULL ELSE 'Dir de la ' || upper(left(country, 1)) || lower(split_part(country, ' ', 1)[2:]) END AS person FROM f")
def person_names(spark, sf_dir):
    raw = F.concat(F.lit("DIR  DE LA "), F.split("country", " ")[0])
    return films(spark, sf_dir).select("id", F.when(F.col("director").isNotNull(), text.person_case(raw)).alias("person"))


@query("S-20", SQL + """
SELECT a.id AS a, b.id AS b, abs(a.year - b.year) <= 1 AS strict FROM f a JOIN f b ON a.segment = b.segment AND a.country = b.country AND a.id < b.id
WHERE coalesce(abs(nullif(a.year, 1950) - nullif(b.year, 1950)) <= 1, true)""")
def year_tolerance_pairs(spark, sf_dir):
    f = films(spark, sf_dir).select("id", "segment", "country", "year")
    a, b = f.alias("a"), f.alias("b")
    y = lambda t: F.nullif(F.col(f"{t}.year"), F.lit(1950))
    near = text.year_acceptable(y("a"), y("b"))
    pairs = a.join(b, F.expr("a.segment = b.segment AND a.country = b.country AND a.id < b.id")).filter(near)
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), text.year_concrete(F.col("a.year"), F.col("b.year")).alias("strict"))


@query("S-23", SQL + """
, t AS (SELECT id, id % 5 AS m FROM f)
SELECT id, CASE m WHEN 0 THEN 'TV season' WHEN 1 THEN 'shorts programme' WHEN 2 THEN 'TV episodes' END AS reason FROM t""")
def non_feature_reasons(spark, sf_dir):
    raw = F.expr("CASE id % 5 WHEN 0 THEN concat(title, ' temporada 2') WHEN 1 THEN concat('CORTOS de ', title) WHEN 2 THEN concat(title, ' CAPÍTULOS 1') WHEN 3 THEN 'Corto Maltés' ELSE title END")
    return films(spark, sf_dir).select("id", text.non_feature_reason(raw).alias("reason"))


@query("S-7", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey WHERE levenshtein(a.c_name, b.c_name) <= 1")
def edit_distance_pairs(spark, sf_dir):
    return R.one_edit_pairs(table(spark, sf_dir, "customer"), "c_custkey", "c_name", "c_nationkey")


@query("S-25 S-27", SQL + """
SELECT id, concat_ws('|', 'catalog:' || ext_id, 'venue:' || poster) AS links, CASE WHEN id % 4 = 0 THEN 'error' WHEN id % 3 = 0 THEN 'declined' ELSE 'proposed' END AS lane,
  CASE WHEN id % 4 = 0 THEN NULL ELSE greatest(0.0, least(1.0, (id % 14) / 10.0 - 0.1)) END AS confidence FROM f""")
def verdict_parse(spark, sf_dir):
    body = F.expr("CASE WHEN id % 4 = 0 THEN '{oops' ELSE concat('{\"id\":', CASE WHEN id % 3 = 0 THEN 'null' ELSE cast(id AS string) END, ',\"confidence\":', cast(id % 14 / 10.0 - 0.1 AS decimal(6, 2)), '}') END")
    v = films(spark, sf_dir).withColumn("v", F.from_json(body, "struct<id:long,confidence:double,_bad:string>", {"columnNameOfCorruptRecord": "_bad"}))
    lane = F.when(F.col("v._bad").isNotNull(), "error").when(F.col("v.id").isNull(), "declined").otherwise("proposed")
    links = text.link_set(F.col("ext_id"), F.lit(None).cast("string"), F.col("poster"))
    return v.select("id", F.array_join(links, "|").alias("links"), lane.alias("lane"), F.when(F.col("v.confidence").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v.confidence")))).alias("confidence"))


@query("F-2 F-30", """
SELECT event_id AS id, 'film ' || user_id AS film_title, CASE WHEN user_id % 5 = 0 THEN 'FOCO ' || user_id END AS program_name, CASE WHEN user_id % 2 = 1 THEN 'premiere' ELSE '' END AS tags,
  date_trunc('second', ts) + to_hours(i + 3) AS starts_at, (row_number() OVER (PARTITION BY event_id ORDER BY i) - 1)::INT AS pos
FROM events, range(5) t(i) WHERE ((event_id + i) % 4 <> 0 OR i = 2) AND i <> 1 QUALIFY i <> 3""")
def json_flatten(spark, sf_dir):
    """Landed JSON is made of events: a film with five showtimes, some hidden, the second over, the third without either mark, the fourth unreadable."""
    at = lambda i: F.date_format(F.date_trunc("second", "ts").cast("timestamp_ntz") + F.make_interval(hours=F.lit(i)), "yyyy-MM-dd HH:mm:ss")
    shown = lambda i: F.when(F.lit(i == 2), None).when((F.col("event_id") + i) % 4 == 0, "0").otherwise("1")
    show = lambda i: F.struct((F.lit("soon") if i == 3 else at(i)).alias("at"), shown(i).alias("shown"), F.when(F.lit(i not in (2, 4)), F.lit(i == 1)).alias("expired"))
    title = F.concat(F.lit("film "), "user_id", F.when(F.col("user_id") % 5 == 0, F.concat(F.lit(" — Foco "), "user_id")).otherwise(""))
    body = F.to_json(F.struct(title.alias("title"), (F.col("user_id") % 2).cast("int").alias("release"), F.lit(90).alias("minutes"), F.array(*[show(i) for i in range(5)]).alias("showtimes")))
    landed = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("source"), body.alias("body"))
    rows = S.nested_showtimes(spark, landed)
    return rows.select(F.col("venue_id").cast("long").alias("id"), "film_title", F.upper("program_name").alias("program_name"), F.array_join("tags", ",").alias("tags"), "starts_at", F.col("feed_pos").alias("pos"))


#: Of each kind of source a payload for each part; every fifth can't be read.
KINDS = ("nested", "coded", "month", "events", "printed", "unknown")


@query("X-1 Q-8", """
WITH p AS (SELECT p_partkey AS id, p_partkey % 5 = 0 AS broken, p_partkey % 3 AS k FROM part)
SELECT kind, id::VARCHAR AS payload_id, CASE WHEN broken OR kind = 'unknown' THEN 'failure' ELSE 'success' END AS status,
  CASE WHEN broken OR kind = 'unknown' THEN 0 WHEN kind = 'events' THEN CASE WHEN k = 0 THEN 0 ELSE 1 END WHEN kind = 'printed' THEN 4 ELSE CASE WHEN k = 0 THEN 1 ELSE 2 END END::BIGINT AS n_rows,
  CASE WHEN broken OR kind = 'unknown' THEN 0 WHEN k = 0 THEN 1 ELSE 0 END::BIGINT AS n_warnings,
  CASE WHEN kind = 'unknown' THEN 'no source unknown' WHEN broken THEN 'payload can''t be read' END AS error
FROM p, (VALUES ('nested'), ('coded'), ('month'), ('events'), ('printed'), ('unknown')) t(kind)""")
def source_results(spark, sf_dir):
    """Five sources and one that is not registered, on payloads of which every fifth is broken and every third has something unreadable in it."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("payload_id"), "p_name", (F.col("p_partkey") % 5 == 0).alias("broken"), (F.col("p_partkey") % 3 == 0).alias("odd"))
    at = F.when(F.col("odd"), "soon").otherwise("2024-02-03 20:30:00")
    show = lambda code, hour, place: F.struct((code if code is not None else F.lit("a")).alias("code"), F.lit(hour).alias("hour"), F.lit(place).alias("complex"))
    event = lambda i, area, start: F.struct(F.lit(i).alias("id"), F.lit(area).alias("area"), F.col("p_name").alias("title"), start.alias("start"))
    bodies = {
        "nested": F.to_json(F.struct(F.col("p_name").alias("title"), F.array(F.struct(F.lit("2024-02-02 18:00:00").alias("at")), F.struct(at.alias("at"))).alias("showtimes"))),
        "coded": F.to_json(F.struct(
            F.lit("2024-02-02").alias("day"), F.lit("main").alias("complex"), F.array(F.struct(F.lit("a").alias("code"), F.col("p_name").alias("name"))).alias("films"),
            F.array(show(None, "18:00", "main"), show(F.when(F.col("odd"), "z").otherwise("a"), "2030", "main"), show(None, "21:00", "other")).alias("shows"),
        )),
        "month": F.to_json(F.array(event("1", "room", F.lit("2024-02-02 18:00")), event("2", "room", at), event("3", "bar", at))),
        "events": F.to_json(F.struct(F.concat("p_name", F.lit(" (Ana Ruiz, 1999)")).alias("name"), at.alias("start"), F.array(F.struct(F.lit("EventbriteFormat").alias("prefix"), F.lit("EventbriteFormat/7").alias("tag"))).alias("tags"))),
        "printed": F.concat_ws("\n", F.when(F.col("broken"), " ").otherwise(F.col("p_name")), F.lit("Ficha"), F.lit("Viernes 2 y sábado 3 de febrero, 18 y 20.30 horas"), F.when(F.col("odd"), "Un día a las 20 horas").otherwise("fin")),
    }
    out = None
    for kind in KINDS:
        body = bodies.get(kind, F.lit("x"))
        landed = p.select("payload_id", F.lit("room").alias("source"), (body if kind == "printed" else F.when(F.col("broken"), F.lit("{oops")).otherwise(body)).alias("body"))
        found = S.fetch(kind, spark, landed, NOW).results.select(F.lit(kind).alias("kind"), "payload_id", "status", F.col("rows").alias("n_rows"), F.col("warnings").alias("n_warnings"), "error")
        out = found if out is None else out.unionByName(found)
    return out


CODED = """
WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type AS source, user_id % 30 AS film, user_id % 7 AS known, hour(ts) AS h, event_id FROM events)
"""


def _coded(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("cast(cast(ts AS date) AS string) AS day", "event_type AS source", "cast(user_id % 30 AS string) AS code", "user_id % 7 AS known", "event_id")
    film = F.when(F.col("known") > 0, F.struct("code", F.concat(F.lit("Film "), "code").alias("name")))
    show = F.struct("code", F.concat("event_id").cast("string").alias("hour"), F.when(F.col("event_id") % 3 > 0, "main").otherwise("annex").alias("complex"))
    body = F.to_json(F.struct(F.array_sort(F.array_distinct(F.collect_list(film))).alias("films"), F.collect_list(show).alias("shows")))
    return e.groupBy("source", "day").agg(body.alias("body"))


@query("F-3 Q-2", CODED + """, k AS (SELECT DISTINCT day, source, film FROM e WHERE known > 0)
SELECT e.source, strftime(e.day, '%Y-%m-%d') AS day, e.event_id, 'Film ' || e.film AS name FROM e JOIN k USING (day, source, film) WHERE e.event_id % 3 > 0""")
def coded_showtimes(spark, sf_dir):
    shows, _ = S.coded_showtimes(_coded(spark, sf_dir), "main")
    return shows.select("source", "day", F.col("hour").cast("long").alias("event_id"), "name")


@query("F-3 J-13", CODED + """, k AS (SELECT DISTINCT day, source, film FROM e WHERE known > 0)
SELECT e.source, strftime(e.day, '%Y-%m-%d') AS day, count(*) AS unknown FROM e WHERE event_id % 3 > 0 AND NOT EXISTS (SELECT 1 FROM k WHERE k.day = e.day AND k.source = e.source AND k.film = e.film) GROUP BY 1, 2""")
def unknown_film_warnings(spark, sf_dir):
    _, unknown = S.coded_showtimes(_coded(spark, sf_dir), "main")
    return unknown.groupBy("source", "day").agg(F.count("*").alias("unknown"))


@query("F-26", """
WITH d AS (SELECT p_partkey % 500 AS film, min(p_name) AS n FROM part GROUP BY 1)
SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_name END, n) AS synopsis FROM customer LEFT JOIN d ON c_custkey % 500 = film""")
def detail_enrichment(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_custkey % 500 AS film", "CASE WHEN c_custkey % 3 > 0 THEN c_name END AS synopsis")
    d = table(spark, sf_dir, "part").selectExpr("p_partkey % 500 AS film", "p_name AS synopsis")
    return S.merge_details(c, d, "film", ["synopsis"]).select("id", "synopsis")


@query("F-6", "SELECT count(*) FILTER (WHERE user_id % 3 = 0) AS kept, count(*) FILTER (WHERE user_id % 3 > 0) AS dropped, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT user_id FROM events)) AS missing FROM events")
def only_requested(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"))
    e = table(spark, sf_dir, "events").select("user_id")
    rows = e.groupBy("user_id").agg(F.count("*").alias("n")).join(asked.withColumn("asked", F.lit(True)), "user_id", "full_outer")
    both = F.col("asked").isNotNull()
    return rows.agg(F.sum(F.when(both, F.col("n"))).alias("kept"), F.sum(F.when(~both, F.col("n"))).alias("dropped"), F.count_if(both & F.col("n").isNull()).alias("missing")).fillna(0)


@query("F-28", r"""
SELECT page_id, regexp_replace(url, '[-/]\d+(?:-\d+)*(?:\.html)?/?(?:[?#].*)?$', '') AS series, regexp_matches(url, '^https?://([^/?#]*\.)?example\.(org|com)([/?#]|$)') AS allowed FROM pages""")
def series_keys(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", S.series_key(u).alias("series"), S.host_allowed(u, ["example.org", "example.com"]).alias("allowed"))


@query("F-8 F-36", SQL + """
SELECT id, array_to_string(list_filter([CASE WHEN k % 3 = 0 THEN 'premiere' END, CASE WHEN k % 4 = 0 THEN 'unique' END, CASE WHEN k % 3 = 0 OR k % 4 = 0 THEN 'cycle' END], lambda x: x IS NOT NULL), ',') AS tags,
  CASE WHEN k % 2 = 0 THEN 'retrospective' ELSE 'restored' END AS program_tags FROM s""")
def label_tags(spark, sf_dir):
    labels = F.array_compact(F.array(F.expr("CASE WHEN k % 3 = 0 THEN 'Estrenó ya' END"), F.expr("CASE WHEN k % 4 = 0 THEN 'FUNCIÓN ESPECIAL' END")))
    program = F.expr("CASE WHEN k % 2 = 0 THEN 'Gran Retrospectiva' ELSE 'Copia restaurada' END")
    return screenings(spark, sf_dir).select("id", F.array_join(S.label_tags(labels), ",").alias("tags"), F.array_join(S.keyword_tags(program), ",").alias("program_tags"))


@query("F-9", r"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS l FROM pages), b AS (SELECT page_id, unnest(l) AS a, generate_subscripts(l, 1) - 1 AS pos FROM a),
c AS (SELECT page_id, pos::INT AS pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '>([^<]*)<', 1) AS label FROM b)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1""")
def html_links(spark, sf_dir):
    return S.cards(table(spark, sf_dir, "pages"))


@query("F-10", SQL + "SELECT id, 'Dir ' || (id % 50) AS director, (1950 + id % 76)::VARCHAR AS year, 'X: Y' AS country FROM f")
def labelled_credits(spark, sf_dir):
    block = F.expr("concat('Dirección: Dir ', id % 50, '\nnoise\nAño:  ', 1950 + id % 76, '\nPaís: X: Y\nDIRECCION: Another', CASE WHEN id % 3 = 0 THEN '\naño: 1900' ELSE '' END)")
    c = films(spark, sf_dir).select("id", S.credits(block).alias("c"))
    return c.select("id", F.col("c")["direccion"].alias("director"), F.col("c")["ano"].alias("year"), F.col("c")["pais"].alias("country"))


@query("F-13 F-14 F-15 F-16", SQL + """
SELECT id, title, CASE WHEN id % 4 IN (0, 2) THEN 'Ana Ruiz' END AS director, CASE id % 4 WHEN 0 THEN 1950 + id % 70 WHEN 1 THEN 2001 END::INT AS year, CASE WHEN id % 4 = 3 THEN 'Noche rara' END AS program,
  'X Y' AS poster, title AS shifted, '18:30' AS at FROM (SELECT id, replace(title, '#', ' ') AS title FROM f)""")
def title_decomposition(spark, sf_dir):
    f = films(spark, sf_dir).selectExpr("id", "replace(title, '#', ' ') AS t")
    raw = F.expr("CASE id % 4 WHEN 0 THEN concat(t, ' (Ana Ruiz, ', 1950 + id % 70, ')') WHEN 1 THEN concat(t, ' (2001)') WHEN 2 THEN concat(t, ' de Ana Ruiz') ELSE concat('Noche rara: \"', t, '\"') END")
    p = f.withColumn("p", S.split_title(raw))
    return p.select("id", "p.*", S.poster_title(F.lit('"“X Y” (1999)" (2001)')).alias("poster"), S.shift_suffix(F.concat("t", F.lit(" 12/03 - Primer Turno"))).alias("shifted"), S.showtime_line(F.concat(F.lit("18:30 "), "t", F.lit(" (95') de Ana Ruiz")))["time"].alias("at"))


@query("F-17", "SELECT p_partkey AS id, DATE '2024-01-01' + i::INT AS day, t AS time FROM part, LATERAL (SELECT unnest(range(p_size % 7 + 1)) AS i), (SELECT unnest(['14:00', '20:30']) AS t)")
def schedule_expansion(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "DATE'2024-01-01' AS a", "date_add(DATE'2024-01-01', p_size % 7) AS b", "array('14:00', '20:30') AS hours")
    return S.expand_schedule(p, "a", "b", "hours").select("id", "day", "time")


@query("F-18 F-24", """
SELECT p_partkey AS id, d.day + (t || ':00')::INTERVAL + INTERVAL 3 HOURS AS starts_at FROM part, LATERAL (
  SELECT unnest([CASE WHEN p_size % 2 = 0 THEN DATE '2024-01-11' ELSE DATE '2024-01-13' END, DATE '2024-01-12'])::TIMESTAMP AS day) d, (SELECT unnest(['16:55', '19:10']) AS t)""")
def weekly_grid(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "concat(CASE WHEN p_size % 2 = 0 THEN 'Ju' ELSE 'Sa' END, ' - Vi - Vi | 16:55, 19:10, 16:55') AS line")
    g = S.weekly_grid(p, "line", F.lit(f"{NOW:%Y-%m-%d}").cast("date"))
    hm = F.split("time", ":")
    return g.select("id", S.wall_to_utc(F.col("day"), hm[0].cast("int"), hm[1].cast("int")).alias("starts_at"))


@query("F-20", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + INTERVAL 23 HOURS + INTERVAL 30 MINUTES END AS starts_at FROM orders")
def spanish_dates(spark, sf_dir):
    d = F.to_date("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.lit("31 de febrero de 2024, 20:30")).otherwise(F.concat(F.dayofmonth(d), F.lit(" de "), F.initcap(times.month_name(d)), F.lit(" de "), F.year(d), F.lit(", 20:30")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.spanish_date(raw).alias("starts_at"))


@query("F-21", """
WITH x AS (SELECT c_custkey AS id, (c_custkey % 12 + 1)::INT AS m, (c_custkey % 28 + 1)::INT AS d FROM customer), y AS (SELECT *, make_date(2024 + k, m, d) AS a FROM x, (SELECT unnest([-1, 0, 1])::INT AS k)),
z AS (SELECT id, min(a) FILTER (WHERE abs(datediff('day', DATE '2024-01-15', a)) <= 240) AS a FROM y GROUP BY id)
SELECT id, CASE WHEN datediff('day', DATE '2024-01-15', a) <= 120 THEN a END AS first_day FROM z""")
def inferred_years(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "concat(lpad(c_custkey % 12 + 1, 2, '0'), '-', lpad(c_custkey % 28 + 1, 2, '0')) AS md")
    return S.inferred_year(c, F.col("md"), None, NOW).select("id", "first_day")


@query("F-22 W-16", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_shipdate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS pos FROM lineitem),
y AS (SELECT *, day(l_shipdate) AS d, lag(day(l_shipdate)) OVER (PARTITION BY l_orderkey ORDER BY pos) AS before FROM x),
z AS (SELECT l_orderkey, pos, ((1 + sum(CASE WHEN d < before THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY pos) - 1) % 12 + 1)::BIGINT AS carried FROM y),
q AS (SELECT *, lag(carried) OVER (PARTITION BY l_orderkey ORDER BY pos) AS last FROM z)
SELECT l_orderkey, pos, carried, sum(CASE WHEN carried < last THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY pos)::BIGINT AS years FROM q""")
def month_carry_forward(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber")
    x = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(w).cast("long")).select("l_orderkey", "pos", F.dayofmonth("l_shipdate").alias("d"), F.lit(None).cast("int").alias("m"))
    return S.carry_months(x, "l_orderkey", "pos", "d", "m", F.lit(1)).select("l_orderkey", "pos", F.col("carried").cast("long").alias("carried"), F.col("years").cast("long").alias("years"))


@query("F-23", """
WITH x AS (SELECT o_orderkey AS id, month(o_orderdate) AS m, day(o_orderdate) AS d, isodow(o_orderdate) AS w FROM orders), y AS (SELECT id, list(k) FILTER (WHERE isodow(try_cast(k || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS DATE)) = w) AS ks FROM x, (SELECT unnest([1996, 1997, 1998])::INT AS k) GROUP BY id)
SELECT id, CASE WHEN len(ks) = 1 THEN ks[1] END AS year FROM y""")
def weekday_years(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "month(o_orderdate) AS m", "day(o_orderdate) AS d", "weekday(o_orderdate) AS w")
    return S.weekday_year(o, "m", "d", "w", [1996, 1997, 1998]).select("id", "year")


@query("F-25", "SELECT l_orderkey, count(*) FILTER (WHERE datediff('day', o_orderdate, l_shipdate) BETWEEN 0 AND 6) AS premieres FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def release_week(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
    return l.groupBy("l_orderkey").agg(F.count_if(S.release_week(F.col("l_shipdate"), F.col("o_orderdate"))).alias("premieres"))


@query("F-27 F-29", SQL + "SELECT kind, count(*) AS n, string_agg(DISTINCT venue_id::VARCHAR, ',' ORDER BY venue_id::VARCHAR) FILTER (WHERE venue_id <> 3) AS rooms FROM s WHERE starts_at > TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1")
def offsite_rooms(spark, sf_dir):
    s = screenings(spark, sf_dir).filter(F.col("starts_at") > times.lit(NOW))
    rooms = F.array_sort(F.collect_set(F.when(F.col("venue_id") != 3, F.col("venue_id").cast("string"))))
    return s.groupBy("kind").agg(F.count("*").alias("n"), F.array_join(rooms, ",").alias("rooms"))


@query("F-31", SQL + "SELECT id AS page_id, CASE WHEN id % 3 = 0 THEN 'first.jpg' ELSE 'b~mv-' || (300 + id % 50) || 'x900.jpg' END AS src FROM f")
def largest_images(spark, sf_dir):
    """Other images are larger, but only some have the marker; a third of pages have none of these."""
    html = F.expr("CASE WHEN id % 3 = 0 THEN '<img src=\"x-900x900.png\"><img src=\"first.jpg\">' ELSE concat('<img src=\"big-9999x9999.jpg\"><img src=\"a~mv-10x10.jpg\"><img src=\"b~mv-', 300 + id % 50, 'x900.jpg\">') END")
    return S.largest_image(films(spark, sf_dir).select(F.col("id").alias("page_id"), html.alias("html")), "~mv", "first")


@query("F-32", r"""
WITH p AS (SELECT page_id, regexp_extract_all(html, '<p>([^<]*)</p>', 1) AS l FROM pages), x AS (SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM p),
b AS (SELECT page_id, trim(arg_max(t, (length(t), -i))) AS t FROM x GROUP BY page_id)
SELECT page_id, CASE WHEN length(t) >= 60 THEN t END AS synopsis FROM pages LEFT JOIN b USING (page_id)""")
def longest_blocks(spark, sf_dir):
    parts = F.transform(F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), F.lit(1)), lambda x: F.concat(x, F.lit("  Texto de Ana Ruiz y Eva Paz. ")))
    return table(spark, sf_dir, "pages").select("page_id", S.longest_block(parts, 60).alias("synopsis"))


@query("F-35", """
WITH x AS (SELECT conv_id, turn, role, text FROM conversations), y AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM x),
z AS (SELECT conv_id, block::BIGINT AS block, arg_min(text, turn) FILTER (WHERE role = 'user') AS title, count(*) AS n_lines, coalesce(string_agg(regexp_extract(text, '^(\\p{L}+)', 1), ' ' ORDER BY turn) FILTER (WHERE regexp_extract(text, '^(\\p{L}+)', 1) <> ''), '') AS times,
  bool_or(text LIKE '%z%') AS short FROM y WHERE block > 0 GROUP BY conv_id, block), q AS (SELECT *, count_if(short) OVER (PARTITION BY conv_id) AS skipped FROM z)
SELECT conv_id, block, title, n_lines, times, skipped FROM q WHERE NOT short""".replace("\\\\", "\\"))
def line_blocks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"]).select("conv_id", "turn", "role", F.col("text").alias("line"))
    return S.blocks(c, "conv_id", "turn", F.col("role") == "user", F.regexp_extract("line", r"^(\p{L}+)", 1), F.col("line").contains("z"))


@query("F-39", """
WITH l AS (SELECT sha256(html || 'v1') AS stamp FROM pages WHERE page_id % 2 = 0) SELECT page_id FROM pages WHERE sha256(html || 'v1') NOT IN (SELECT stamp FROM l)""")
def changed_payloads(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("body"))
    done = p.filter("page_id % 2 = 0").select(F.sha2(F.concat("body", F.lit("v1")), 256).alias("stamp"))
    return S.unchanged(p, done, "v1").select("page_id")


@query("X-2 F-33", """SELECT o_orderkey AS id, (CASE WHEN o_orderkey % 2 = 0 THEN least(month(o_orderdate), 99) ELSE month(o_orderdate) END)::INT AS month FROM orders""")
def earliest_months(spark, sf_dir):
    d = F.to_date("o_orderdate")
    raw = F.concat(F.lit("Del 3 de "), times.month_name(d), F.lit(" al 5 de "), times.month_name(F.add_months(d, 1)))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.earliest_month(raw).cast("int").alias("month"))
