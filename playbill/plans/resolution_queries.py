"""Resolution queries on the given tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import resolve as R
from .roles import table

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


def _listing_rows(spark, sf_dir):
    """Parts as listed titles, some with noise, some without year, some with a director."""
    p = table(spark, sf_dir, "part")
    return p.selectExpr(
        "p_partkey AS listing_id", "CASE p_partkey % 3 WHEN 0 THEN concat('CICLO SUR: ', p_name) WHEN 1 THEN concat(p_name, 's') ELSE p_name END AS title", "cast(NULL AS string) AS original",
        "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 1950 + p_size END AS year", "CASE WHEN p_partkey % 6 = 0 THEN p_brand END AS director")


def _catalog(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.selectExpr("p_partkey AS ext_id", "p_name AS cat_title", "cast(NULL AS string) AS cat_original", "1950 + p_size AS cat_year", "p_retailprice AS popularity", "p_partkey * 37 % 3000 AS votes", "array(p_brand) AS cat_directors")


#: Forms of titles (q: looked up, c: of the catalog), the words that find them, their keys, and pairs of forms that share one.
MET = r"""
WITH RECURSIVE p AS (
  SELECT DISTINCT p_partkey % 3 AS kind, p_name, CASE p_partkey % 3 WHEN 0 THEN 'CICLO SUR: ' || p_name WHEN 1 THEN p_name || 's' ELSE p_name END AS title FROM part
), q AS (
  SELECT DISTINCT title, unnest(CASE kind WHEN 0 THEN ['ciclo sur ' || p_name, 'ciclo sur', p_name] WHEN 1 THEN [p_name || 's'] ELSE [p_name] END) AS k FROM p
), c AS (
  SELECT DISTINCT p_name AS k FROM part
), forms AS (
  SELECT k FROM q UNION SELECT k FROM c
), words AS (
  SELECT word, count(*) AS df FROM (SELECT k, unnest(list_distinct(string_split(k, ' '))) AS word FROM c) GROUP BY word
), weighed AS (
  SELECT k, word, length(bin(n // coalesce(df, 1))) - 1 AS weight
  FROM (SELECT k, unnest(list_distinct(string_split(k, ' '))) AS word FROM forms) LEFT JOIN words USING (word), (SELECT count(*) AS n FROM c)
), summed AS (
  SELECT k, word, sum(weight) OVER (PARTITION BY k) AS total, sum(weight) OVER (PARTITION BY k ORDER BY weight DESC, word) - weight AS before FROM weighed
), less AS (
  SELECT k, 'd:' AS mark, k AS w FROM forms UNION ALL
  SELECT k, 'w:', word FROM summed WHERE total > 0 AND 10 * (total - before) >= 3 * total
), once AS (
  SELECT k, mark, w, left(w, greatest(i - 1, 0)) || substr(w, i + 1) AS x
  FROM (SELECT *, unnest(range(0, CASE WHEN mark = 'w:' AND length(w) < 4 THEN 1 ELSE length(w) + 1 END)::INT[]) AS i FROM less)
), keys AS (
  SELECT DISTINCT k, mark || x AS key FROM (
    SELECT k, mark, x FROM once UNION ALL
    SELECT k, mark, left(x, greatest(i - 1, 0)) || substr(x, i + 1)
    FROM (SELECT *, unnest(range(0, length(x) + 1)::INT[]) AS i FROM once WHERE mark = 'd:' AND length(w) BETWEEN 2 AND 12 AND length(x) = length(w) - 1))
), met AS (
  SELECT DISTINCT q.title, c.k AS cat_title FROM q JOIN keys a ON a.k = q.k JOIN keys b USING (key) JOIN c ON c.k = b.k
)
"""

#: Similarity of the pairs, letter by letter, then ranked candidates of the listings.
RANKED = MET.rstrip() + r""", asked AS (
  SELECT DISTINCT title, unnest(CASE kind WHEN 0 THEN ['ciclo sur ' || p_name, p_name] WHEN 1 THEN [p_name || 's'] ELSE [p_name] END) AS a FROM p
), walk AS (
  SELECT DISTINCT a, cat_title AS b, 1 AS i, repeat('0', length(cat_title)) AS used, '' AS got, greatest(greatest(length(a), length(cat_title)) // 2 - 1, 0) AS reach FROM asked JOIN met USING (title)
  UNION ALL
  SELECT a, b, i + 1, CASE WHEN j IS NULL THEN used ELSE left(used, (j - 1)::INT) || '1' || substr(used, (j + 1)::INT) END, CASE WHEN j IS NULL THEN got ELSE got || substr(a, i, 1) END, reach
  FROM (SELECT *, list_min(list_filter(range(greatest(1, i - reach), least(length(b), i + reach) + 1), lambda x: substr(b, x, 1) = substr(a, i, 1) AND substr(used, x, 1) = '0')) AS j
    FROM walk WHERE i <= length(a))
), ended AS (
  SELECT a, b, length(got)::DOUBLE AS m, len(list_filter(range(1, length(got) + 1), lambda x: substr(got, x, 1) <> substr(other, x, 1))) / 2 AS swaps,
    CASE WHEN left(a, 4) = left(b, 4) THEN 4 WHEN left(a, 3) = left(b, 3) THEN 3 WHEN left(a, 2) = left(b, 2) THEN 2 WHEN left(a, 1) = left(b, 1) THEN 1 ELSE 0 END AS head
  FROM (SELECT *, array_to_string(list_transform(list_filter(range(1, length(b) + 1), lambda x: substr(used, x, 1) = '1'), lambda x: substr(b, x, 1)), '') AS other FROM walk WHERE i = length(a) + 1)
), jaro AS (
  SELECT a, b, head, CASE WHEN m > 0 THEN (m / length(a) + m / length(b) + (m - swaps) / m) / 3 ELSE 0 END AS j FROM ended
), scored AS (
  SELECT title, b AS cat_title, max(CASE WHEN a = b THEN 1.0::DOUBLE WHEN j > 0 THEN j + head * 0.1::DOUBLE * (1 - j) ELSE 0 END) AS score
  FROM asked JOIN met USING (title) JOIN jaro USING (a) WHERE jaro.b = met.cat_title GROUP BY ALL
), l AS (
  SELECT p_partkey AS listing_id, CASE p_partkey % 3 WHEN 0 THEN 'CICLO SUR: ' || p_name WHEN 1 THEN p_name || 's' ELSE p_name END AS title,
    CASE WHEN p_partkey % 4 > 0 THEN 1950 + p_size END AS year, CASE WHEN p_partkey % 6 = 0 THEN p_brand END AS director FROM part
), cat AS (
  SELECT p_partkey AS ext_id, p_name AS cat_title, 1950 + p_size AS cat_year, p_retailprice AS popularity, p_partkey * 37 % 3000 AS votes, p_brand AS credited FROM part
), rows AS (
  SELECT listing_id, ext_id, score, director, credited, popularity, votes, max(score) OVER (PARTITION BY listing_id) AS top
  FROM l JOIN scored USING (title) JOIN cat USING (cat_title) WHERE coalesce(abs(year - cat_year) <= 1, true)
), banded AS (
  SELECT *, score >= top - 0.01::DOUBLE AS band FROM rows
), ranked AS (
  SELECT *, band AND score >= 0.85::DOUBLE AS e, coalesce(levenshtein(lower(director), lower(credited)) <= 1, false) AS agrees,
    row_number() OVER (PARTITION BY listing_id ORDER BY band DESC, CASE WHEN NOT band THEN score END DESC, popularity DESC, ext_id) AS rank FROM banded
), champions AS (
  SELECT *, row_number() OVER w AS i, lead(CASE WHEN e THEN votes END) OVER w AS rival, count(*) FILTER (WHERE e) OVER (PARTITION BY listing_id) AS n
  FROM ranked WINDOW w AS (PARTITION BY listing_id ORDER BY e DESC, votes DESC, ext_id)
), passed AS (
  SELECT * FROM champions WHERE e AND i = 1 AND (n = 1 OR director IS NULL AND votes >= 100 AND votes >= 4 * greatest(coalesce(rival, 1), 1))
)
"""


@query("J-9 S-2 S-10", MET + "SELECT title, cat_title FROM met")
def candidate_blocking(spark, sf_dir):
    return R.title_pairs(_listing_rows(spark, sf_dir), _catalog(spark, sf_dir)).select("title", "cat_title")


@query("J-10 W-6 R-1 S-6 W-7 W-8", RANKED + "SELECT listing_id, ext_id, score FROM passed")
def best_matches(spark, sf_dir):
    listings, catalog = _listing_rows(spark, sf_dir), _catalog(spark, sf_dir)
    return R.matches(listings, catalog)


@query("R-2 J-11 W-10 W-15", RANKED.rstrip() + r""", left_ AS (
  SELECT * FROM l WHERE listing_id % 35 > 0
), third AS (
  SELECT listing_id, arg_min(ext_id, rank) AS ext_id, greatest(arg_min(score, rank), 0.85::DOUBLE) AS score FROM ranked WHERE rank <= 3 AND agrees GROUP BY listing_id
), pivot_ AS (
  SELECT listing_id, min(ext_id) AS ext_id FROM left_ JOIN cat ON director = credited AND abs(year - cat_year) <= 1 GROUP BY listing_id HAVING count(DISTINCT ext_id) = 1
), found AS (
  SELECT listing_id, 1 AS step, listing_id AS ext_id, 1.0::DOUBLE AS score FROM l WHERE listing_id % 35 = 0
  UNION ALL SELECT listing_id, 2, ext_id, score FROM passed JOIN left_ USING (listing_id) WHERE passed.director IS NULL OR agrees
  UNION ALL SELECT listing_id, 3, ext_id, third.score FROM third JOIN left_ USING (listing_id)
  UNION ALL SELECT listing_id, 4, ext_id, 0.85::DOUBLE FROM pivot_
), first_ AS (
  SELECT listing_id, min(step) AS step, arg_min(ext_id, step) AS ext_id, arg_min(score, step) AS score FROM found GROUP BY listing_id
)
SELECT listing_id, ext_id, score, ['override', 'match', 'director', 'pivot'][step] AS stage,
  CASE WHEN step IS NOT NULL THEN 'ok' WHEN listing_id IN (SELECT listing_id FROM rows) THEN 'low-confidence' ELSE 'no-candidates' END AS reason
FROM l LEFT JOIN first_ USING (listing_id)""")
def enrichment_cascade(spark, sf_dir):
    listings, catalog = _listing_rows(spark, sf_dir), _catalog(spark, sf_dir)
    overrides = listings.filter("listing_id % 35 = 0").select("listing_id", F.col("listing_id").alias("ext_id"))
    credits = catalog.select(F.col("cat_directors")[0].alias("name"), "ext_id", "cat_year")
    return R.resolve(listings, catalog, overrides, credits)


BAND = """WITH p AS (SELECT p_name, p_brand, p_partkey AS id, p_size AS votes, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_size DESC, p_partkey) AS i,
  lead(p_size) OVER (PARTITION BY p_name, p_brand ORDER BY p_size DESC, p_partkey) AS rival FROM part)
"""


@query("W-7 W-8", BAND + "SELECT p_name, p_brand, id AS champion FROM p WHERE i = 1 AND votes >= 4 * greatest(coalesce(rival, 0), 1)")
def vote_dominance(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_name", "p_brand", F.col("p_partkey").alias("ext_id"), F.col("p_size").alias("votes"))
    return R.vote_champions(p, ["p_name", "p_brand"], least_votes=0).select("p_name", "p_brand", F.col("ext_id").alias("champion"))


@query("W-9", """
WITH c AS (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY 1), v AS (SELECT p_name, p_partkey AS id, p_partkey * 37 % 3000 AS votes FROM part)
SELECT c.id AS listing_id, max(votes) FILTER (WHERE v.id = c.id) >= 4 * greatest(coalesce(max(votes) FILTER (WHERE v.id <> c.id), 1), 1) AS dominant FROM c JOIN v USING (p_name) GROUP BY c.id""")
def chosen_dominates(spark, sf_dir):
    p = _catalog(spark, sf_dir)
    rows = p.withColumn("listing_id", F.min("ext_id").over(W.partitionBy("cat_title")))
    return R.dominates(rows, rows.select("listing_id", F.col("listing_id").alias("ext_id")).distinct())


@query("W-15", "SELECT p_brand, p_size, min(p_partkey) AS id FROM part GROUP BY 1, 2 HAVING count(*) = 1")
def exactly_one(spark, sf_dir):
    return R.only_one(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_partkey").select("p_brand", "p_size", F.col("p_partkey").alias("id"))


@query("R-3 S-21", """
WITH p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'researched' ELSE 'judged' END AS kind, 0.8 + o_orderkey % 20 / 100.0 AS c, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 50 END AS y, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 50 END AS cy,
  CASE WHEN o_orderkey % 5 > 0 THEN 90 END AS rt, CASE WHEN o_orderkey % 7 > 0 THEN 84 + o_orderkey % 9 END AS crt, o_orderkey % 13 = 0 AS dok, o_orderkey % 6 = 0 AS dk, o_orderstatus = 'F' AS tok FROM orders)
SELECT id, CASE WHEN kind <> 'judged' THEN 'researched' WHEN coalesce(abs(rt - crt) > 5, false) THEN 'runtime' WHEN c >= 0.9 AND (coalesce(abs(y - cy) <= 1, false) OR dok OR coalesce(abs(rt - crt) <= 5, false)) THEN 'apply'
  WHEN c >= 0.95 AND tok AND NOT coalesce(abs(y - cy) > 1, false) AND NOT (dk AND NOT dok) THEN 'apply' WHEN c < 0.9 THEN 'confidence' WHEN tok AND c < 0.95 THEN 'title bar' ELSE 'no corroboration' END AS verdict FROM p""")
def proposal_gate(spark, sf_dir):
    p = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "CASE WHEN o_orderkey % 11 = 0 THEN 'researched' ELSE 'judged' END AS kind", "0.8 + o_orderkey % 20 / 100.0 AS confidence", "CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 50 END AS year", "CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 50 END AS cat_year",
        "CASE WHEN o_orderkey % 5 > 0 THEN 90 END AS runtime", "CASE WHEN o_orderkey % 7 > 0 THEN 84 + o_orderkey % 9 END AS cat_runtime", "o_orderkey % 13 = 0 AS director_ok", "o_orderkey % 6 = 0 AS director_known", "o_orderstatus = 'F' AS title_ok")
    return R.gate(p).select("id", "verdict")


@query("R-4 J-15", """
WITH v AS (SELECT c_custkey AS id, c_custkey % 4 AS pick, c_custkey % 7 = 0 AS error FROM customer WHERE c_custkey % 10 < 9), s AS (SELECT c_custkey AS id, unnest([0, 1, 2]) AS ext FROM customer WHERE c_custkey % 3 > 0),
j AS (SELECT c_custkey AS id, EXISTS (SELECT 1 FROM s WHERE s.id = c_custkey) AS a, v.pick, v.error, EXISTS (SELECT 1 FROM s WHERE s.id = c_custkey AND s.ext = v.pick) AS ok FROM customer LEFT JOIN v ON v.id = c_custkey)
SELECT id AS listing_id, CASE WHEN NOT a THEN 'no-candidate' WHEN coalesce(error, true) THEN 'error' WHEN ok THEN 'proposed' ELSE 'declined' END AS lane, CASE WHEN a AND NOT coalesce(error, true) AND ok THEN pick END AS ext_id,
  CASE WHEN a AND NOT coalesce(error, true) AND ok THEN 0.5 ELSE 0.0 END AS confidence FROM j""")
def proposal_lanes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("listing_id"))
    shown = c.filter("listing_id % 3 > 0").select("listing_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("ext_id"))
    verdicts = c.filter("listing_id % 10 < 9").selectExpr("listing_id", "listing_id % 4 AS ext_id", "0.5D AS confidence", "listing_id % 7 = 0 AS error")
    return R.proposals(c, shown, verdicts)


@query("R-7 U-2 J-4", """
WITH m AS (SELECT c_custkey AS listing_id, c_name AS title, c_custkey % 9 AS ext_id FROM customer), s AS (SELECT -row_number() OVER (ORDER BY s_name, s_suppkey % 9) AS listing_id, s_name AS title, s_suppkey % 9 AS ext_id FROM supplier)
SELECT *, listing_id >= 0 AND (ext_id = 4 OR ext_id = listing_id % 5) AS reachable FROM (SELECT * FROM m UNION ALL SELECT * FROM s)""")
def golden_cases(spark, sf_dir):
    manual = table(spark, sf_dir, "customer").selectExpr("c_custkey AS listing_id", "c_name AS title", "c_custkey % 9 AS ext_id")
    seeds = table(spark, sf_dir, "supplier").selectExpr("s_name AS title", "s_suppkey % 9 AS ext_id")
    shown = manual.select("listing_id", F.explode(F.array(F.col("listing_id") % 5, F.lit(4).cast("long"))).alias("ext_id"))
    return R.golden_set(manual, seeds, shown)
