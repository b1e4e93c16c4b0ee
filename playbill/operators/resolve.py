"""Resolution of listed titles against a catalog: candidates, scores, disambiguation, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.similarity import key_similarity
from ..storage import saved
from .catalog import numbered

# Thresholds of the matcher and of the gate.
THRESHOLD, TIE, LEAST_VOTES, DOMINANCE = 0.85, 0.01, 100, 4
APPLY, APPLY_TITLE, RUNTIME_SLACK = 0.9, 0.95, 5


#: Letters of a form up to which any two may be wrong, and letters from which a word may have one wrong.
SHORT, LEAST_LETTERS = 12, 4
#: Tenths of a form's weight that two forms must share by words to meet.
SHARED = 3
TITLE, CAT_TITLE = ["title", "original"], ["cat_title", "cat_original"]


def _without(k: Column, i: Column) -> Column:
    return F.concat(F.substring(k, F.lit(1), i - 1), F.substring(k, i + 1, F.length(k)))


def _less_one(k: Column, mark: str) -> Column:
    """The text itself and all that it is without one letter, after a mark."""
    return F.transform(F.sequence(F.lit(0), F.length(k)), lambda i: F.concat(F.lit(mark), _without(k, i)))


def rare_words(forms: DataFrame, known: DataFrame) -> DataFrame:
    """(k, rare): of each distinct form the words under which it is found, among all distinct forms `known` (k).

    A word weighs the binary logarithm of how rare it is among the known forms, rounded down; one in over half of them weighs nothing, one that they lack the most. Words are
    taken by weight, then alphabet, as long as they and those behind them have SHARED tenths of the form's weight. So two forms
    that share such a part of either's weight share a word that both take, and a head that many titles have brings none of them together.
    """
    words = known.select("k", F.explode(F.array_distinct(F.split("k", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    total = known.agg(F.count("*")).scalar()
    log2 = lambda n: F.length(F.bin(n)) - 1
    weights = words.select("word", log2(F.floor(total / F.col("df")).cast("long")).alias("weight"))
    each = forms.select("k", F.explode(F.filter(F.array_distinct(F.split("k", " ")), lambda w: w != "")).alias("word"))
    each = each.join(weights, "word", "left").select("k", "word", F.coalesce("weight", log2(F.greatest(total, F.lit(1)).cast("long"))).alias("weight"))
    own = each.groupBy("k").agg(F.sum("weight").alias("sum"), F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("m"), "word"))).alias("w"))
    before = lambda i: F.aggregate(F.slice("w", F.lit(1), i), F.lit(0).cast("long"), lambda n, x: n - x["m"])
    taken = F.filter("w", lambda x, i: (F.col("sum") > 0) & (10 * (F.col("sum") - before(i)) >= SHARED * F.col("sum")))
    return own.select("k", F.transform(taken, lambda x: x["word"]).alias("rare"))


def blocking_keys(k: Column, rare: Column) -> Column:
    """Keys under which similar forms meet: the form and what it is without any one letter (any two, if it is SHORT), and the same of its rare words.

    Such keys are as many as there are forms and words, so that no key grows with the tables as first letters do.
    """
    twice = F.flatten(F.transform(F.sequence(F.lit(1), F.length(k)), lambda i: _less_one(_without(k, i), "d:")))
    words = F.flatten(F.transform(rare, lambda w: F.when(F.length(w) < LEAST_LETTERS, F.array(F.concat(F.lit("w:"), w))).otherwise(_less_one(w, "w:"))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(_less_one(k, "d:"), F.when(F.length(k).between(2, SHORT), twice).otherwise(none), F.coalesce(words, none)))


def one_edit_pairs(rows: DataFrame, key: str, value: str, by: str) -> DataFrame:
    """(a, b): keys, a < b, of all rows of one `by` whose values differ by at most one inserted, deleted or replaced letter.

    Distinct values meet first, by equi-joins: replaced letters at (place, the rest), inserted ones at the shorter value, so that a key has as many
    values as the place has letters. Rows are then attached to pairs of values; no two rows are compared, and what grows beyond the rows is the result.
    No side is broadcast: Spark sizes values and what is exploded from them by the compressed file of all rows.
    """
    shuffled = lambda df: df.hint("merge")
    own = rows.select(F.col(by).alias("g"), F.col(value).alias("v"), F.col(key).alias("k")).dropna().repartition("g", "v")
    values = own.select("g", "v").distinct()
    rests = F.transform(F.sequence(F.lit(1), F.length("v")), lambda i: _without(F.col("v"), i))
    less = values.filter(F.length("v") > 0).select("g", "v", F.posexplode(rests).alias("i", "rest"))
    replaced = less.alias("x").join(shuffled(less.alias("y")), F.expr("x.g = y.g AND x.i = y.i AND x.rest = y.rest AND x.v < y.v")).select("x.g", "x.v", F.col("y.v").alias("w"))
    inserted = less.select("g", "v", "rest").distinct().alias("x").join(shuffled(values.alias("y")), F.expr("x.g = y.g AND x.rest = y.v")).select("x.g", "x.v", F.col("y.v").alias("w"))
    links = replaced.unionByName(inserted)
    equal = own.alias("x").join(shuffled(own.alias("y")), F.expr("x.g = y.g AND x.v = y.v AND x.k < y.k")).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"))
    linked = own.join(shuffled(links), ["g", "v"]).select("g", "w", F.col("k").alias("a")).alias("x").join(shuffled(own.alias("y")), F.expr("x.g = y.g AND x.w = y.v AND x.a <> y.k"))
    return equal.unionByName(linked.select(F.least("x.a", "y.k").alias("a"), F.greatest("x.a", "y.k").alias("b")))


def query_forms(title: Column, original: Column) -> Column:
    """Forms of a listing that are looked up, each with its priority."""
    forms = F.filter(F.array(title, original, text.strip_noise(title)), lambda f: F.length(F.trim(f)) > 0)
    return F.transform(F.array_distinct(forms), lambda f, i: F.struct(f.alias("form"), i.alias("priority")))


def title_pairs(listings: DataFrame, catalog: DataFrame) -> DataFrame:
    """(title, original, cat_title, cat_original, priority): distinct titles of which two forms share a blocking key, with the priority of the first
    form that does.

    Each form counts once, however many titles and rows have it: forms meet by an equi-join on keys, titles are attached to pairs of forms. No key is capped.
    """
    keys_of = lambda f: F.explode(F.array_distinct(F.transform(text.title_forms(f), text.title_key)))
    asked = listings.select(*TITLE).distinct().select(*TITLE, F.explode(query_forms(F.col("title"), F.col("original"))).alias("q")).select(*TITLE, "q.priority", keys_of(F.col("q.form")).alias("k"))
    listed = catalog.select(*CAT_TITLE).distinct().select(*CAT_TITLE, F.explode(F.array_compact(F.array(*CAT_TITLE))).alias("f")).select(*CAT_TITLE, keys_of(F.col("f")).alias("k")).distinct()
    known = listed.select("k").distinct()
    keyed = lambda forms: forms.join(rare_words(forms, known), "k", "left").select("k", F.explode(blocking_keys(F.col("k"), F.col("rare"))).alias("key"))
    met = keyed(asked.select("k").distinct()).join(keyed(known).withColumnRenamed("k", "ck"), "key").select("k", "ck").distinct()
    return asked.join(met, "k").join(listed.withColumnRenamed("k", "ck"), "ck").groupBy(*TITLE, *CAT_TITLE).agg(F.min("priority").alias("priority"))


def same(a: str, b: str, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def of_rows(pairs: DataFrame, listings: DataFrame, catalog: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of titles as pairs of rows (all columns of both, and `columns` of the pairs) within the year's tolerance."""
    left = listings.alias("l").join(pairs.alias("p"), same("l", "p", TITLE)).select("l.*", *[f"p.{c}" for c in [*CAT_TITLE, *columns]])
    rows = left.alias("l").join(catalog.alias("c"), same("l", "c", CAT_TITLE) & text.year_acceptable(F.col("l.year"), F.col("c.cat_year")))
    return rows.select("l.*", *[f"c.{c}" for c in catalog.columns if c not in CAT_TITLE])


def candidates(listings: DataFrame, catalog: DataFrame) -> DataFrame:
    """(listing_id, ext_id, priority): catalog rows whose title shares a blocking key with a form of the listing's."""
    return of_rows(title_pairs(listings, catalog), listings, catalog, ["priority"]).select("listing_id", "ext_id", "priority")


def score(listings: DataFrame, catalog: DataFrame, at_least: float = 0.0) -> DataFrame:
    """Candidates with their best similarity: of the listing's forms that are looked up with the forms of the catalog's titles. Each distinct pair of keys is
    scored once, and titles are scored before rows are paired. With at_least, candidates that do not reach it are left out, and those
    whose lengths and letters show it are not compared."""
    pairs = title_pairs(listings, catalog)
    keys = lambda c: F.array_distinct(F.transform(c, text.title_key))
    asked = F.transform(query_forms(F.col("title"), F.col("original")), lambda q: q["form"])
    forms = pairs.select(*TITLE, *CAT_TITLE, "priority", F.explode(keys(asked)).alias("a"), F.flatten(F.transform(F.array_compact(F.array(*CAT_TITLE)), text.title_forms)).alias("c"))
    forms = saved(forms.select(*TITLE, *CAT_TITLE, "priority", "a", F.explode(keys(F.col("c"))).alias("b")), "forms")
    scored = forms.select("a", "b").distinct().withColumn("s", key_similarity(F.col("a"), F.col("b"), at_least))
    best = forms.join(scored.filter(F.col("s") >= at_least), ["a", "b"]).groupBy(*TITLE, *CAT_TITLE).agg(F.min("priority").alias("priority"), F.max("s").alias("score"))
    return of_rows(best, listings, catalog, ["priority", "score"])


def rank(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Ranked candidates of each listing (or of what `keys` tell apart): those within TIE of the best by popularity, the rest by score; then by id."""
    keys = keys or ["listing_id"]
    top = F.max("score").over(W.partitionBy(*keys))
    band = F.col("score") >= top - TIE
    order = W.partitionBy(*keys).orderBy(band.desc(), F.when(~band, F.col("score")).desc(), F.coalesce("popularity", F.lit(0.0)).desc(), "ext_id")
    return scored.withColumn("band", band).withColumn("rank", F.row_number().over(order))


def by_votes(keys: list[str], first: Column | None = None):
    """Rows of a group by votes, those of `first` before all others, then by id."""
    return W.partitionBy(*keys).orderBy(*([] if first is None else [first.desc()]), F.coalesce("votes", F.lit(0)).desc(), "ext_id")


def dominant(window, least_votes: int = LEAST_VOTES, of: Column | None = None) -> Column:
    """Whether a row has least_votes and DOMINANCE times the votes of the next row (of those of `of`)."""
    votes = F.coalesce("votes", F.lit(0))
    rival = F.lead(votes if of is None else F.when(of, votes)).over(window)
    return (votes >= least_votes) & (votes >= DOMINANCE * F.greatest(rival, F.lit(1)))


def vote_champions(rows: DataFrame, keys: list[str], least_votes: int = LEAST_VOTES) -> DataFrame:
    """Of each group the row (ext_id, votes, ...) with most votes, where it dominates the others."""
    by = by_votes(keys)
    return rows.select("*", F.row_number().over(by).alias("_i"), dominant(by, least_votes).alias("_d")).filter("_i = 1 AND _d").drop("_i", "_d")


def only_one(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys and `column` of the groups that have exactly one value of it."""
    found = rows.groupBy(*keys).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    return found.filter("_low = _high").select(*keys, F.col("_low").alias(column))


def best_match(ranked: DataFrame) -> DataFrame:
    """Of each listing the match, if its score passes and it is not ambiguous, or dominates its band by votes.

    Ambiguous with a director known is no match: the director decides later.
    """
    band, by = ranked.filter(F.col("band") & (F.col("score") >= THRESHOLD)), by_votes(["listing_id"])
    champion = band.select("*", F.count("*").over(W.partitionBy("listing_id")).alias("n"), F.row_number().over(by).alias("i"), dominant(by).alias("_d")).filter("i = 1")
    return champion.filter((F.col("n") == 1) | (F.col("director").isNull() & F.col("_d"))).select("listing_id", "ext_id", "score")


def dominates(ranked: DataFrame, chosen: DataFrame) -> DataFrame:
    """Whether a listing's chosen candidate has DOMINANCE times the votes of each other of the same title."""
    rows = ranked.join(chosen.select("listing_id", F.col("ext_id").alias("_c")), "listing_id").withColumn("_k", text.title_key(F.col("cat_title")))
    own = F.max(F.when(F.col("ext_id") == F.col("_c"), F.col("_k"))).over(W.partitionBy("listing_id"))
    rows = rows.withColumn("_own", own).filter(F.col("_k") == F.col("_own"))
    mine, rival = F.max(F.when(F.col("ext_id") == F.col("_c"), F.col("votes"))), F.max(F.when(F.col("ext_id") != F.col("_c"), F.col("votes")))
    return rows.groupBy("listing_id").agg((mine >= DOMINANCE * F.greatest(F.coalesce(rival, F.lit(1)), F.lit(1))).alias("dominant"))


def director_fallback(ranked: DataFrame) -> DataFrame:
    """The first of a listing's top three whose director is the listed one; its score is raised to the threshold."""
    near = ranked.filter((F.col("rank") <= 3) & F.col("director").isNotNull() & text.directors_match(F.col("director"), F.col("cat_directors")))
    return near.groupBy("listing_id").agg(F.min_by(F.struct("ext_id", F.greatest("score", F.lit(THRESHOLD)).alias("score")), "rank").alias("x")).select("listing_id", "x.*")


def director_pivot(listings: DataFrame, credits: DataFrame) -> DataFrame:
    """Listings whose director has exactly one film in the listed year's window: names to credits by folded name."""
    asked = listings.filter("director IS NOT NULL AND year IS NOT NULL").select("director", "year")
    names = asked.distinct().select("director", "year", F.explode(text.split_directors(F.col("director"))).alias("n"))
    near = names.select("director", "year", text.title_key(F.col("n")).alias("person"), F.explode(F.array(*[F.col("year") + i for i in (-1, 0, 1)])).alias("cat_year"))
    # Of a person's films of a year the least and the greatest id say whether there are others, so that listings never meet films row by row.
    films = credits.select(text.title_key(F.col("name")).alias("person"), "ext_id", "cat_year").groupBy("person", "cat_year").agg(F.min("ext_id").alias("low"), F.max("ext_id").alias("high"))
    bounds = [F.min("low").alias("low"), F.max("high").alias("high")]
    hits = near.join(films, ["person", "cat_year"]).groupBy("director", "year").agg(*bounds)
    own = listings.select("listing_id", "director", "year").join(hits, ["director", "year"]).groupBy("listing_id").agg(*bounds)
    return own.filter("low = high").select("listing_id", F.col("low").alias("ext_id"), F.lit(THRESHOLD).alias("score"))


#: What a listing asks: listings that agree in these have the same candidates in the same order.
ASKED = [*TITLE, "year"]


def shortlist(catalog: DataFrame) -> DataFrame:
    """The catalog's rows that can be among anyone's first three or decide anyone's tie, with `size`.

    Rows of one title and year score alike for everybody, so of each such group only the three most popular and the two with most votes
    matter, and how many rows it has: `size` is that for one of them, 0 for the others.
    """
    group = [*CAT_TITLE, "cat_year"]
    popular = W.partitionBy(*group).orderBy(F.coalesce("popularity", F.lit(0.0)).desc(), "ext_id")
    rows = catalog.select("*", F.row_number().over(popular).alias("_p"), F.row_number().over(by_votes(group)).alias("_v"), F.count("*").over(W.partitionBy(*group)).alias("_n"))
    return rows.filter("_p <= 3 OR _v <= 2").withColumn("size", F.when(F.col("_p") == 1, F.col("_n")).otherwise(0)).drop("_p", "_v", "_n")


def answers(listings: DataFrame, catalog: DataFrame, at_least: float = 0.0) -> DataFrame:
    """(title, original, year, champion, first): to each distinct question the row of the best scores with most votes (with alone: there is no other, and dominant), if the
    score passes, and the first three rows in order (rank, ext_id, score, cat_directors); questions without candidates have no row."""
    asked = listings.select(*ASKED).distinct()
    rows = score(asked.withColumn("listing_id", F.lit(None).cast("long")), shortlist(catalog), at_least)
    ranked = rank(rows, ASKED)
    eligible = F.col("band") & (F.col("score") >= THRESHOLD)
    by = by_votes(ASKED, eligible)
    kept = ranked.select("*", eligible.alias("_e"), F.row_number().over(by).alias("_i"), dominant(by, of=eligible).alias("_d"))
    told = F.struct("ext_id", "score", "cat_directors", F.col("_d").alias("dominant"))
    first = F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "ext_id", "score", "cat_directors"))))
    out = kept.groupBy(*ASKED).agg(F.max(F.when(F.col("_e") & (F.col("_i") == 1), told)).alias("c"), F.sum(F.when(F.col("_e"), F.col("size"))).alias("_n"), first.alias("first"))
    return out.select(*ASKED, F.when(F.col("c").isNotNull(), F.struct("c.*", (F.col("_n") == 1).alias("alone"))).alias("champion"), "first")


def answered(listings: DataFrame, found: DataFrame) -> DataFrame:
    return listings.alias("l").join(found.alias("a"), same("l", "a", ASKED), "left").select("l.*", "a.champion", "a.first")


def matches(listings: DataFrame, catalog: DataFrame) -> DataFrame:
    """(listing_id, ext_id, score): what `best_match` finds, by way of the distinct questions."""
    rows = answered(listings, answers(listings, catalog, THRESHOLD))
    return rows.filter(F.col("champion.alone") | (F.col("director").isNull() & F.col("champion.dominant"))).select("listing_id", "champion.ext_id", "champion.score")


#: Stages of the cascade, in order.
STAGES = ("override", "match", "director", "pivot")


def resolve(listings: DataFrame, catalog: DataFrame, overrides: DataFrame, credits: DataFrame) -> DataFrame:
    """The cascade: override, best match (verified by director where scripts compare), director among the top
    three, director's only film; each stage for what the ones before left. One row for each listing with a reason.

    Each distinct question is answered once, and the answers are saved: a champion and three rows. A listing's director then decides on
    these, and of what the stages found that with the least number is taken."""
    fixed = overrides.select("listing_id", F.struct(F.lit(1).alias("at"), "ext_id", F.lit(1.0).alias("score")).alias("_1"))
    left = listings.join(fixed, "listing_id", "left_anti")
    rows = answered(left, saved(answers(left, catalog), "answers"))
    known, c = F.col("director").isNotNull(), F.col("champion")
    agrees = lambda x: known & text.directors_match(F.col("director"), x["cat_directors"])
    comparable = F.exists(c["cat_directors"], lambda d: text.comparable_scripts(F.col("director"), d))
    passes = (c["alone"] | (~known & c["dominant"])) & (~known | ~F.coalesce(comparable, F.lit(False)) | agrees(c))
    by_director = F.get(F.filter("first", agrees), F.lit(0))
    step = lambda n, x, score: F.struct(F.lit(n).alias("at"), x["ext_id"].alias("ext_id"), score.alias("score"))
    told = rows.select("listing_id", F.col("first").isNotNull().alias("tried"), F.when(passes, step(2, c, c["score"])).alias("_2"), by_director.alias("_d"))
    told = told.withColumn("_3", F.when(F.col("_d").isNotNull(), step(3, F.col("_d"), F.greatest("_d.score", F.lit(THRESHOLD))))).drop("_d")
    pivot = director_pivot(left, credits).select("listing_id", step(4, F.struct("ext_id"), F.col("score")).alias("_4"))
    out = listings.select("listing_id").join(fixed, "listing_id", "left").join(told, "listing_id", "left").join(pivot, "listing_id", "left")
    out = out.withColumn("x", F.array_min(F.array_compact(F.array("_1", "_2", "_3", "_4"))))
    found = F.col("x").isNotNull()
    reason = F.when(found, "ok").when(F.col("tried"), "low-confidence").otherwise("no-candidates")
    stage = F.element_at(F.array(*map(F.lit, STAGES)), F.col("x.at"))
    return out.select("listing_id", "x.ext_id", "x.score", F.when(found, stage).alias("stage"), reason.alias("reason"))


def gate(p: DataFrame) -> DataFrame:
    """Whether a proposal may be applied. Columns: kind, confidence, year, cat_year, runtime, cat_runtime, director_ok, director_known, title_ok."""
    year_ok, runtime_ok = text.year_concrete(F.col("year"), F.col("cat_year")), F.coalesce(F.abs(F.col("runtime") - F.col("cat_runtime")) <= RUNTIME_SLACK, F.lit(False))
    runtime_off = F.coalesce(F.abs(F.col("runtime") - F.col("cat_runtime")) > RUNTIME_SLACK, F.lit(False))
    year_off = F.coalesce(F.abs(F.col("year") - F.col("cat_year")) > 1, F.lit(False))
    director_off, c = F.col("director_known") & ~F.col("director_ok"), F.col("confidence")
    why = (
        F.when(F.col("kind") != "judged", "researched")
        .when(runtime_off, "runtime")
        .when((c >= APPLY) & (year_ok | F.col("director_ok") | runtime_ok), "apply")
        .when((c >= APPLY_TITLE) & F.col("title_ok") & ~year_off & ~director_off, "apply")
        .when(c < APPLY, "confidence")
        .when(F.col("title_ok") & (c < APPLY_TITLE), "title bar")
        .otherwise("no corroboration")
    )
    return p.withColumn("verdict", why)


def proposals(pool: DataFrame, shown: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Listings as no-candidate, error, declined or proposed; an id that was not shown counts as declined, with no confidence."""
    any_ = shown.select("listing_id").distinct().withColumn("_any", F.lit(True))
    valid = verdicts.join(shown.select("listing_id", F.col("ext_id"), F.lit(True).alias("_ok")), ["listing_id", "ext_id"], "left")
    j = pool.select("listing_id").join(any_, "listing_id", "left").join(valid, "listing_id", "left")
    lane = F.when(F.col("_any").isNull(), "no-candidate").when(F.coalesce("error", F.lit(True)), "error").when(F.col("_ok"), "proposed").otherwise("declined")
    return j.select("listing_id", lane.alias("lane"), F.when(lane == "proposed", F.col("ext_id")).alias("ext_id"), F.when(lane == "proposed", F.col("confidence")).otherwise(0.0).alias("confidence"))


def golden_set(manual: DataFrame, seeds: DataFrame, shown: DataFrame) -> DataFrame:
    """Manual matches and seeds (ids below 0), with whether the expected id is among the frozen candidates."""
    seeds = numbered(seeds.select("title", "ext_id"), ["title", "ext_id"]).select((-F.col("_i")).cast("long").alias("listing_id"), "title", "ext_id")
    cases = manual.select("listing_id", "title", "ext_id").unionByName(seeds)
    frozen = shown.groupBy("listing_id").agg(F.array_sort(F.collect_set("ext_id")).alias("ids"))
    return cases.join(frozen, "listing_id", "left").select("listing_id", "title", "ext_id", F.coalesce(F.array_contains("ids", F.col("ext_id")), F.lit(False)).alias("reachable"))
