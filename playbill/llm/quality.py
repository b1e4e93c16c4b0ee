"""Quality rules for texts, with verdicts on the hosts they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Workspace, attach, let

#: Share of a host's documents that may fail a rule, after shrinking, before the host is dropped.
HOST_LIMIT = 0.5
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (2.0, 1000.0)
RULES = ("short", "repeats", "symbols", "dup_lines")


def words_of(text: Column) -> Column:
    """Words of a text: maximal runs of anything but white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_window_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more among the words.

    Windows are compared by 128 bits: two 64-bit hashes with different seeds. Sorting them with their places
    puts equal ones side by side; the places of those are then swept in order.
    """
    n = F.size(words)
    three = lambda i: (F.get(words, i - 1), F.get(words, i), F.get(words, i + 1))
    first = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.xxhash64(*three(i)).alias("a"), i.alias("i")))

    def ties(s: Column, same) -> Column:
        return F.filter(s, lambda x, k: ((k > 0) & same(x, F.get(s, k - 1))) | ((k < F.size(s) - 1) & same(x, F.get(s, k + 1))))

    def places(s: Column) -> Column:
        # Only windows whose first hashes tie are hashed again.
        some = F.transform(ties(s, lambda x, y: x["a"] == y["a"]), lambda x: F.struct(x["a"].alias("a"), F.xxhash64(F.lit("b"), *three(x["i"])).alias("b"), x["i"].alias("i")))
        near = let(F.array_sort(some), lambda t: ties(t, lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"])))
        return F.array_sort(F.transform(near, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1), x + 3) - x))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    found = let(F.array_sort(first), lambda s: let(places(s), covered))
    return F.when(n < 3, F.lit(0)).otherwise(found).cast("long")


def text_features(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """key, host and of each whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    flat = docs.select(
        F.col(key).alias("_k"),
        F.col(host).alias("_host"),
        F.char_length(F.regexp_replace(body, SPACE, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(words_of(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_window_words(w).alias("r"))).alias("_w"),
    )
    return flat.select("_k", "_host", F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_w.r").alias("n_repeat_words"))


def rule_failures() -> dict[str, Column]:
    """Of a row of features: which rules it fails."""
    n = F.col("n_words")
    return {
        "short": n < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": 10 * F.col("n_dup_lines") > n,
    }


def host_verdicts(features: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row for each host: _host, host_rate (its worst shrunk failure rate), host_ok.

    Failures of each rule are counted by host. A beta prior is fitted to all hosts' rates of a rule
    by moments, and each host's rate is (failures + a) / (documents + a + b). A host with few
    documents is thus judged mostly by the others' rate. With one host, the prior's weight is its
    upper bound. The rows read back are one for each rule.
    """
    fails = [F.sum(c.cast("long")).alias(f"_{r}") for r, c in rule_failures().items()]
    hosts = features.groupBy("_host").agg(F.count("*").alias("_n"), *fails)
    stack = ", ".join(f"'{r}', _{r}" for r in RULES)
    long = hosts.selectExpr("_host", "_n", f"stack({len(RULES)}, {stack}) as (_rule, _f)")
    moments = (
        long.groupBy("_rule")
        .agg((F.sum("_f") / F.sum("_n")).alias("m"), F.var_pop(F.col("_f") / F.col("_n")).alias("v"))
        .collect()
    )
    low, high = PRIOR_WEIGHT
    mean, weight = F.lit(0.0), F.lit(low)
    for row in moments:
        m, v = row["m"], row["v"]
        w = high if not v else min(high, max(low, m * (1 - m) / v - 1))
        mean = F.when(F.col("_rule") == row["_rule"], F.lit(float(m))).otherwise(mean)
        weight = F.when(F.col("_rule") == row["_rule"], F.lit(float(w))).otherwise(weight)
    shrunk = (F.col("_f") + mean * weight) / (F.col("_n") + weight)
    return long.groupBy("_host").agg(F.max(shrunk).alias("host_rate")).withColumn("host_ok", F.col("host_rate") <= limit)


def judge_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row for each input row: key, the features, base_failed, host_rate, kept.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word windows. kept is
    false for those and for all documents of a host over the limit. Null texts have no words and
    fail; a text of any length is one row's arrays, some 30 bytes a word; a null host is a host of its own; repeated rows are judged each; an empty table gives no
    rows; other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "quality")
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if 0 < len(docs.inputFiles()) < cores:  # too few files for all cores to have a part of the scan
        docs = docs.select(key, text, host).repartition(cores, F.xxhash64(key, text))
    features = ws.save(text_features(docs, key, text, host), "features")
    verdicts = ws.save(host_verdicts(features, limit), "hosts")
    judged = attach(features, verdicts, "_host", F.col("_k"))
    rules = rule_failures()
    bad = rules["short"] | rules["repeats"]
    return judged.select(
        F.col("_k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        bad.alias("base_failed"), F.round("host_rate", 6).alias("host_rate"), (~bad & F.col("host_ok")).alias("kept"),
    )


def op3_host_quality(spark, sf_dir: str) -> DataFrame:
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)
), dup AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, range(3) t(k) GROUP BY doc_id
), f AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)
), h AS (
  SELECT source, count(*) AS n, count_if(n_words < 50) AS a, count_if(100 * n_repeat_words > 50 * n_words) AS b,
    count_if(10 * n_symbols > n_words) AS c, count_if(10 * n_dup_lines > n_words) AS e
  FROM f GROUP BY source
), l AS (
  SELECT source, n, unnest([a, b, c, e]) AS f, unnest([1, 2, 3, 4]) AS rule FROM h
), p AS (
  SELECT rule, sum(f) / sum(n) AS m, var_pop(f / n) AS v FROM l GROUP BY rule
), q AS (
  SELECT rule, m, CASE WHEN v = 0 THEN 1000.0 ELSE least(1000.0, greatest(2.0, m * (1 - m) / v - 1)) END AS w FROM p
), r AS (
  SELECT source, max((f + m * w) / (n + w)) AS rate FROM l JOIN q USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, round(rate, 6) AS host_rate,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND rate <= 0.5 AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""
