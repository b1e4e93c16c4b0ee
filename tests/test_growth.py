"""Work that grows no faster than its input and result."""

import random
from datetime import datetime

import pytest

from playbill.operators import catalog, operations, resolve
from playbill.sources import feeds, pages
from playbill.storage import saved


def near(a, b):
    """Whether one inserted, deleted or replaced letter, or none, makes the one the other."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def test_one_edit_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    names = ["", "a", "b", "ab", "aab", "aaab", "ñu", "ñ", "😀a", "a😀", *("".join(rng.choice("abñ") for _ in range(rng.randrange(6))) for _ in range(150))]
    rows = [(i, rng.choice(names), rng.randrange(2)) for i in range(300)] + [(300, None, 0), (None, "a", 0), (301, "a", None), (5, "ab", 1), (5, "ab", 1)]
    df = spark.createDataFrame(rows, "k long, v string, g int")
    expected = sorted((a[0], b[0]) for a in rows for b in rows if None not in (*a, *b) and a[2] == b[2] and a[0] < b[0] and near(a[1], b[1]))
    found = resolve.one_edit_pairs(df, "k", "v", "g")
    assert sorted(map(tuple, found.collect())) == expected


def test_names_of_one_nation_are_not_compared_in_pairs(spark, tmp_path):
    """30,000 names in one nation, of which few are near: all pairs would be 450 million comparisons."""
    import __spark_entry__

    spark.range(30_000).selectExpr("id AS c_custkey", "md5(cast(id DIV 2 AS string)) AS c_name", "1 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    found = __spark_entry__.queries()["edit_distance_pairs"](spark, str(tmp_path))
    assert "levenshtein" not in found._jdf.queryExecution().toString()
    assert found.count() == 15_000


def test_names_and_what_they_are_without_a_letter_are_not_broadcast(spark, tmp_path):
    """Names are exploded by their letters, and Spark sizes that by the file."""
    import __spark_entry__

    spark.range(300).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "id % 2 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    found = __spark_entry__.queries()["edit_distance_pairs"](spark, str(tmp_path))
    names = {i: (i % 2, f"Customer#{i}") for i in range(300)}
    assert found.count() == sum(names[a][0] == names[b][0] and near(names[a][1], names[b][1]) for a in names for b in names if a < b)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_directors_films_are_counted_before_listings_meet_them(spark):
    """One director with 20,000 films and 20,000 listings: 400 million pairs, were they to meet row by row."""
    names = [("Ana Ruiz", 1990, None), ("Eva Paz", 1990, 7), ("Eva Paz", 1992, 7), ("Eva Paz", 1993, None), ("Ana Ruiz", None, None), (None, 1990, None), ("Eva Paz y Juan Sosa", 1990, None), ("Juan Sosa, Juan Sosa", 2000, 9)]
    told = spark.createDataFrame([(i, d, y) for i, (d, y, _) in enumerate(names)], "listing_id long, director string, year int")
    credits = spark.createDataFrame([("Eva Paz", 7, 1991), ("eva paz", 7, 1991), ("Juan Sosa", 8, 1990), ("Juan Sosa", 9, 2001), ("Juan Sosa", 10, None), (None, 11, 1990)], "name string, ext_id long, cat_year int")
    many = spark.range(20_000)
    told = told.union(many.selectExpr("id + 100", "'Ana Ruiz'", "cast(1990 AS int)"))
    credits = credits.union(many.selectExpr("'Ana Ruiz'", "id + 1000", "cast(1990 AS int)"))
    found = resolve.director_pivot(told, credits)
    assert {(r["listing_id"], r["ext_id"]) for r in found.collect()} == {(i, e) for i, (_, _, e) in enumerate(names) if e}
    widest = 0
    todo = [found._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName() in ("AdaptiveSparkPlan", "ResultQueryStage", "ShuffleQueryStage", "BroadcastQueryStage"):
            todo.append(plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan())
        if plan.metrics().contains("numOutputRows"):
            widest = max(widest, plan.metrics().apply("numOutputRows").value())
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    assert 0 < widest <= 20_100


def test_rows_of_one_position_are_numbered_in_several_tasks(spark, monkeypatch):
    """A feed whose payloads have few rows each gives all of them the same positions."""
    kept = []
    monkeypatch.setattr(catalog, "saved", lambda df, name: kept.append(saved(df, name)) or kept[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        films = spark.range(2_000).selectExpr("cast(NULL AS long) AS id", "id % 2 AS pos", "md5(cast(id AS string)) AS title").union(spark.createDataFrame([(7, 0, "old")], "id long, pos long, title string"))
        out = catalog.with_new_ids(films, films, ["pos", "title"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    fresh = sorted((r for r in out if r["title"] != "old"), key=lambda r: (r["pos"], r["title"]))
    assert [r["id"] for r in fresh] == list(range(8, 2_008))
    assert [r["id"] for r in out if r["title"] == "old"] == [7]
    (ranges,) = kept
    sizes = [r["count"] for r in ranges.groupBy("_g").count().collect()]
    assert sum(sizes) == 2_000 and max(sizes) <= 1_000


def test_payloads_of_one_file_are_taken_apart_in_several_tasks(spark, monkeypatch):
    landed = spark.createDataFrame([(str(i), "room", "{}") for i in range(100)], "payload_id string, source string, body string").coalesce(1)
    seen = []

    def job(spark, landed, now):
        seen.append(landed.rdd.getNumPartitions())
        return feeds.nested_lanes(spark, landed, now)

    monkeypatch.setitem(feeds.SOURCES, "watched", job)
    assert feeds.fetch("watched", spark, landed, datetime(2024, 1, 1)).results.count() == 100
    assert seen == [4]
    plan = pages.event_feed(landed, datetime(2024, 1, 1))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [source" in plan and plan.index("from_json") < plan.index("RepartitionByExpression")


def test_tasks_of_redundancy_grow_with_the_rows(spark, monkeypatch):
    rows = spark.range(10_000).selectExpr("id % 10 AS venue_id", "id DIV 7 AS film_id", "date_add(DATE '2024-01-01', cast(id % 3 AS int)) AS day")
    expected = sorted(map(str, operations.redundancy(rows).collect()))
    monkeypatch.setattr(operations, "ROWS_A_TASK", 500)
    found = operations.redundancy(rows)
    assert "hashpartitioning(venue_id" in found._jdf.queryExecution().toString() and ", 20), REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
    assert sorted(map(str, found.collect())) == expected
