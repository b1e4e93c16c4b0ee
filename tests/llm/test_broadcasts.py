"""Sides that Spark sizes too low, and would bring to the driver, are shuffled."""

import pytest

from playbill.llm import byte_dedup, chunks, common, substring_dedup

WORDS = " ".join(f"w{i}" for i in range(30))
TEXTS = [WORDS, WORDS, f"a {WORDS}", None, "", *(f"{i} is only here {i}" for i in range(5))]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_rows_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([(k, i) for i, k in enumerate(["a", "b", None])], "k string, v long").coalesce(1).write.parquet(f"{tmp_path}/small")
    big = spark.createDataFrame([(k, i) for i, k in enumerate(["a", "a", "b", None, "c"])], "k string, x long")
    for how, more in (("left", [("c", 4, None)]), ("inner", [])):
        found = common.attach(big, spark.read.parquet(f"{tmp_path}/small"), "k", big.x, how, rows=0)
        assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)
        assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == [("a", 0, 0), ("a", 1, 0), ("b", 2, 1), (None, 3, 2), *more]


@pytest.mark.parametrize(("work", "size", "joined"), [(substring_dedup.remove_repeats, 5, ("level", "copies", "result")), (byte_dedup.remove_common_bytes, 40, ("level", "copies", "runs", "strings", "result"))])
def test_answers_to_chunks_and_copied_texts_are_not_broadcast(spark, monkeypatch, work, size, joined):
    """Both with more copied texts than may be broadcast; the plans of steps that read the chunks or their texts' hashes."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    plain = sorted(map(str, work(docs, size).collect()))
    plans, save = [], common.Workspace.save

    def seen(ws, df, label):
        if label.startswith(joined) and label != "level":
            plans.append((label, plan(df)))
        return save(ws, df, label)

    monkeypatch.setattr(common.Workspace, "save", seen)
    monkeypatch.setattr(chunks, "attach", lambda *given: common.attach(*given, rows=0))
    assert sorted(map(str, work(docs, size).collect())) == plain
    assert {label.rstrip("0123456789") for label, _ in plans} == set(joined)
    assert [label for label, p in plans if "Broadcast" in p or "SortMergeJoin" not in p] == []
