"""Stateful detectors over several batches: timers, finishes, and the end of a silent source's state."""

import os
import random
from datetime import datetime, timedelta

import pytest

from playbill.streaming import jobs

DAY = datetime(2024, 1, 1)


def landed(spark, folder, schema, *files):
    """A file for each batch, read in that order, one at a time."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"{i:03d}"))
        # Files are read by their time of change.
        for f in (folder / f"{i:03d}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.fixture(autouse=True)
def plain_state_after(spark):
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_stuck_runs_over_batches(spark, tmp_path):
    at = lambda m: DAY + timedelta(minutes=m)
    stream = landed(spark, tmp_path / "in", "run_id long, event string, at timestamp", [(1, "start", at(0)), (2, "start", at(1)), (3, "finish", at(2)), (4, "start", at(3)), (4, "finish", at(9))], [(1, "finish", at(20)), (9, "start", at(25))], [(3, "start", at(26)), (2, "finish", at(40))], [(9, "finish", at(90))])
    out = jobs.run_available(spark, jobs.stuck_runs(stream), "stuck").collect()
    ms = lambda m: int((at(m) - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert sorted((r["run_id"], r["started_ms"]) for r in out) == [(2, ms(1)), (9, ms(25))]


def test_a_silent_source_ends(spark, tmp_path):
    """Silences between rows are told by their ends; a source silent for good is told once, without an end, and is new when it speaks again."""
    at = lambda d, h=0: DAY + timedelta(days=d, hours=h)
    stream = landed(spark, tmp_path / "in", "source string, at timestamp", [("a", at(0)), ("a", at(0, 1)), ("b", at(0)), ("a", at(0, 5))], [("b", at(50))], [("b", at(100))], [("b", at(101)), ("a", at(101))], [("a", at(101, 1)), ("b", at(101, 1))])
    ms = lambda d, h=0: int((at(d, h) - datetime(1970, 1, 1)).total_seconds() * 1000)
    out = sorted(map(tuple, jobs.run_available(spark, jobs.silences(stream), "silent").collect()), key=repr)
    assert out == sorted([("a", ms(0, 1), ms(0, 5)), ("b", ms(0), ms(50)), ("b", ms(50), ms(100)), ("b", ms(100), ms(101)), ("a", ms(0, 5), None)], key=repr)


def test_runs_of_a_group_share_its_timer(spark, tmp_path, monkeypatch):
    """10,000 runs that start and of which a tenth does not finish: timers and state rows are by the groups, not by the runs."""
    monkeypatch.setattr(jobs, "RUN_GROUPS", 8, raising=False)
    spark.range(10_000).selectExpr("id AS run_id", "'start' AS event", "TIMESTAMP'2024-01-01' AS at").union(
        spark.range(10_000).filter("id % 10 > 0").selectExpr("id", "'finish'", "TIMESTAMP'2024-01-01 00:05:00'")
    ).union(spark.range(1).selectExpr("id - 1", "'finish'", "TIMESTAMP'2024-01-02'")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id long, event string, at timestamp").parquet(str(tmp_path / "in"))
    query = jobs.stuck_runs(stream).writeStream.format("memory").queryName("by_group").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["run_id"] for r in spark.table("by_group").collect()) == list(range(0, 10_000, 10))
    state = [p["stateOperators"][0] for p in query.recentProgress]
    assert 0 < sum(s["customMetrics"]["numRegisteredTimers"] for s in state) <= 8
    assert max(s["numRowsTotal"] for s in state) <= 8 * 3


@pytest.mark.parametrize("groups", [1, 5])
def test_stuck_runs_of_any_batches_are_those_of_all_rows(spark, tmp_path, monkeypatch, groups):
    """Microseconds count, a limit that is just reached is no excess, finishes may come first, and rows without a time or a run are borne."""
    monkeypatch.setattr(jobs, "RUN_GROUPS", groups, raising=False)
    rng, limit, big = random.Random(7), 30 * 60_000_000, 2**53 + 1
    starts = {i: i * 40_000_000 + rng.randrange(1_000_000) for i in range(400)}
    rows = [(i, "start", t) for i, t in starts.items()]
    rows += [(i, "finish", t + rng.choice([0, 60_000_000, limit - 1, limit, limit + 1, 2 * limit])) for i, t in starts.items() if i % 3]
    rows += [(1000, "finish", 0), (1000, "start", 5 * limit), (2000, "finish", 2 * limit), (big, "start", 10), (big - 1, "start", 11), (None, "start", 12), (None, "start", 13)]
    end = max(t for _, _, t in rows) + limit
    end += -end % 1000
    rows += [(3000, "start", end - limit), (3001, "start", end - limit - 1000), (9999, "finish", end)]
    rows.sort(key=lambda r: r[2])
    first = {}
    for run, event, t in rows:
        first.setdefault((run, event), t)
    ends = {run: first.get((run, "finish")) for run, _, _ in rows}
    expected = [(r, first[r, "start"] // 1000) for r, f in ends.items() if (r, "start") in first and (end if f is None else f) > first[r, "start"] + limit]
    at = lambda t: None if t is None else datetime(2024, 1, 1) + timedelta(microseconds=t)
    rows = [(r, e, at(t)) for r, e, t in rows]
    files = [[*rows[:200], (5000, "start", None), (5, "finish", None)], rows[200:350], rows[350:360], rows[360:]]
    stream = landed(spark, tmp_path / "in", "run_id long, event string, at timestamp", *files)
    epoch = int((datetime(2024, 1, 1) - datetime(1970, 1, 1)).total_seconds() * 1000)
    out = [(r["run_id"], r["started_ms"] - epoch) for r in jobs.run_available(spark, jobs.stuck_runs(stream), "stuck").collect()]
    assert sorted(out, key=repr) == sorted(expected, key=repr) and len(out) > 100
