"""Continuous jobs: ingest, duplicate dropping, day counts, stuck runs and silent sources."""

from __future__ import annotations

import sys
from collections.abc import Callable
from datetime import datetime, timedelta

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import times
from ..operators.catalog import ingest
from ..storage import Snapshots, saved, shared_folder

# Stateful functions travel by value, so executors need no copy of the library on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STUCK_MINUTES, SILENT_MINUTES = 30, 120
#: Days after which a silent source is given up.
SILENT_DAYS = 60
#: Groups that runs are dealt to.
RUN_GROUPS = 1024
#: Stands for a start or a finish that has not come.
NEVER = 2**63 - 1


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream, with the schema that they have."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_available(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """What a stream in append mode gives for the input there is now, through a file sink that has each row once."""
    root = shared_folder(spark, name)
    df.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def without_duplicates(stream: DataFrame, keys: list[str], time: str = "at", delay: str = "31 days") -> DataFrame:
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def day_counts(stream: DataFrame, key: str, time: str = "at", delay: str = "1 hour") -> DataFrame:
    """Rows of each key and local day, once the day is over; rows later than the delay are dropped."""
    days = stream.withWatermark(time, delay).groupBy(key, F.window(time, "1 day", startTime="3 hours").alias("w"))
    return days.agg(F.count("*").alias("n")).select(key, F.to_date("w.start").alias("day"), "n")


def _milliseconds(at: pd.Series) -> list[int]:
    return (at.astype("int64") // (1_000_000 if str(at.dtype).startswith("datetime64[ns") else 1000)).tolist()


def timed(stream: DataFrame, delay: str, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """A processor with state and timers on event time for each key. Its state is in RocksDB, so it may outgrow memory; the setting holds for the session's later streams."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.withWatermark("at", delay).groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def _first_times(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for each run: its first start and its first finish."""
    return rows.groupby("run_id", as_index=False, sort=False)[["started", "ended"]].min()


class _Stuck(StatefulProcessor):
    """The open runs of a group: a start or a finish that waits for the other, in microseconds. One timer, for the earliest start; what is settled leaves the state."""

    def init(self, handle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "run_id array<long>, started array<long>, ended array<long>")

    def waiting(self) -> pd.DataFrame:
        state = self.open.get() if self.open.exists() else ([], [], [])
        return pd.DataFrame(dict(zip(("run_id", "started", "ended"), state, strict=True)), dtype="int64")

    def timer(self, runs: pd.DataFrame) -> int | None:
        """The first millisecond after the limit of the earliest start."""
        first = runs["started"].min() if len(runs) else NEVER
        return None if first == NEVER else (int(first) + STUCK_MINUTES * 60_000_000) // 1000 + 1

    def settle(self, key, runs: pd.DataFrame, watermark: int):
        limit = STUCK_MINUTES * 60_000_000
        over = (runs["started"] < NEVER) & ((runs["ended"] < NEVER) | (runs["started"] + limit < watermark * 1000))
        stuck, left = runs[over & (runs["ended"] > runs["started"] + limit)], runs[~over]
        if len(left):
            self.open.update(tuple(left[c].tolist() for c in ("run_id", "started", "ended")))
        else:
            self.open.clear()
        if (timer := self.timer(left)) is not None:
            self.handle.registerTimer(timer)
        if len(stuck):
            yield pd.DataFrame({"run_id": stuck["run_id"] if key[0] >= 0 else None, "started_ms": stuck["started"] // 1000})

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        before = self.waiting()
        if (timer := self.timer(before)) is not None:
            self.handle.deleteTimer(timer)
        yield from self.settle(key, _first_times(pd.concat([before, *map(_first_times, rows)])), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield from self.settle(key, self.waiting(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stuck_runs(stream: DataFrame) -> DataFrame:
    """Runs (run_id, event start or finish, at) that did not finish in STUCK_MINUTES of event time; the state of a run ends with it.

    Runs are dealt to RUN_GROUPS groups by their ids, so Python, the state and the timers are called for each group that a batch meets, not for each run.
    A finish without a start stays in the state, as its start may come at any time.
    """
    begins, at, none = F.col("event") == "start", F.unix_micros("at"), F.lit(NEVER)
    group = F.when(F.col("run_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("run_id"), F.lit(RUN_GROUPS)))
    times_of = [F.when(begins, at).otherwise(none).alias("started"), F.when(begins, none).otherwise(at).alias("ended")]
    # Rows without a run are one run, in a group of its own: a missing id would make floats of the ids beside it.
    rows = stream.filter("at IS NOT NULL").select(group.alias("run_group"), F.coalesce("run_id", F.lit(0)).alias("run_id"), *times_of, "at")
    return timed(rows, "0 seconds", "run_group", _Stuck(), "run_id long, started_ms long")


class _Silent(StatefulProcessor):
    """The last row of a source. Its timer ends the state of a source that stays silent, and tells so."""

    def init(self, handle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "last long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        last = before = self.last.get()[0] if self.last.exists() else None
        out = []
        if last is not None and last + SILENT_DAYS * 86_400_000 <= timerValues.getCurrentWatermarkInMs():  # given up in this very batch
            out.append((key[0], last, None))
            last = None
        for t in sorted(t for pdf in rows for t in _milliseconds(pdf["at"])):
            if last is not None and t - last > SILENT_MINUTES * 60_000:
                out.append((key[0], last, t))
            last = t if last is None else max(last, t)
        if before is not None:
            self.handle.deleteTimer(before + SILENT_DAYS * 86_400_000)
        self.last.update((last,))
        self.handle.registerTimer(last + SILENT_DAYS * 86_400_000)
        if out:
            yield pd.DataFrame(out, columns=["source", "from_ms", "to_ms"]).astype({"to_ms": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"source": [key[0]], "from_ms": [last], "to_ms": pd.array([None], "Int64")})

    def close(self) -> None:
        pass


def silences(stream: DataFrame) -> DataFrame:
    """Stretches of over SILENT_MINUTES without a row of a source. A source that is silent for SILENT_DAYS gives one row without an end, and its state goes: when it
    speaks again it is new."""
    return timed(stream, "1 hour", "source", _Silent(), "source string, from_ms long, to_ms long")


SNAPSHOTS = {
    "films": "id long, scraped_title string, scraped_year int, director string, title_original string, runtime int, synopsis string, skip boolean, match_source string",
    "screenings": "id long, film_id long, venue_id string, starts_at timestamp_ntz, program_name string, tags array<string>, source_url string, scraped_at timestamp_ntz",
}
#: Parts that films are dealt to, by their titles.
FILM_PARTS = 64


def film_part(title: Column) -> Column:
    return F.pmod(F.xxhash64(title), F.lit(FILM_PARTS)).cast("string")


def screening_part(starts_at: Column) -> Column:
    """Screenings lie by their local day, so that what is past is never touched."""
    return F.coalesce(times.local_day(starts_at).cast("string"), F.lit("none"))


def snapshots(spark: SparkSession, root: str) -> Snapshots:
    return Snapshots(spark, root, SNAPSHOTS, {"films": film_part(F.col("scraped_title")), "screenings": screening_part(F.col("starts_at"))})


def ingest_batch(store: Snapshots, rows: DataFrame, now: datetime, version: int) -> dict:
    """The version that follows the last one below it: reads and rewrites the parts of the rows' titles, and of their days and the days from today on.

    Their number is bounded by FILM_PARTS and by how far ahead venues announce, whatever the history holds. A version that is made again replaces itself."""
    base = store.mark(version)
    touched = {
        "films": {r[0] for r in rows.filter("scraped_title IS NOT NULL").select(film_part(F.col("scraped_title"))).distinct().collect()},
        "screenings": {r[0] for r in rows.select(screening_part(F.col("starts_at"))).distinct().collect()},
    }
    today = str((now - timedelta(hours=times.OFFSET_HOURS)).date())
    touched["screenings"] |= {p for p in base["parts"]["screenings"] if p >= today}
    before = {t: store.read(t, base, touched[t]) for t in SNAPSHOTS}
    after = ingest(before["films"], before["screenings"], rows, now, top=base["top"])
    return store.commit(version, base, {t: after[t].select(*before[t].columns) for t in SNAPSHOTS}, touched)


def ingest_stream(
    spark: SparkSession, landed: DataFrame, job: Callable[[SparkSession, DataFrame, datetime], DataFrame], now: datetime, root: str, start: dict[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """Landed payloads through a source's job into the next snapshots of films and screenings, a version for each batch (see `Snapshots`).

    The first version follows the snapshots of `start`, or none. A batch that is run again makes its version again from the one
    before it, so the result is the same. Where nothing has landed the snapshots are those of the last version, or of the start.
    """
    store = snapshots(spark, root)
    if start and not store.versions():
        store.commit(0, store.mark(), {t: start[t] for t in SNAPSHOTS}, {})

    def step(batch: DataFrame, number: int) -> None:
        rows = job(spark, batch, now)
        rows = rows.filter(F.col("lane") == "row").drop("payload_id", "lane", "message")
        rows = rows.withColumnsRenamed({"film_title": "scraped_title", "year": "scraped_year", "runtime_min": "runtime", "film_title_original": "title_original"})
        rows = saved(rows.withColumns({"scraped_at": times.lit(now), "skip": F.coalesce("skip", F.lit(False))}), "batch")
        ingest_batch(store, rows, now, number + 1)

    landed.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return {t: store.read(t) for t in SNAPSHOTS}
