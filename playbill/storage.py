"""Tables that cut lineage, in a folder that all executors share; and snapshots in parts, of which a batch rewrites only those it touches."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where spark.checkpoint.dir says, or a temporary one, in local mode only, where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read from there, so that what follows neither plans nor computes it again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Snapshots:
    """Tables in parts, with a mark for each version.

    {root}/data/{table}/v={version}/part={part} has a part's rows as some version wrote them; {root}/commits/{version} says, for every table, which version
    each of its parts is of, and the greatest id so far. A version writes the parts it touches, then its mark, which appears at
    once by renaming. Readers follow the last mark, so they see whole versions only, whatever a killed job left behind; and the work of a
    version grows with the parts it touches, not with the tables. The files of the last version and the one before stay.
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str], parts: dict[str, Column]):
        """tables: name -> schema; parts: name -> the part (a string) that a row is in."""
        self.spark, self.root, self.tables, self.parts = spark, root.rstrip("/"), tables, parts
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n) for n in self._names("commits") if n.isdigit()]

    def mark(self, below: int | None = None) -> dict:
        """The last version's mark, or the last one below a number; an empty one where there is none."""
        found = [v for v in self.versions() if below is None or v < below]
        if not found:
            return {"version": -1, "top": dict.fromkeys(self.tables, 0), "parts": {t: {} for t in self.tables}}
        stream = self.fs.open(self._path(f"commits/{found[-1]:012d}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str, mark: dict | None = None, only: Iterable[str] | None = None) -> DataFrame:
        """A table as of a mark (the last one), all parts of it or some."""
        own = (mark or self.mark())["parts"][table]
        chosen = own.keys() if only is None else own.keys() & set(only)
        paths = [f"{self.root}/data/{table}/v={own[p]:012d}/part={p}" for p in sorted(chosen)]
        return self.spark.read.schema(self.tables[table]).parquet(*paths) if paths else self.spark.createDataFrame([], self.tables[table])

    def commit(self, version: int, base: dict, frames: dict[str, DataFrame], touched: dict[str, set[str]]) -> dict:
        """The next version: of each table the frame holds all rows of the touched parts (and of parts that are new)."""
        parts, top = {t: dict(p) for t, p in base["parts"].items()}, dict(base["top"])
        for table, df in frames.items():
            folder = f"{self.root}/data/{table}/v={version:012d}"
            df.withColumn("part", self.parts[table]).write.mode("overwrite").partitionBy("part").parquet(folder)
            written = [n.removeprefix("part=") for n in self._names(f"data/{table}/v={version:012d}") if n.startswith("part=")]
            for part in touched.get(table, ()):
                parts[table].pop(part, None)
            parts[table] |= dict.fromkeys(written, version)
            if written:
                rows = self.spark.read.schema(self.tables[table]).parquet(*[f"{folder}/part={p}" for p in written])
                top[table] = max(top[table], rows.agg(F.max("id")).first()[0] or 0)
        mark = {"version": version, "top": top, "parts": parts}
        self.fs.mkdirs(self._path("commits"))
        draft, final = self._path(f"commits/.{version:012d}-{uuid.uuid4().hex}"), self._path(f"commits/{version:012d}")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(mark).encode()))
        out.close()
        if self.fs.exists(final):  # the batch is run again
            self.fs.delete(final, False)
        if not self.fs.rename(draft, final):
            raise OSError(f"version {version} could not be marked")
        self._tidy(base, mark)
        return mark

    def _tidy(self, base: dict, mark: dict) -> None:
        """Drops the marks before the base, and what neither it nor the new one refers to."""
        for v in self.versions():
            if v < base["version"]:
                self.fs.delete(self._path(f"commits/{v:012d}"), False)
        for table in self.tables:
            used = {(v, p) for m in (base, mark) for p, v in m["parts"][table].items()}
            for name in self._names(f"data/{table}"):
                v, folder = int(name.removeprefix("v=")), f"data/{table}/{name}"
                if v >= mark["version"]:
                    continue
                for part in [n for n in self._names(folder) if n.startswith("part=") and (v, n.removeprefix("part=")) not in used]:
                    self.fs.delete(self._path(f"{folder}/{part}"), True)
                if not any(n.startswith("part=") for n in self._names(folder)):
                    self.fs.delete(self._path(folder), True)
