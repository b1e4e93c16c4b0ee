"""Pieces that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words; everything else is part of a word.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a side that may be broadcast (a few hundred bytes each); larger sides are joined salted.
BROADCAST_ROWS = 10_000
#: Rows of a hash of 16 bytes each, and bytes of rows that are measured, which may be broadcast.
BROADCAST_HASHES, BROADCAST_BYTES = 500_000, 32 << 20
SALTS = 32


class Workspace:
    """Tables that cut lineage, in the folder that spark.checkpoint.dir names.

    Saved tables outlive lost executors. They stay until `drop` or `close`, as the frames that
    operators return read them lazily.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not base:
            base = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-")
            if not spark.sparkContext.getCheckpointDir():
                spark.sparkContext.setCheckpointDir(base)
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.root}/{label}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, label: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{label}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def tidy(self, *labels: str) -> None:
        """Drops tables, and has the driver collect its garbage: Spark removes the shuffle files of steps that nothing refers to
        any more only when it does, which would otherwise be much later."""
        for label in labels:
            self.drop(label)
        self.spark.sparkContext._jvm.System.gc()

    def keep(self, label: str) -> None:
        """Drops all tables but this one."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for x in fs.listStatus(path):
            if x.getPath().getName() != label:
                fs.delete(x.getPath(), True)

    def close(self) -> None:
        self.drop()


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the md5 of the parts joined by ':'."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def shuffled(df: DataFrame) -> DataFrame:
    """df, as a side of a join that is never broadcast: Spark sizes what is made of compressed files, or of few rows by an explode or a Python
    function, far too low, and would bring it to the driver."""
    return df.hint("merge")


def attach(big: DataFrame, small: DataFrame, key: str, spread: Column, how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left (or inner) join with a side that has one row a key, whose keys may be null and hot in `big`.

    The small side is counted first: up to `rows` rows it is broadcast, beyond that each of
    its rows is repeated for SALTS salts and the rows of a hot key go to as many tasks.
    """
    cond = F.col("b." + key).eqNullSafe(F.col("s." + key))
    if small.limit(rows + 1).count() <= rows:
        joined = big.alias("b").join(F.broadcast(small).alias("s"), cond, how)
    else:
        salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
        joined = dealt.alias("b").join(shuffled(salted.alias("s")), cond & (F.col("b._salt") == F.col("s._salt")), how)
    return joined.select(*[F.col(f"b.`{c}`") for c in big.columns], *[F.col(f"s.`{c}`") for c in small.columns if c != key])


def without(docs: DataFrame, gone: DataFrame, key: str, digest: Column) -> DataFrame:
    """docs, all columns, without the rows of `gone` (columns key, digest, saved): those of its keys, null or not, whose texts have its digests.

    `digest` is that of a row of docs, whose columns it names by the prefix "d". The bytes of
    `gone` are added up first: it is broadcast up to BROADCAST_BYTES, else both sides are shuffled.
    """
    size = gone.agg(F.sum(F.coalesce(F.octet_length(F.col("key").cast("string")), F.lit(0)) + F.octet_length("digest") + 32)).first()[0] or 0
    cond = F.col(f"d.`{key}`").eqNullSafe(F.col("g.key")) & (digest == F.col("g.digest"))
    return docs.alias("d").join((F.broadcast(gone) if size <= BROADCAST_BYTES else gone).alias("g"), cond, "left_anti")
