"""Exact de-duplication by a 128-bit content hash, with byte comparison inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_HASHES, SPACE, Workspace, attach, without


def normalised(text: Column) -> Column:
    """The text with each run of white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def first_128_bits(text: Column) -> Column:
    """Half of the text's sha256, in hexadecimal digits."""
    return F.substring(F.sha2(text, 256), 1, 32)


def _judged(docs: DataFrame, key: str, text: str, hash128: Callable[[Column], Column], ws: Workspace) -> DataFrame:
    """_k, _sha of each row, with _keep and _size of its class where that has two rows or more."""
    norm = normalised(F.col(text))
    sha = F.sha2(norm, 256)
    hashed = F.unhex(F.substring(sha, 1, 32) if hash128 is first_128_bits else hash128(norm))
    rows = ws.save(docs.select(F.col(key).alias("_k"), hashed.alias("_h"), sha.alias("_sha")), "rows")
    groups = ws.save(rows.groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1").select("_h", F.lit(True).alias("_many")), "groups")
    texts = docs.select(F.col(key).alias("_k"), hashed.alias("_h"), norm.alias("_t"))
    texts = attach(texts, groups, "_h", F.col("_k"), "inner", BROADCAST_HASHES)
    classes = ws.save(texts.groupBy("_h", "_t").agg(F.min("_k").alias("_keep"), F.count("*").alias("_size")), "classes")
    shared = ws.save(classes.groupBy("_h").agg(F.count("*").alias("_c")).filter("_c > 1").select("_h"), "collisions")
    plain = ws.save(classes.join(shared, "_h", "left_anti").select("_h", "_keep", "_size"), "plain")
    if shared.isEmpty():
        return attach(rows, plain, "_h", F.col("_k"))
    apart = (
        docs.select(F.col(key).alias("_k"), hashed.alias("_h"), sha.alias("_sha"), norm.alias("_t"))
        .join(shared, "_h", "left_semi")
        .join(classes, ["_h", "_t"])
        .select("_k", "_h", "_sha", "_keep", "_size")
    )
    return attach(rows.join(shared, "_h", "left_anti"), plain, "_h", F.col("_k")).unionByName(apart)


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", hash128: Callable[[Column], Column] = first_128_bits) -> DataFrame:
    """One row for each input row: key, keep_id, group_size, kept, text_sha256.

    Rows are grouped by a 128-bit hash of the normalised text (any function of it may be given).
    Only groups of two or more are read again with their texts and grouped by (hash, bytes), so
    that texts that merely share a hash stay apart. A group is never brought together: the hashes of groups are
    broadcast behind a count, or joined salted beyond it, and each map task sends one row for each of its
    distinct texts. Of equal texts the smallest key stays; of repeated rows
    with that key all are kept, as no key tells them apart. Null texts count as empty; null keys
    come after all others. A text of any length is one value, hashed and compared whole. An empty table
    gives no rows; other columns, whatever their names, are ignored.
    """
    judged = _judged(docs, key, text, hash128, Workspace(docs.sparkSession, "exact"))
    keep = F.when(F.col("_size").isNull(), F.col("_k")).otherwise(F.col("_keep"))
    return judged.select(
        F.col("_k").alias(key),
        keep.alias("keep_id"),
        F.coalesce(F.col("_size"), F.lit(1)).cast("long").alias("group_size"),
        F.col("_k").eqNullSafe(keep).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that `exact_duplicates` keeps.

    A row is told by its key and text, so that others of the same key, null or not, stay. Null and empty texts
    are equal; repeated rows all stay or all go; an empty table gives no rows; columns of any names come back as they are.
    """
    ws = Workspace(docs.sparkSession, "distinct")
    gone = exact_duplicates(docs, key, text).filter("not kept").select(F.col(key).alias("key"), F.col("text_sha256").alias("digest")).distinct()
    return without(docs, ws.save(gone, "gone"), key, F.sha2(normalised(F.col(f"d.`{text}`")), 256))


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
