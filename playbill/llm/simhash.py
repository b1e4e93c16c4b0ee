"""SimHash fingerprints and groups of near-duplicates, found with sharded BK-trees."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from hashlib import md5
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bktree import Forest, join_groups
from .chunks import mix
from .common import Workspace, without
from .components import connected_components

#: Two fingerprints at most RADIUS bits apart agree on all but RADIUS of BLOCKS blocks of bits.
BLOCKS = 4
RADIUS = 2
#: Wide fingerprints, for similarities well below 1: bits, and the radius within which a pair is looked at. Sets of
#: shingles with Jaccard similarity j differ in arccos(2j / (1 + j)) / pi of the bits: 39 of 256 at 0.8 with a deviation
#: of 6, and 48 where one has four shingles and the other these and a fifth; the radius is four deviations beyond that.
WIDE_BITS, WIDE_RADIUS = 256, 73
#: The shards of a text: BANDS sets of BAND_ROWS least hashes.
BANDS, BAND_ROWS = 12, 3
#: The similarity, as a fraction, from which two sets are linked.
SIMILAR = (4, 5)
#: Bytes of candidates' texts that are compared with each other or with as many others at once.
CHUNK_BYTES = 8 << 20
#: Fingerprints in a tree; a larger shard is dealt out over several trees, each asked by all of it.
TREE_SIZE = 4096
#: Shingles that are hashed at a time, so that long texts take bounded memory.
PIECE = 1 << 16
#: Rows whose trees are built together.
TOGETHER = 50_000


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles in pieces. A-Z count as lower case; fewer words are one shingle."""
    w = text.lower().split()
    if 0 < len(w) < words:
        w, words = [b" ".join(w)], 1
    shingles = map(b" ".join, zip(*[islice(w, k, None) for k in range(words)], strict=False))
    while piece := list(map(xxhash.xxh64_intdigest, islice(shingles, PIECE), repeat(seed))):
        yield np.array(piece, np.uint64)


def lane(hashes: np.ndarray, number: int) -> np.ndarray:
    """Further hashes of the same shingles; number 0 gives them as they are."""
    return mix(hashes + np.uint64(number) * np.uint64(0x9E3779B97F4A7C15)) if number else hashes


def vote(pieces: Iterable[np.ndarray], lanes: int) -> np.ndarray:
    """64 bits a lane: a bit is set if it is set in over half of the hashes, repeats included."""
    ones, n = np.zeros((lanes, 64), np.int64), 0
    for h in pieces:
        n += len(h)
        for i in range(lanes):
            bits = np.unpackbits(np.ascontiguousarray(lane(h, i)).view(np.uint8), bitorder="little").reshape(-1, 64)
            ones[i] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8")[:, 0]


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of the shingles in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def bands(hashes: np.ndarray) -> list[int]:
    """BANDS numbers, each of BAND_ROWS least hashes of the shingles: similar texts share one."""
    none = np.iinfo(np.uint64).max
    rows = np.array([lane(hashes, 100 + i).min(initial=none) for i in range(BANDS * BAND_ROWS)]).reshape(BANDS, BAND_ROWS)
    out = rows[:, 0]
    for j in range(1, BAND_ROWS):
        out = mix(out + mix(rows[:, j]))
    return out.view(np.int64).tolist()


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x.as_py() or b"" for x in batch.column(1).cast(pa.binary())]
        prints = [vote(shingle_hashes(t, words), 1).view(np.int64).tolist() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.list_(pa.int64()))], ["_k", "_f"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Of rows _k, _h, text: a digest of the set of shingles, its wide fingerprint and its bands."""
    for batch in batches:
        digests, prints, keys = [], [], []
        for x in batch.column(2).cast(pa.binary()):
            text = x.as_py() or b""
            found = shingle_set(text, words)
            digests.append(md5(found.tobytes()).digest())
            prints.append(vote(np.array_split(found, len(found) // PIECE + 1), WIDE_BITS // 64).view(np.int64).tolist())
            keys.append(bands(found))
        longs = pa.list_(pa.int64())
        columns = [*batch.columns[:2], pa.array(digests, pa.binary()), pa.array(prints, longs), pa.array(keys, longs)]
        yield pa.RecordBatch.from_arrays(columns, ["_k", "_h", "_d", "_f", "_bands"])


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (_g, _role, _n, _f): for each shard _g, links of its nodes _n as stars."""

    def linked(g, role, n, prints):
        node, asks = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        forest, names = Forest(g[node], prints[node]), np.arange(len(g))
        for q, v in forest.within(g[asks], prints[asks], radius):
            names = join_groups(names, asks[q], node[v])
        far = np.flatnonzero(names != np.arange(len(g)))
        return pa.RecordBatch.from_arrays([pa.array(n[names[far]]), pa.array(n[far])], ["a", "b"])

    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        prints = batch.column(3).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
        new = [*(c.to_numpy() for c in batch.columns[:3]), prints]
        kept = new if kept is None else [np.concatenate(x) for x in zip(kept, new, strict=True)]
        if len(kept[0]) >= TOGETHER:
            whole = np.searchsorted(kept[0], kept[0][-1])  # the last shard may go on
            if whole:
                yield linked(*[x[:whole] for x in kept])
                kept = [x[whole:] for x in kept]
    if kept is not None and len(kept[0]):
        yield linked(*kept)


def block_shards(radius: int) -> Column:
    """Shards of a one-lane fingerprint: its bits outside `radius` blocks, for each choice of these."""
    width, masks = 64 // BLOCKS, []
    for same in combinations(range(BLOCKS), BLOCKS - radius):
        mask = sum(((1 << width) - 1) << (width * i) for i in same)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return F.array(*[F.col("_f")[0].bitwiseAND(F.lit(m)) for m in masks])


def chunk_pairs(rows: DataFrame, group: list[str], node: str) -> DataFrame:
    """rows with _g, _role: each group's rows are dealt by node into _parts chunks, and each pair of chunks is a _g.

    Of the pair of chunks i <= j, those of i are the tree (role 0) and those of j ask (1); i = j: both (2).
    """
    rows = rows.withColumn("_c", F.pmod(F.xxhash64(node), F.col("_parts")).cast("int"))
    pair = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), role.cast("long").alias("role"))
    c = F.col("_c")
    tree = F.transform(F.sequence(c, F.col("_parts") - 1), lambda j: pair(c, j, F.when(j == c, 2).otherwise(0)))
    ask = F.filter(F.transform(F.sequence(F.lit(0), c), lambda i: pair(i, c, F.lit(1))), lambda p: p["i"] < c)
    dealt = rows.withColumn("_p", F.explode(F.concat(tree, ask)))
    return dealt.withColumn("_g", F.xxhash64(*group, "_p.i", "_p.j")).withColumn("_role", F.col("_p.role"))


def shard_links(rows: DataFrame, radius: int, tree_size: int = TREE_SIZE) -> DataFrame:
    """`near_links` of rows _n, _f, _t, _m: a node's shard _m in table _t; a node may be in several of a table."""
    sizes = rows.groupBy("_t", "_m").agg(F.count("*").alias("_c")).filter("_c > 1")
    rows = rows.join(sizes, ["_t", "_m"]).withColumn("_parts", F.ceil(F.col("_c") / tree_size).cast("int"))
    dealt = chunk_pairs(rows, ["_t", "_m"], "_n").select("_g", "_role", "_n", "_f")
    # The order inside a shard makes a task that is run again build the same trees.
    dealt = dealt.repartition("_g").sortWithinPartitions("_g", "_role", "_n")
    return dealt.mapInArrow(partial(_links, radius=radius), "a long, b long").distinct()


def near_links(nodes: DataFrame, radius: int, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links a, b of nodes that join all whose fingerprints share a shard and are at most radius apart.

    nodes: _n (a number of its own for each), _f (its fingerprint, unlike all others), _shards (the
    i-th number is its shard in table i). A node alone in its shard is left out. Each shard's tree
    is sent to all of the shard: one of over tree_size nodes is dealt into chunks, and each pair of
    chunks is a tree and its queries. So a task holds at most twice tree_size nodes of a shard.
    Of nodes linked in a shard, a star of links is returned, not all pairs.
    """
    return shard_links(nodes.select("_n", "_f", F.posexplode("_shards").alias("_t", "_m")), radius, tree_size)


def alike(role: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Names (a member's number) of the groups that pairs of similarity SIMILAR or more make of sets in a pair of chunks."""
    size, names = np.array([len(x) for x in sets]), np.arange(len(sets))
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    start, mark = np.cumsum(size) - size, np.zeros(len(known), bool)
    top, of = SIMILAR
    for q in np.flatnonzero(role != 0):
        # Sizes alone rule out pairs; pairs in one group already need no link.
        other = (role != 1) & (names != names[q]) & (of * np.minimum(size, size[q]) >= top * np.maximum(size, size[q]))
        if role[q] == 2:
            other[:q] = False
        v = np.flatnonzero(other)
        if not len(v):
            continue
        own = ids[start[q] : start[q] + size[q]]
        mark[own] = True
        first = np.cumsum(size[v]) - size[v]
        at = np.arange(size[v].sum()) + np.repeat(start[v] - first, size[v])
        common = np.add.reduceat(mark[ids[at]], first, dtype=np.int64)
        mark[own] = False
        v = v[of * common >= top * (size[q] + size[v] - common)]
        names[np.isin(names, names[v])] = names[q]
    return names


def _alike(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (_g, _role, _n, text): links of the similar texts of each _g as stars."""

    def linked(rows):
        role, n, sets = zip(*rows, strict=True)
        n, names = np.array(n, np.int64), alike(np.array(role), list(sets))
        far = np.flatnonzero(names != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(n[names[far]]), pa.array(n[far])], ["a", "b"])

    now, rows = None, []
    for batch in batches:
        texts = batch.column(3).cast(pa.binary())
        for g, role, n, t in zip(*(c.to_pylist() for c in batch.columns[:3]), texts, strict=True):
            if g != now:
                if len(rows) > 1:
                    yield linked(rows)
                now, rows = g, []
            rows.append((role, n, shingle_set(t.as_py() or b"", words)))
    if len(rows) > 1:
        yield linked(rows)


def similar_links(texts: DataFrame, words: int, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Links a, b that join all texts (_n, _c, _t) of a group _c with similarity SIMILAR or more.

    A group of over `chunk` bytes is dealt into chunks, and each pair of chunks is compared by itself.
    """
    sizes = texts.groupBy("_c").agg(F.sum(F.octet_length(F.coalesce("_t", F.lit("")))).alias("_bytes"))
    sizes = sizes.select(F.col("_c").alias("_group"), F.greatest(F.ceil(F.col("_bytes") / chunk), F.lit(1)).cast("int").alias("_parts"))
    rows = texts.withColumnRenamed("_c", "_group").join(sizes, "_group")
    dealt = chunk_pairs(rows, ["_group"], "_n").select("_g", "_role", "_n", "_t")
    dealt = dealt.repartition("_g").sortWithinPartitions("_g", "_role", "_n")
    return dealt.mapInArrow(partial(_alike, words=words), "a long, b long").distinct()


def _groups(docs: DataFrame, key: str, text: str, words: int, radius: int) -> DataFrame:
    """_k, _f, component_id of each row."""
    ws = Workspace(docs.sparkSession, "simhash")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))
    rows = ws.save(rows.mapInArrow(partial(_fingerprints, words=words), f"_k {kind}, _f array<long>"), "prints")
    # Rows with equal fingerprints are one node.
    nodes = rows.groupBy("_f").agg(F.min("_k").alias("_least")).withColumn("_n", F.col("_f")[0])
    nodes = ws.save(nodes, "nodes")
    names = connected_components(near_links(nodes.select("_n", "_f", block_shards(radius).alias("_shards")), radius), ws)
    named = nodes.join(names.withColumnRenamed("node", "_n"), "_n", "left")
    least = named.filter("component is not null").groupBy("component").agg(F.min("_least").alias("_first"))
    ids = named.join(least, "component", "left").select("_f", F.coalesce("_first", "_least").alias("component_id"))
    return rows.join(ids, "_f").select("_k", "_f", "component_id")


def text_hash(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def _similar(docs: DataFrame, key: str, text: str, words: int, radius: int) -> DataFrame:
    """_k, _h (md5 of the text), _first (the least _k with its _h that links reach, nulls last) of each row."""
    ws = Workspace(docs.sparkSession, "similar")
    kind = docs.schema[key].dataType.simpleString()
    raw, hashed = F.coalesce(F.col(text).cast("string"), F.lit("")), text_hash(F.col(text))
    rows = docs.select(F.col(key).alias("_k"), hashed.alias("_h"), raw.alias("_t"))
    rows = ws.save(rows.mapInArrow(partial(_sets, words=words), f"_k {kind}, _h binary, _d binary, _f array<long>, _bands array<long>"), "sets")
    # Rows with equal sets of shingles are one node; fingerprint and bands are functions of the set.
    least = F.min(F.struct(F.col("_k").isNull().alias("none"), "_k", "_h")).alias("_least")
    nodes = rows.groupBy("_d").agg(least, F.min("_h").alias("_rep"), F.first("_f").alias("_f"), F.first("_bands").alias("_bands"))
    nodes = ws.save(nodes.select("_d", "_least", "_rep", "_f", "_bands", F.xxhash64("_d").alias("_n"), F.xxhash64("_f").alias("_p")), "nodes")
    # Candidates: fingerprints linked through shared bands, and equal ones.
    shards = nodes.select(F.col("_p").alias("_n"), "_f", F.posexplode("_bands").alias("_t", "_m")).distinct()
    loose = connected_components(shard_links(shards, radius), ws, "loose")
    nodes = nodes.drop("_f", "_bands")
    grouped = nodes.join(loose.withColumnRenamed("node", "_p"), "_p", "left").select("_n", "_rep", F.coalesce("component", "_p").alias("_c"))
    several = grouped.groupBy("_c").agg(F.count("*").alias("_size")).filter("_size > 1").select("_c")
    asked = ws.save(grouped.join(several, "_c", "left_semi"), "candidates")
    texts = docs.select(hashed.alias("_rep"), raw.alias("_t")).join(asked, "_rep").dropDuplicates(["_rep"])
    names = connected_components(similar_links(ws.save(texts, "texts"), words), ws, "alike")
    ws.drop("texts")
    named = nodes.join(names.withColumnRenamed("node", "_n"), "_n", "left")
    first = named.filter("component is not null").groupBy("component").agg(F.min("_least").alias("_of_all"))
    ids = named.join(first, "component", "left").select("_d", F.coalesce("_of_all", "_least").alias("_first"))
    return rows.join(ids, "_d").select("_k", "_h", "_first")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row for each input row: key, fingerprint (16 hex digits), component_id.

    Fingerprints of 64 bits that differ in at most radius (under BLOCKS) are linked; component_id is the
    smallest key that links reach. Shards are the fingerprints that agree on all but `radius`
    blocks of bits, so none is missed. Null and empty texts have fingerprint zero, linked like any
    other. Equal fingerprints are one node, so groups of copies cost one row; repeated rows and
    ties share a component; null keys are never the smallest unless alone. An empty table gives no
    rows; other columns are ignored.
    """
    found = _groups(docs, key, text, words, radius)
    return found.select(F.col("_k").alias(key), F.lower(F.lpad(F.hex(F.col("_f")[0]), 16, "0")).alias("fingerprint"), "component_id")


def similar_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, radius: int = WIDE_RADIUS) -> DataFrame:
    """One row for each input row: key, component_id, for texts whose sets of shingles have Jaccard similarity 0.8 or more.

    Candidates share one of BANDS bands of least hashes (two texts of similarity 0.8 do with probability
    0.9998) and have wide fingerprints at most radius bits apart; groups of candidates are then compared
    by their whole sets, and only pairs of similarity 0.8 or more are linked. Other cases as in `near_duplicates`.
    """
    return _similar(docs, key, text, words, radius).select(F.col("_k").alias(key), F.col("_first._k").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, radius: int = WIDE_RADIUS) -> DataFrame:
    """The rows of docs, all columns, but of each group of similar texts only the least key with its text.

    A row is told by its key and text, so that others of the same key, null or not, stay. Of rows with
    the least key the one of least text hash stays; rows of equal key and text all stay or all go. Null and empty texts are
    one group, as are all texts of fewer words than a shingle that have the same words; texts of any length are compared whole; an
    empty table gives no rows; columns of any names come back as they are.
    """
    found = _similar(docs, key, text, words, radius)
    first = F.col("_k").eqNullSafe(F.col("_first._k")) & (F.col("_h") == F.col("_first._h"))
    gone = Workspace(docs.sparkSession, "distinct").save(found.filter(~first).select(F.col("_k").alias("key"), F.col("_h").alias("digest")).distinct(), "gone")
    return without(docs, gone, key, text_hash(F.col(f"d.`{text}`")))


def op2_simhash_groups(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
