"""Near copies against brute force at the threshold, with boilerplate, in chunks, and with null and repeated keys."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from playbill.llm import exact_dedup, simhash


def shingles(text, words=5):
    w = text.lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or {tuple(w)}


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return 5 * len(a & b) >= 4 * len(a | b)


def brute_groups(texts):
    names = {k: k for k in texts}
    links = [(a, b) for a in texts for b in texts if a < b and similar(texts[a], texts[b])]
    for _ in texts:
        for a, b in links:
            names[a] = names[b] = min(names[a], names[b])
    return names


def pair(tag, own, common):
    """Two texts of `own` shingles each, `common` of them shared."""
    head = [f"{tag}h{i}" for i in range(common + 4)]
    return [" ".join(head + [f"{tag}{side}{i}" for i in range(own - common)]) for side in "ab"]


@pytest.mark.parametrize(("own", "common", "linked"), [(89, 78, 0), (90, 80, 40), (91, 82, 40), (890, 780, 0), (900, 800, 40)])
def test_recall_and_false_links_at_the_threshold(spark, own, common, linked):
    texts = dict(enumerate(t for i in range(40) for t in pair(f"p{i}x", own, common)))
    out = dict(tuple(r) for r in simhash.similar_texts(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect())
    assert out == brute_groups(texts) and sum(out[2 * i + 1] == 2 * i for i in range(40)) == linked


def test_short_texts_and_chains(spark):
    words = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(words[i : i + 44]) for i in range(0, 16, 2)}  # each like its neighbours only
    texts |= {100 + i: f"s{i} a b c d e f g" for i in range(20)} | {200 + i: f"s{i} a b c d e f g h" for i in range(20)}
    out = dict(tuple(r) for r in simhash.similar_texts(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect())
    assert out == brute_groups(texts)


@pytest.mark.parametrize("chunk", [1 << 20, 4000])
def test_links_of_a_group_in_chunks(spark, chunk):
    rng = np.random.default_rng(5)
    base, texts = [f"b{i}" for i in range(120)], {}
    for i in range(30):
        w = list(base)
        for at in rng.integers(0, 120, rng.integers(1, 8)):
            w[at] = f"c{i}"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame([(k, 1, t) for k, t in texts.items()], "_n long, _c long, _t string")
    links = [tuple(r) for r in simhash.similar_links(docs, 5, chunk).collect()]
    names = {k: k for k in texts}
    for _ in texts:
        for a, b in links:
            names[a] = names[b] = min(names[a], names[b])
    assert names == brute_groups(texts) and len(set(names.values())) > 1


def test_boilerplate_does_not_join_texts(spark):
    line = " ".join(f"line{i}" for i in range(13))
    own = {i: [f"d{i}w{j}" for j in range(104)] for i in range(12)}
    own |= {20 + i: [*own[i][:-4], "e", "f", "g", "h"] for i in range(0, 12, 2)}
    texts = {k: " ".join([line] * 40 + w) for k, w in own.items()}
    texts |= {50 + i: " ".join([line] * 20 + [f"s{i}w{j}" for j in range(44)]) for i in range(12)}
    out = dict(tuple(r) for r in simhash.similar_texts(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect())
    assert out == brute_groups(texts) and out[20] == 0 and len(set(out.values())) == 24


def test_repeats_count_once_and_equal_prints_keep_all_bands(spark):
    """A set's fingerprint doesn't depend on repeats; equal fingerprints of different sets are asked in the bands of each."""
    some = " ".join(f"w{i}" for i in range(13))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([b"", b""]), pa.array([" ".join([some] * 3), " ".join([some] * 40)])], ["_k", "_h", "_t"])
    one, many = next(simhash._sets(iter([batch]), 5)).to_pylist()
    assert (one["_d"], one["_f"], one["_bands"]) == (many["_d"], many["_f"], many["_bands"])
    rows = [(1, [0], 0, 7), (1, [0], 0, 8), (2, [1], 0, 8), (3, [3], 0, 7)]
    links = simhash.shard_links(spark.createDataFrame(rows, "_n long, _f array<long>, _t int, _m long"), 2)
    assert {frozenset(r) for r in links.collect()} == {frozenset((1, 2)), frozenset((1, 3))}


def test_null_and_repeated_keys_with_texts_of_their_own_stay(spark):
    words = [f"w{i}" for i in range(60)]
    copied, near, own = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(f"o{i}" for i in range(60))
    other = " ".join(f"x{i}" for i in range(60))
    for second, drop in ((copied, exact_dedup.drop_exact_duplicates), (near, simhash.drop_near_duplicates)):
        rows = [(1, copied), (5, second), (5, own), (None, second), (None, other), (None, None), (7, "alone")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert Counter(tuple(r) for r in drop(docs).collect()) == Counter([(1, copied), (5, own), (None, other), (None, None), (7, "alone")])
    nulls = spark.createDataFrame([(None, copied), (None, near), (None, own)], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.drop_near_duplicates(nulls).collect()) in (sorted([own, copied]), sorted([own, near]))
