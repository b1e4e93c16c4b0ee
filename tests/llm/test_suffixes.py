"""Suffix order and removal of common bytes against plain versions."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from playbill.llm import byte_dedup
from playbill.llm.common import Workspace
from playbill.llm.packed import OWN, SCHEMA, arrays_of, binary, each_chunk, packed, packed_binary, texts_of, total
from playbill.llm.suffix_array import Splitters, ranked, sample_ranks, with_ranks


def test_packed():
    a, b = np.array([0, 255, 1 << 40]), np.zeros(0, np.int64)
    assert [x.tolist() for x in arrays_of(packed(a, b, a[:2]))] == [a.tolist(), [], [0, 255]]
    strings = binary(np.frombuffer(b"wxyz", np.uint8), np.array([1, 1, 0, 2]))
    texts, (c,) = texts_of(packed_binary(strings.slice(1, 3), a))
    assert texts.to_pylist() == [b"x", b"", b"yz"] and c.tolist() == a.tolist()


def test_splitters():
    rows = [(1, 2), (1, 5), (3, 0), (3, 9), (7, 7)]
    s = Splitters(rows, 5, 2)
    got = s.bucket([np.array([0, 1, 1, 3, 9]), np.array([9, 4, 5, 1, 0])])
    assert got.tolist() == [0, 0, 1, 2, 4]


@pytest.mark.parametrize(("symbols", "size", "small", "rows"), [(2, 60, 8, 16), (1, 50, 4, 16), (3, 300, 20, 40), (50, 400, 1 << 20, 1 << 20)])
def test_order_of_suffixes(spark, symbols, size, small, rows):
    rng = np.random.default_rng(size)
    strings = [np.r_[rng.integers(1, symbols + 1, int(rng.integers(0, size))), 10**6 + c] for c in range(5)]
    df = spark.createDataFrame([(c, OWN, packed(x), len(x)) for c, x in enumerate(strings)], SCHEMA)
    ws = Workspace(spark, "t")
    below = sample_ranks(df, ws, small, rows)
    level = ws.save(each_chunk({"string": df, "ranks": below}, with_ranks), "level")
    out = ranked(level, total(df), ws, rows, "all").collect()
    ranks = {(r["chunk"], i): v for r in out for i, v in enumerate(arrays_of(r["data"])[0].tolist())}
    assert len(set(ranks.values())) == sum(map(len, strings))
    assert sorted(ranks, key=ranks.get) == sorted(ranks, key=lambda k: strings[k[0]][k[1] :].tolist())


def brute(docs, length):
    texts = [(k, (t or "").encode()) for k, t in docs]
    found = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = Counter()
    for k, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if found[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[k, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()] += 1
    return out


def result(df, length=200, **more):
    return Counter((r[0], r[1], r[2], len(r[3]), r[4]) for r in byte_dedup.remove_common_bytes(df, length, **more).collect())


@pytest.mark.parametrize(("length", "small", "rows"), [(16, 1 << 20, 1 << 20), (40, 10, 50), (200, 10, 50), (1000, 10, 50)])
def test_common_bytes(spark, length, small, rows):
    rng = np.random.default_rng(length)
    word = lambda: "".join(rng.choice(list("abcdé"), 6))
    text = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, text(int(rng.integers(0, 120))) * (2 if length > 200 else 1)) for i in range(40)]
    for i in range(30):
        a, b = docs[int(rng.integers(40))][1], docs[int(rng.integers(40))][1]
        x, y = sorted(rng.integers(0, len(a) + 1, 2))
        docs.append((100 + i, text(5) + a[x:y] + text(3) + b[: int(rng.integers(0, len(b) + 1))]))
    docs += [(200, None), (201, ""), (202, docs[7][1]), (203, docs[7][1]), (204, "ab" * 400), (205, docs[9][1] * 2), (206, "z" * length)]
    docs += [(None, "z" * (length + 3)), (None, docs[3][1]), (None, None), (207, "abcde " * 500), (208, "xabcde " * 500), (209, docs[5][1] * 3 + "q"), (210, "y" * 3 * length), (211, "y" * (2 * length) + docs[6][1])]
    docs += [(210, "y" * 3 * length), (212, " ".join(f"w{i % 997} x{i % 31}" for i in range(2 * length)))]
    df = spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id long, text string, spans string, chunk int").repartition(3)
    assert result(df, length, chunk_bytes=3000, small=small, bucket_rows=rows) == brute(docs, length)


def test_common_bytes_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(rows, 200)
    tables = {t.name for t in spark.catalog.listTables()}
    assert not any(t.startswith("chunks_") for t in tables)
    assert byte_dedup.remove_common_bytes(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        byte_dedup.remove_common_bytes(df, 15)


def test_equal_strings_without_phrases_are_settled_together():
    """One start stands for all equal ones of a chunk, and all of those are known to be repeated."""
    rng = np.random.default_rng(3)
    kinds = (lambda: b"x" * int(rng.integers(1, 90)), lambda: bytes(rng.choice([97, 98], int(rng.integers(1, 60))).tolist()), lambda: (bytes(rng.choice(6, int(rng.integers(2, 9))).tolist()) * 20)[: int(rng.integers(1, 120))])
    for _ in range(200):
        data, length = b"".join(kinds[int(k)]() for k in rng.integers(0, 3, 5)), int(rng.choice([16, 20, 40]))
        n = len(data) - length + 1
        if n < 8:
            continue
        cuts = np.sort(rng.choice(n, 4, replace=False))
        low, high = cuts[::2], cuts[1::2]
        places = lambda a, b: [i for x, y in zip(a.tolist(), b.tolist(), strict=True) for i in range(x, y + 1)]
        starts = places(low, high)
        counts = Counter(data[i : i + length] for i in starts)
        a, b, c, d = byte_dedup.one_of_each(data, low, high, length)
        assert Counter(data[i : i + length] for i in places(a, b)) == Counter(dict.fromkeys(counts, 1))
        assert set(places(c, d)) == {i for i in starts if counts[data[i : i + length]] > 1}


def test_long_texts_with_short_periods(spark):
    """Padding and rulers of a million bytes: all but what stands alone goes, and one text's stretch is found in another."""
    texts = ["x" * 1_000_000, "ab" * 300_000, "abcdefg" * 100_000, "head " + "-=" * 100 + " tail", "y" * 200, "y" * 199, "x" * 200 + "z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], [tuple(s) for s in r["spans"]], r["kept_sha256"]) for r in byte_dedup.remove_common_bytes(df, 200).collect()}
    gone = lambda t, *spans: (sum(b - a for a, b in spans), list(spans), hashlib.sha256("".join(t[x:y] for x, y in zip([0, *[b for _, b in spans]], [*[a for a, _ in spans], len(t)], strict=True)).encode()).hexdigest())
    want = {i: gone(t, (0, len(t))) for i, t in enumerate(texts[:3])} | {3: gone(texts[3]), 4: gone(texts[4]), 5: gone(texts[5]), 6: gone(texts[6], (0, 200))}
    assert got == want
