"""Periodic runs against all periods of all places, and on odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from playbill.llm import periodic_runs

SF = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, runs string, start int, period int, _w string, _t string, n_words int"


def plain_runs(words):
    """Each period, each maximal stretch; of equal stretches the smallest period."""
    least = {}
    for q in range(1, len(words)):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                least.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in least.items()), key=lambda x: (x[0], x[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("seed", range(6))
def test_all_runs_of_all_periods(seed):
    rng, docs = random.Random(seed), []
    for _ in range(150):
        n, kinds = rng.choice([0, 1, 5, 6, 20, 60, 200, 500]), rng.choice([1, 2, 3, 5, 50])
        words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 4) if n > 10 else 0):
            a = rng.randrange(n)
            p, end = rng.randint(1, max(1, (n - a) // 4)), rng.randint(a, n)
            words[a:end] = [words[a + (i - a) % p] for i in range(a, end)]
        docs.append(words)
    assert periodic_runs.runs_of(docs) == [plain_runs(w) for w in docs]


def test_runs_inside_runs_and_at_the_ends():
    inner = ["a", "a", "a", "a", "a", "a", "b"]
    for words in (inner * 5, ["x", *inner * 4], [*inner * 4, "x"], [f"w{i}" for i in range(40)] * 4, [f"w{i}" for i in range(40)] * 4 + ["w0", "y"], [f"w{i}" for i in range(33)] * 3):
        assert periodic_runs.runs_of([words, words[::-1]]) == [plain_runs(words), plain_runs(words[::-1])]


def test_long_periodic_texts():
    for period in (1, 2, 7, 8, 9, 16, 17, 1000, 4097):
        words = [f"w{i}" for i in range(period)] * (60_000 // period + 1)
        assert periodic_runs.runs_of([["z"], words, ["z"]]) == [[], [(0, len(words), period)], []]


def test_query_on_all_documents(spark):
    """Texts of up to 400 words against the plain version; of the others the runs are verified where they are claimed."""
    out = {r["doc_id"]: tuple(r) for r in periodic_runs.op13_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(docs)
    checked = found = 0
    for k, text in docs:
        if len((text or "").split()) <= 1500:
            assert out[k] == plain_row(k, text), k
            checked, found = checked + 1, found + out[k][1]
    assert checked > 150 and found > 5


def test_odd_rows(spark):
    chosen = [k for k in range(2000) if zlib.crc32(str(k).encode()) % 10 == 0][:6]
    texts = [None, "", " \t\n", "a b", "a a a a a a a", "x " * 30 + "y", "é é é é é é", "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 9]
    data = [(k, t, "r", 1, 2, "w", "t", 3) for k in [*chosen, 1, None] for t in texts] + [(1, "a a a a a a", "r", 1, 2, "w", "t", 3)] * 2
    docs = spark.createDataFrame(data, CLASHING)
    found = periodic_runs.run_digests(periodic_runs.collapse_runs(periodic_runs.with_planted_runs(docs)))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr(plain_row(k, t)) for k, t, *_ in data)
    assert periodic_runs.collapse_runs(docs).columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert periodic_runs.run_digests(periodic_runs.collapse_runs(periodic_runs.with_planted_runs(docs.limit(0)))).count() == 0
