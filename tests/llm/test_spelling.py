"""Spelling variants against all pairs of words, and on odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from playbill.llm import spelling

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def plain_variants(counts, least_count=5, least_length=6, ratio=5):
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    form, out = {}, []
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def plain_counts(docs, slip):
    out = Counter()
    for k, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{k}:{run}".encode())
            if slip and k is not None and h % slip == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            out[run] += 1
    return out


def variants(spark, counts, **more):
    rows = spark.createDataFrame([(w, n, "f") for w, n in counts.items()], "word string, n long, form string")
    return sorted(tuple(r) for r in spelling.spelling_variants(rows, **more).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("alphabet", ["ab", "abcdefé", "abcdefghijklmnop日𝄞"])
def test_all_pairs_are_found(spark, alphabet):
    rng, counts = random.Random(len(alphabet)), Counter()
    for _ in range(150):
        w = "".join(rng.choice(alphabet) for _ in range(rng.randint(5, 12)))
        counts[w] += rng.choice([1, 5, 40, 400, 4000])
        for _ in range(rng.randint(0, 4)):
            i, c = rng.randrange(len(w)), rng.choice(alphabet)
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w + c])
            counts[w] += rng.choice([1, 5, 30, 200])
    got = variants(spark, counts)
    assert got == plain_variants(counts) and any(x[4] for x in got)


@pytest.mark.parametrize("symbols", [2, 4, 9])
def test_neighbourhoods_are_whole(symbols):
    """Every reduced word at one edit is among the hashes, and nothing else."""
    rng = random.Random(symbols)
    for length in (0, 1, 2, 5):
        s = np.array([[rng.randint(1, symbols) for _ in range(length)] for _ in range(20)], np.uint64).reshape(20, length)
        got = spelling._neighbourhoods(s, symbols)
        for row, hashes in zip(s.tolist(), got.tolist(), strict=True):
            want = [row] + [row[:i] + row[i + 1 :] for i in range(length)]
            want += [row[:i] + [c] + row[i + 1 :] for i in range(length) for c in range(1, symbols + 1)]
            want += [row[:i] + [c] + row[i:] for i in range(length + 1) for c in range(1, symbols + 1)]
            value = lambda x: int(spelling._prefixes(np.array([x], np.uint64).reshape(1, -1))[-1][0])
            assert set(hashes) == {value(x) for x in want}


def test_long_chains_of_forms_and_ties(spark):
    counts = {"a" * i: 5**i for i in range(6, 25)} | {"zzzzzb": 100, "zzzzzc": 100, "zzzzzz": 20, "éèêëàâ": 500, "éèêëàä": 100}
    got = variants(spark, counts, least_length=6)
    assert got == plain_variants(counts)
    assert ("aaaaaa", "aaaaaaa", "a" * 24, 5**6, 1, 5**7) in got and ("zzzzzz", "zzzzzb", "zzzzzb", 20, 2, 100) in got


def test_neighbourhoods_and_forms_are_not_broadcast(spark, monkeypatch):
    """A word has some hundred neighbours, and Spark sizes them by the file of the words."""
    plans, save = [], spelling.Workspace.save
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(spelling.Workspace, "save", lambda ws, df, label: seen(df) or save(ws, df, label))
    rows = spark.createDataFrame([("a" * i, 5**i) for i in range(6, 12)], "word string, n long")
    found = spelling.spelling_variants(rows)
    seen(found)
    assert {r["root"] for r in found.collect()} == {"a" * 11}
    assert sum("SortMergeJoin" in p for p in plans) > 2 and not any("Broadcast" in p for p in plans)


def test_query_on_all_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in spelling.op11_spelling_variants(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == plain_variants(plain_counts(docs, 199)) and len(got) > 100


def test_odd_rows(spark):
    long = "lengthy " * 40_000
    data = [(1, None), (2, ""), (3, " \t"), (4, "Ärgere ÄRGERE Àéîõüÿ x÷÷÷÷÷÷y 日本lengthy"), (5, long), (5, long), (None, "without a key without"), (None, None)]
    docs = spark.createDataFrame([(k, t, "w", 1) for k, t in data], "doc_id long, text string, word string, n int")
    for slip in (0, 2):
        got = {r["word"]: r["n"] for r in spelling.word_counts(docs, slip=slip).collect()}
        assert got == {w: n for w, n in plain_counts(data, slip).items() if len(w) >= 6}
    assert spelling.spelling_variants(spelling.word_counts(docs.limit(0))).count() == 0
    words = spark.createDataFrame([("abcdef", 3), ("abcdef", 4), (None, 9), ("abcdex", 1), ("abcdeg", 40)], "word string, n long")
    assert sorted(map(tuple, spelling.spelling_variants(words).collect())) == [("abcdef", "abcdeg", "abcdeg", 7, 1, 40), ("abcdeg", None, "abcdeg", 40, 1, None)]
    with pytest.raises(ValueError):
        spelling.spelling_variants(words, ratio=1)
