"""Blocking and matching of misspelt titles against all pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from playbill.functions.similarity import jaro_winkler, similarities
from playbill.operators import resolve

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def misspelt(rng, title, errors):
    t = list(title)
    for _ in range(errors):
        i = rng.randrange(len(t) - 1)
        kind = rng.randrange(4)
        if kind == 0:
            t[i], t[i + 1] = t[i + 1], t[i]
        elif kind == 1:
            t[i] = rng.choice(LETTERS)
        elif kind == 2:
            t.insert(i, rng.choice(LETTERS))
        elif len(t) > 4:
            del t[i]
    return " ".join("".join(t).split())


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(LETTERS) for _ in range(rng.randrange(3, 9)))
    titles = sorted({" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(120)})
    catalog = [(100 + i, t, None, 1990 + i % 5, float(i % 7), 40 * (i % 6), [f"Dir {i % 9}"]) for i, t in enumerate(titles)]
    catalog += [(500 + i, t, None, 1990 + i % 5, 3.0, 1000 * (i % 2), [f"Dir {i % 4}"]) for i, t in enumerate(titles[:40])]
    listings = [(i, misspelt(rng, titles[i % len(titles)], i % 3), None, None if i % 4 == 0 else 1990 + i % len(titles) % 5, f"Dir {i % 9}" if i % 2 else None) for i in range(240)]
    listings += [(900, "ansora", None, None, None), (901, "mteropolis", None, None, None), (902, "satr wars", None, None, None), (903, "zzzz qqqq", None, None, None)]
    catalog += [(900, "anora", None, 2024, 1.0, 9, []), (901, "metropolis", None, 1927, 1.0, 9, []), (902, "star wars", None, 1977, 1.0, 9, [])]
    schemas = ("listing_id long, title string, original string, year int, director string", "ext_id long, cat_title string, cat_original string, cat_year int, popularity double, votes long, cat_directors array<string>")
    return listings, catalog, spark.createDataFrame(listings, schemas[0]), spark.createDataFrame(catalog, schemas[1])


def near(a, b):
    return a is None or b is None or abs(a - b) <= 1


def test_blocking_keeps_similar_titles(tables):
    listings, catalog, left, right = tables
    met = {(r["title"], r["cat_title"]) for r in resolve.title_pairs(left, right).collect()}
    titles = {x[1] for x in listings}, {x[1] for x in catalog}
    similar = [(a, b) for a, b in itertools.product(*titles) if jaro_winkler(a, b) >= resolve.THRESHOLD]
    recall = sum(p in met for p in similar) / len(similar)
    assert len(similar) > 150 and recall >= 0.98, (recall, [p for p in similar if p not in met])
    assert len(met) < 0.1 * len(titles[0]) * len(titles[1])


def matched(listing, catalog):
    """The match by all pairs, in plain words: the best score; all within TIE of it; one, or one that dominates by votes."""
    _, title, _, year, director = listing
    scores = {c[0]: jaro_winkler(title, c[1]) for c in catalog if near(year, c[3])}
    top = max(scores.values(), default=0)
    band = [c for c in catalog if c[0] in scores and scores[c[0]] >= top - resolve.TIE and scores[c[0]] >= resolve.THRESHOLD]
    band.sort(key=lambda c: (-c[5], c[0]))
    if len(band) == 1 or (band and director is None and band[0][5] >= resolve.LEAST_VOTES and band[0][5] >= resolve.DOMINANCE * max(band[1][5], 1)):
        return band[0][0], round(scores[band[0][0]], 9)
    return None


def test_best_match_is_that_of_all_pairs(tables):
    listings, catalog, left, right = tables
    got = {r["listing_id"]: (r["ext_id"], round(r["score"], 9)) for r in resolve.best_match(resolve.rank(resolve.score(left, right))).collect()}
    assert got == {r["listing_id"]: (r["ext_id"], round(r["score"], 9)) for r in resolve.matches(left, right).collect()}
    want = {x[0]: m for x in listings if (m := matched(x, catalog))}
    assert got.items() <= want.items() and len(got) >= 0.98 * len(want) > 100
    assert {900, 901, 902} <= set(got) and 903 not in got


def test_cascade(spark):
    one = lambda i, title, year=None, director=None: (i, title, None, year, director)
    listings = [one(1, "fixed by hand"), one(2, "metropolis", 1927, "Fritz Lang"), one(3, "solaris", None, "Steven Soderbergh"), one(4, "zyzzyva", 1999, "Ana Ruiz"), one(5, "nothing like it"), one(6, "solaris"), one(7, "stalker", 1979, "Someone Else")]
    catalog = [
        (20, "Metropolis", None, 1927, 5.0, 900, ["Fritz Lang"]), (30, "Solaris", None, 1972, 9.0, 500, ["Andrei Tarkovsky"]), (31, "Solaris", None, 2002, 8.0, 450, ["Steven Soderbergh"]),
        (40, "Quite another", None, 1999, 1.0, 5, ["Ana Ruiz"]), (70, "Stalker", None, 1979, 9.0, 800, ["Andrei Tarkovsky"]),
    ]
    left = spark.createDataFrame(listings, "listing_id long, title string, original string, year int, director string")
    right = spark.createDataFrame(catalog, "ext_id long, cat_title string, cat_original string, cat_year int, popularity double, votes long, cat_directors array<string>")
    overrides = spark.createDataFrame([(1, 77)], "listing_id long, ext_id long")
    credits = right.select(F.explode("cat_directors").alias("name"), "ext_id", "cat_year")
    out = {r["listing_id"]: (r["stage"], r["ext_id"], r["reason"]) for r in resolve.resolve(left, right, overrides, credits).collect()}
    assert out == {
        1: ("override", 77, "ok"), 2: ("match", 20, "ok"), 3: ("director", 31, "ok"), 4: ("pivot", 40, "ok"), 5: (None, None, "no-candidates"),
        6: (None, None, "low-confidence"), 7: (None, None, "low-confidence"),
    }
    third = resolve.director_fallback(resolve.rank(resolve.score(left, right))).collect()
    assert {(r["listing_id"], r["ext_id"]) for r in third} == {(2, 20), (3, 31)} and all(r["score"] >= resolve.THRESHOLD for r in third)
    assert {(r["listing_id"], r["ext_id"]) for r in resolve.director_pivot(left, credits).collect()} == {(2, 20), (4, 40)}


def test_similarity_against_letter_by_letter():
    """The scores of whole batches are those of the rule in plain words, and a bound leaves out only pairs below it."""

    def plain(a, b):
        if not a or not b:
            return float(a == b and a is not None)
        reach, taken, left = max(max(len(a), len(b)) // 2 - 1, 0), [False] * len(b), []
        for i, ch in enumerate(a):
            j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not taken[j] and b[j] == ch), None)
            if j is not None:
                taken[j] = True
                left.append(ch)
        right, m = [ch for ch, t in zip(b, taken, strict=True) if t], len(left)
        if not m or a == b:
            return float(a == b)
        jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(left, right, strict=True)) / 2) / m) / 3
        prefix = next((i for i in range(4) if a[i : i + 1] != b[i : i + 1] or not a[i : i + 1]), 4)
        return jaro + prefix * 0.1 * (1 - jaro)

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé日 "[: rng.choice([2, 4, 7])]) for _ in range(rng.choice([0, 1, 2, 5, 9, 20, 70])))
    a = [word() for _ in range(4000)] + [None, None, "x"]
    b = [rng.choice([word(), x[::-1], x[1:] + "a", x[:5] + word()]) if x is not None else None for x in a[:-2]] + ["x", None]
    want = [plain(x, y) for x, y in zip(a, b, strict=True)]
    assert similarities(a, b).tolist() == want
    assert similarities(a, b, 0.85).tolist() == [x if x >= 0.85 or y > 0 else 0.0 for x, y in zip(want, similarities(a, b, 0.85), strict=True)]
    assert all(y == x for x, y in zip(want, similarities(a, b, 0.85), strict=True) if x >= 0.85)


def test_common_heads_do_not_bring_all_titles_together(spark):
    """Titles that share a head but no rare word: pairs grow with the titles, not with their square; misspelt ones still meet."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(LETTERS) for _ in range(rng.randrange(7, 12)))
    met = {}
    for n in (200, 800):
        known = [f"la noche {word()} {word()}" for _ in range(n)]
        asked = [misspelt(rng, t, 1) for t in known]
        left = spark.createDataFrame([(i, t, None) for i, t in enumerate(asked)], "listing_id long, title string, original string")
        right = spark.createDataFrame([(t, None) for t in known], "cat_title string, cat_original string")
        pairs = {(r["title"], r["cat_title"]) for r in resolve.title_pairs(left, right).collect()}
        assert set(zip(asked, known, strict=True)) <= pairs
        met[n] = len(pairs)
    assert met[200] < 2 * 200 and met[800] < 2 * 800


def test_the_shortlist_decides_as_the_whole_catalog(spark):
    """Groups of many rows of one title and year: champions, ties and first three as from all rows, in plain words."""
    rng = random.Random(13)
    catalog = [(i, rng.choice(["solaris", "stalker", "mirror"]), None, rng.choice([1972, 1979, None]), float(rng.randrange(5)), rng.choice([0, 90, 100, 400, 1700]), ["X"]) for i in range(120)]
    catalog.append((500, "nostalghia", None, 1983, 1.0, 3, ["X"]))
    listings = [(1, "solaris", None, None, None), (2, "solaris", None, 1972, None), (3, "stalkers", None, 1980, None), (4, "mirror", None, 1950, None), (5, "nostalgia", None, 1983, "Y"), (6, "solaris", None, None, None)]
    left = spark.createDataFrame(listings, "listing_id long, title string, original string, year int, director string")
    right = spark.createDataFrame(catalog, "ext_id long, cat_title string, cat_original string, cat_year int, popularity double, votes long, cat_directors array<string>")
    got = {r["listing_id"]: (r["ext_id"], round(r["score"], 9)) for r in resolve.matches(left, right).collect()}
    assert got == {x[0]: m for x in listings if (m := matched(x, catalog))}
    found = {(r["title"], r["year"]): [(x["rank"], x["ext_id"]) for x in r["first"]] for r in resolve.answers(left, right).collect()}
    whole = resolve.rank(resolve.score(left, right)).filter("rank <= 3").join(left.select("listing_id", "title", "year"), ["listing_id", "title", "year"]).collect()
    for r in whole:
        assert (r["rank"], r["ext_id"]) in found[r["title"], r["year"]]
