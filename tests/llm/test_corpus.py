"""Corpus operators against plain versions, and on nulls, empty tables, ties and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter
from urllib.parse import urljoin

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from playbill.llm import components, exact_dedup, mixing, quality, registry, sentencepiece_ops, sharding, simhash, substring_dedup, toxicity, url_filter
from playbill.llm.bktree import Forest, join_groups
from playbill.llm.common import Workspace
from playbill.llm.segmentation import Lattices, sample_segmentations

SF = "/root/testdata/sf0.001"
MODEL = sentencepiece_ops.default_model()
#: Names that operators might use themselves.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, shard string, row int, h int, count int, score int, component int, _x int"


def odd_rows(spark):
    long = " ".join(f"w{i % 997} x{i % 31}" for i in range(30_000))
    rows = [
        (1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (5, " \t\n"), (6, long), (7, long + " end"),
        (8, "é ü ñ 日本 ▁ x"), (9, "A  B\tC d e f"), (None, "a b c d e f"), (None, None),
    ]
    data = [(k, t, None, "s" if i % 3 else None, 1, "k", 1, "s", 1, 1, 1, 1, 1, 1) for i, (k, t) in enumerate(rows)]
    return spark.createDataFrame(data, CLASHING)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, want.fetchall()))


def test_sharding(spark):
    docs = odd_rows(spark)
    out = rows_of(sharding.assign_shards(docs, [1.0, 2.0, 1.0]))
    assert len(out) == docs.count()
    for s in {r["shard"] for r in out}:
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 3) for r in out)
    assert {r["size"] for r in out if r["doc_id"] == 3} == {1}
    shares = Counter(r[0] for r in spark.range(20_000).select(sharding.rendezvous(F.col("id").cast("string"), [1.0, 3.0])).collect())
    assert abs(shares[1] / 20_000 - 0.75) < 0.02
    assert sharding.assign_shards(docs.limit(0), [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit("x"), [])


def test_exact_duplicates(spark):
    docs = odd_rows(spark)
    out = {(r["doc_id"], r["text_sha256"]): r for r in rows_of(exact_dedup.exact_duplicates(docs))}
    six = hashlib.sha256(b"a b c d e f").hexdigest()
    assert out[1, six]["kept"] and out[1, six]["group_size"] == 4 and not out[2, six]["kept"] and out[2, six]["keep_id"] == 1
    assert out[4, hashlib.sha256(b"").hexdigest()]["keep_id"] == 3
    assert out[5, hashlib.sha256(b" ").hexdigest()]["kept"]
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 7, 8, 9]


def test_texts_that_share_a_hash_stay_apart(spark):
    docs = documents(spark)
    weak = lambda t: F.concat(F.substring(F.md5(t), 1, 1), F.lit("0" * 31))
    a = exact_dedup.exact_duplicates(docs, hash128=weak)
    b = exact_dedup.exact_duplicates(docs)
    assert sorted(a.collect()) == sorted(b.collect())


def test_mixing(spark):
    docs = odd_rows(spark)
    out = mixing.mix_sources(docs, {"s": 2.0}, epochs=20.0)
    got = rows_of(out.select("row.*", "copy_no"))
    assert set(out.select("row.*").columns) == set(docs.columns)
    counts = Counter((r["doc_id"], r["text"]) for r in got)
    assert counts[2, "a b c d e f"] % 2 == 0  # repeated rows get equal counts
    assert mixing.mix_sources(docs.limit(0), {}).count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 > 0, "hot").otherwise("rare").alias("source"), F.lit("x" * 9).alias("text"))
    shares = {r["source"]: r["n"] for r in mixing.mix_sources(many, {"hot": 1.0, "rare": 3.0}, epochs=20.0).groupBy("row.source").agg(F.count("*").alias("n")).collect()}
    assert abs(shares["rare"] / 80_000 - 0.75) < 0.01 and abs(sum(shares.values()) / 80_000 - 1) < 0.02  # rates of 60 take two parts
    one = many.filter("source = 'rare'")
    counts = Counter(Counter(r[0] for r in mixing.mix_sources(one, {}).select("row.doc_id").collect()).values())
    assert abs(counts[1] / 1000 - math.exp(-1)) < 0.05 and abs(counts[2] / 1000 - math.exp(-1) / 2) < 0.05


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    in_dup = {i + k for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(in_dup)


def test_quality(spark):
    for docs in (odd_rows(spark), documents(spark)):
        texts = Counter((r["doc_id"], *brute_quality(r["text"])) for r in docs.collect())
        out = quality.judge_quality(docs)
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        assert Counter(tuple(r) for r in out.select("doc_id", *names).collect()) == texts
        assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and (not r["kept"] or not r["base_failed"]) for r in rows_of(out))
    assert quality.judge_quality(documents(spark).limit(0)).count() == 0


def test_bad_host_goes_and_small_host_is_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short text"
    rows = [(i, bad if i % 10 else good, "bad") for i in range(100)] + [(100 + i, good, f"h{i % 20}") for i in range(400)] + [(600, bad, "tiny"), (601, good, "tiny")]
    out = {r["doc_id"]: r for r in rows_of(quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")))}
    assert not out[0]["kept"] and not out[0]["base_failed"] and out[101]["kept"] and out[601]["kept"]


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    for docs in (documents(spark), odd_rows(spark).filter("doc_id is not null")):
        rows = [(r["doc_id"], brute_print(r["text"])) for r in docs.collect()]
        names = {k: k for k, _ in rows}
        for _ in rows:
            for a, x in rows:
                for b, y in rows:
                    if names[b] < names[a] and (x ^ y).bit_count() <= 2:
                        names[a] = names[b]
            if all(names[names[k]] == names[k] for k in names):
                break
        want = Counter((k, f"{p:016x}", names[k]) for k, p in rows)
        assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(documents(spark).limit(0)).count() == 0
    assert simhash.near_duplicates(odd_rows(spark)).count() == odd_rows(spark).count()


def test_trees_find_all_within_radius(spark):
    rng = np.random.default_rng(1)
    for lanes, radius in ((1, 2), (4, 40)):
        base = rng.integers(0, 1 << 63, (40, lanes), dtype=np.uint64)
        prints = np.unique(base[rng.integers(0, 40, 600)] ^ (np.uint64(1) << rng.integers(0, 64, (600, lanes), dtype=np.uint64)), axis=0)
        tree = np.sort(rng.integers(0, 3, len(prints)))
        found = {(int(a), int(b)) for q, v in Forest(tree, prints).within(tree, prints, radius) for a, b in zip(q, v, strict=True)}
        far = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
        assert found == {(a, b) for a, b in zip(*np.nonzero((far <= radius) & (tree[:, None] == tree[None])), strict=True)}
    assert join_groups(np.arange(6), np.array([1, 2, 5]), np.array([2, 3, 4])).tolist() == [0, 1, 1, 1, 4, 4]


def test_links_of_a_shard_over_several_trees(spark):
    rng = np.random.default_rng(2)
    prints = sorted({int(x) & 0xFFFF for x in rng.integers(0, 1 << 16, 300)})
    nodes = spark.createDataFrame([(p, [p], [0]) for p in prints], "_n long, _f array<long>, _shards array<long>")
    whole, parts = (simhash.near_links(nodes, 2, size) for size in (4096, 16))

    def groups(links):
        names = {p: p for p in prints}
        for _ in prints:
            for a, b in links:
                names[a] = names[b] = min(names[a], names[b])
        return names

    assert groups([tuple(r) for r in whole.collect()]) == groups([tuple(r) for r in parts.collect()])


def test_similar_texts(spark):
    rng = np.random.default_rng(3)
    text = lambda: [f"v{x}" for x in rng.integers(0, 3000, 300)]
    rows, n = [], 0
    for _ in range(20):
        a = text()
        b = list(a)
        for at in rng.integers(0, 300, 3):
            b[at] = "changed"
        rows += [(n, " ".join(a)), (n + 1, " ".join(b)), (n + 2, " ".join(text()))]
        n += 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = dict(tuple(r) for r in simhash.similar_texts(docs).collect())
    assert all(out[k + 2] == k + 2 for k in range(0, n, 3))
    assert sum(out[k + 1] == k for k in range(0, n, 3)) >= 19
    assert simhash.drop_near_duplicates(odd_rows(spark)).columns == odd_rows(spark).columns


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5), (7, 6)]
    ws = Workspace(spark, "t")
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(chain, "a long, b long"), ws).collect())
    assert len({got[i] for i in range(201)}) == 1 and len({got[i] for i in range(1000, 1300)}) == 1 and got[0] != got[1000]
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0
    ws.close()


def brute_remove(docs, window):
    seen, out = set(), Counter()
    words = {k: (t or "").encode().split() for k, t in docs}
    for k in sorted(words):
        w, gone = words[k], set()
        for i in range(len(w) - window + 1):
            s = tuple(w[i : i + window])
            if s in seen:
                gone |= set(range(i, i + window))
            seen.add(s)
        out[k, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("window", [4, 20, 27])
def test_substring_dedup(spark, window):
    rng = np.random.default_rng(window)
    docs = [(int(k), " ".join(f"a{x}" for x in rng.integers(0, 2 if k % 7 == 0 else 40, rng.integers(0, 90)))) for k in rng.permutation(60)]
    docs += [(100 + i, docs[i][1] + " tail " + docs[i + 1][1]) for i in range(20)] + [(200, None), (201, ""), (202, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in substring_dedup.remove_repeats(df, window, chunk_bytes=2000).collect())
    assert got == brute_remove(docs, window)


def test_substring_dedup_odd_rows(spark):
    assert substring_dedup.remove_repeats(odd_rows(spark)).count() == odd_rows(spark).count()
    assert substring_dedup.remove_repeats(odd_rows(spark).limit(0)).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = docs.join(labels.select("doc_id"), "doc_id")
    out = toxicity.score_toxicity(known, labels.filter(~toxicity.held_out(F.col("doc_id")))).join(labels, "doc_id").toPandas()
    held = out[[zlib.crc32(str(k).encode()) % 5 == 0 for k in out["doc_id"]]]
    ranks, ones = held["score"].rank(), held["toxic"].sum()
    area = (ranks[held["toxic"] == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(held) - ones))
    assert area > 0.97
    assert held[held["toxic"] == 0]["predicted"].mean() < 0.02 and held[held["toxic"] == 1]["predicted"].mean() > 0.6
    assert held[held["toxic"] == 1]["offending"].map(len).gt(0).mean() > 0.6


def test_toxicity_odd_rows(spark):
    docs, labels = odd_rows(spark), spark.createDataFrame([(1, 1), (6, 0), (6, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    out = rows_of(toxicity.score_toxicity(docs, labels))
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out) and {r["score"] for r in out if r["doc_id"] in (3, 4, 5)} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), labels.limit(0)).count() == 0
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == docs.count()


@pytest.fixture(scope="module")
def lattices():
    with open(MODEL, "rb") as f:
        return Lattices(f.read(), 0.3, True)


def test_samples_follow_the_lattice(lattices):
    first, second, logs, estimate, n = Counter(), Counter(), {}, Counter(), 4000
    for (s, bound) in sample_segmentations(lattices, [b"inge"] * n, [str(i) for i in range(n)], 2):
        (a, la, ga), (b, lb, gb) = [(tuple(x.tolist()), p, g) for x, p, g in s]
        assert a != b and ga >= gb >= bound
        first[a], second[b], logs[a], logs[b] = first[a] + 1, second[b] + 1, la, lb
        for x, p in ((a, la), (b, lb)):
            estimate[x] += math.exp(p) / -math.expm1(-math.exp(p - bound)) / n
    assert abs(sum(map(math.exp, logs.values())) - 1) < 1e-3
    for a, p in ((a, math.exp(p)) for a, p in logs.items()):
        then = sum(math.exp(q) * p / (1 - math.exp(q)) for o, q in logs.items() if o != a)
        assert abs(first[a] / n - p) < 0.02 and abs(second[a] / n - then) < 0.04
        assert abs(estimate[a] - p) < 0.02


def test_samples_do_not_depend_on_other_texts(lattices, spark):
    texts = [(t or "").encode() for (t,) in documents(spark).select("text").limit(64).collect()] + [b"", b"a  b", "▁ x\n\n y".encode()]
    keys = [str(i) for i in range(len(texts))]

    def flat(drawn):
        return [[(ids.tolist(), p, g) for ids, p, g in samples] + [bound] for samples, bound in drawn]

    with open(MODEL, "rb") as f:
        alone = Lattices(f.read(), 0.3, True)
    together = flat(sample_segmentations(lattices, texts, keys, 3))
    assert together == [flat(sample_segmentations(alone, [t], [k], 3))[0] for t, k in reversed(list(zip(texts, keys, strict=True)))][::-1]


def test_encoding_round_trip(spark):
    docs = documents(spark).unionByName(odd_rows(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    out = sentencepiece_ops.decode(sentencepiece_ops.encode(docs, MODEL), MODEL).filter("doc_id > 10").join(docs, "doc_id")
    assert out.filter("decoded <> text or not round_trip").count() == 0
    odd = sentencepiece_ops.decode(sentencepiece_ops.encode(odd_rows(spark), MODEL), MODEL)
    assert odd.filter("not round_trip").count() == 0
    assert {r["decoded"] for r in odd.filter("doc_id is null or doc_id = 8 or doc_id = 4").collect()} == {"", "a b c d e f", "é ü ñ 日本 ▁ x"}
    with pytest.raises(ValueError):
        sentencepiece_ops.decode(docs.withColumn("decoded", F.lit(1)), MODEL, "n_chars")
    rows = rows_of(sentencepiece_ops.encode(odd_rows(spark), MODEL, k=3))
    assert [len(r["ids"]) for r in rows if r["doc_id"] in (3, 4)] == [0, 0]
    assert len({tuple(r["ids"]) for r in rows if r["doc_id"] == 6}) == 3
    assert sentencepiece_ops.encode(docs.limit(0), MODEL).count() == 0


def test_url_aliases(spark):
    rows = [
        (1, "http://spam.net/x", None), (2, "http://ok.example.com/en/1", '<link rel="canonical" href="http://spam.net/x">'),
        (3, "https://www.ok.example.com/en/1/?utm_medium=q", ""), (4, "http://a.example.net/en/1", '<meta http-equiv=refresh content="0; url=http://spam.net/x">'),
        (5, "http://EXAMPLE.com/de/#x", None), (6, None, None), (7, "no scheme", ""), (8, "http://b.org", None), (9, "http://r.org/", None), (2, "http://ok.example.com/en/1", None),
    ]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, host string, component int")
    hops = spark.createDataFrame([("http://r.org/", "http://hop.org/"), ("http://hop.org/", "http://m.spam.net/x.html")], "from_url string, to_url string")
    out = {r["page_id"]: r for r in rows_of(url_filter.filter_urls(pages, redirects=hops))}
    verdicts = {k: r["verdict"] for k, r in out.items()}
    assert verdicts == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "block"}
    assert out[5]["host"] == "example.com" and out[5]["rule"] == "example.com/de/" and out[4]["rule"] == "example.net/en/" and out[6]["host"] == ""
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_links_of_pages(spark):
    base = "https://a.org/x/y/z.html?q=1#f"
    links = ["//bad.net/q", "/p", "p", "./p/q", "../p", "../../../p", "?k=2", "http://c.com/d", "..", "./", "p/./q/../r"]
    rows = spark.createDataFrame([(x,) for x in links], "x string").select("x", url_filter.resolved(F.col("x"), F.lit(base)).alias("got")).collect()
    assert {r["x"]: r["got"] for r in rows} == {x: urljoin(base, x) for x in links}
    pages = [
        (1, "http://a.com/item?id=1", '<link href="//bad.net/q" rel=canonical>'), (2, "http://a.com/item?id=2&utm_source=x", None),
        (3, "http://b.com/k/p", "<LINK REL='canonical' HREF='../q?a=1&amp;b=2'>"), (4, "http://b.com/q?a=1&b=2", '<link rel="canonical" href="http://bad.net/z">'),
        (5, "http://b.com/q?a=1", None), (6, "http://a.com/item?id=1&gclid=7", None), (7, None, "<link rel=canonical href=/q>" * 40_000), (7, None, None),
    ]
    out = {r["page_id"]: r["verdict"] for r in rows_of(url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")))}
    assert out == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "block", 7: "allow"}


def test_columns_of_any_name(spark):
    names = ["key", "digest", "_gone", "_k", "_h", "_sha", "_keep", "component", "g.key"]
    docs = odd_rows(spark)
    docs = docs.select("*", *[F.lit("x").alias(n) for n in names])
    # Near copies: rows 2 and 9 are texts of row 1 but for case and spaces, row 7 has one word more than row 6; 3, 4 and 5 have no words.
    for drop, kept in ((exact_dedup.drop_exact_duplicates, [1, 3, 5, 6, 7, 8, 9]), (simhash.drop_near_duplicates, [1, 3, 6, 8])):
        out = drop(docs)
        assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == kept
    with pytest.raises(ValueError):
        sharding.write_shards(docs, "/nowhere", [1.0])


def test_pipeline_on_odd_rows_and_on_none(spark, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (2, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd_rows(spark)), ("none", odd_rows(spark).limit(0))):
        sf = str(tmp_path / name)
        docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        out = rows_of(corpus_pipeline.run(spark, sf))
        assert all(r["round_trip"] for r in out) and (name == "none") == (not out)


def test_pipeline(spark):
    import corpus_pipeline

    docs = documents(spark)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = Workspace(spark, "t").save(out, name)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).filter("round_trip").count() > docs.select("doc_id").distinct().count()


def test_toxicity_long_text_first(spark):
    """A labelled text far beyond the bound, first in hash order, keeps none of the others out of the training; rows that do not fit are left out, later ones taken."""
    docs = [(i, f"plain words here {i}. " + ("vile rotten curse. " if i % 2 else "kind gentle song. ")) for i in range(400)]
    first = spark.createDataFrame([(i,) for i in range(400)], "doc_id long").orderBy(F.xxhash64("doc_id")).first()[0]
    docs[first] = (first, docs[first][1] + "filler of no account. " * 60_000)
    frame, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    ws = Workspace(spark, "test")
    for numbers in (40_000, 8_000):
        weights = np.frombuffer(toxicity.train_toxicity(frame, labels, ws, numbers=numbers), np.float32)
        ws = Workspace(spark, "test")
        values = toxicity.Remembered(lambda word, w=weights: float(w[toxicity.parts(word)].sum()))
        scores = [toxicity.score_text(t, values, float(weights[-1]))[0] for _, t in docs]
        assert min(scores[1::2]) > 0.5 > max(s for i, s in enumerate(scores) if i % 2 == 0)
    assert toxicity.fitting([5, 100, 3, 2, 1], 10) == [0, 2, 3] and toxicity.fitting([], 10) == []


def test_noisy_or_fit_against_plain_gradients():
    """The fitted weights of words are those that plain Adam on the same loss, document by document, gives."""
    texts = [("bad one. fine words.", 1), ("fine words. more words.", 0), ("bad again. fine.", 1), ("words again.", 0)] * 4
    own = [[words for words, _ in toxicity.sentences(t)] for t, _ in texts]
    numbers = np.array([toxicity.parts(w) for d in own for s in d for w in s], np.int32)
    sentence = np.repeat(np.arange(sum(map(len, own))), [len(s) for d in own for s in d])
    document = np.repeat(np.arange(len(own)), [len(d) for d in own])
    got = toxicity.fit_noisy_or(numbers, sentence, document, np.array([y for _, y in texts]))

    learnt = sorted({p for d in own for s in d for w in s for p in toxicity.parts(w)} - {0})
    weights, bias = dict.fromkeys(learnt, 0.0), -5.0
    m, v = Counter(), Counter()
    for t in range(1, toxicity.EPOCHS + 1):
        g = Counter({p: toxicity.RIDGE * w for p, w in weights.items()})
        for d, (_, y) in zip(own, texts, strict=True):
            bags = [[p for w in s for p in toxicity.parts(w) if p] for s in d]
            chance = [1 / (1 + math.exp(-(bias + sum(weights[p] for p in b)))) for b in bags]
            clean = math.prod(1 - x for x in chance)
            slope = -clean / max(1 - clean, 1e-9) if y else 1.0
            for b, x in zip(bags, chance, strict=True):
                for p in [*b, "bias"]:
                    g[p] += slope * x / len(own)
        for p in [*learnt, "bias"]:
            m[p], v[p] = 0.9 * m[p] + 0.1 * g[p], 0.999 * v[p] + 0.001 * g[p] ** 2
            step = toxicity.RATE * (m[p] / (1 - 0.9**t)) / (math.sqrt(v[p] / (1 - 0.999**t)) + 1e-8)
            if p == "bias":
                bias -= step
            else:
                weights[p] -= step
    assert abs(got[-1] - bias) < 1e-3 and all(abs(got[p] - w) < 1e-3 for p, w in weights.items())
