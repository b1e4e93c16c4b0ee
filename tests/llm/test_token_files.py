"""Token files against the library's own ids, and on odd rows."""

import random
import tempfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from playbill.llm import token_files

SF = "/root/testdata/sf0.001"
PATH = token_files.default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as _f:
    ENCODER = token_files.Encoder(_f.read())


def plain(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


PARTS = [*" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　​᠎aé'1,.日", "<|endoftext|>", "'ll", "'s", "  ", "\n\n", " \n", "word", "12"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=4)), max_size=12).map("".join), max_size=4))
def test_pieces_give_the_ids_of_whole_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, counts = ENCODER.encode(texts)
    want = [plain(t) for t in texts]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_an_encoder_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    with open(PATH, encoding="utf-8") as f:
        encoder = token_files.Encoder(f.read())
    for i in range(30):
        texts = [f"some words {i} and {i * 7} others", "y" * 200, " again and again"]
        assert encoder.encode(texts)[0].tolist() == [x for t in texts for x in plain(t)]
        assert encoder.held < 50 + 300


@pytest.mark.parametrize("kind", range(3))
def test_any_stretch_of_codes(kind):
    rng = random.Random(kind)
    for n in (0, 1, 7, 8, 9, 511, 512, 513, 1024, 5000):
        values = [rng.choice([0, 5, 255, 256, 70_000, 1 << 24, (1 << 32) - 1]) if kind == 0 else rng.randrange(50_257 if kind == 1 else 200) for _ in range(n)]
        ids = np.array(values, np.uint32)
        codes = token_files.Codes(memoryview(token_files.Codes.pack(ids)))
        assert len(codes) == n and codes.size == len(token_files.Codes.pack(ids))
        assert [codes[i] for i in range(0, n, 3)] == values[::3]
        for _ in range(40):
            low, high = sorted((rng.randint(0, n), rng.randint(0, n)))
            assert codes.stretch(low, high).tolist() == values[low:high]


def rows_in_order(docs):
    """Null keys first, then by key; rows of equal keys by their ids' order in the files, told by n_tokens and checksum only."""
    out, start = [], 0
    for k, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*plain(t), 0], "<u4")
        out.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_on_all_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = [tuple(r) for r in token_files.op12_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(out) == rows_in_order(docs)


@pytest.mark.parametrize("file_ids", [1, 40, 1 << 23])
def test_odd_rows_and_files_of_any_size(spark, file_ids):
    long = " ".join(f"w{i % 997} x{i % 31}" for i in range(30_000))
    data = [(5, "five"), (None, "no key"), (3, None), (-4, "minus"), (1, ""), (2, long), (7, "<|endoftext|> 日本"), (9, "same"), (9, "same"), (9, "other"), (None, None)]
    docs = spark.createDataFrame([(k, t, "f", 1, "i", 2) for k, t in data], "doc_id long, text string, file string, begin int, ids string, start int").repartition(3)
    path = f"{tempfile.mkdtemp(prefix='spark-')}/tokens"
    token_files.write_tokens(docs, path, PATH, file_ids=file_ids)
    rows = token_files.read_tokens(spark, path)
    got = [tuple(r) for r in token_files.starts(rows, path).select("doc_id", "start", "n_tokens", "ids").collect()]
    assert sorted((repr(k), np.frombuffer(ids, "<u4").tolist()) for k, _, _, ids in got) == sorted((repr(k), [*plain(t), 0]) for k, t in data)
    in_order = sorted(got, key=lambda x: x[1])
    assert [k for k, *_ in in_order] == [k for k, *_ in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0))]
    assert [x[1] for x in in_order] == np.cumsum([0, *[x[2] for x in in_order]])[:-1].tolist()
    index = spark.read.parquet(f"{path}/index")
    assert index.agg(F.sum("n_docs"), F.sum("n_ids")).first() == (len(data), sum(x[2] for x in got))
    if file_ids == 1:
        assert index.count() == len(data)


def test_no_rows(spark):
    path = f"{tempfile.mkdtemp(prefix='spark-')}/tokens"
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert token_files.starts(token_files.read_tokens(spark, path), path).count() == 0
