"""What the one task that fits the toxicity model holds."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from playbill.llm import toxicity


def rows(n, size):
    rng = random.Random(3)
    texts = [" ".join(f"word{rng.randrange(3000)}" for _ in range(size)) for _ in range(n)]
    labels = pa.array([{"label": i % 2, "k": i} for i in range(n)], pa.struct([("label", pa.int32()), ("k", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts), labels], ["k", "text", "label"])


def bags(batch, i):
    out = list(toxicity._bags(iter([batch]), 1 << 30))
    places = iter(i)
    for b in out:
        label = pa.array([x["label"] for x in b.column("label").to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("words", "parts", "counts")), label, pa.array([next(places) for _ in range(b.num_rows)], pa.int32())], ["words", "parts", "counts", "label", "i"])


def test_the_fit_holds_the_numbers_of_a_word_once(monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    monkeypatch.setattr(toxicity, "WORDS_TOGETHER", 100_000)
    given = list(bags(rows(400, 5_000), range(400)))  # two million words; six numbers of each would be 48 MB, twice that while they are put together
    assert len(given) == 20
    tracemalloc.start()
    try:
        (out,) = toxicity._fit(iter(given))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 45 * 2_000_000 + 60 * toxicity.WIDTH
    assert len(out.column("weights")[0].as_py()) == 4 * (toxicity.WIDTH + 1)


def test_the_order_of_arrival_changes_nothing(monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 5)
    monkeypatch.setattr(toxicity, "WIDTH", 1 << 11)  # words collide
    given = list(bags(rows(60, 300), range(60)))
    split = [b.slice(at, 1) for b in given for at in range(b.num_rows)]
    random.Random(1).shuffle(split)
    one, two = (next(toxicity._fit(iter(x))).column("weights")[0].as_py() for x in (given, split))
    assert one == two
    assert np.isfinite(np.frombuffer(one, np.float32)).all()
    assert next(toxicity._fit(iter([]))).column("weights")[0].as_py() == toxicity._blank()
