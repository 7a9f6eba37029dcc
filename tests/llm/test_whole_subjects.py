"""The classifier at its full size, with little sent to the driver."""

import numpy as np
import pandas as pd

from bindery.llm import subjects


def test_full_size():
    assert (subjects.BUCKETS, subjects.ROUNDS) == (1 << 15, 90)


def test_gradients_are_added_in_one_order():
    r = np.random.default_rng(1)
    rows = [(i, (r.normal(size=1000) * 10.0**i).astype(np.float32)) for i in range(8)]
    want = sum((g for _, g in rows), np.zeros(1000, np.float32))
    for order in ([3, 1, 7, 0, 5, 2, 6, 4], range(8)):
        batches = [pd.DataFrame({"part": [rows[i][0]], "g": [rows[i][1].tobytes()]}) for i in order]
        (got,) = subjects._added(iter(batches))
        assert (np.frombuffer(got["g"][0], np.float32) == want).all()
    assert list(subjects._added(iter([]))) == []


def test_evaluation_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(subjects, "BLOCK", 2)
    texts = [f"held out {w} sentence {w} that has {w} enough words" for w in ("one", "two", "three", "four", "five")]
    parts = list(subjects.blocks([None, "", *texts, texts[-1]]))
    assert [len(x) for x in parts] == [2, 2, 1]
    docs = spark.createDataFrame([(1, f"Own words. {texts[0]}. More. {texts[4]}"), (2, "None of them here"), (3, texts[3])], "k int, t string")
    assert {r.k: sorted(r.q) for r in subjects.without_quotes(docs, parts).collect()} == {1: [1, 3], 2: [], 3: [0]}
    assert {r.k: r.q for r in subjects.without_quotes(docs, []).collect()} == {1: [], 2: [], 3: []}
