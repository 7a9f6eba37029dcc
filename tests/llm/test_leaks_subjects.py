"""Problems 7 and 8 on small fixtures."""

import random

import numpy as np
import pytest

from bindery.llm import leaks, subjects

PASSAGE = "When the river rose in 1570 Mibeltaga carried 84 tiles from Brekudrugris to the loft of Kulailusun before dusk"


def test_index_equals_brute_force():
    r = np.random.default_rng(1)
    text = np.concatenate([r.integers(1, 6, 4000), np.tile([1, 2, 3], 200), r.integers(1, 9, 500)])
    index = leaks.FMIndex(text)
    patterns = np.array([text[i : i + 5] for i in r.integers(0, len(text) - 5, 60)] + [[9, 9, 9, 9, 9], [50, 1, 1, 1, 1]])
    lo, hi = index.search(patterns)
    for p, a, b in zip(patterns, lo, hi):
        want = [i for i in range(len(text) - 4) if (text[i : i + 5] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id bigint, text string, item_id string, start int")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, passage string, question string")


def test_leaks(spark):
    w = PASSAGE.split()
    texts = [
        "x " + PASSAGE.upper() + " y", "> " + "\n> ".join(" ".join(w[i : i + 3]) for i in range(0, 15, 3)), " ".join(w[:11]) + " so", " ".join(w[:11]) + " other " + " ".join(w[12:]),
        "<p>" + " ".join(f"<b>{x}</b>" for x in w[2:14]) + "</p>", " ".join(w[3:15]).replace("e", "е").replace("r", "ｒ"), None, "", "who is it " * 5, " ".join(w[1:13]).replace(" ", " &nbsp;“") + "&amp;",
    ]
    df = docs(spark, texts + [texts[0]])
    it = items(spark, [(1, PASSAGE, "short question"), (2, PASSAGE, None), (3, None, None), (4, "", "who is it " * 4)])
    got = {(r.doc_id, r.item_id) for r in leaks.spans(df, "doc_id", "text", it, "item_id", ["passage", "question"]).select("doc_id", "item_id").collect()}
    assert got == {(d, i) for d in (0, 1, 4, 5, 9, 10) for i in (1, 2)} | {(8, 4)}
    assert leaks.spans(df.limit(0), "doc_id", "text", it, "item_id", ["passage"]).count() == 0
    assert leaks.spans(df, "doc_id", "text", it.limit(0), "item_id", ["passage"]).count() == 0


def test_spans_merge_and_blocks_change_nothing(spark, monkeypatch):
    df = docs(spark, [f"a b {PASSAGE} c {PASSAGE}"])
    it = items(spark, [(i, PASSAGE, None) for i in range(5)])
    whole = {tuple(r) for r in leaks.spans(df, "doc_id", "text", it, "item_id", ["passage"]).collect()}
    n = len(leaks.words(PASSAGE))
    assert whole == {(0, i, s, s + n) for i in range(5) for s in (2, 3 + n)}
    monkeypatch.setattr(leaks, "BLOCK", 2)
    monkeypatch.setattr(leaks, "SHARD", 10)
    assert {tuple(r) for r in leaks.spans(df, "doc_id", "text", it, "item_id", ["passage"]).collect()} == whole


NOUNS = {"law": ["court", "deed", "notary", "statute", "tenant"], "music": ["piano", "chord", "violin", "tempo", "choir"], "software": ["compiler", "socket", "schema", "branch", "callback"]}


def made(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        has = r.sample(sorted(NOUNS), r.choice([0, 1, 1, 2]))
        s = [f"my {r.choice(NOUNS[k])} fails as soon as I touch the {r.choice(NOUNS[k])} today" for k in has for _ in range(2)]
        s.append("any help is much appreciated by me")
        r.shuffle(s)
        rows.append((i, ". ".join(x.capitalize() for x in s) + ".", has))
    return rows


def test_held_out_accuracy(spark, monkeypatch):
    monkeypatch.setattr(subjects, "ROUNDS", 40)
    train, test = made(150, 1), made(80, 2)
    schema = "doc_id bigint, text string"
    known = spark.createDataFrame([(i, s) for i, _, has in train for s in ([f" {x.upper()}" for x in has] or ["none"])] + [(0, None), (None, "law")], "doc_id bigint, subject string")
    m = subjects.fit(spark.createDataFrame([r[:2] for r in train], schema), "doc_id", "text", known, "subject", sorted(NOUNS), [])
    df = spark.createDataFrame([r[:2] for r in test] + [(900, None), (901, ""), (902, "​")] + [test[0][:2]], schema)
    got = {tuple(r) for r in subjects.assign(df, "doc_id", "text", m, []).collect()}
    want = {(i, s) for i, _, has in test for s in has}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(want)


def test_no_labels_no_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, subject string")
    m = subjects.fit(none, "doc_id", "text", none, "subject", ["law"], [])
    assert subjects.assign(none, "doc_id", "text", m, []).count() == 0


def test_passages():
    p = subjects.passages("First sentence stands here. Second one follows it!\n\n```py\nx = foo(bar, baz, qux)\n```\n<p>Use `x` with some care now</p>")
    assert [c for c, _ in p] == [True, False, False, False] and p[0][1][:2] == ["py", "x"]
    text = PASSAGE + ". Other words stand here alone."
    quoted = subjects.Quotes([PASSAGE]).passages(text)
    assert quoted == [0] and len(subjects.Features().of_text(text, quoted)) == 1 and len(subjects.Features().of_text(text)) == 2
    assert subjects.passages("It is law.") == [(False, ["it", "is", "law"])]


def test_gradient_is_that_of_the_loss():
    m = subjects.Model(["a", "b"])
    for name in ("e", "w", "b"):
        setattr(m, name, getattr(m, name).astype(np.float64))
    flat, n, docs_, y = np.array([3, 4, 5, 3, 7]), np.array([2, 1, 2]), np.array([2, 1]), np.array([[1.0, 1.0], [0.0, 0.0]])

    def loss():
        z = m.hidden(flat, np.array([0, 2, 3]), n) @ m.w.T + m.b
        q = np.stack([np.log1p(-1 / (1 + np.exp(-z[:2]))).sum(0), np.log1p(-1 / (1 + np.exp(-z[2:]))).sum(0)])
        return -(y * np.log1p(-np.exp(q)) + (1 - y) * q).sum()

    g = m.gradient(flat, n, docs_, y)
    for x, d in ((m.w, g[1]), (m.b, g[2])):
        for at in np.ndindex(x.shape):
            old = x[at]
            x[at] = old + 1e-5
            up = loss()
            x[at] = old - 1e-5
            down = loss()
            x[at] = old
            assert d[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-4)
