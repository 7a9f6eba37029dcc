"""Hangul and characters beyond U+FFFF that have no shape."""

import unicodedata

import pytest

from bindery.llm import lookalike

REC = "doc_id string, rec string, text string"


@pytest.mark.parametrize("a, b, same", [("한국 고서", unicodedata.normalize("NFD", "한국 고서"), True), ("葛\U000e0100城", "葛城", True), ("plain\U000e0041 text", "plain text", True), ("한국", "한글", False), ("a \U0001f600", "a \U0001f680", False), ("\U0001f3f4\U000e0067\U000e0062\U000e007f", "\U0001f3f4\U000e0075\U000e0073\U000e007f", False)])
def test_pairs(spark, a, b, same):
    df = spark.createDataFrame([("d", "a", a), ("d", "b", b)], REC)
    assert [tuple(r) for r in lookalike.pairs(df).collect()] == [("d", "a", "b")] * same


def test_keys_are_joined_either_way(spark, monkeypatch):
    rows = [("d", "a", "ﬁx Ꭰо"), ("d", "b", "fix Do"), ("d", "c", "other"), ("e", "a", "fix Do"), ("d", "n", None), ("d", "c", "other")]
    df = spark.createDataFrame(rows, "doc_id string, rec string, text string")
    want = {("d", "a", "fix Do"), ("d", "b", "fix Do"), ("d", "c", "other"), ("e", "a", "fix Do"), ("d", "n", None)}
    for size in (0, 1 << 20):
        monkeypatch.setattr(lookalike, "BROADCAST", size)
        got = [(r.doc_id, r.rec, r.canonical) for r in lookalike.canonical(df).collect()]
        assert len(got) == 5 and set(got) == want
        assert lookalike.pairs(df).count() == 1
