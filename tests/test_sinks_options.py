"""Writes that do no harm, strict JSON and options."""

import os

import pytest

from bindery import options
from bindery.sources import sinks, strict


def test_write_copy_refuses_and_compares(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, t string")
    path = str(tmp_path / "out")
    with pytest.raises(sinks.Refused):
        sinks.write_copy(df, path, digest=("aa", "bb"))
    with pytest.raises(sinks.Refused):
        sinks.write_copy(df, path, source=path)
    sinks.write_copy(df, path, source=str(tmp_path / "in"), digest=("aa", "aa"))
    assert sorted(os.listdir(tmp_path)) == ["out"] and spark.read.parquet(path).count() == 3
    with pytest.raises(sinks.Refused):
        sinks.write_copy(df.limit(1), path)
    assert spark.read.parquet(path).count() == 3
    assert sinks.compared(df, df.distinct()) == (3, 2, 1, 0) and sinks.compared(df.limit(0), df) == (0, 3, 0, 3)


def test_outputs_and_plan_files(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    sinks.check_outputs(spark, [a], [b, "-"])
    for outputs in ([a], [b, b], ["-", "-"]):
        with pytest.raises(sinks.Refused):
            sinks.check_outputs(spark, [a], outputs)
    (tmp_path / "b").write_text("{}\n")
    with pytest.raises(sinks.Refused):
        sinks.check_outputs(spark, [a], [b])
    sinks.check_outputs(spark, [a], [b], force=True)
    assert sinks.read_plan(spark, b, a).first().text == "{}\n"
    for kw in ({"output": b}, {"most": 1}):
        with pytest.raises(sinks.Refused):
            sinks.read_plan(spark, b, **kw)


@pytest.mark.parametrize(
    "text, fault",
    [
        ('{"a": [1, -0.5e3, "x\\u00e9\\ud83d\\ude00", null, true]}', None), ("0", None), ("-0", None), ('"01 {[ \\\\ud800"', None), ("[" * 128 + "]" * 128, None),
        ('{"a":1,"a":2}', "duplicate"), ('{"a":{"b":1,"b":1}}', "duplicate"), ("[01]", "number"), ("-012", "number"), ("[1] x", "trailing"), ("[1", "end"), ("", "end"), ("[1,]", "syntax"), ("[NaN]", "syntax"),
        ('"\\ud800"', "surrogate"), ('"\\udc00\\ud800"', "surrogate"), ("[" * 129 + "]" * 129, "depth"),
    ],
)
def test_strict_json(text, fault):
    assert strict.check(text)[0] == fault


def test_fault_position_in_bytes():
    assert strict.check('"é" x') == ("trailing", 4)


def test_options():
    assert options.Options.of('{"search": {"first_pages": 10}, "plan": {"title_style": "chapter"}}').search.first_pages == 10
    for text in ('{"serch": {}}', '{"search": {"first_pages": "10"}}', '{"search": {"first_pages": true}}', '{"search": {"first_pages": 0}}', '{"mapping": {"footer_band": 1.5}}', '{"plan": {"title_style": "x"}}', '{"raster": {"dpi": 1e400}}', "[]", '{"plan": {}, "plan": {}}'):
        with pytest.raises(options.Invalid):
            options.Options.of(text)
