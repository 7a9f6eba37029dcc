"""Problems 1, 3 and 4 on small fixtures."""

import itertools
import random
import time

import pytest

from bindery.llm import boilerplate, lookalike, mojibake
from bindery.session import written

REC = "doc_id string, rec string, text string"


def pairs(spark, rows):
    return {tuple(r) for r in lookalike.pairs(spark.createDataFrame(rows, REC)).collect()}


def test_looks_the_same(spark):
    same = ["The fine café K 5 Å", "Тhe ﬁne café  K 5 Å", "﻿The fine c​afé\nK 5 Å ", "Ｔhe fine café K 5 Å"]
    rows = [("d", f"r{i}", t) for i, t in enumerate(same)]
    assert len(pairs(spark, rows)) == 6


def test_looks_different(spark):
    other = ["x² y", "x2 y", "X2 y", "x2 ý", "x2-y", "x2—y", "x2y", "Сталь", "сталь", "и", "й"]
    assert pairs(spark, [("d", f"r{i}", t) for i, t in enumerate(other)]) == set()


def test_books_rows_nulls_and_blanks(spark):
    rows = [("d", "a", "one"), ("e", "b", "οne"), ("d", "c", "one"), ("d", "n", None), ("d", "a", "one"), ("d", "z", ""), ("d", "y", " ​")]
    assert pairs(spark, rows) == {("d", "y", "z")}
    assert pairs(spark, []) == set()
    long = "word " * 40_000
    assert pairs(spark, [("d", "a", long), ("d", "b", long.replace("w", "ｗ"))]) == {("d", "a", "b")}


def test_canonical_member(spark):
    df = spark.createDataFrame([("d", "a", "ﬁx"), ("d", "b", "fix"), ("d", "c", "other  text")], REC)
    got = {r.rec: r.canonical for r in lookalike.canonical(df).collect()}
    assert got == {"a": "fix", "b": "fix", "c": "other text"}


REGION = "site string, doc_id string, page_index int, revision bigint, region_id int, text string, _h int"
OWN = ["lanterns", "quarry gates", "moors and bridges", "signal lamps by night", "an early ferry timetable"]
KEY = ["doc_id", "page_index", "revision", "region_id"]


def regions(spark, texts):
    return spark.createDataFrame([(s, d, 0, 1, i, t, 7) for s, d, i, t in texts], REGION)


def found(df):
    return {(r.doc_id, r.region_id, r.line_no) for r in boilerplate.repeated_lines(df, "text", KEY, "site", "doc_id").collect()}


def test_repeated_lines(spark):
    line = "Licensed to subscribers of Some Library; page {}"
    noisy = ["Licensed to subscribers of Some Library; page 7", "LICENSED TO SUBSCRIBERS OF SOME LIBRARY; PAGE 8", "Licensed to subscribrs of Some Lbrary, page 9", "Lіcensed to subscribers of Some Library - page 10", "Licensed to subscribers of Some Library page"]
    rows = [("s", f"d{i}", i, f"{OWN[i]} are the words of one document alone\n{t}") for i, t in enumerate(noisy)]
    rows += [("s", "d0", 90, "page 17"), ("s", "d0", 91, None), ("s", "d0", 92, ""), ("t", "x", 93, line.format(1))]
    rows += [("s", f"d{i}", 100 + i, "Printed in four books of this site only") for i in range(4)] + [("s", "d0", 110 + i, "Printed in four books of this site only") for i in range(9)]
    rows += rows[:3]
    df = regions(spark, rows)
    assert found(df) == {(f"d{i}", i, 1) for i in range(5)}
    clean = {(r.doc_id, r.region_id): r.text for r in boilerplate.without_lines(df, "text", KEY, boilerplate.repeated_lines(df, "text", KEY, "site", "doc_id")).collect()}
    assert clean["d2", 2] == "moors and bridges are the words of one document alone" and clean["d0", 91] is None and clean["d0", 92] == ""
    assert found(regions(spark, [])) == set()


def dist(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def all_pairs(rows, min_docs=5):
    """Lines near a form in whose neighbourhood enough documents stand, by comparing all forms with all."""
    form = {(s, d, i, n): f for s, d, i, t in rows for n, x in enumerate(t.split("\n")) if len(f := "".join(c for c in x.lower() if c.isalpha())) >= 15}
    near = {k: [j for j, g in form.items() if j[0] == k[0] and dist(f, g) <= 2] for k, f in form.items()}
    centres = [k for k, js in near.items() if len({j[1] for j in js}) >= min_docs]
    return {j[1:] for k in centres for j in near[k]}


def noisy_rows(seed, sizes, letters=None):
    r = random.Random(seed)
    bases = ["quiet archives lend their maps to anyone", "please return the lantern before the thaw", "the harbour office keeps a copy of this", "another sentence that is long enough here", "a short line, this one"]
    rows = []
    for b, (base, size) in enumerate(zip(bases, sizes)):
        for d in range(size):
            t = list(base)
            for _ in range(r.choice([0, 0, 0, 1, 2] if letters is None else letters)):
                k = r.randrange(len(t))
                t[k : k + 1] = r.choice(["", "q", t[k] + "z"])
            rows.append((r.choice("ssst"), f"d{d}", b * 100 + d, "".join(t)))
    return rows


@pytest.mark.parametrize("seed, sizes, letters", [(5, [4, 5, 6, 7, 8], None), (6, [14, 6, 9, 5, 12], [1, 2, 2]), (7, [30, 9, 5, 8, 20], [0, 1, 1, 2, 3])])
def test_repeated_lines_against_all_pairs(spark, seed, sizes, letters):
    rows = noisy_rows(seed, sizes, letters)
    want = all_pairs(rows)
    assert want and found(regions(spark, rows)) == want


def test_repeated_lines_without_exact_copies(spark):
    base = "please return the lantern before the thaw"
    one_wrong = [("s", f"d{i}", i, base[:k] + "q" + base[k + 1 :]) for i, k in enumerate([0, 1, 4, 9, 19, 27, 33, 40])]
    assert len(found(regions(spark, one_wrong))) == 8
    a, b, c = "quiet archives lend their maps to anyone", "quxet archives lend their mxps to anyone", "quxxt archives lend their mxxs to anyone"
    chain = [("s", f"d{i}", i, a) for i in range(10)] + [("s", f"d{20 + i}", 20 + i, b) for i in range(6)] + [("s", "d40", 40, c)]
    assert len(found(regions(spark, chain))) == 17 and found(regions(spark, chain)) == all_pairs(chain)


@pytest.mark.parametrize("hot", [2, 5])
def test_hot_parts_are_divided_again(spark, hot):
    rows = [("s", f"d{d}", d, x) for d, x in enumerate(f"this page was last changed by {a}{b}" for a in ("karlin", "kqrlin", "morten", "olgaas", "pxterb") for b in ("ab", "ac", "zzz", "ypsil"))]
    rows += noisy_rows(8, [9, 9, 9, 9, 9], [1, 2])
    with written(boilerplate.lines(regions(spark, rows), "text", KEY, "site", "doc_id")) as at:
        ids = boilerplate.repeated(at, 5, hot)
        got = {(r.doc_id, r.region_id, r.line_no) for r in at.join(ids, "_h", "left_semi").collect()}
    assert got == all_pairs(rows)


def test_ids_of_near_forms_differ_in_few_signs(spark):
    rows = noisy_rows(9, [12, 12, 12, 12, 12], [2])
    at = boilerplate.lines(regions(spark, rows), "text", KEY, "site", "doc_id").select("_s", "_f", "_h").distinct().collect()
    assert len({r._h for r in at}) == len(at)
    for x in at:
        for y in at:
            if x._s == y._s and dist(x._f, y._f) <= 2:
                assert (((x._h ^ y._h) & (2**64 - 1)) >> 24).bit_count() <= 8


@pytest.mark.parametrize("size", [0, 1, 2])
def test_ids_are_joined_either_way(spark, size, monkeypatch):
    monkeypatch.setattr(boilerplate, "BROADCAST", size)
    rows = noisy_rows(5, [4, 5, 6, 7, 8])
    assert found(regions(spark, rows)) == all_pairs(rows)


ROWS = "k int, text string, restored int"


@pytest.fixture(scope="module")
def model(spark):
    words = "la forêt répète l'été près du château à l'hôtel où la clé gêne le métier – der Wärter schließt das östliche Tor über die Brücke · Тихий архив хранит большой город и старый мост".split()
    return mojibake.Model({w: 200 for w in words if not w.isascii()} | {w.strip("–·"): 200 for w in ["señal", "año", "canção", "não", "°C", "m²", "—", "…"]})


@pytest.mark.parametrize("text", ["la forêt répète l'été", "der Wärter schließt das Tor über", "Тихий архив хранит город", "la clé gêne"])
@pytest.mark.parametrize("written, read", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("cp1252", "mac-roman"), ("cp1251", "cp866"), ("koi8-r", "cp1251")])
def test_round_trip(model, text, written, read):
    try:
        raw = text.encode(written)
    except UnicodeEncodeError:
        pytest.skip("not in this encoding")
    if read == "cp1252":
        garbled = "".join(mojibake._chars_of("cp1252")[b] if b > 127 else chr(b) for b in raw)
    else:
        garbled = raw.decode(read)
    assert model.restore(garbled) == text


def test_right_text_stays(model):
    for text in ["la forêt répète", "Тихий архив", "5 °C – m² —", "plain words", "", "nеw Тitlе", "Ｆｕｌｌ width", "of\xa0STU\xadDY", "ÉTÉ À L'HÔTEL"]:
        assert model.restore(text) is None


def test_lost_and_twice(model):
    assert model.restore("la for�t r�p�te") == "la forêt répète"
    twice = "répète".encode().decode("latin-1").encode().decode("latin-1")
    assert model.restore(twice) == "répète"


def test_tables(spark):
    texts = ["la forêt répète l'été", "près du château"] * 30 + ["la forÃªt rÃ©pÃ¨te"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(900, None, 0), (901, "", 0), (60, texts[60], 1)], ROWS)
    got = [(r.k, r.restored) for r in mojibake.restored(df, "text", ["k"], mojibake.model(df, "text")).collect()]
    assert got == [(60, "la forêt répète")]
    none = spark.createDataFrame([], ROWS)
    assert mojibake.restored(none, "text", ["k"], mojibake.model(none, "text")).count() == 0


def test_long_damaged_runs_take_no_time(model):
    strict = lambda t: t.encode().decode("cp1252", "replace")
    began = time.time()
    for n in (4, 8, 12, 200):
        assert model.restore(strict("с" * n)) is not None
    assert time.time() - began < 2
    assert model.restore(strict("Тихий архив хранит большой город и старый мост")) == "Тихий архив хранит большой город и старый мост"


def test_lattice_against_all_strings():
    """Every way through a lattice of lost bytes, against decoding all strings of bytes."""
    for run in ("Ñ�Ñ€", "â��", "Ñ�Ð°Ñ�Ñ�", "�", "Ã©�"):
        sets = [mojibake._holes("cp1252") if ch == mojibake.LOST else (mojibake._bytes_of("cp1252")[ch],) for ch in run]
        want = set()
        for raw in itertools.product(*sets):
            try:
                want.add(bytes(raw).decode())
            except UnicodeDecodeError:
                continue
        lattice = mojibake._damaged(run, "utf-8", "cp1252")
        ways = {0: {""}}
        for i, here in enumerate(lattice or []):
            for q, ch in here:
                ways.setdefault(q, set()).update(w + ch for w in ways.get(i, ()))
        assert ways.get(len(run), set()) == want


def test_best_way_against_all_ways(model):
    lattice = [[(1, ch) for ch in "éèêа"], [(2, "t"), (2, "c")], [(3, ch) for ch in "éàа"]]
    every = ["r" + "".join(x) for x in itertools.product("éèêа", "tc", "éàа")]
    pairs = max(every, key=model.chars)
    assert model.chars(max(model.best(["r"], [lattice]), key=model.chars)) == pytest.approx(model.chars(pairs))


def test_capitals_of_one_alphabet_read_in_another_code(model):
    for text in ("ТИХИЙ АРХИВ ХРАНИТ ГОРОД", "СТАРЫЙ МОСТ"):
        assert model.restore(text.encode("koi8-r").decode("cp1251")) == text


def test_lost_bytes_of_one_byte_codes(model):
    assert model.restore("über".encode("cp437").decode("cp1252", "replace")) == "über"


def test_letters_read_as_non_breaking_spaces(model):
    for text in ("Стеклянный завод и Медная крыша", "Вторая башня"):
        bigger = mojibake.Model({w: 200 for w in "Стеклянный завод Медная крыша Вторая башня Тихий архив хранит большой город".split()})
        assert bigger.restore(text.encode("cp1251").decode("cp866")) == text
