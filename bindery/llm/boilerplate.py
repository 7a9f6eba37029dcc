"""Problem 3: lines repeated across the documents of one source.

A line's form is its letters: small, without accents, look-alikes mapped,
nothing else. Forms of one source are the same if at most two edits lie between
them. A form is a centre if the forms within two edits of it, itself among
them, stand in enough documents; the lines within two edits of a centre are
the repeated ones.

Forms that stand in enough documents themselves (strong ones) come first: what
is near them is settled without counting. Of the others documents are counted
by neighbourhood, each of them standing in a few documents only.

Near forms meet by hashed parts. With two edits a form keeps its first m
letters, or its last m, or one edit lies in each of these and what is between
them is whole, shifted by one letter at most. So each form has four parts: the
first, the last, the one after the first, and that one letter further on. m is
a third of the letters, on a grid; forms whose length is just above a step
have the parts of the step below too. Parts that only one form has are dropped
after a count that is added up before the shuffle; those that more than ``HOT``
forms share are divided again by the same four parts of the remaining letters,
so that no part brings more than ``HOT`` forms together.

The id of a form is a hash whose upper 40 bits are the parities of its pairs of
letters, mixed with its source. An edit turns four of them at most, so ids that
differ in more than eight aren't near and their texts needn't be fetched.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from bindery.llm.lookalike import LOOKS
from bindery.session import cut, written

EDITS = 2
HOT = 1000
LEAST = 5  # a rest of fewer letters isn't divided further
BROADCAST = 1 << 20  # ids, at most 24 MB; beyond it they are joined by shuffle
SIGNS = 40
# Ligatures of several letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


@cache
def _letters() -> tuple[str, str]:
    """Translation to small base letters; what isn't a letter comes last and is left out, but for the line feed."""
    small = {ch.lower(): look.lower() for ch, look in LOOKS.items() if unicodedata.category(ch) == "Lu"}
    to, gone = {}, []
    ranges = [*range(0, 0x590), *range(0x1E00, 0x2300), *range(0x2500, 0x2600), *range(0x3000, 0x3001), *range(0xFE00, 0x10000)]
    for n in ranges:
        ch = chr(n)
        if ch in LIGATURES or ch == "\n":
            continue
        parts = unicodedata.normalize("NFKD", LOOKS.get(ch, ch)).lower()
        base = next((x for x in parts if unicodedata.category(x)[0] == "L"), "")
        base = small.get(base, LOOKS.get(base, base)).lower()
        base = unicodedata.normalize("NFD", base)[:1]
        if not base:
            gone.append(ch)
        elif base != ch:
            to[ch] = base
    return "".join(to) + "".join(gone), "".join(to.values())


def letters(text: Column) -> Column:
    """The letters of a text in one form, line by line; see the module."""
    plain = text
    for ch, target in LIGATURES.items():
        plain = F.replace(plain, F.lit(ch), F.lit(target))
    source, target = _letters()
    wide = F.regexp_replace(F.translate(F.when(text.rlike("[ﬀ-ﬆ]"), plain).otherwise(text), source, target), r"[^\p{L}\n]+", "")
    return F.when(F.octet_length(text) == F.length(text), F.regexp_replace(F.lower(text), r"[^a-z\n]+", "")).otherwise(wide)


@F.pandas_udf(LongType())
def _signs(forms: pd.Series) -> pd.Series:
    """Parities of the pairs of letters, by a hash of the pair onto ``SIGNS`` bits."""
    n = forms.str.len().to_numpy(np.int64)
    if not len(n):
        return pd.Series([], dtype="int64")
    code = np.frombuffer("".join(forms).encode("utf-32-le"), np.uint32).astype(np.uint64)
    x = code[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    bits = np.zeros(len(code), np.uint64)
    bits[:-1] = np.uint64(1) << ((x >> np.uint64(32)) * np.uint64(SIGNS) >> np.uint64(32))
    ends = np.cumsum(n)
    bits[ends - 1] = 0  # a pair across two forms
    return pd.Series(np.bitwise_xor.reduceat(bits, ends - n).astype(np.int64))


def lines(df: DataFrame, text: str, keys: list[str], source: str, doc: str, min_letters: int = 15) -> DataFrame:
    """``keys, line_no``, ``_s`` (source), ``_f`` (form), ``_h`` (id of both), ``_d`` (hash of the document) of each long enough line."""
    at = df.where(F.col(text).isNotNull() & (F.octet_length(text) >= min_letters)).select(*keys, F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_s"), F.xxhash64(doc).alias("_d"), F.posexplode(F.split(letters(F.col(text)), "\n")).alias("line_no", "_f"))
    at = at.where(F.length("_f") >= min_letters)
    low = F.lit((1 << (64 - SIGNS)) - 1)
    site = F.xxhash64("_s").bitwiseAND(F.bitwise_not(low))
    id_ = F.shiftleft(_signs("_f"), 64 - SIGNS).bitwiseXOR(site).bitwiseOR(F.xxhash64("_s", "_f").bitwiseAND(low))
    return at.select(*keys, "line_no", "_s", "_f", id_.alias("_h"), "_d")


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids``, which is counted: broadcast up to ``BROADCAST`` rows, shuffled beyond."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, key, "left_semi")


def _size(n: Column) -> Column:
    """Letters of a part of a form of ``n``: a third of it on a grid with steps of one, then of a quarter."""
    x = F.floor((n - EDITS) / 3)
    grid = F.floor(F.pow(F.lit(1.25), F.floor(F.log(x.cast("double")) / F.log(F.lit(1.25)))))
    return F.when(x < 10, x).otherwise(F.greatest(F.lit(9), F.least(grid, x))).cast("int")


def _parts(above: Column, f: Column, n: Column, m: Column, rest: bool) -> Column:
    """The four parts of ``f``, hashed below ``above``, each with what remains of the form if ``rest`` is asked for."""
    sub = lambda at, k: F.substring(f, at + 1, k)
    one = F.lit(1)
    rows = [
        (0, sub(F.lit(0), m), lambda: sub(m, n)),
        (1, sub(n - m, m), lambda: sub(F.lit(0), n - m)),
        (2, sub(m, m), lambda: F.concat(sub(F.lit(0), m), sub(2 * m, n))),
        (2, sub(m + one, m), lambda: F.concat(sub(F.lit(0), m + one), sub(2 * m + one, n))),
    ]
    return F.array(*[F.struct(F.xxhash64(above, m, F.lit(kind), part).alias("_k"), *([left().alias("_r")] if rest else [])) for kind, part, left in rows])


def _keyed(work: DataFrame, rest: bool) -> DataFrame:
    """``_h, _open, _k`` and, if asked for, ``_r``: the parts of ``_r`` below ``_k``."""
    n = F.length("_r")
    x = work.where(n >= LEAST).withColumn("_n", n).withColumn("_m", _size(n)).withColumn("_m2", _size(n - EDITS))
    both = F.concat(_parts(F.col("_k"), F.col("_r"), F.col("_n"), F.col("_m"), rest), F.when((F.col("_m2") != F.col("_m")) & (F.col("_m2") > 0), _parts(F.col("_k"), F.col("_r"), F.col("_n"), F.col("_m2"), rest)).otherwise(F.array()))
    x = x.select("_h", "_open", F.explode(both).alias("_x"))
    return x.select("_h", "_open", "_x.*")


def _apart() -> Column:
    return F.bit_count(F.shiftrightunsigned(F.col("_a").bitwiseXOR(F.col("_b")), 64 - SIGNS))


def candidates(forms: DataFrame, hot: int = HOT) -> DataFrame:
    """``_a, _b``: ids of forms that share a part and may be near; at least one of them ``_open``.

    ``forms`` has ``_h, _s, _f, _open``. Cut; no part brings more than ``hot``
    forms together, unless fewer than ``LEAST`` letters are left to divide them.
    """
    work = forms.select("_h", "_open", F.xxhash64("_s").alias("_k"), F.col("_f").alias("_r"))
    out = None
    while True:
        rows = _keyed(work, False)
        shared = rows.groupBy("_k").agg(F.count("*").alias("_n"), F.max("_open").alias("_o")).where("_n > 1 and _o").select("_k", "_n")
        shared = cut(shared)
        hots = shared.where(F.col("_n") > hot).select("_k")
        more = not hots.isEmpty()
        met = only(rows, shared.where(F.col("_n") <= hot).select("_k") if more else shared.select("_k"), "_k").groupBy("_k").agg(F.array_sort(F.collect_set(F.struct("_h", "_open"))).alias("_g"))
        near = "bit_count(shiftrightunsigned(a._h ^ b._h, {0})) <= {1} and (a._open or b._open) and a._h <> b._h".format(64 - SIGNS, 4 * EDITS)
        pairs = met.select(F.explode(F.expr(f"flatten(transform(_g, (a, i) -> transform(filter(slice(_g, i + 2, size(_g)), b -> {near}), b -> struct(a._h as _a, b._h as _b))))")).alias("_p")).select("_p._a", "_p._b")
        pairs = cut(pairs.distinct())
        out = pairs if out is None else out.unionByName(pairs)
        if not more:
            return out.distinct()
        work = cut(only(_keyed(work, True), cut(hots), "_k"))
        # what can't be divided further is compared as it is
        short = work.where(F.length("_r") < LEAST).select("_h", "_open", "_k").distinct()
        a, b = short.select("_k", F.col("_h").alias("_a"), F.col("_open").alias("_oa")), short.select("_k", F.col("_h").alias("_b"), F.col("_open").alias("_ob"))
        out = out.unionByName(cut(a.join(b, "_k").where(F.expr("_a < _b and (_oa or _ob)") & (_apart() <= 4 * EDITS)).select("_a", "_b").distinct()))


def _near(f: str, g: str) -> Column:
    return (F.abs(F.length(f) - F.length(g)) <= EDITS) & (F.expr(f"levenshtein({f}, {g}, {EDITS})") >= 0)


def _verified(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """Those of ``_a, _b`` whose forms are within ``EDITS`` edits and of one source; cut."""
    ids = cut(pairs.select(F.col("_a").alias("_h")).unionByName(pairs.select(F.col("_b").alias("_h"))).distinct())
    texts = cut(only(forms.select("_h", "_s", "_f"), ids, "_h"))
    x = pairs.join(texts.select(F.col("_h").alias("_a"), F.col("_s").alias("_t"), F.col("_f").alias("_g")), "_a").join(texts.withColumnRenamed("_h", "_b"), "_b")
    return cut(x.where((F.col("_s") == F.col("_t")) & _near("_f", "_g")).select("_a", "_b"))


def near_strong(forms: DataFrame, strong: DataFrame) -> DataFrame:
    """``_h`` of the forms within ``EDITS`` edits of a strong one; ``strong`` has ``_h, _s, _f`` and is cut."""
    row = lambda x: x.select("_h", F.lit(True).alias("_open"), F.xxhash64("_s").alias("_k"), F.col("_f").alias("_r"))
    stored = cut(_keyed(row(strong), False).select("_k", F.col("_h").alias("_b")).distinct())
    probes = _keyed(row(forms), False).select("_k", F.col("_h").alias("_a"))
    side = F.broadcast(stored) if stored.count() <= BROADCAST else stored
    pairs = cut(probes.join(side, "_k").where((F.col("_a") != F.col("_b")) & (_apart() <= 4 * EDITS)).select("_a", "_b").distinct())
    return _verified(pairs, forms).select(F.col("_a").alias("_h")).distinct()


def repeated(at: DataFrame, min_docs: int, hot: int = HOT) -> DataFrame:
    """``_h`` of the repeated forms among ``at``, the rows of ``lines``."""
    grouped = at.groupBy("_h").agg(F.first("_s").alias("_s"), F.first("_f").alias("_f"), F.min("_d").alias("_d"), F.max("_d").alias("_e"))
    with written(grouped) as forms:
        many = cut(forms.where("_d <> _e").select("_h"))
        docs = cut(only(at, many, "_h").select("_h", "_d").distinct())
        count = docs.groupBy("_h").agg(F.count("*").alias("_n"))
        strong_ids = cut(count.where(F.col("_n") >= min_docs).select("_h"))
        strong = cut(only(forms.select("_h", "_s", "_f"), strong_ids, "_h"))
        settled = cut(strong_ids.unionByName(near_strong(forms, strong)).distinct())
        weak = forms.join(F.broadcast(strong_ids) if strong_ids.count() <= BROADCAST else strong_ids, "_h", "left_anti")
        open_ = weak.join((F.broadcast(settled) if settled.count() <= BROADCAST else settled).withColumn("_done", F.lit(True)), "_h", "left").withColumn("_open", F.col("_done").isNull())
        near = _verified(candidates(open_.select("_h", "_s", "_f", "_open"), hot), forms)
        both = cut(near.unionByName(near.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))))
        # a form that isn't strong stands in fewer than min_docs documents, so this adds few rows for each pair
        ids = cut(both.select(F.col("_a").alias("_h")).distinct())
        of = only(forms.where("_d = _e").select("_h", "_d"), ids, "_h").unionByName(docs.join(ids, "_h", "left_semi"))
        of = cut(of.select(F.col("_h").alias("_b"), "_d"))
        around = both.join(of, "_b").select("_a", "_d").unionByName(of.select(F.col("_b").alias("_a"), "_d"))
        centres = around.groupBy("_a", "_d").agg(F.lit(1).alias("_1")).groupBy("_a").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_docs).select(F.col("_a").alias("_h"))
        centres = cut(centres.unionByName(settled).distinct())
        beside = both.join(centres.withColumnRenamed("_h", "_a"), "_a", "left_semi").select(F.col("_b").alias("_h"))
        return cut(centres.unionByName(beside).distinct())


def repeated_lines(df: DataFrame, text: str, keys: list[str], source: str, doc: str, min_docs: int = 5, min_letters: int = 15) -> DataFrame:
    """``keys, line_no`` of each line that stands in at least ``min_docs`` documents of its source.

    Null texts take no part, an empty table gives an empty result, repeated
    rows count once. A null source counts as a source of its own. ``line_no``
    counts the pieces between line feeds from 0. Whole texts aren't shuffled:
    each form is once, and only those whose ids and parts agree are compared.
    """
    with written(lines(df, text, keys, source, doc, min_letters)) as at:
        return cut(only(at, repeated(at, min_docs), "_h").select(*keys, "line_no").distinct())


def without_lines(df: DataFrame, text: str, keys: list[str], found: DataFrame) -> DataFrame:
    """``keys, text``: each text without the lines in ``found``; a null text stays null, a text of such lines only becomes empty."""
    gone = found.groupBy(*keys).agg(F.collect_set("line_no").alias("_gone"))
    base = df.select(*keys, text).distinct()
    x = base.join(gone, keys, "left")
    kept = F.filter(F.split(F.col(text), "\n"), lambda line, i: ~F.array_contains(F.col("_gone"), i))
    return x.select(*keys, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text))
