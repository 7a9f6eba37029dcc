"""Problem 1: text that looks the same but is stored in different characters.

Values are mapped onto one look (width forms, letters of other alphabets,
ligatures, blanks, characters without a shape) and grouped under Spark's
accent-sensitive ``UNICODE`` collation, which also makes composed and
decomposed accents equal. Each class gets one canonical member.

The collated ``GROUP BY`` sorts whole texts by their collation, so it runs only
over texts that can have a look-alike. Those are found with a key that is the
same for all texts of one class (and for some others): the 64-bit hash of the
text without accents, blanks and everything that the mapping may change in
length. Only keys that hold two different stored texts go on.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.session import cut

# Letters of the Cyrillic, Greek, Armenian, Cherokee and Coptic alphabets and signs that look like another letter or sign.
LOOKS = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ԍ": "G", "Һ": "H", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "Ё": "Ë", "ё": "ë", "Ї": "Ï", "ї": "ï", "Ѐ": "È", "ѐ": "è",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Ά": "Á", "Έ": "É", "Ή": "H́", "Ί": "Í", "Ό": "Ó", "Ύ": "Ý", "ό": "ó",
    "Օ": "O", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "Լ": "L",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲭ": "X",
    "µ": "μ", "ɑ": "a", "ɡ": "g", "‐": "-", "‑": "-", "‧": "·", "∙": "·", "⋅": "·", "′": "'", "ʼ": "’", ";": ";", "·": "·",
}
# White space as Unicode defines it, without the control characters that are line ends.
BLANKS = "\t\n\x0b\x0c\r " + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# Tags have no shape but in flags, which they tell apart; Hangul is composed of a varying number of characters.
FLAGS = r"(\x{1F3F4}[\x{E0020}-\x{E007F}]+)|"
TAGS = FLAGS + r"[\x{E0000}-\x{E007F}]+"
LOOSE = FLAGS + r"[\x{1100}-\x{11FF}\x{A960}-\x{A97F}\x{AC00}-\x{D7FB}\x{10000}-\x{1F3F3}\x{1F3F5}-\x{10FFFF}]+"


@cache
def _tables() -> tuple[dict[str, str], dict[str, str], str, str]:
    """Single-character map, map to several characters, characters without a shape, letters of variable length."""
    one, many, hidden = {}, {}, []
    for n in range(0x80, 0x10000):
        ch = chr(n)
        if 0xD800 <= n <= 0xDFFF:
            continue
        kind, _, rest = unicodedata.decomposition(ch).rpartition(">")
        target = "".join(chr(int(x, 16)) for x in rest.split())
        if unicodedata.category(ch) in ("Cf", "Cc") or 0xFE00 <= n <= 0xFE0F or n in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5):
            hidden.append(ch)
        elif ch in BLANKS:
            continue
        elif kind in ("<wide", "<narrow") or (kind == "<compat" and (0xFB00 <= n <= 0xFB17 or 0x2160 <= n <= 0x217F or n in (0x2025, 0x2026, 0x0132, 0x0133, 0x01C7, 0x01C8, 0x01C9, 0x01CA, 0x01CB, 0x01CC))):
            (one if len(target) == 1 else many)[ch] = target
    hidden += [chr(n) for n in (*range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B), *range(0xE0100, 0xE01F0))]
    hidden += [chr(n) for n in range(32) if chr(n) not in BLANKS] + ["\x7f"]
    for ch, target in LOOKS.items():
        (one if len(target) == 1 else many)[ch] = target
    loose = "".join(sorted({x for t in many.values() for x in t if x.isascii()}))
    return one, many, "".join(hidden), loose


@cache
def _coarse() -> tuple[str, str]:
    """Translation to base characters, with all that may vary in length left out at the end of the first string."""
    one, many, hidden, loose = _tables()
    to = {}
    gone = set(hidden) | set(BLANKS) | set(many) | set(loose)
    for n in range(0x80, 0x10000):
        if 0xD800 <= n <= 0xDFFF or 0xAC00 <= n <= 0xD7A3:
            continue
        ch = chr(n)
        if ch in gone:
            continue
        parts = unicodedata.normalize("NFD", one.get(ch, ch))
        base = one.get(parts[0], parts[0])
        if unicodedata.combining(ch) or base in gone:
            gone.add(ch)
        elif base != ch:
            to[ch] = base
    return "".join(to) + "".join(sorted(gone)), "".join(to.values())


def coarse_key(text: Column) -> Column:
    """A hash that all texts with one look share; texts of plain ASCII take a shorter table."""
    source, target = _coarse()
    plain = "".join(x for x in source if x.isascii())
    ascii_only = F.octet_length(text) == F.length(text)
    return F.xxhash64(F.when(ascii_only, F.translate(text, plain, "")).otherwise(F.translate(F.regexp_replace(text, LOOSE, "$1"), source, target)))


def look(text: Column) -> Column:
    """The text in the form to be compared under the ``UNICODE`` collation."""
    one, many, hidden, _ = _tables()
    out = F.translate(text, "".join(one) + hidden, "".join(one.values()))
    for ch, target in many.items():
        out = F.replace(out, F.lit(ch), F.lit(target))
    out = F.regexp_replace(out, TAGS, "$1")
    return F.trim(F.regexp_replace(out, f"[{BLANKS}]+", " "))


BROADCAST = 1 << 20  # keys, at most 24 MB; beyond it they are joined by shuffle


def _keyed(records: DataFrame) -> DataFrame:
    x = records.where(F.col("text").isNotNull()).select("doc_id", "rec", "text", coarse_key(F.col("text")).alias("_key"), F.xxhash64("text").alias("_raw"))
    return x.withColumn("_key", F.xxhash64("doc_id", "_key"))


def _mixed(keyed: DataFrame) -> DataFrame:
    """Keys that hold two different stored texts; only hashes are shuffled."""
    return cut(keyed.groupBy("_key").agg(F.min("_raw").alias("_a"), F.max("_raw").alias("_b")).where("_a <> _b").select("_key"))


def _side(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST else keys


def candidates(records: DataFrame) -> DataFrame:
    """Records whose coarse key holds two different stored texts, with their ``look`` and the hash of the stored text.

    The keys are counted: up to ``BROADCAST`` of them go to the records, beyond
    that the records are shuffled.
    """
    keyed = _keyed(records)
    return _candidates(keyed, _side(_mixed(keyed)))


def _candidates(keyed: DataFrame, mixed: DataFrame) -> DataFrame:
    return cut(keyed.join(mixed, "_key", "left_semi").select("doc_id", "rec", "text", look(F.col("text")).alias("look")).distinct())


def classes(records: DataFrame) -> DataFrame:
    """``doc_id, canonical, n_forms, n_records``: look-alike classes of at least two stored texts.

    ``records`` has ``doc_id, rec, text`` (other columns are left out). Null
    texts take no part; texts without any visible character form one class of
    their own; repeated rows count once. The canonical member is the one whose
    look is smallest in bytes, and of these the smallest stored text.
    """
    return members(records).groupBy("doc_id", "canonical").agg(F.countDistinct("text").alias("n_forms"), F.countDistinct("rec").alias("n_records"))


def members(records: DataFrame) -> DataFrame:
    """``doc_id, rec, text, canonical``: each record of a class of several stored texts, with the canonical member joined back."""
    return _members(candidates(records), "JOIN", "g.canonical")


def _members(found: DataFrame, join: str, value: str) -> DataFrame:
    return found.sparkSession.sql(
        f"""
        WITH c AS (SELECT doc_id, rec, text, look, collate(look, 'UNICODE') AS k FROM {{v}}),
             g AS (SELECT doc_id, k, min_by(text, struct(look, text)) AS canonical FROM c GROUP BY doc_id, k HAVING min(text) <> max(text))
        SELECT c.doc_id, c.rec, c.text, {value} AS canonical FROM c {join} g ON c.doc_id = g.doc_id AND c.k = g.k
        """,
        v=found,
    )


def pairs(records: DataFrame) -> DataFrame:
    """``doc_id, rec_a, rec_b``: records of one book that look the same and are stored differently, ``rec_a < rec_b``.

    Both records' whole texts must differ as stored. The canonical member names
    the class, so the texts themselves aren't compared again.
    """
    m = cut(members(records).select("doc_id", "rec", F.xxhash64("canonical").alias("_c"), F.xxhash64("text").alias("_raw")))
    a = m.select("doc_id", "_c", F.col("rec").alias("rec_a"), F.col("_raw").alias("_ra"))
    b = m.select("doc_id", "_c", F.col("rec").alias("rec_b"), F.col("_raw").alias("_rb"))
    return a.join(b, ["doc_id", "_c"]).where("rec_a < rec_b and _ra <> _rb").select("doc_id", "rec_a", "rec_b").distinct()


def canonical(records: DataFrame) -> DataFrame:
    """Every record with ``canonical``: the canonical member of its class, or its own look where nothing looks like it.

    Records that nothing can look like take no part in the grouping; they are
    only told apart from repeated rows, which shuffles their texts once.
    """
    keyed = _keyed(records)
    mixed = _side(_mixed(keyed))
    alone = keyed.join(mixed, "_key", "left_anti").select("doc_id", "rec", "text").distinct().withColumn("canonical", look(F.col("text")))
    none = records.where("text is null").select("doc_id", "rec", "text").distinct().withColumn("canonical", F.lit(None).cast("string"))
    return _members(_candidates(keyed, mixed), "LEFT JOIN", "coalesce(g.canonical, c.look)").unionByName(alone).unionByName(none)


def book_records(text_region: DataFrame, toc_entry: DataFrame, bookmark_node: DataFrame) -> DataFrame:
    """Region texts and titles of contents entries and bookmarks as ``doc_id, rec, text``."""
    region = text_region.select("doc_id", F.concat(F.lit("text_region:"), F.col("page_index"), F.lit("/"), F.col("revision"), F.lit("/"), F.col("region_id")).alias("rec"), "text")
    toc = toc_entry.select("doc_id", F.concat(F.lit("toc_entry:"), F.col("entry_id")).alias("rec"), F.col("title").alias("text"))
    node = bookmark_node.select("doc_id", F.concat(F.lit("bookmark_node:"), F.col("node_id")).alias("rec"), F.col("title").alias("text"))
    return region.unionByName(toc).unionByName(node)
