"""Scalar text functions over the corpus, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.functions import text as T
from bindery.plans import query
from bindery.session import read
from bindery.sources.corpus import SQL_SPACES

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TRIM = "trim({}, " + SQL_SPACES + ")"
KEY = "trim(regexp_replace(" + LOW + r", '[\x00-/:-`{{-\x7F]+', ' ', 'g'), ' ')"
TOC = "SELECT DISTINCT doc_id, entry_id, title, ord, literal, numbering, ordinal, range_end, prefix FROM toc_entry"
ROMAN_OK = r"regexp_matches({0}, '^[IVXLCDMivxlcdm]{{1,15}}$') AND regexp_matches(upper({0}), '^M{{0,3}}(CM|CD|D?C{{0,3}})(XC|XL|L?X{{0,3}})(IX|IV|V?I{{0,3}})$')"
ROMAN_VALUE = """list_sum(list_transform(range(1, length({0}) + 1), lambda i: (
  CASE WHEN strpos('IVXLCDM', substr(upper({0}), CAST(i AS INTEGER), 1)) < strpos('IVXLCDM', coalesce(nullif(substr(upper({0}), CAST(i + 1 AS INTEGER), 1), ''), 'I')) AND i < length({0}) THEN -1 ELSE 1 END)
  * [1, 5, 10, 50, 100, 500, 1000][strpos('IVXLCDM', substr(upper({0}), CAST(i AS INTEGER), 1))]))"""


def toc(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "toc_entry").select("doc_id", "entry_id", "title", "ord", "literal", "numbering", "ordinal", "range_end", "prefix").distinct()


@query(
    f"""SELECT doc_id, entry_id, trim(regexp_replace({LOW.format("title")}, '[ \t\n\r\f\v]+', ' ', 'g'), {SQL_SPACES}) AS heading_key, {KEY.format("title")} AS title_key,
  replace({KEY.format("title")}, ' ', '') AS compact,
  array_to_string(list_transform(string_split({KEY.format("replace(title, chr(173), '')")}, ' '), lambda w: CASE WHEN regexp_matches(w, '[0-9]') OR strlen(w) = 1 THEN translate(w, 'ilo', '110') ELSE w END), ' ') AS loose_key
  FROM ({TOC}) WHERE title IS NOT NULL"""
)
def title_keys(spark: SparkSession, d: str) -> DataFrame:
    x, t = toc(spark, d).where("title is not null"), F.col("title")
    return x.select("doc_id", "entry_id", T.heading_key(t).alias("heading_key"), T.key(t).alias("title_key"), T.compact(t).alias("compact"), T.loose_key(t).alias("loose_key"))


@query(
    f"""SELECT doc_id, entry_id, node_id, CASE WHEN abs(strlen(a) - strlen(b)) > 8 OR levenshtein(a, b) > 8 THEN -1 ELSE levenshtein(a, b) END AS distance
  FROM (SELECT DISTINCT t.doc_id, entry_id, node_id, {KEY.format("t.title")} AS a, {KEY.format("n.title")} AS b
    FROM toc_entry t JOIN bookmark_node n ON n.doc_id = t.doc_id AND n.ord = t.ord WHERE t.title IS NOT NULL AND n.title IS NOT NULL)"""
)
def title_distance(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "bookmark_node").select("doc_id", "ord", "node_id", T.key(F.col("title")).alias("b")).where("b is not null")
    x = toc(spark, d).select("doc_id", "ord", "entry_id", T.key(F.col("title")).alias("a")).where("a is not null").join(n, ["doc_id", "ord"])
    return x.select("doc_id", "entry_id", "node_id", T.byte_distance(F.col("a"), F.col("b"), 8).cast("long").alias("distance")).distinct()


@query(
    f"""SELECT doc_id, entry_id, literal,
  CASE WHEN regexp_matches(v, '^[0-9]{{1,8}}$') THEN 'decimal' WHEN regexp_matches(v, '^[A-Za-z]{{1,3}}-[0-9]{{1,8}}$') THEN 'prefixed_decimal' WHEN v <> '' AND {ROMAN_OK.format("v")} THEN 'roman' END AS kind,
  CAST(CASE WHEN regexp_matches(v, '^[0-9]{{1,8}}$') THEN CAST(v AS INTEGER) WHEN regexp_matches(v, '^[A-Za-z]{{1,3}}-[0-9]{{1,8}}$') THEN CAST(regexp_extract(v, '-([0-9]+)$', 1) AS INTEGER)
    WHEN v <> '' AND {ROMAN_OK.format("v")} THEN {ROMAN_VALUE.format("v")} END AS INTEGER) AS value
  FROM (SELECT *, {TRIM.format("literal")} AS v FROM ({TOC}) WHERE literal IS NOT NULL)"""
)
def page_tokens(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("literal")
    return toc(spark, d).where("literal is not null").select("doc_id", "entry_id", "literal", T.token_kind(v).alias("kind"), T.token_ordinal(v).alias("value"))


@query(
    f"""SELECT doc_id, page_index, lo AS roman, CAST({ROMAN_VALUE.format("lo")} AS INTEGER) AS back FROM (
  SELECT DISTINCT doc_id, page_index, array_to_string([['', 'm', 'mm', 'mmm'][n // 1000 + 1], ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][n // 100 % 10 + 1],
    ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1], ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1]], '') AS lo
  FROM (SELECT doc_id, page_index, page_index + 1 AS n FROM page WHERE page_index < 3999))"""
)
def int_to_roman(spark: SparkSession, d: str) -> DataFrame:
    r = F.lower(T.to_roman(F.col("page_index") + 1))
    return read(spark, d, "page").where("page_index < 3999").select("doc_id", "page_index").distinct().select("doc_id", "page_index", r.alias("roman"), T.roman_value(r).alias("back"))


@query(
    f"""SELECT doc_id, entry_id, a, b, CAST(CAST(a AS INTEGER) AS INTEGER) AS first, CAST(CAST(b AS INTEGER) AS INTEGER) AS last, CAST(a AS INTEGER) > CAST(b AS INTEGER) AS uncertain FROM (
  SELECT doc_id, entry_id, regexp_extract(v, '^([0-9]{{1,8}})(-|–)([0-9]{{1,8}})$', 1) AS a, regexp_extract(v, '^([0-9]{{1,8}})(-|–)([0-9]{{1,8}})$', 3) AS b
  FROM (SELECT doc_id, entry_id, CASE WHEN ordinal % 3 = 0 THEN ordinal || '-' || (ordinal + ord - 5) WHEN ordinal % 3 = 1 THEN ordinal || '–' || (ordinal + ord % 7) ELSE literal END AS v FROM ({TOC}) WHERE ordinal IS NOT NULL)) WHERE a <> ''"""
)
def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    n, o = F.col("ordinal"), F.col("ord")
    v = F.when(n % 3 == 0, F.concat(n.cast("string"), F.lit("-"), (n + o - 5).cast("string"))).when(n % 3 == 1, F.concat(n.cast("string"), F.lit("–"), (n + o % 7).cast("string"))).otherwise(F.col("literal"))
    pattern = "^([0-9]{1,8})[-–]([0-9]{1,8})$"
    x = toc(spark, d).where("ordinal is not null").select("doc_id", "entry_id", F.regexp_extract(v, pattern, 1).alias("a"), F.regexp_extract(v, pattern, 2).alias("b")).where("a <> ''")
    a, b = F.col("a").cast("int"), F.col("b").cast("int")
    return x.select("doc_id", "entry_id", "a", "b", a.alias("first"), b.alias("last"), (a > b).alias("uncertain"))


LINES = "SELECT DISTINCT doc_id, page_index, revision, line_no, text FROM text_line WHERE text IS NOT NULL"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "text_line").where("text is not null").select("doc_id", "page_index", "revision", "line_no", "text").distinct()


LINE = ["doc_id", "page_index", "revision", "line_no"]
DOTS = r"'(\.[ \t\n\r\f\v]*){3,}$'"


@query(
    f"""SELECT doc_id, page_index, revision, line_no, title, token, kind, leader FROM (
  SELECT *, trim(regexp_replace(trim(regexp_extract(v, '(?s)^(.*[ \t\n\r\f\v])([^ \t\n\r\f\v]+)$', 1), {SQL_SPACES}), '[ \t\n\r\f\v]*(\\.[ \t\n\r\f\v]*){{3,}}$', ''), {SQL_SPACES}) AS title,
    regexp_extract(v, '(?s)^(.*[ \t\n\r\f\v])([^ \t\n\r\f\v]+)$', 2) AS token,
    regexp_matches(trim(regexp_extract(v, '(?s)^(.*[ \t\n\r\f\v])([^ \t\n\r\f\v]+)$', 1), {SQL_SPACES}), {DOTS}) AS leader
  FROM (SELECT *, {TRIM.format("text")} AS v FROM ({LINES}))) q,
  LATERAL (SELECT CASE WHEN regexp_matches(token, '^[0-9]{{1,8}}$') THEN 'decimal' WHEN regexp_matches(token, '^[A-Za-z]{{1,3}}-[0-9]{{1,8}}$') THEN 'prefixed_decimal' WHEN token <> '' AND {ROMAN_OK.format("token")} THEN 'roman' END AS kind)
  WHERE title <> '' AND (kind IS NOT NULL OR leader)"""
)
def split_rows(spark: SparkSession, d: str) -> DataFrame:
    v = T.trim(F.col("text"))
    pattern = r"^([\s\S]*[ \t\n\r\f\x0B])([^ \t\n\r\f\x0B]+)$"
    head, token = F.regexp_extract(v, pattern, 1), F.regexp_extract(v, pattern, 2)
    x = lines(spark, d).select(*LINE, T.clean_title(head).alias("title"), token.alias("token"), T.token_kind(token).alias("kind"), T.leader_near_end(head).alias("leader"))
    return x.where("title <> '' and (kind is not null or leader)")


@query(
    f"""SELECT doc_id, page_index, revision, line_no, length({{letters}}) >= 2 AS title_like, strlen(text) AS n_bytes, length(text) AS n_chars,
  length(regexp_replace({LOW.format("v")}, '^(part |chapter |section |appendix )', '')) < length(v) AS labelled,
  length(regexp_replace({LOW.format("v")}, '^(part |chapter |section |appendix )', '')) < length(v) OR (strlen(text) <= 38 AND length(regexp_replace(text, '[^A-Z]', '', 'g')) >= 3 AND NOT regexp_matches(text, '[a-z]')) AS section_heading,
  v <> '' AND (regexp_matches(v, '[,:;-]$') OR list_contains(['a','an','and','as','at','by','for','from','in','into','of','on','or','the','to','via','with'], regexp_extract({LOW.format("v")}, '([^ ]*)$', 1))) AS ends_open,
  list_contains(['chapter','part','section','unit','lesson','lecture','appendix','volume','vol','book','figure','fig','table','page','step','exercise','problem','example','no','number'], regexp_extract({LOW.format("text")}, '([a-z]+)[ \t\n\r\f\v.:#]*$', 1)) AS ends_with_label,
  regexp_extract(v, '^(([A-Za-z]|[0-9]+)(\\.[0-9]+)+) ', 1) AS section_number
  FROM (SELECT *, {TRIM.format("text")} AS v FROM ({LINES}))""".replace("{letters}", r"regexp_replace(text, '[\x00-@\[-`{-\x7F]', '', 'g')")
)
def line_flags(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return lines(spark, d).select(
        *LINE, T.title_like(t).alias("title_like"), F.octet_length(t).cast("long").alias("n_bytes"), F.length(t).cast("long").alias("n_chars"), (T.heading_label(t) > 0).alias("labelled"),
        T.section_heading(t).alias("section_heading"), T.ends_open(t).alias("ends_open"), T.ends_with_label(t).alias("ends_with_label"), T.section_number(t).alias("section_number"),
    )


@query(
    """SELECT p_partkey, nine, CAST((10 - s13 % 10) % 10 AS INTEGER) AS check13, CASE (11 - s10 % 11) % 11 WHEN 10 THEN 'X' ELSE CAST((11 - s10 % 11) % 11 AS VARCHAR) END AS check10,
  '978' || nine || CAST((10 - s13 % 10) % 10 AS VARCHAR) AS isbn13, (10 - s13 % 10) % 10 = p_partkey % 10 AS printed_ok
  FROM (SELECT p_partkey, nine, 9 + 7 * 3 + 8 + list_sum(list_transform(range(1, 10), lambda i: CAST(nine[i] AS INTEGER) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) AS s13,
    list_sum(list_transform(range(1, 10), lambda i: CAST(nine[i] AS INTEGER) * (11 - i))) AS s10
  FROM (SELECT p_partkey, lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS nine FROM part))"""
)
def isbn_checks(spark: SparkSession, d: str) -> DataFrame:
    nine = F.lpad((F.col("p_partkey") * 7919 % 1000000000).cast("string"), 9, "0")
    c = T.isbn13_check(F.concat(F.lit("978"), F.col("nine")))
    x = read(spark, d, "part").select("p_partkey", nine.alias("nine"))
    return x.select("p_partkey", "nine", c.alias("check13"), T.isbn10_check(F.col("nine")).alias("check10"), F.concat(F.lit("978"), "nine", c.cast("string")).alias("isbn13"), (c == F.col("p_partkey") % 10).alias("printed_ok"))


@query("SELECT DISTINCT doc_id, sha256, lower(hex(from_hex(sha256))) = sha256 AS round_trip, length(sha256) = 64 AS whole, sha256(doc_id || coalesce(title, '')) AS digest FROM book WHERE sha256 IS NOT NULL")
def digests(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "book").where("sha256 is not null")
    return x.select("doc_id", "sha256", (F.lower(F.hex(F.unhex("sha256"))) == F.col("sha256")).alias("round_trip"), (F.length("sha256") == 64).alias("whole"), F.sha2(F.concat("doc_id", F.coalesce("title", F.lit(""))), 256).alias("digest")).distinct()


@query(
    r"""SELECT doc_id, length(text) AS scalars, length(regexp_replace(text, '[\t \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g')) AS visible, length(text) - length(replace(text, '�', '')) AS replaced, strlen(text) AS bytes
  FROM documents WHERE text IS NOT NULL"""
)
def utf8_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    visible = F.length(F.regexp_replace(t, r"[\t \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", ""))
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.length(t).cast("long").alias("scalars"), visible.cast("long").alias("visible"), (F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit("")))).cast("long").alias("replaced"), F.octet_length(t).cast("long").alias("bytes"))


@query(
    f"""WITH RECURSIVE e AS (SELECT doc_id, entry_id, ord, {TRIM.format("title")} AS t, row_number() OVER (PARTITION BY doc_id ORDER BY ord, entry_id) AS i FROM ({TOC}) WHERE title IS NOT NULL),
  s AS (SELECT *, regexp_extract(t, '^([A-Z])[.: ] *[^ ]', 1) AS letter, regexp_extract(t, '^([0-9]{{1,2}})[.:]? +[^ ]', 1) AS num, regexp_replace(t, '^([A-Z][.: ]|[0-9]{{1,2}}[.:]?) *', '') AS rest FROM e)
  SELECT doc_id, entry_id, CASE WHEN num <> '' THEN 'Chapter ' || num || ': ' || rest
    WHEN letter <> '' AND (EXISTS (SELECT 1 FROM s c WHERE c.doc_id = s.doc_id AND c.t LIKE s.letter || '.%' AND c.i > s.i) OR letter = 'A' AND EXISTS (SELECT 1 FROM s c WHERE c.doc_id = s.doc_id AND c.letter = 'B' AND c.i > s.i)) THEN 'Appendix ' || letter || ': ' || rest ELSE t END AS styled FROM s"""
)
def title_style(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    x = toc(spark, d).where("title is not null").select("doc_id", "entry_id", T.trim(F.col("title")).alias("t"), F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "entry_id")).alias("i"))
    x = x.withColumn("letter", F.regexp_extract(t, "^([A-Z])[.: ] *[^ ]", 1)).withColumn("num", F.regexp_extract(t, "^([0-9]{1,2})[.:]? +[^ ]", 1)).withColumn("rest", F.regexp_replace(t, "^([A-Z][.: ]|[0-9]{1,2}[.:]?) *", ""))
    after = Window.partitionBy("doc_id").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("later", F.collect_set(F.when(F.col("t").rlike("^[A-Z][.]"), F.substring("t", 1, 1))).over(after)).withColumn("heads", F.collect_set(F.when(F.col("letter") != "", F.col("letter"))).over(after))
    child = F.array_contains("later", F.col("letter")) | ((F.col("letter") == "A") & F.array_contains("heads", "B"))
    styled = F.when(F.col("num") != "", F.concat(F.lit("Chapter "), "num", F.lit(": "), "rest")).when((F.col("letter") != "") & F.coalesce(child, F.lit(False)), F.concat(F.lit("Appendix "), "letter", F.lit(": "), "rest")).otherwise(t)
    return x.select("doc_id", "entry_id", styled.alias("styled"))
