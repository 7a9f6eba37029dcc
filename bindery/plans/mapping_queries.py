"""Parsing of contents pages and mapping of entries, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.operators import mapping, parse
from bindery.plans import query
from bindery.plans.detect_queries import LETTERS, REF, TAIL
from bindery.plans.scalar_queries import KEY, LOW, ROMAN_OK, ROMAN_VALUE, TRIM, toc
from bindery.session import cut, read
from bindery.sources import corpus
from bindery.sources.corpus import PAGE, SQL_FRAGMENTS, SQL_PAGES, SQL_SPACES

SQL_TOC = """en AS (SELECT DISTINCT doc_id, entry_id, title, ord, literal, numbering, ordinal FROM toc_entry),
sp AS (SELECT DISTINCT doc_id, s.page_index AS page_index, s.revision AS revision, s.region_id AS region_id, entry_id FROM (SELECT doc_id, entry_id, unnest(sources) AS s FROM toc_entry)),
tp AS (SELECT DISTINCT doc_id, page_index FROM sp), bo AS (SELECT doc_id, max(page_index) + 1 AS first FROM tp GROUP BY ALL)"""
SQL_TF = f"{SQL_FRAGMENTS}, {SQL_PAGES}, {SQL_TOC}, tf AS (SELECT fr.*, (t + b) / 2 AS y, row_number() OVER (PARTITION BY doc_id, page_index, revision ORDER BY (t + b) / 2, l, region_id, piece) AS i FROM fr SEMI JOIN sp USING (doc_id, page_index, revision))"
SQL_ASM = (
    f"WITH RECURSIVE {SQL_TF}"
    + """,
ar AS (SELECT doc_id, page_index, revision, i, y, 1 AS row FROM tf WHERE i = 1
  UNION ALL SELECT tf.doc_id, tf.page_index, tf.revision, tf.i, CASE WHEN tf.y - ar.y > 5 THEN tf.y ELSE ar.y END, ar.row + CASE WHEN tf.y - ar.y > 5 THEN 1 ELSE 0 END
  FROM ar JOIN tf ON tf.doc_id = ar.doc_id AND tf.page_index = ar.page_index AND tf.revision = ar.revision AND tf.i = ar.i + 1),
rows_ AS (SELECT tf.doc_id, tf.page_index, tf.revision, ar.row, string_agg(text, ' ' ORDER BY l, region_id, piece) AS text, min(l) AS l, max(r) AS r, min(t) AS t, max(b) AS b
  FROM tf JOIN ar USING (doc_id, page_index, revision, i) GROUP BY ALL)"""
)


def toc_fragments(spark: SparkSession, d: str) -> DataFrame:
    return corpus.fragments(spark, d).join(toc_sources(spark, d).select(*PAGE).distinct(), PAGE, "left_semi")


def toc_sources(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "toc_entry").select("doc_id", "entry_id", F.explode("sources").alias("s"))
    return x.select("doc_id", "entry_id", "s.page_index", "s.revision", "s.region_id").distinct()


def body(spark: SparkSession, d: str) -> DataFrame:
    return toc_sources(spark, d).groupBy("doc_id").agg((F.max("page_index") + 1).alias("first"))


@query(SQL_ASM + " SELECT doc_id, page_index, revision, CAST(row AS INTEGER) AS row, text, l, r FROM rows_")
def assemble_rows(spark: SparkSession, d: str) -> DataFrame:
    return parse.assemble_rows(toc_fragments(spark, d)).select(*PAGE, "row", "text", "l", "r")


@query(
    SQL_ASM
    + f""",
wt AS (SELECT *, {TRIM.format("text")} AS v FROM rows_),
wu AS (SELECT *, CASE WHEN regexp_matches(v, {TAIL}) AND regexp_matches(regexp_extract(v, {TAIL}, 2), {REF}) AND length({LETTERS.format(f"regexp_extract(v, {TAIL}, 1)")}) >= 2 THEN regexp_extract(v, {TAIL}, 2) END AS token FROM wt),
wv AS (SELECT *, trim(regexp_replace({TRIM.format("CASE WHEN token IS NULL THEN v ELSE regexp_extract(v, " + TAIL + ", 1) END")}, '[ \t\n\r\f\v]*(\\.[ \t\n\r\f\v]*){{3,}}$', ''), {SQL_SPACES}) AS title,
  length(regexp_replace({LOW.format("v")}, '^(part |chapter |section |appendix )', '')) < length(v) AS lab FROM wu),
ww AS (SELECT *, lag(token) OVER w AS pk, lag(title) OVER w AS pt, lag(text) OVER w AS px, lag(v) OVER w AS pv, lag(lab) OVER w AS plab, lag(l) OVER w AS pl, lag(b) OVER w AS pb, lag(t) OVER w AS ptop FROM wv WINDOW w AS (PARTITION BY doc_id, page_index, revision ORDER BY row)),
wx AS (SELECT *, coalesce(pk IS NULL AND px IS NOT NULL AND strlen(px) >= 18 AND {LOW.format("pv")} NOT IN ('contents', 'table of contents') AND NOT lab AND NOT regexp_matches(v, '^([A-Za-z]|[0-9]+)(\\.[0-9]+)+ ')
  AND NOT (plab OR (strlen(px) <= 38 AND length(regexp_replace(px, '[^A-Z]', '', 'g')) >= 3 AND NOT regexp_matches(px, '[a-z]'))) AND abs(l - pl) <= 16 AND t >= ptop AND t - pb <= 1.8 * greatest(b - t, pb - ptop), false) AS take FROM ww WHERE token IS NOT NULL)
SELECT doc_id, page_index, revision, CAST(row AS INTEGER) AS row, CASE WHEN take THEN concat_ws(' ', pt, title) ELSE title END AS title, token, take AS wrapped FROM wx"""
)
def wrap_titles(spark: SparkSession, d: str) -> DataFrame:
    return parse.wrapped(parse.assemble_rows(toc_fragments(spark, d)))


SQL_LEFT = """le AS (SELECT sp.doc_id, entry_id, ord, min(l) AS left_ FROM sp JOIN en USING (doc_id, entry_id) JOIN rg USING (doc_id, page_index, revision, region_id) GROUP BY ALL),
li AS (SELECT *, left_ - min(left_) OVER (PARTITION BY doc_id) AS indent FROM le)"""


def entry_lefts(spark: SparkSession, d: str) -> DataFrame:
    x = toc_sources(spark, d).join(toc(spark, d).select("doc_id", "entry_id", "ord"), ["doc_id", "entry_id"]).join(corpus.regions(spark, d), [*PAGE, "region_id"])
    return x.groupBy("doc_id", "entry_id", "ord").agg(F.min("l").alias("left"))


@query(
    f"""WITH {SQL_FRAGMENTS}, {SQL_TOC}, {SQL_LEFT}
SELECT a.doc_id, a.entry_id, round(a.indent, 3) AS indent, CASE WHEN a.indent <= 8 THEN 'root' WHEN p.entry_id IS NOT NULL THEN 'known_parent' ELSE 'unknown' END AS kind, CASE WHEN a.indent > 8 THEN p.entry_id END AS parent_id
FROM li a LEFT JOIN (SELECT DISTINCT ON (x.doc_id, x.entry_id) x.doc_id, x.entry_id AS child, y.entry_id FROM li x JOIN li y ON y.doc_id = x.doc_id AND (y.ord < x.ord OR (y.ord = x.ord AND y.entry_id < x.entry_id)) AND y.indent + 16 <= x.indent ORDER BY x.doc_id, x.entry_id, y.ord DESC, y.entry_id DESC) p
  ON p.doc_id = a.doc_id AND p.child = a.entry_id"""
)
def hierarchy_indent(spark: SparkSession, d: str) -> DataFrame:
    return parse.by_indent(entry_lefts(spark, d)).withColumn("indent", F.round("indent", 3))


NUM = r"coalesce(nullif(regexp_extract(trim(title, " + SQL_SPACES + r"), '^(([A-Za-z]|[0-9]+)(\.[0-9]+)+) ', 1), ''), nullif(regexp_extract(title, '^(Chapter |Appendix |Part )?([A-Z]|[0-9]+)[.: ]', 2), ''))"


@query(
    f"""WITH {SQL_TOC}, nu AS (SELECT doc_id, entry_id, ord, {NUM} AS number FROM en WHERE {NUM} IS NOT NULL)
SELECT a.doc_id, a.entry_id, a.number, (SELECT arg_max(b.entry_id, (b.ord, b.entry_id)) FROM nu b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND contains(a.number, '.') AND b.number = regexp_replace(a.number, '\\.[^.]*$', '')) AS parent_id FROM nu a"""
)
def hierarchy_number(spark: SparkSession, d: str) -> DataFrame:
    return parse.by_number(toc(spark, d))


@query(
    """SELECT doc_id, count(*) AS n_entries, count(*) FILTER (numbering = 'unknown' OR ordinal IS NULL) AS n_unread, count(*) FILTER (kind = 'unknown') AS n_unknown,
  bool_and(coalesce(NOT uncertain, true) AND coalesce(kind <> 'unknown', true) AND ordinal IS NOT NULL) AS complete
  FROM (SELECT DISTINCT doc_id, entry_id, numbering, ordinal, uncertain, hierarchy.kind AS kind FROM toc_entry) GROUP BY doc_id"""
)
def parse_completeness(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "toc_entry").select("doc_id", "entry_id", "numbering", "ordinal", "uncertain", F.col("hierarchy.kind").alias("kind")).distinct()
    ok = F.coalesce(~F.col("uncertain"), F.lit(True)) & F.coalesce(F.col("kind") != "unknown", F.lit(True)) & F.col("ordinal").isNotNull()
    return x.groupBy("doc_id").agg(F.count("*").alias("n_entries"), F.count_if((F.col("numbering") == "unknown") | F.col("ordinal").isNull()).alias("n_unread"), F.count_if(F.col("kind") == "unknown").alias("n_unknown"), F.bool_and(ok).alias("complete"))


def kind(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^[0-9]{{1,8}}$') THEN 'decimal' WHEN regexp_matches({x}, '^[A-Za-z]{{1,3}}-[0-9]{{1,8}}$') THEN 'prefixed_decimal' WHEN {x} <> '' AND {ROMAN_OK.format(x)} THEN 'roman' END"


def value(x: str) -> str:
    return f"CAST(CASE WHEN regexp_matches({x}, '^[0-9]{{1,8}}$') THEN CAST({x} AS INTEGER) WHEN regexp_matches({x}, '^[A-Za-z]{{1,3}}-[0-9]{{1,8}}$') THEN CAST(regexp_extract({x}, '-([0-9]+)$', 1) AS INTEGER) WHEN {x} <> '' AND {ROMAN_OK.format(x)} THEN {ROMAN_VALUE.format(x)} END AS INTEGER)"


SQL_MARGIN = (
    f"WITH {SQL_FRAGMENTS}, {SQL_PAGES}, {SQL_TOC}"
    + f""",
bx AS (SELECT rg.*, pp.height FROM rg JOIN (SELECT DISTINCT doc_id, page_index, revision, height FROM la WHERE height > 0) pp USING (doc_id, page_index, revision) WHERE text <> ''),
bd AS (SELECT *, 'header' AS kind, t AS out_ FROM bx WHERE (t + b) / 2 <= 0.1 * height UNION ALL SELECT *, 'footer', -b FROM bx WHERE (t + b) / 2 >= (1 - 0.15) * height),
be AS (SELECT *, {TRIM.format("text")} AS v, row_number() OVER (PARTITION BY doc_id, page_index, revision, kind ORDER BY out_, region_id) = 1 AS outermost FROM bd),
bf AS (SELECT *, regexp_extract(v, '(?s)^(.*) ([^ ]*)$', 2) AS lastw, regexp_extract(v, '(?s)^(.*) ([^ ]*)$', 1) AS before, regexp_extract(v, '(?s)^([^ ]*) (.*)$', 1) AS firstw, regexp_extract(v, '(?s)^([^ ]*) (.*)$', 2) AS after FROM be),
bg AS (SELECT *, {kind("v")} AS kv, {kind("lastw")} AS kl, {kind("firstw")} AS kf FROM bf),
bh AS (SELECT *, CASE WHEN outermost AND kv IS NULL AND strlen(v) <= 80 AND NOT contains(v, chr(10)) THEN
    CASE WHEN length({LETTERS.format("before")}) >= 2 AND kl IS NOT NULL AND NOT list_contains(['chapter','part','section','unit','lesson','lecture','appendix','volume','vol','book','figure','fig','table','page','step','exercise','problem','example','no','number'], regexp_extract({LOW.format("before")}, '([a-z]+)[ \t\n\r\f\v.:#]*$', 1)) THEN lastw
      WHEN length({LETTERS.format("after")}) >= 2 AND kf IS NOT NULL THEN firstw END END AS running FROM bg),
bi AS (SELECT *, CASE WHEN kv IS NOT NULL THEN v ELSE running END AS literal FROM bh),
bj AS (SELECT * FROM bi WHERE literal IS NOT NULL AND {value("literal")} > 0),
bk AS (SELECT doc_id, page_index, revision, kind, count(*) AS n, max(running) AS alone, max(literal) AS literal FROM bj GROUP BY ALL),
ob AS (SELECT doc_id, page_index, revision, kind, coalesce(alone, literal) AS literal, {kind("coalesce(alone, literal)")} AS style, {value("coalesce(alone, literal)")} AS ordinal FROM bk WHERE alone IS NOT NULL OR n = 1),
ax AS (SELECT DISTINCT ob.doc_id, page_index, page_index - ordinal AS off FROM ob JOIN bo USING (doc_id) WHERE style = 'decimal' AND page_index >= first),
ay AS (SELECT doc_id, page_index, count(*) AS k, min(off) AS off FROM ax GROUP BY ALL),
av AS (SELECT doc_id, off, count(*) AS support FROM ay WHERE k = 1 GROUP BY ALL),
ab AS (SELECT DISTINCT ON (doc_id) doc_id, off, support FROM av ORDER BY doc_id, support DESC, off),
ao AS (SELECT q.doc_id, q.n_pages, n.n_offsets, n.n_offsets > 1 AS contradictory, ab.support, ab.off,
   CASE WHEN n_offsets = 1 AND n_pages >= 2 THEN 'strong' WHEN support >= 3 AND support >= 0.8 * n_pages THEN 'dominant' END AS method
  FROM (SELECT doc_id, count(*) AS n_pages FROM ay GROUP BY ALL) q JOIN (SELECT doc_id, count(DISTINCT off) AS n_offsets FROM ax GROUP BY ALL) n USING (doc_id) LEFT JOIN ab USING (doc_id)),
hl AS (SELECT *, {KEY.format("text")} AS k1 FROM fr SEMI JOIN la USING (doc_id, page_index, revision) ANTI JOIN tp USING (doc_id, page_index)),
hm AS (SELECT *, lead(k1) OVER w AS k2, lead(k1, 2) OVER w AS k3, lead(t) OVER w AS t2, lead(b) OVER w AS b2, lead(t, 2) OVER w AS t3 FROM hl WINDOW w AS (PARTITION BY doc_id, page_index, revision ORDER BY t, l, region_id, piece)),
hk AS (SELECT doc_id, page_index, k1 AS key FROM hm UNION SELECT doc_id, page_index, concat_ws(' ', k1, k2) FROM hm WHERE t2 - b BETWEEN -(b - t) AND 1.5 * (b - t)
  UNION SELECT doc_id, page_index, concat_ws(' ', k1, k2, k3) FROM hm WHERE t2 - b BETWEEN -(b - t) AND 1.5 * (b - t) AND t3 - b2 BETWEEN -(b - t) AND 1.5 * (b - t)),
hd AS (SELECT DISTINCT e.doc_id, e.entry_id, hk.page_index FROM (SELECT doc_id, entry_id, {KEY.format("title")} AS key FROM en) e JOIN hk USING (doc_id, key) WHERE key <> ''),
me AS (SELECT DISTINCT en.doc_id, entry_id, en.ordinal, numbering, CASE WHEN numbering = 'decimal' AND method IS NOT NULL AND en.ordinal + off >= first THEN en.ordinal + off END AS target
  FROM en LEFT JOIN ao USING (doc_id) LEFT JOIN bo USING (doc_id)),
mf AS (SELECT me.*, (SELECT count(DISTINCT page_index) FROM hd WHERE hd.doc_id = me.doc_id AND hd.entry_id = me.entry_id) AS n_head, (SELECT min(page_index) FROM hd WHERE hd.doc_id = me.doc_id AND hd.entry_id = me.entry_id) AS only_,
   target IS NOT NULL AND (EXISTS (SELECT 1 FROM ob WHERE ob.doc_id = me.doc_id AND ob.page_index = me.target AND ob.style = 'decimal' AND ob.ordinal = me.ordinal) OR EXISTS (SELECT 1 FROM hd WHERE hd.doc_id = me.doc_id AND hd.entry_id = me.entry_id AND hd.page_index = me.target)) AS confirmed FROM me),
mp AS (SELECT doc_id, entry_id, CASE WHEN confirmed OR n_head = 1 THEN 'resolved' WHEN n_head > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status,
   CAST(CASE WHEN confirmed THEN target WHEN n_head = 1 THEN only_ END AS INTEGER) AS page, CASE WHEN confirmed THEN 'inferred_offset' WHEN n_head = 1 THEN 'heading' END AS method FROM mf)"""
)


def observations(spark: SparkSession, d: str) -> DataFrame:
    return mapping.margin_numbers(corpus.regions(spark, d), corpus.latest(spark, d))


@query(SQL_MARGIN + " SELECT doc_id, page_index, revision, kind, literal, style, ordinal FROM ob")
def margin_numbers(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d)


@query(SQL_MARGIN + " SELECT doc_id, n_pages, n_offsets, contradictory, CASE WHEN method IS NOT NULL THEN off END AS offset_, support, method FROM ao")
def offset_anchors(spark: SparkSession, d: str) -> DataFrame:
    return mapping.offsets(observations(spark, d), body(spark, d)).withColumnRenamed("offset", "offset_")


def latest_fragments(spark: SparkSession, d: str) -> DataFrame:
    return corpus.fragments(spark, d).join(corpus.latest(spark, d).select(*PAGE), PAGE, "left_semi")


def found_headings(spark: SparkSession, d: str) -> DataFrame:
    return mapping.headings(latest_fragments(spark, d), toc(spark, d), toc_sources(spark, d).select("doc_id", "page_index").distinct())


@query(SQL_MARGIN + " SELECT doc_id, entry_id, page_index FROM hd")
def heading_match(spark: SparkSession, d: str) -> DataFrame:
    return found_headings(spark, d)


def mapped(spark: SparkSession, d: str) -> DataFrame:
    o, b = cut(observations(spark, d)), body(spark, d)
    return mapping.map_entries(toc(spark, d), mapping.offsets(o, b), o, found_headings(spark, d), b)


@query(SQL_MARGIN + " SELECT doc_id, entry_id, status, page, method FROM mp")
def entry_mapping(spark: SparkSession, d: str) -> DataFrame:
    return mapped(spark, d)


@query(SQL_MARGIN + " SELECT status, method, count(*) AS n FROM mp GROUP BY ALL")
def mapping_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return mapped(spark, d).groupBy("status", "method").agg(F.count("*").alias("n"))


@query(
    SQL_MARGIN
    + """ SELECT doc_id, page_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, page_index) AS INTEGER) AS rank, n FROM (
  SELECT doc_id, CAST(me.ordinal + off AS INTEGER) AS page_index, count(*) AS n FROM me JOIN ao USING (doc_id) WHERE numbering = 'decimal' AND me.ordinal + off >= 0
    AND NOT EXISTS (SELECT 1 FROM la WHERE la.doc_id = me.doc_id AND la.page_index = me.ordinal + off) GROUP BY ALL) QUALIFY rank <= 500"""
)
def evidence_requests(spark: SparkSession, d: str) -> DataFrame:
    """Pages that entries point to and that weren't acquired, most wanted first, at most 500 a book as the option says."""
    seen = cut(observations(spark, d))
    o = mapping.offsets(seen, body(spark, d))
    # the best offset asks for pages before it is strong enough to decide
    a = seen.where("style = 'decimal'").join(body(spark, d), "doc_id").where("page_index >= first").select("doc_id", "page_index", (F.col("page_index") - F.col("ordinal")).alias("offset")).distinct()
    votes = a.groupBy("doc_id", "page_index").agg(F.count("*").alias("k"), F.min("offset").alias("offset")).where("k = 1").groupBy("doc_id", "offset").agg(F.count("*").alias("support"))
    best = votes.groupBy("doc_id").agg(F.max(F.struct("support", (-F.col("offset")).alias("o"))).alias("m")).select("doc_id", (-F.col("m.o")).alias("offset")).join(o.select("doc_id"), "doc_id")
    want = toc(spark, d).where("numbering = 'decimal'").select("doc_id", "entry_id", "ordinal").distinct().join(best, "doc_id").select("doc_id", (F.col("ordinal") + F.col("offset")).alias("page_index")).where("page_index >= 0")
    want = want.join(corpus.latest(spark, d).select("doc_id", "page_index"), ["doc_id", "page_index"], "left_anti").groupBy("doc_id", "page_index").agg(F.count("*").alias("n"))
    return want.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "page_index"))).where("rank <= 500").select("doc_id", F.col("page_index").cast("int").alias("page_index"), "rank", "n")
