"""Mapping by numbering sections with labels, links and reasons, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions import text as T
from bindery.operators import sections
from bindery.plans import query
from bindery.plans.mapping_queries import SQL_MARGIN, body, observations, toc_sources, value
from bindery.plans.scalar_queries import LOW, ROMAN_OK
from bindery.session import kept, read
from bindery.sources import corpus
from bindery.sources.corpus import SQL_SPACES

HKEY = "trim(regexp_replace(" + LOW.format("{0}") + ", '[ \t\n\r\f\v]+', ' ', 'g'), ' ')"
LABELS = """CASE WHEN page_index < bo.first THEN lower(['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX'][CAST(page_index + 1 AS INTEGER)]) ELSE CAST(page_index - bo.first + 1 + dc.count % 3 AS VARCHAR) END"""
SQL_SECTIONS = (
    SQL_MARGIN
    + f""",
e2 AS (SELECT doc_id, entry_id, min(title) AS title, min(numbering) AS numbering, min(ordinal) AS ordinal, min(range_end) AS range_end, min(upper(prefix)) AS prefix, bool_or(coalesce(uncertain, false)) AS uncertain FROM toc_entry WHERE doc_id IS NOT NULL AND entry_id IS NOT NULL GROUP BY ALL),
dc AS (SELECT doc_id, CAST(greatest(coalesce(max(page_count), 0), coalesce(max(page_index) + 1, 0)) AS INTEGER) AS count FROM (SELECT doc_id, page_count, NULL AS page_index FROM book UNION ALL SELECT doc_id, NULL, page_index FROM page) GROUP BY ALL),
se AS (SELECT * FROM (SELECT bo.doc_id, 'body' AS section, first, count AS "end", 'decimal' AS style, '' AS prefix FROM bo JOIN dc USING (doc_id)
  UNION ALL SELECT bo.doc_id, 'front', 0, first, 'roman', '' FROM bo JOIN dc USING (doc_id) WHERE EXISTS (SELECT 1 FROM e2 WHERE e2.doc_id = bo.doc_id AND numbering = 'roman')
  UNION ALL SELECT bo.doc_id, 'prefix ' || p.prefix, first, count, 'prefixed_decimal', p.prefix FROM bo JOIN dc USING (doc_id) JOIN (SELECT DISTINCT doc_id, prefix FROM e2 WHERE numbering = 'prefixed_decimal' AND prefix IS NOT NULL) p USING (doc_id)) WHERE first < "end"),
ot AS (SELECT DISTINCT doc_id, page_index, style, CASE WHEN style = 'prefixed_decimal' THEN upper(regexp_extract(literal, '^([A-Za-z]{{1,3}})-', 1)) ELSE '' END AS prefix, ordinal FROM ob WHERE ordinal IS NOT NULL),
sa AS (SELECT DISTINCT ot.doc_id, section, page_index, CAST(page_index AS BIGINT) - ot.ordinal AS off FROM ot JOIN se ON se.doc_id = ot.doc_id AND se.style = ot.style AND se.prefix = ot.prefix AND page_index >= first AND page_index < "end"),
sb AS (SELECT doc_id, section, page_index, count(*) AS k, min(off) AS off FROM sa GROUP BY ALL),
sv AS (SELECT doc_id, section, off, count(*) AS n FROM sb WHERE k = 1 GROUP BY ALL),
sw AS (SELECT DISTINCT ON (doc_id, section) doc_id, section, off AS best, n FROM sv ORDER BY doc_id, section, n DESC, off),
sx AS (SELECT g.doc_id, g.section, n_pages, n_off, low, best, n, n_off > 1 AND coalesce(n, 0) >= 3 AND coalesce(n, 0) * 5 >= n_pages * 4 AS dominant FROM (SELECT doc_id, section, count(DISTINCT page_index) AS n_pages, count(DISTINCT off) AS n_off, min(off) AS low FROM sa GROUP BY ALL) g LEFT JOIN sw USING (doc_id, section)),
sy AS (SELECT doc_id, section, n_pages, CASE WHEN n_off = 1 AND n_pages >= 2 THEN low WHEN dominant THEN best END AS off, n_off > 1 AND NOT dominant AS contradictory,
  CASE WHEN dominant THEN coalesce((SELECT list(sb.page_index ORDER BY sb.page_index) FROM sb WHERE sb.doc_id = sx.doc_id AND sb.section = sx.section AND (sb.k <> 1 OR sb.off <> sx.best)), []) ELSE [] END AS outliers FROM sx),
hr AS (SELECT rg.doc_id, rg.page_index, rg.revision, t, b, b - t AS h, {HKEY.format("text")} AS k1, height, l, region_id FROM rg JOIN (SELECT DISTINCT doc_id, page_index, revision, height FROM la WHERE height > 0) USING (doc_id, page_index, revision) ANTI JOIN tp USING (doc_id, page_index)),
hs AS (SELECT *, lead(k1) OVER w AS k2, lead(k1, 2) OVER w AS k3, lead(t) OVER w AS t2, lead(b) OVER w AS b2, lead(h) OVER w AS h2, lead(t, 2) OVER w AS t3, lead(h, 2) OVER w AS h3, (t + b) / 2 <= 0.25 * height AS high FROM hr WHERE k1 <> '' WINDOW w AS (PARTITION BY doc_id, page_index, revision ORDER BY t, l, region_id)),
ht AS (SELECT *, t2 - b BETWEEN -greatest(h, h2) AND 1.5 * greatest(h, h2) AS two, t3 - b2 BETWEEN -greatest(h2, h3) AND 1.5 * greatest(h2, h3) AS three FROM hs),
hu AS (SELECT doc_id, page_index, high, k1 AS key FROM ht UNION ALL SELECT doc_id, page_index, high, concat_ws(' ', k1, k2) FROM ht WHERE two UNION ALL SELECT doc_id, page_index, high, concat_ws(' ', k1, k2, k3) FROM ht WHERE two AND three),
he AS (SELECT doc_id, entry_id, {HKEY.format("title")} AS key, regexp_matches({HKEY.format("title")}, '^[0-9]') AS numbered FROM e2 WHERE title IS NOT NULL),
hx AS (SELECT DISTINCT he.doc_id, entry_id, page_index FROM he JOIN hu ON hu.doc_id = he.doc_id AND (hu.key = he.key OR (numbered AND hu.key = 'chapter ' || he.key)) WHERE he.key <> '' AND (numbered OR high)),
lf AS (SELECT p.doc_id, p.page_index, {LABELS} AS label FROM (SELECT DISTINCT doc_id, unnest(range(0, count)) AS page_index FROM dc WHERE count % 2 = 0) p JOIN bo USING (doc_id) JOIN dc USING (doc_id)),
lg AS (SELECT lf.doc_id, section, count(DISTINCT page_index) FILTER (label IS NOT NULL) AS n, max("end" - first) AS size FROM lf JOIN se ON se.doc_id = lf.doc_id AND page_index >= first AND page_index < "end" GROUP BY ALL),
lt AS (SELECT DISTINCT lf.doc_id, se.section, page_index, CASE WHEN regexp_matches(label, '^[0-9]+$') THEN 'decimal' ELSE 'roman' END AS style, '' AS prefix, {value("label")} AS ordinal FROM lf JOIN se ON se.doc_id = lf.doc_id AND page_index >= first AND page_index < "end" JOIN lg ON lg.doc_id = se.doc_id AND lg.section = se.section AND lg.n = lg.size WHERE label IS NOT NULL),
bq AS (SELECT DISTINCT doc_id, {HKEY.format("title")} AS key, dest FROM bookmark_node WHERE dest IS NOT NULL AND title IS NOT NULL),
li AS (SELECT DISTINCT he.doc_id, he.entry_id, bq.dest AS page_index FROM he JOIN bq USING (doc_id, key) JOIN dc USING (doc_id) WHERE key <> '' AND dest >= 0 AND dest < count AND EXISTS (SELECT 1 FROM sp WHERE sp.doc_id = he.doc_id AND sp.entry_id = he.entry_id)),
wh AS (SELECT se.doc_id, section FROM se JOIN (SELECT DISTINCT doc_id, page_index FROM la WHERE outcome NOT IN ('failed', 'cancelled', 'no_text_found')) p ON p.doc_id = se.doc_id AND p.page_index >= first AND p.page_index < "end" GROUP BY se.doc_id, section, first, "end" HAVING count(DISTINCT p.page_index) = "end" - first),
ey AS (SELECT *, ordinal IS NOT NULL AND NOT uncertain AND coalesce(numbering IN ('decimal', 'roman', 'prefixed_decimal'), false) AS known, CASE WHEN numbering = 'prefixed_decimal' THEN prefix ELSE '' END AS pre FROM e2),
ez AS (SELECT ey.doc_id, entry_id, known, numbering AS style, pre, ordinal, range_end, se.section, first, "end", off, contradictory, n_pages, len(outliers) AS n_outliers, ordinal + off AS target,
   coalesce(ordinal + off >= first AND ordinal + off < "end" AND (range_end IS NULL OR (range_end >= ordinal AND range_end + off >= first AND range_end + off < "end")), false) AS fits
  FROM ey LEFT JOIN se ON known AND se.doc_id = ey.doc_id AND se.style = ey.numbering AND se.prefix = ey.pre LEFT JOIN sy ON sy.doc_id = se.doc_id AND sy.section = se.section),
aw AS (SELECT doc_id, entry_id, CAST(target AS INTEGER) AS page_index, 'inferred_offset' AS method FROM ez WHERE fits
  UNION SELECT ez.doc_id, entry_id, lt.page_index, 'viewer_label' FROM ez JOIN lt ON known AND lt.doc_id = ez.doc_id AND lt.section = ez.section AND lt.style = ez.style AND lt.prefix = ez.pre AND lt.ordinal = ez.ordinal
  UNION SELECT doc_id, entry_id, page_index, 'associated_local_link' FROM li),
ac AS (SELECT aw.*, EXISTS (SELECT 1 FROM hx WHERE hx.doc_id = aw.doc_id AND hx.entry_id = aw.entry_id AND hx.page_index = aw.page_index) OR (ez.known AND EXISTS (SELECT 1 FROM ot WHERE ot.doc_id = aw.doc_id AND ot.page_index = aw.page_index AND ot.style = ez.style AND ot.prefix = ez.pre AND ot.ordinal = ez.ordinal)) AS confirmed FROM aw JOIN ez USING (doc_id, entry_id)),
ch AS (SELECT doc_id, entry_id, page_index, method FROM ac WHERE confirmed UNION SELECT hx.doc_id, hx.entry_id, hx.page_index, 'heading_match' FROM hx JOIN ez USING (doc_id, entry_id) JOIN se s ON s.doc_id = hx.doc_id AND s.section = 'body' AND hx.page_index >= s.first AND hx.page_index < s."end" JOIN wh ON wh.doc_id = s.doc_id AND wh.section = 'body' WHERE NOT known),
cg AS (SELECT doc_id, entry_id, count(DISTINCT page_index) AS n_dest, count(*) AS n_choices, min(page_index) AS only_, arg_min(method, list_position(['associated_local_link', 'viewer_label', 'inferred_offset', 'heading_match'], method)) AS method FROM ch GROUP BY ALL),
hg AS (SELECT doc_id, entry_id, count(*) AS n_hints FROM ac WHERE NOT confirmed AND method <> 'inferred_offset' GROUP BY ALL),
er AS (SELECT ez.doc_id, ez.entry_id, section, CASE WHEN coalesce(n_dest, 0) > 1 THEN 'ambiguous' WHEN n_dest = 1 AND NOT coalesce(contradictory, false) THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN n_dest = 1 AND NOT coalesce(contradictory, false) THEN only_ END AS page,
  CASE WHEN n_dest = 1 AND NOT coalesce(contradictory, false) THEN method END AS method, coalesce(n_choices, 0) AS n_choices, coalesce(n_hints, 0) AS n_hints,
  CASE WHEN n_dest > 1 THEN 'several_destinations' WHEN n_dest = 1 AND NOT coalesce(contradictory, false) THEN CASE WHEN n_choices > 1 THEN 'methods_agree' WHEN n_outliers > 0 THEN 'outliers_ignored' ELSE 'confirmed' END
    WHEN NOT known THEN 'no_reference' WHEN section IS NULL THEN 'no_section' WHEN coalesce(contradictory, false) THEN 'conflicting_offsets' WHEN off IS NULL THEN 'few_anchors' WHEN NOT fits THEN 'outside_section' ELSE 'target_not_confirmed' END AS reason
  FROM ez LEFT JOIN cg USING (doc_id, entry_id) LEFT JOIN hg USING (doc_id, entry_id))"""
)


def entries(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "toc_entry").where("doc_id is not null and entry_id is not null")
    return x.groupBy("doc_id", "entry_id").agg(*[F.min(c).alias(c) for c in ("title", "numbering", "ordinal", "range_end")], F.min(F.upper("prefix")).alias("prefix"), F.bool_or(F.coalesce("uncertain", F.lit(False))).alias("uncertain"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    told = read(spark, d, "book").select("doc_id", F.coalesce("page_count", F.lit(0)).alias("n"))
    seen = read(spark, d, "page").select("doc_id", (F.col("page_index") + 1).alias("n"))
    return told.unionByName(seen).groupBy("doc_id").agg(F.coalesce(F.max("n"), F.lit(0)).cast("int").alias("count"))


def all_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections.sections(entries(spark, d), body(spark, d), counts(spark, d))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """Viewer labels, which the tables lack, by a stated rule: books of an even number of pages have them, Roman before the body (up to twenty), counted on from its first page by up to two beyond."""
    x = counts(spark, d).where("count % 2 = 0 and count > 0").join(body(spark, d), "doc_id")
    x = x.select("doc_id", "first", "count", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("page_index"))
    p = F.col("page_index")
    label = F.when((p < F.col("first")) & (p < 20), F.lower(T.to_roman(p + 1))).when(p >= F.col("first"), (p - F.col("first") + 1 + F.col("count") % 3).cast("string"))
    return x.select("doc_id", "page_index", label.alias("label"))


def links(spark: SparkSession, d: str) -> DataFrame:
    """Links, which the tables lack, by a stated rule: an entry that names its source links to where bookmarks of its very title lead."""
    key = lambda c: T.heading_key(F.col(c)).alias("key")
    node = read(spark, d, "bookmark_node").where("dest is not null and title is not null").select("doc_id", key("title"), F.col("dest").alias("page_index")).distinct()
    e = entries(spark, d).select("doc_id", "entry_id", key("title")).where("key <> ''").join(toc_sources(spark, d).select("doc_id", "entry_id").distinct(), ["doc_id", "entry_id"], "left_semi")
    return e.join(node, ["doc_id", "key"]).join(counts(spark, d), "doc_id").where("page_index >= 0 and page_index < count").select("doc_id", "entry_id", "page_index").distinct()


@query(SQL_SECTIONS + ' SELECT doc_id, section, first, "end", style, prefix FROM se')
def numbering_sections(spark: SparkSession, d: str) -> DataFrame:
    return all_sections(spark, d)


@query(SQL_SECTIONS + " SELECT doc_id, section, n_pages, off AS offset_, contradictory, len(outliers) AS n_outliers, array_to_string(list_slice(outliers, 1, 5), ',') AS first_outliers FROM sy")
def section_anchors(spark: SparkSession, d: str) -> DataFrame:
    """What the printed numbers of each section say; five of the outliers are named."""
    a = sections.anchors(sections.tokens(observations(spark, d)), all_sections(spark, d))
    return a.select("doc_id", "section", F.col("n_pages").cast("long").alias("n_pages"), F.col("offset").alias("offset_"), "contradictory", F.size("outliers").cast("long").alias("n_outliers"), F.array_join(F.slice("outliers", 1, 5).cast("array<string>"), ",").alias("first_outliers"))


@query(SQL_SECTIONS + " SELECT doc_id, section, page_index, style, ordinal FROM lt")
def viewer_labels(spark: SparkSession, d: str) -> DataFrame:
    return sections.label_tokens(labels(spark, d), all_sections(spark, d)).select("doc_id", "section", "page_index", "style", "ordinal")


@query(SQL_SECTIONS + " SELECT doc_id, entry_id, page_index FROM li")
def entry_links(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d)


@query(SQL_SECTIONS + " SELECT doc_id, entry_id, page_index FROM hx")
def heading_observations(spark: SparkSession, d: str) -> DataFrame:
    """Pages that read like an entry's title: in the top quarter, or anywhere and also behind "chapter" if it has a number."""
    return sections.headings(corpus.regions(spark, d), corpus.latest(spark, d), entries(spark, d), toc_sources(spark, d).select("doc_id", "page_index").distinct())


def resolved(spark: SparkSession, d: str) -> DataFrame:
    s = kept(all_sections(spark, d))
    tokens = kept(sections.tokens(observations(spark, d)))
    head = kept(heading_observations(spark, d))
    good = corpus.latest(spark, d).where("outcome not in ('failed', 'cancelled', 'no_text_found')").select("doc_id", "page_index").distinct()
    whole = s.join(good, "doc_id").where("page_index >= first and page_index < end").groupBy("doc_id", "section").agg(F.countDistinct("page_index").alias("n"), F.max(F.col("end") - F.col("first")).alias("size")).where("n = size").select("doc_id", "section")
    return sections.resolve(entries(spark, d), s, sections.anchors(tokens, s), tokens, head, sections.label_tokens(labels(spark, d), s), links(spark, d), whole)


@query(SQL_SECTIONS + " SELECT * FROM er")
def entry_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Each entry's section, decision and reason, with links, labels, offsets and headings as choices that the page must confirm."""
    return resolved(spark, d)


@query(SQL_SECTIONS + " SELECT doc_id, page_index, kind, entry_id, literal FROM (SELECT doc_id, page_index, kind, NULL AS entry_id, literal FROM ob UNION ALL SELECT doc_id, page_index, 'heading', entry_id, NULL FROM hx UNION ALL SELECT doc_id, page_index, 'label', NULL, CAST(ordinal AS VARCHAR) FROM lt)")
def observation_list(spark: SparkSession, d: str) -> DataFrame:
    """All observations in the order page, kind (footer, label, heading, header), entry, literal."""
    none = F.lit(None).cast("string")
    o = observations(spark, d).select("doc_id", "page_index", "kind", none.alias("entry_id"), "literal")
    h = heading_observations(spark, d).select("doc_id", "page_index", F.lit("heading").alias("kind"), "entry_id", none.alias("literal"))
    v = viewer_labels(spark, d).select("doc_id", "page_index", F.lit("label").alias("kind"), none.alias("entry_id"), F.col("ordinal").cast("string").alias("literal"))
    rank = F.array_position(F.array(*map(F.lit, ("footer", "label", "heading", "header"))), F.col("kind"))
    return o.unionByName(h).unionByName(v).orderBy("doc_id", "page_index", rank, "entry_id", "literal")
