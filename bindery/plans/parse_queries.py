"""Columns, ids, merged hierarchy and evidence of contents pages, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.operators import detect, parse
from bindery.plans import query
from bindery.plans.detect_queries import LETTERS, REF, SQL_CANDIDATES, TAIL, scored
from bindery.plans.mapping_queries import NUM, SQL_ASM, SQL_LEFT, SQL_TOC, entry_lefts, toc_fragments, toc_sources
from bindery.plans.scalar_queries import LOW, TRIM, toc
from bindery.session import read
from bindery.sources import corpus
from bindery.sources.corpus import PAGE, SQL_FRAGMENTS, SQL_PAGES

SQL_TWO = f"""WITH RECURSIVE {SQL_FRAGMENTS}, {SQL_PAGES}, {SQL_TOC},
cw AS (SELECT fr.*, w.width FROM fr SEMI JOIN sp USING (doc_id, page_index, revision) JOIN (SELECT doc_id, page_index, revision, max(width) AS width FROM pg WHERE width > 0 GROUP BY ALL) w USING (doc_id, page_index, revision)),
c2 AS (SELECT doc_id, page_index, revision, text, l, r, region_id, width FROM cw
  UNION ALL SELECT doc_id, page_index, -revision, text, CASE WHEN region_id % 2 = 0 THEN l * 0.3 ELSE width * 0.5 + l * 0.3 END, CASE WHEN region_id % 2 = 0 THEN width * 0.4 ELSE width * 0.9 END, region_id, width FROM cw),
ci AS (SELECT *, (regexp_matches({TRIM.format("text")}, {TAIL}) AND regexp_matches(regexp_extract({TRIM.format("text")}, {TAIL}, 2), {REF}) AND length({LETTERS.format("regexp_extract(" + TRIM.format("text") + ", " + TAIL + ", 1)")}) >= 2) OR regexp_matches(text, {REF}) AS cited FROM c2),
cj AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index, revision ORDER BY r, region_id, text) AS i FROM ci WHERE cited),
ck AS (SELECT doc_id, page_index, revision, i, CAST(r AS DOUBLE) AS mean, 1 AS n, 1 AS cluster FROM cj WHERE i = 1
  UNION ALL SELECT cj.doc_id, cj.page_index, cj.revision, cj.i, CASE WHEN cj.r - ck.mean <= 18 THEN (ck.mean * ck.n + cj.r) / (ck.n + 1) ELSE cj.r END, CASE WHEN cj.r - ck.mean <= 18 THEN ck.n + 1 ELSE 1 END, ck.cluster + CASE WHEN cj.r - ck.mean <= 18 THEN 0 ELSE 1 END
  FROM ck JOIN cj ON cj.doc_id = ck.doc_id AND cj.page_index = ck.page_index AND cj.revision = ck.revision AND cj.i = ck.i + 1),
cl AS (SELECT doc_id, page_index, revision, cluster, max(n) AS n, arg_max(mean, i) AS mean FROM ck GROUP BY ALL),
cm AS (SELECT doc_id, page_index, revision, count(*) AS k, arg_min(n, cluster) AS n0, arg_max(n, cluster) AS n1, arg_min(mean, cluster) AS m0, arg_max(mean, cluster) AS m1 FROM cl GROUP BY ALL),
cp AS (SELECT DISTINCT doc_id, page_index, revision, max(width) OVER (PARTITION BY doc_id, page_index, revision) AS w FROM c2),
cq AS (SELECT cp.doc_id, cp.page_index, cp.revision, coalesce(k, 0) AS n_clusters, coalesce(k >= 2 AND n0 >= 2 AND n1 >= 2 AND (m1 - m0) / w >= 0.25, false) AS two, m0, m1, (SELECT min(l) FROM c2 WHERE c2.doc_id = cp.doc_id AND c2.page_index = cp.page_index AND c2.revision = cp.revision AND l > m0 + 0.02 * w) AS start FROM cp LEFT JOIN cm USING (doc_id, page_index, revision)),
cr AS (SELECT doc_id, page_index, revision, n_clusters, two, CASE WHEN two THEN (m0 + coalesce(start, m1)) / 2 END AS divider FROM cq)"""


def two_columned(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of contents pages, and each page again as books with two columns set it, which the corpus lacks (negative revisions)."""
    size = corpus.pages(spark, d).where("width > 0").groupBy(*PAGE).agg(F.max("width").alias("width"))
    f = toc_fragments(spark, d).join(size, PAGE)
    left = F.col("region_id") % 2 == 0
    w = F.col("width")
    made = f.withColumn("revision", -F.col("revision")).withColumn("l", F.when(left, F.col("l") * 0.3).otherwise(w * 0.5 + F.col("l") * 0.3)).withColumn("r", F.when(left, w * 0.4).otherwise(w * 0.9))
    return f.unionByName(made)


@query(SQL_TWO + " SELECT doc_id, page_index, revision, CAST(n_clusters AS BIGINT) AS n_clusters, two AS two_columns, CAST(floor(divider * 64) AS BIGINT) AS divider FROM cr")
def column_of(spark: SparkSession, d: str) -> DataFrame:
    """Whether a contents page has two columns and where they part, in sixty-fourths of a point."""
    return parse.page_columns(two_columned(spark, d)).select(*PAGE, F.col("n_clusters").cast("long").alias("n_clusters"), "two_columns", F.floor(F.col("divider") * 64).alias("divider"))


@query(SQL_TWO + " SELECT c2.doc_id, c2.page_index, c2.revision, CAST(CASE WHEN l >= divider THEN 1 ELSE 0 END AS INTEGER) AS column_, CAST(floor(max(r) * 64) AS BIGINT) AS measure, CAST(floor(min(l) * 64) AS BIGINT) AS baseline FROM c2 JOIN cr USING (doc_id, page_index, revision) GROUP BY ALL")
def column_measures(spark: SparkSession, d: str) -> DataFrame:
    """Of each column how far its text reaches and where it begins, in sixty-fourths of a point."""
    f = two_columned(spark, d)
    x = parse.in_columns(f, parse.page_columns(f))
    return x.groupBy(*PAGE, F.col("column").alias("column_")).agg(F.floor(F.max("r") * 64).alias("measure"), F.floor(F.min("l") * 64).alias("baseline"))


@query(
    SQL_ASM
    + f""", wv AS (SELECT *, {TRIM.format("text")} AS v FROM rows_), wu AS (SELECT *, CASE WHEN regexp_matches(v, {TAIL}) AND regexp_matches(regexp_extract(v, {TAIL}, 2), {REF}) AND length({LETTERS.format(f"regexp_extract(v, {TAIL}, 1)")}) >= 2 THEN regexp_extract(v, {TAIL}, 2) END AS token FROM wv)
SELECT doc_id, 'toc/p' || page_index || 'r' || revision || 'e' || ord AS entry_id, CAST(ord AS BIGINT) AS ord, token FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, revision, row) - 1 AS ord FROM wu WHERE token IS NOT NULL)"""
)
def entry_ids(spark: SparkSession, d: str) -> DataFrame:
    """Entries numbered through a book, with ids of page, revision and number."""
    x = parse.entry_ids(parse.wrapped(parse.assemble_rows(toc_fragments(spark, d))))
    return x.select("doc_id", "entry_id", F.col("ord").cast("long").alias("ord"), "token")


@query(
    f"""WITH {SQL_FRAGMENTS}, {SQL_TOC}, {SQL_LEFT},
hi AS (SELECT a.doc_id, a.entry_id, CASE WHEN a.indent <= 8 THEN 'root' WHEN p.entry_id IS NOT NULL THEN 'known_parent' ELSE 'unknown' END AS kind, CASE WHEN a.indent > 8 THEN p.entry_id END AS parent_id
  FROM li a LEFT JOIN (SELECT DISTINCT ON (x.doc_id, x.entry_id) x.doc_id, x.entry_id AS child, y.entry_id FROM li x JOIN li y ON y.doc_id = x.doc_id AND (y.ord < x.ord OR (y.ord = x.ord AND y.entry_id < x.entry_id)) AND y.indent + 16 <= x.indent ORDER BY x.doc_id, x.entry_id, y.ord DESC, y.entry_id DESC) p ON p.doc_id = a.doc_id AND p.child = a.entry_id),
nu AS (SELECT doc_id, entry_id, ord, {NUM} AS number FROM en WHERE {NUM} IS NOT NULL),
hn AS (SELECT DISTINCT a.doc_id, a.entry_id, (SELECT arg_max(b.entry_id, (b.ord, b.entry_id)) FROM nu b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND contains(a.number, '.') AND b.number = regexp_replace(a.number, '\\.[^.]*$', '')) AS by_number FROM nu a)
SELECT hi.doc_id, hi.entry_id, CASE WHEN by_number IS NOT NULL THEN 'known_parent' ELSE kind END AS kind, coalesce(by_number, parent_id) AS parent_id,
  CASE WHEN by_number IS NOT NULL AND parent_id IS NOT DISTINCT FROM by_number THEN 'both' WHEN by_number IS NOT NULL AND kind <> 'unknown' THEN 'number_overrides' WHEN by_number IS NOT NULL THEN 'number' WHEN kind = 'unknown' THEN 'none' ELSE 'indent' END AS reason FROM hi LEFT JOIN (SELECT * FROM hn WHERE by_number IS NOT NULL) hn USING (doc_id, entry_id)"""
)
def hierarchy_merged(spark: SparkSession, d: str) -> DataFrame:
    """Parents by number before parents by indentation."""
    return parse.merged_hierarchy(parse.by_indent(entry_lefts(spark, d)), parse.by_number(toc(spark, d)))


@query(
    f"""SELECT DISTINCT doc_id, entry_id, len(w) >= 3 OR (len(w) = 2 AND w[1] NOT IN ('part', 'chapter', 'section', 'appendix')) AS may_have FROM (
  SELECT doc_id, entry_id, list_filter(string_split({LOW.format(TRIM.format("title"))}, ' '), lambda q: q <> '') AS w FROM (SELECT doc_id, entry_id, title FROM toc_entry WHERE title IS NOT NULL UNION ALL SELECT doc_id, entry_id || '/label', 'Chapter ' || ord FROM toc_entry WHERE title IS NOT NULL))"""
)
def heading_references(spark: SparkSession, d: str) -> DataFrame:
    """Whether titles, and labels alone made of their orders, can have a reference behind them."""
    x = toc(spark, d).where("title is not null").select("doc_id", "entry_id", "ord", "title")
    made = x.select("doc_id", F.concat("entry_id", F.lit("/label")).alias("entry_id"), F.concat(F.lit("Chapter "), "ord").alias("title"))
    return x.select("doc_id", "entry_id", "title").unionByName(made).select("doc_id", "entry_id", parse.heading_with_reference(F.col("title")).alias("may_have")).distinct()


@query(SQL_CANDIDATES + " SELECT c.doc_id, c.first, p.page_index, s.status IS NULL AS missing FROM ca c, LATERAL (SELECT unnest(range(c.first, c.last + 1)) AS page_index) p LEFT JOIN pl s ON s.doc_id = c.doc_id AND s.page_index = p.page_index")
def candidate_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages of each candidate, and whether they were supplied."""
    c = detect.candidates(scored(spark, d)).select("doc_id", "first", F.explode(F.sequence(F.col("first").cast("long"), F.col("last").cast("long"))).alias("page_index"))
    there = corpus.latest(spark, d).select("doc_id", F.col("page_index").cast("long").alias("page_index"), F.lit(True).alias("there")).distinct()
    return c.join(there, ["doc_id", "page_index"], "left").select("doc_id", "first", "page_index", F.col("there").isNull().alias("missing"))


@query(
    f"""WITH {SQL_TOC}, {SQL_PAGES}, rk AS (SELECT DISTINCT doc_id, page_index, revision, region_id FROM text_region), pk AS (SELECT DISTINCT doc_id, page_index, revision FROM pg)
SELECT doc_id, count(*) AS n_sources, count(*) FILTER (NOT EXISTS (SELECT 1 FROM rk WHERE rk.doc_id = sp.doc_id AND rk.page_index = sp.page_index AND rk.revision = sp.revision AND rk.region_id = sp.region_id)) AS n_missing,
  count(*) FILTER (NOT EXISTS (SELECT 1 FROM la WHERE la.doc_id = sp.doc_id AND la.page_index = sp.page_index AND la.revision = sp.revision)) AS n_outdated FROM sp GROUP BY doc_id"""
)
def evidence_check(spark: SparkSession, d: str) -> DataFrame:
    """Regions that entries name: those that don't exist, and those of a page that was acquired again since."""
    s = toc_sources(spark, d)
    r = read(spark, d, "text_region").select(*PAGE, "region_id").distinct().withColumn("r", F.lit(True))
    p = corpus.latest(spark, d).select(*PAGE).distinct().withColumn("p", F.lit(True))
    x = s.join(r, [*PAGE, "region_id"], "left").join(p, PAGE, "left")
    return x.groupBy("doc_id").agg(F.count("*").alias("n_sources"), F.count_if(F.col("r").isNull()).alias("n_missing"), F.count_if(F.col("p").isNull()).alias("n_outdated"))


