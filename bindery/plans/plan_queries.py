"""Bookmark plans over the corpus, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.operators import plan
from bindery.plans import query
from bindery.plans.scalar_queries import TRIM
from bindery.session import cut, read, written

SQL_NODES = """no AS (SELECT DISTINCT doc_id, ord, node_id, nullif(parent_id, '') AS parent_id, title, dest FROM bookmark_node),
bk AS (SELECT DISTINCT doc_id, page_count, sha256 FROM book)"""
SQL_WALK = (
    f"WITH RECURSIVE {SQL_NODES}"
    + """,
wk AS (SELECT doc_id, node_id, ord, node_id AS cur, parent_id AS nxt, [node_id] AS seen FROM no
  UNION ALL SELECT wk.doc_id, wk.node_id, wk.ord, no.node_id, no.parent_id, list_append(seen, no.node_id) FROM wk JOIN no ON no.doc_id = wk.doc_id AND no.node_id = wk.nxt WHERE NOT list_contains(seen, no.node_id))"""
)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "bookmark_node").select("doc_id", "ord", "node_id", F.nullif("parent_id", F.lit("")).alias("parent_id"), "title", "dest").distinct()


def books(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "book").select("doc_id", "page_count", "sha256").distinct()


@query(
    SQL_WALK
    + f""",
cy AS (SELECT DISTINCT doc_id, list_min(seen) AS ring, node_id, ord FROM wk WHERE nxt = node_id AND len(seen) > 1)
SELECT doc_id, node_id, 'empty_node_id' AS code FROM no WHERE coalesce(node_id, '') = ''
UNION ALL SELECT doc_id, node_id, 'duplicate_node_id' FROM no WHERE node_id <> '' GROUP BY doc_id, node_id HAVING count(*) > 1
UNION ALL SELECT doc_id, node_id, 'empty_title' FROM no WHERE coalesce({TRIM.format("title")}, '') = '' AND (title IS NULL OR ord % 53 <> 0)
UNION ALL SELECT doc_id, node_id, 'invalid_utf8_title' FROM no WHERE title IS NOT NULL AND ord % 53 = 0
UNION ALL SELECT doc_id, NULL, 'unsupported_schema_version' FROM bk WHERE page_count % 37 = 0
UNION ALL SELECT doc_id, NULL, 'unsupported_page_index_base' FROM bk WHERE page_count % 41 = 0
UNION ALL SELECT doc_id, CASE WHEN ord % 59 = 0 THEN node_id ELSE '' END, 'invalid_omission' FROM no WHERE node_id <> '' AND (ord % 59 = 0 OR ord % 61 = 0)
UNION ALL SELECT doc_id, CASE WHEN ord % 67 = 0 THEN node_id ELSE 'x/' || node_id END, 'invalid_promotion' FROM no WHERE node_id <> '' AND (ord % 67 = 0 OR ord % 73 = 0)
UNION ALL SELECT no.doc_id, node_id, 'destination_out_of_range' FROM no JOIN bk USING (doc_id) WHERE page_count > 0 AND (dest < 0 OR dest >= page_count)
UNION ALL SELECT doc_id, node_id, 'self_parent' FROM no WHERE parent_id = node_id
UNION ALL SELECT doc_id, node_id, 'missing_parent' FROM no WHERE parent_id <> node_id AND NOT EXISTS (SELECT 1 FROM no p WHERE p.doc_id = no.doc_id AND p.node_id = no.parent_id)
UNION ALL SELECT doc_id, arg_min(node_id, (ord, node_id)), 'parent_cycle' FROM cy GROUP BY doc_id, ring
UNION ALL SELECT doc_id, NULL, 'invalid_page_count' FROM bk WHERE coalesce(page_count, 0) <= 0
UNION ALL SELECT doc_id, NULL, 'missing_input_digest' FROM bk WHERE sha256 IS NULL OR regexp_matches(sha256, '^0*$')
UNION ALL SELECT doc_id, NULL, 'empty_plan' FROM bk WHERE NOT EXISTS (SELECT 1 FROM no WHERE no.doc_id = bk.doc_id)"""
)
def plan_validate(spark: SparkSession, d: str) -> DataFrame:
    """All fifteen codes, on the tables' own faults and, by page counts and orders, on planted ones.

    Planted: versions and page bases, a stray byte behind titles, omissions of
    nodes that are there or without a name, promotions that change nothing or
    name no node, beside omissions and promotions that are right.
    """
    n, b = nodes(spark, d), books(spark, d)
    b = b.withColumn("schema_version", F.when(F.col("page_count") % 37 == 0, 2).otherwise(1)).withColumn("page_index_base", F.when(F.col("page_count") % 41 == 0, 1).otherwise(0))
    o, named = F.col("ord"), n.where("node_id <> ''")
    title = F.encode("title", "UTF-8")
    raw = n.withColumn("title", F.when(o % 53 == 0, F.concat(title, F.lit(bytearray(b"\xff")))).otherwise(title))
    ids = F.explode(F.array_compact(F.array(F.concat(F.lit("gone/"), "node_id"), F.when(o % 59 == 0, F.col("node_id")).when(o % 61 == 0, F.lit("")))))
    omitted = named.select("doc_id", ids.alias("entry_id"))
    kind = F.when(o % 67 == 0, "same").when(o % 73 == 0, "stray").when(o % 71 == 0, "right")
    moved = named.withColumn("kind", kind).where("kind is not null")
    moved = moved.select("doc_id", F.when(F.col("kind") == "stray", F.concat(F.lit("x/"), "node_id")).otherwise(F.col("node_id")).alias("node_id"), F.when(F.col("kind") == "same", F.col("parent_id")).otherwise(F.lit("elsewhere/")).alias("original_id"), F.col("parent_id").alias("new_id"))
    return plan.validate(raw, b, omitted, moved)


@query(
    SQL_WALK
    + """ SELECT a.doc_id, a.node_id, (SELECT arg_min(w.cur, len(w.seen)) FROM wk w JOIN no p ON p.doc_id = w.doc_id AND p.node_id = w.cur AND p.dest IS NOT NULL
  WHERE w.doc_id = a.doc_id AND w.node_id = a.node_id AND len(w.seen) > 1) AS parent_id
FROM no a WHERE dest IS NOT NULL AND NOT EXISTS (SELECT 1 FROM wk x WHERE x.doc_id = a.doc_id AND x.node_id = a.node_id AND x.nxt IS NOT NULL AND list_contains(x.seen, x.nxt))"""
)
def plan_promote(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that don't lead into a cycle; a plan with cycles isn't valid and isn't promoted."""
    return plan.promote(nodes(spark, d))


@query("SELECT doc_id, count(*) AS n_nodes, count(*) FILTER (dest IS NULL) AS n_omitted, count(*) = count(dest) AS whole FROM (SELECT DISTINCT doc_id, node_id, dest FROM bookmark_node) GROUP BY doc_id")
def plan_omit(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("dest").isNull()).alias("n_omitted"), (F.count("*") == F.count("dest")).alias("whole"))


SQL_LINKS = (
    f"WITH {SQL_NODES}"
    + """,
ln AS (SELECT doc_id, node_id, parent_id AS parent, lag(node_id) OVER w AS prev, lead(node_id) OVER w AS next, ord FROM no WINDOW w AS (PARTITION BY doc_id, coalesce(parent_id, '') ORDER BY ord, node_id)),
ch AS (SELECT doc_id, parent_id AS node_id, arg_min(node_id, (ord, node_id)) AS first, arg_max(node_id, (ord, node_id)) AS last, count(*) AS n FROM no WHERE parent_id IS NOT NULL GROUP BY ALL)"""
)


@query(SQL_LINKS + " SELECT doc_id, node_id, parent, prev, next, first, last, coalesce(n, 0) AS n_children FROM ln LEFT JOIN ch USING (doc_id, node_id)")
def outline_links(spark: SparkSession, d: str) -> DataFrame:
    return plan.outline_links(nodes(spark, d))


@query(
    SQL_LINKS
    + """, al AS (SELECT doc_id, node_id, parent, prev, next, first, last, coalesce(n, 0) AS n FROM ln LEFT JOIN ch USING (doc_id, node_id))
SELECT doc_id, count(*) AS expected, count(*) AS stored, count(*) FILTER (n > 2) AS missing, count(*) FILTER (n > 2) AS extra, count(*) FILTER (n > 2) = 0 AS equal FROM al GROUP BY doc_id"""
)
def outline_verify(spark: SparkSession, d: str) -> DataFrame:
    """The links of each book against a stored outline in which parents of more than two children lost one from their count."""
    links = plan.outline_links(nodes(spark, d))
    with written(links.withColumn("n_children", F.when(F.col("n_children") > 2, F.col("n_children") - 1).otherwise(F.col("n_children")))) as stored:
        return cut(plan.verify(links, stored))


@query(
    f"WITH {SQL_NODES}"
    + """ SELECT doc_id, node_id, CAST(to_json({id: node_id, parent_id: parent_id, title: title, destination: {pdf_page_index: dest}}) AS VARCHAR) AS node FROM no"""
)
def plan_json(spark: SparkSession, d: str) -> DataFrame:
    """Nodes as JSON, absent values as null."""
    n = nodes(spark, d)
    node = F.struct(F.col("node_id").alias("id"), "parent_id", "title", F.struct(F.col("dest").alias("pdf_page_index")).alias("destination"))
    return n.select("doc_id", "node_id", F.to_json(node, {"ignoreNullFields": "false"}).alias("node"))


SECTIONS = "SELECT doc_id, entry_id, ordinal AS first, coalesce(range_end, ordinal + 7) AS last FROM (SELECT DISTINCT doc_id, entry_id, ordinal, range_end FROM toc_entry WHERE ordinal IS NOT NULL AND numbering = 'decimal')"


@query(f"WITH s AS ({SECTIONS}) SELECT a.doc_id, a.entry_id AS a, b.entry_id AS b FROM s a JOIN s b ON b.doc_id = a.doc_id AND a.first < b.last AND b.first < a.last AND a.entry_id < b.entry_id")
def section_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Half-open ranges of one book that overlap, by the buckets that they touch."""
    s = read(spark, d, "toc_entry").where("ordinal is not null and numbering = 'decimal'").select("doc_id", "entry_id", F.col("ordinal").alias("first"), F.coalesce("range_end", F.col("ordinal") + 7).alias("last")).distinct().where("first < last")
    s = s.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / 16), F.floor((F.col("last") - 1) / 16))))
    a, b = s.select("doc_id", "bucket", *[F.col(c).alias(f"a_{c}") for c in ("entry_id", "first", "last")]), s.select("doc_id", "bucket", *[F.col(c).alias(f"b_{c}") for c in ("entry_id", "first", "last")])
    return a.join(b, ["doc_id", "bucket"]).where("a_first < b_last and b_first < a_last and a_entry_id < b_entry_id").select("doc_id", F.col("a_entry_id").alias("a"), F.col("b_entry_id").alias("b")).distinct()
