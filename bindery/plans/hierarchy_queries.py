"""Problem 2 over bookmark nodes and contents entries, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.operators.hierarchy import all_descendants, descendants, hierarchy
from bindery.session import read

BY = ["kind", "doc_id"]


def outline_records(spark: SparkSession, d: str) -> DataFrame:
    node = read(spark, d, "bookmark_node").select(F.lit("bookmark_node").alias("kind"), "doc_id", F.col("node_id").alias("rec_id"), "parent_id", "ord")
    toc = read(spark, d, "toc_entry").select(F.lit("toc_entry").alias("kind"), "doc_id", F.col("entry_id").alias("rec_id"), F.col("hierarchy.parent_id").alias("parent_id"), "ord")
    return node.unionByName(toc)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(outline_records(spark, d), BY, "rec_id", "parent_id", "ord")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy(outline_records(spark, d), BY, "rec_id", "parent_id", "ord", paths=True)
    return tree.select(*BY, "rec_id", "state", F.array_join("path", "\n").alias("path"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(hierarchy(outline_records(spark, d), BY, "rec_id", "parent_id", "ord", paths=True), BY)


def p2_descendants_all(spark: SparkSession, d: str) -> DataFrame:
    """``p2_descendants`` with all that lies on and below cycles."""
    return all_descendants(outline_records(spark, d), BY, "rec_id", "parent_id", "ord")


WALK = """
WITH RECURSIVE r AS (
  SELECT kind, doc_id, rec_id, min(parent_id) AS parent_id, count(parent_id) < count(*) AS top FROM (
    SELECT 'bookmark_node' AS kind, doc_id, node_id AS rec_id, nullif(parent_id, '') AS parent_id FROM bookmark_node
    UNION ALL
    SELECT 'toc_entry', doc_id, entry_id, nullif(hierarchy.parent_id, '') FROM toc_entry)
  WHERE doc_id IS NOT NULL AND rec_id IS NOT NULL
  GROUP BY kind, doc_id, rec_id),
n AS (SELECT kind, doc_id, rec_id, CASE WHEN top THEN NULL ELSE parent_id END AS parent_id FROM r),
w AS (
  SELECT kind, doc_id, rec_id, rec_id AS cur, parent_id AS nxt, [rec_id] AS seen FROM n
  UNION ALL
  SELECT w.kind, w.doc_id, w.rec_id, n.rec_id, n.parent_id, list_append(w.seen, n.rec_id)
  FROM w JOIN n ON n.kind = w.kind AND n.doc_id = w.doc_id AND n.rec_id = w.nxt
  WHERE NOT list_contains(w.seen, n.rec_id)),
e AS (SELECT kind, doc_id, rec_id, arg_max(cur, len(seen)) AS cur, arg_max(CASE WHEN nxt IS NULL THEN '' ELSE nxt END, len(seen)) AS nxt, arg_max(seen, len(seen)) AS seen FROM w GROUP BY ALL)
"""

SQL = {
    "p2_found": WALK
    + """
SELECT kind, doc_id, rec_id,
  CASE WHEN list_contains(seen, nxt) THEN list_min(seen[list_position(seen, nxt):]) ELSE cur END AS root_id,
  CAST(CASE WHEN list_contains(seen, nxt) THEN list_position(seen, nxt) - 1 ELSE len(seen) - 1 END AS INTEGER) AS depth,
  CASE WHEN nxt = '' THEN 'tree' WHEN NOT list_contains(seen, nxt) THEN 'orphan' WHEN list_position(seen, nxt) = 1 THEN 'cycle' ELSE 'below_cycle' END AS state
FROM e""",
    "p2_paths": WALK
    + """
SELECT kind, doc_id, rec_id,
  CASE WHEN nxt = '' THEN 'tree' WHEN NOT list_contains(seen, nxt) THEN 'orphan' WHEN list_position(seen, nxt) = 1 THEN 'cycle' ELSE 'below_cycle' END AS state,
  array_to_string(list_reverse(CASE WHEN list_contains(seen, nxt) THEN seen[:list_position(seen, nxt)] ELSE seen END), chr(10)) AS path
FROM e""",
    "p2_descendants": WALK
    + """
SELECT kind, doc_id, seen[i] AS rec_id, rec_id AS descendant, CAST(i - 1 AS INTEGER) AS distance
FROM (SELECT *, unnest(range(2, len(seen) + 1)) AS i FROM e WHERE nxt = '' OR NOT list_contains(seen, nxt))""",
    "p2_descendants_all": WALK
    + """
SELECT kind, doc_id, seen[i] AS rec_id, rec_id AS descendant, CAST(i - 1 AS INTEGER) AS distance
FROM (SELECT *, unnest(range(2, len(seen) + 1)) AS i FROM e)""",
}
