"""Bibliographic metadata over the corpus, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions import text as T
from bindery.operators import metadata
from bindery.plans import query
from bindery.plans.scalar_queries import KEY
from bindery.session import read
from bindery.sources import corpus
from bindery.sources.corpus import PAGE, SQL_FRAGMENTS, SQL_PAGES

SQL_LINES = (
    f"WITH RECURSIVE {SQL_FRAGMENTS}, {SQL_PAGES}"
    + """,
fo AS (SELECT *, (t + b) / 2 AS y, row_number() OVER (PARTITION BY doc_id, page_index, revision ORDER BY (t + b) / 2, l, region_id, piece) AS i FROM fr SEMI JOIN la USING (doc_id, page_index, revision)),
lg AS (SELECT doc_id, page_index, revision, i, 1 AS line, t, b FROM fo WHERE i = 1
  UNION ALL SELECT fo.doc_id, fo.page_index, fo.revision, fo.i, lg.line + CASE WHEN abs(fo.y - (lg.t + lg.b) / 2) <= 0.4 * greatest(fo.b - fo.t, lg.b - lg.t) THEN 0 ELSE 1 END,
    CASE WHEN abs(fo.y - (lg.t + lg.b) / 2) <= 0.4 * greatest(fo.b - fo.t, lg.b - lg.t) THEN least(lg.t, fo.t) ELSE fo.t END, CASE WHEN abs(fo.y - (lg.t + lg.b) / 2) <= 0.4 * greatest(fo.b - fo.t, lg.b - lg.t) THEN greatest(lg.b, fo.b) ELSE fo.b END
  FROM lg JOIN fo ON fo.doc_id = lg.doc_id AND fo.page_index = lg.page_index AND fo.revision = lg.revision AND fo.i = lg.i + 1),
lx AS (SELECT fo.doc_id, fo.page_index, fo.revision, lg.line, string_agg(text, ' ' ORDER BY l, region_id, piece) AS text, min(fo.t) AS t, max(fo.b) AS b, max(fo.b - fo.t) AS h FROM fo JOIN lg USING (doc_id, page_index, revision, i) GROUP BY ALL)"""
)
def lines(spark: SparkSession, d: str) -> DataFrame:
    return metadata.page_lines(corpus.fragments(spark, d).join(corpus.latest(spark, d).select(*PAGE), PAGE, "left_semi"))


@query(SQL_LINES + " SELECT doc_id, page_index, revision, CAST(line AS INTEGER) AS line, text, round(h, 3) AS h FROM lx")
def page_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select(*PAGE, "line", "text", F.round("h", 3).alias("h"))


@query(
    f"""SELECT key, count(DISTINCT doc_id) AS books, count(DISTINCT contributor_id) AS n, bool_or(role = 'author') AS author, count(DISTINCT doc_id) >= 2 AS supported
  FROM (SELECT doc_id, contributor_id, role, {KEY.format("name")} AS key FROM contributor WHERE name IS NOT NULL) WHERE key <> '' GROUP BY key"""
)
def name_support(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "contributor").where("name is not null").select("doc_id", "contributor_id", "role", T.key(F.col("name")).alias("key")).where("key <> ''")
    g = x.groupBy("key").agg(F.countDistinct("doc_id").alias("books"), F.countDistinct("contributor_id").alias("n"), F.bool_or(F.col("role") == "author").alias("author"))
    return g.withColumn("supported", F.col("books") >= 2)
