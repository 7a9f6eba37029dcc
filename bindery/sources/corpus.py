"""Corpus tables in the form that the operators take: one row per key, usable boxes, lines as fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions.text import trim
from bindery.session import read

PAGE = ["doc_id", "page_index", "revision"]


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions with text and a usable box: finite, right of left, bottom below top; repeated rows once."""
    x = read(spark, d, "text_region").select(*PAGE, "region_id", "text", F.col("box_left").alias("l"), F.col("box_top").alias("t"), F.col("box_right").alias("r"), F.col("box_bottom").alias("b"))
    finite = [~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("l", "t", "r", "b")]
    x = x.where(F.col("text").isNotNull() & finite[0] & finite[1] & finite[2] & finite[3] & (F.col("r") > F.col("l")) & (F.col("b") > F.col("t")))
    return x.repartition(*PAGE).distinct()  # laid out by page once: neither this nor what groups or joins by page shuffles the texts again


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """The boxes of ``regions`` without their texts, which aren't shuffled."""
    x = read(spark, d, "text_region").where("text is not null").select(*PAGE, "region_id", F.col("box_left").alias("l"), F.col("box_top").alias("t"), F.col("box_right").alias("r"), F.col("box_bottom").alias("b"))
    for c in ("l", "t", "r", "b"):
        x = x.where(~F.isnan(c) & (F.abs(c) < float("inf")))
    return x.where("r > l and b > t").distinct()


def texts(spark: SparkSession, d: str) -> DataFrame:
    """All texts of regions, repeated rows once."""
    return read(spark, d, "text_region").where("text is not null").select(*PAGE, "region_id", "text").distinct()


def fragments(spark: SparkSession, d: str) -> DataFrame:
    """Lines of regions; a region of several lines is split into parts of equal height, blank ones dropped."""
    x = regions(spark, d).withColumn("_p", F.split("text", "\n")).withColumn("n", F.size("_p"))
    x = x.select(*PAGE, "region_id", "l", "r", "t", "b", "n", F.posexplode("_p").alias("piece", "_x")).withColumn("text", trim(F.col("_x"))).where("text <> ''")
    h = F.col("b") - F.col("t")
    return x.select(*PAGE, "region_id", "piece", "text", "l", "r", (F.col("t") + h * F.col("piece") / F.col("n")).alias("t"), (F.col("t") + h * (F.col("piece") + 1) / F.col("n")).alias("b"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Acquired pages, each key once."""
    return read(spark, d, "page").select(*PAGE, "outcome", "source", "width", "height", "readability", "coverage", "image_object_count").distinct()


def latest(spark: SparkSession, d: str) -> DataFrame:
    """Of each page the acquisition of the highest revision."""
    top = read(spark, d, "page").groupBy("doc_id", "page_index").agg(F.max("revision").alias("revision"))
    return pages(spark, d).join(top, PAGE, "left_semi")


SQL_SPACES = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
SQL_REGIONS = """rg AS (SELECT DISTINCT doc_id, page_index, revision, region_id, text, box_left AS l, box_top AS t, box_right AS r, box_bottom AS b
  FROM text_region WHERE text IS NOT NULL AND isfinite(box_left) AND isfinite(box_top) AND isfinite(box_right) AND isfinite(box_bottom) AND box_right > box_left AND box_bottom > box_top)"""
SQL_FRAGMENTS = SQL_REGIONS + f""",
fx AS (SELECT *, string_split(text, chr(10)) AS p, unnest(range(0, len(string_split(text, chr(10))))) AS piece FROM rg),
fr AS (SELECT doc_id, page_index, revision, region_id, CAST(piece AS INTEGER) AS piece, trim(p[piece + 1], {SQL_SPACES}) AS text, l, r,
  t + (b - t) * piece / len(p) AS t, t + (b - t) * (piece + 1) / len(p) AS b FROM fx WHERE trim(p[piece + 1], {SQL_SPACES}) <> '')"""
SQL_PAGES = """pg AS (SELECT DISTINCT doc_id, page_index, revision, outcome, source, width, height, readability, coverage, image_object_count FROM page),
la AS (SELECT pg.* FROM pg JOIN (SELECT doc_id, page_index, max(revision) AS revision FROM page GROUP BY ALL) USING (doc_id, page_index, revision))"""
