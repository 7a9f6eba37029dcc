"""Further rules over the corpus, with SQL: number repair, names, approximate headings, front matter, overrides, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions import text as T
from bindery.plans import query, rules
from bindery.plans.mapping_queries import SQL_MARGIN, body, latest_fragments, mapped, observations, toc_sources
from bindery.plans.scalar_queries import KEY, TOC, toc
from bindery.session import cut, read
from bindery.sources import corpus
from bindery.sources.corpus import PAGE, SQL_FRAGMENTS, SQL_PAGES, SQL_SPACES


@query(
    f"""SELECT DISTINCT doc_id, entry_id, damaged, CASE WHEN regexp_matches(joined, '^[0-9]{{2,4}}$') AND regexp_matches(damaged, '[ Il]') AND NOT regexp_matches(damaged, '^[0-9]{{2,}} [0-9]{{2,}}$') THEN joined END AS repaired FROM (
  SELECT doc_id, entry_id, damaged, replace(translate(damaged, 'Il', '11'), ' ', '') AS joined FROM (
    SELECT doc_id, entry_id, CASE ordinal % 4 WHEN 0 THEN replace(CAST(ordinal AS VARCHAR), '1', 'I') WHEN 1 THEN regexp_replace(CAST(ordinal AS VARCHAR), '^([0-9]+)([0-9])$', '\\1 \\2') WHEN 2 THEN CAST(ordinal AS VARCHAR) || ' ' || CAST(ordinal + 10 AS VARCHAR) ELSE CAST(ordinal AS VARCHAR) END AS damaged
    FROM ({TOC}) WHERE ordinal IS NOT NULL))"""
)
def number_repair(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that the text layer broke: a space inside or I and l for 1, of two to four digits; two whole numbers stay two."""
    n = F.col("ordinal")
    s = n.cast("string")
    damaged = F.when(n % 4 == 0, F.replace(s, F.lit("1"), F.lit("I"))).when(n % 4 == 1, F.regexp_replace(s, "^([0-9]+)([0-9])$", "$1 $2")).when(n % 4 == 2, F.concat(s, F.lit(" "), (n + 10).cast("string"))).otherwise(s)
    x = toc(spark, d).where("ordinal is not null").select("doc_id", "entry_id", damaged.alias("damaged")).distinct()
    joined = F.replace(F.translate("damaged", "Il", "11"), F.lit(" "), F.lit(""))
    ok = joined.rlike("^[0-9]{2,4}$") & F.col("damaged").rlike("[ Il]") & ~F.col("damaged").rlike("^[0-9]{2,} [0-9]{2,}$")
    return x.select("doc_id", "entry_id", "damaged", F.when(ok, joined).alias("repaired"))


@query(
    f"""SELECT doc_id, entry_id, damaged, regexp_replace(translate(regexp_extract(damaged, '^([0-9]{{1,2}}\\. ?[0-9Il]{{1,2}}) [A-Z]', 1), 'Il ', '11'), ' ', '') AS number FROM (
  SELECT DISTINCT doc_id, entry_id, (ord % 9 + 1) || '. ' || CASE ord % 3 WHEN 0 THEN 'I' || (ord % 10) WHEN 1 THEN 'l' ELSE CAST(ord % 10 AS VARCHAR) END || ' ' || title AS damaged FROM toc_entry WHERE title IS NOT NULL)
  WHERE regexp_matches(damaged, '^[0-9]{{1,2}}\\. ?[0-9Il]{{1,2}} [A-Z]')"""
)
def section_repair(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("ord")
    tail = F.when(o % 3 == 0, F.concat(F.lit("I"), (o % 10).cast("string"))).when(o % 3 == 1, F.lit("l")).otherwise((o % 10).cast("string"))
    x = toc(spark, d).where("title is not null").select("doc_id", "entry_id", F.concat((o % 9 + 1).cast("string"), F.lit(". "), tail, F.lit(" "), "title").alias("damaged")).distinct()
    number = F.translate(F.regexp_extract("damaged", r"^([0-9]{1,2}\. ?[0-9Il]{1,2}) [A-Z]", 1), "Il ", "11")
    return x.select("doc_id", "entry_id", "damaged", number.alias("number")).where("number <> ''")


@query(f"SELECT DISTINCT contributor_id, {rules.name_like('name')} AS name_like FROM contributor WHERE name IS NOT NULL")
def name_like(spark: SparkSession, d: str) -> DataFrame:
    """Two to five capitalised tokens, initials allowed, no stop word among them, small capitals told."""
    return read(spark, d, "contributor").where("name is not null").select("contributor_id", T.name_like(F.col("name")).alias("name_like")).distinct()


SQL_NEAR = (
    SQL_MARGIN
    + f""",
at_ AS (SELECT DISTINCT me.doc_id, me.entry_id, CAST(me.target AS INTEGER) AS page_index, regexp_replace({KEY.format("en.title")}, ' ', '', 'g') AS k FROM me JOIN en USING (doc_id, entry_id) WHERE target IS NOT NULL AND en.title IS NOT NULL),
ln_ AS (SELECT DISTINCT doc_id, page_index, regexp_replace(k1, ' ', '', 'g') AS k FROM hl)
SELECT a.doc_id, a.entry_id, a.page_index, min(levenshtein(a.k, l.k)) AS distance FROM at_ a JOIN ln_ l ON l.doc_id = a.doc_id AND l.page_index = a.page_index
WHERE strlen(a.k) >= 12 AND abs(strlen(a.k) - strlen(l.k)) <= strlen(a.k) // 20 AND levenshtein(a.k, l.k) <= strlen(a.k) // 20 GROUP BY ALL"""
)


@query(SQL_NEAR)
def approx_heading(spark: SparkSession, d: str) -> DataFrame:
    """Lines on the page that the offset names which differ from the title in at most one byte of twenty."""
    from bindery.operators import mapping

    o, b = cut(observations(spark, d)), body(spark, d)
    off = mapping.offsets(o, b).where("method is not null").select("doc_id", "offset").join(b, "doc_id")
    e = toc(spark, d).where("title is not null and numbering = 'decimal'").join(off, "doc_id").withColumn("page_index", F.col("ordinal") + F.col("offset")).where("page_index >= first")
    e = e.select("doc_id", "entry_id", "page_index", T.compact(F.col("title")).alias("a")).where(F.octet_length("a") >= 12).distinct()
    toc_pages = toc_sources(spark, d).select("doc_id", "page_index").distinct()
    f = latest_fragments(spark, d).join(toc_pages, ["doc_id", "page_index"], "left_anti").select("doc_id", "page_index", T.compact(F.col("text")).alias("b")).distinct()
    most = F.floor(F.octet_length("a") / 20).cast("int")
    x = e.join(f, ["doc_id", "page_index"]).where(F.abs(F.octet_length("a") - F.octet_length("b")) <= most)
    x = x.withColumn("distance", T.byte_distance(F.col("a"), F.col("b"), 100)).where((F.col("distance") >= 0) & (F.col("distance") <= most))
    return x.groupBy("doc_id", "entry_id", "page_index").agg(F.min("distance").cast("long").alias("distance"))


@query(
    SQL_MARGIN
    + """ SELECT doc_id, count(DISTINCT page_index + 0) AS n_pages, count(DISTINCT page_index - ordinal) AS n_offsets, CASE WHEN count(DISTINCT page_index - ordinal) = 1 THEN min(page_index - ordinal) END AS front_offset
  FROM ob WHERE style = 'roman' GROUP BY doc_id"""
)
def front_matter_split(spark: SparkSession, d: str) -> DataFrame:
    """Roman margin numbers of a book: a front matter of its own exactly if they agree on one offset."""
    off = F.col("page_index") - F.col("ordinal")
    g = observations(spark, d).where("style = 'roman'").groupBy("doc_id").agg(F.countDistinct("page_index").alias("n_pages"), F.countDistinct(off).alias("n_offsets"), F.min(off).alias("o"))
    return g.select("doc_id", "n_pages", "n_offsets", F.when(F.col("n_offsets") == 1, F.col("o")).alias("front_offset"))


@query(
    SQL_MARGIN
    + """ SELECT b.doc_id, CASE WHEN e.n IS NULL THEN 'no_entries' WHEN e.open = 0 THEN 'ready' WHEN e.done = 0 THEN 'blocked' ELSE 'partial' END AS outcome, coalesce(e.done, 0) AS resolved, coalesce(e.open, 0) AS open
FROM (SELECT DISTINCT doc_id FROM book) b LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (status = 'resolved') AS done, count(*) FILTER (status <> 'resolved') AS open FROM mp GROUP BY ALL) e USING (doc_id)"""
)
def analysis_outcome(spark: SparkSession, d: str) -> DataFrame:
    g = mapped(spark, d).groupBy("doc_id").agg(F.count_if(F.col("status") == "resolved").alias("done"), F.count_if(F.col("status") != "resolved").alias("open"))
    x = read(spark, d, "book").select("doc_id").distinct().join(g, "doc_id", "left")
    outcome = F.when(F.col("open").isNull(), "no_entries").when(F.col("open") == 0, "ready").when(F.col("done") == 0, "blocked").otherwise("partial")
    return x.select("doc_id", outcome.alias("outcome"), F.coalesce("done", F.lit(0)).alias("resolved"), F.coalesce("open", F.lit(0)).alias("open"))
