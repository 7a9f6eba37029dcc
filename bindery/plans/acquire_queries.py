"""Page acquisition decisions, geometry and recognition arithmetic, sources and sinks, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.plans import query
from bindery.session import folder, read
from bindery.sources import corpus, sinks
from bindery.sources.corpus import PAGE, SQL_PAGES, SQL_REGIONS


@query(
    f"""WITH {SQL_PAGES} SELECT doc_id, page_index, revision, source = 'ocr' AS ocr, sum(CASE WHEN source = 'ocr' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY revision, page_index ROWS UNBOUNDED PRECEDING) AS spent
  FROM (SELECT DISTINCT doc_id, page_index, revision, source FROM pg)"""
)
def ocr_budget(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("revision", "page_index").rowsBetween(Window.unboundedPreceding, 0)
    x = corpus.pages(spark, d).select(*PAGE, "source").distinct()
    return x.select(*PAGE, (F.col("source") == "ocr").alias("ocr"), F.sum(F.when(F.col("source") == "ocr", 1).otherwise(0)).over(w).alias("spent"))


@query(
    f"""WITH {SQL_PAGES} SELECT doc_id, ['complete', 'partial', 'cancelled'][CAST(max(CASE outcome WHEN 'cancelled' THEN 2 WHEN 'degraded' THEN 1 WHEN 'failed' THEN 1 ELSE 0 END) + 1 AS INTEGER)] AS status,
  count(*) FILTER (outcome = 'ok') AS n_ok, count(*) FILTER (outcome = 'degraded') AS n_degraded, count(*) FILTER (outcome = 'failed') AS n_failed, count(*) FILTER (outcome = 'no_text_found') AS n_no_text FROM la GROUP BY doc_id"""
)
def text_status(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("outcome")
    worst = F.max(F.when(o == "cancelled", 2).when(o.isin("degraded", "failed"), 1).otherwise(0))
    x = corpus.latest(spark, d).groupBy("doc_id").agg(worst.alias("w"), *[F.count_if(o == v).alias(f"n_{n}") for v, n in (("ok", "ok"), ("degraded", "degraded"), ("failed", "failed"), ("no_text_found", "no_text"))])
    return x.select("doc_id", F.when(F.col("w") == 2, "cancelled").when(F.col("w") == 1, "partial").otherwise("complete").alias("status"), "n_ok", "n_degraded", "n_failed", "n_no_text")


@query(f"WITH {SQL_PAGES} SELECT doc_id, outcome, count(*) AS n, count(DISTINCT source) AS n_sources, count(DISTINCT source) > 1 AS drift FROM pg GROUP BY doc_id, outcome")
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.pages(spark, d).groupBy("doc_id", "outcome").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"), (F.countDistinct("source") > 1).alias("drift"))


@query("SELECT doc_id, page_index, revision, count(*) AS copies, count(DISTINCT acquired_at) AS times FROM page GROUP BY ALL HAVING count(*) > 1")
def duplicate_pages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "page").groupBy(*PAGE).agg(F.count("*").alias("copies"), F.countDistinct("acquired_at").alias("times")).where("copies > 1")


@query(
    f"""WITH {SQL_REGIONS} SELECT doc_id, page_index, revision, region_id, string_agg(x, chr(10) ORDER BY i) AS flat FROM (
  SELECT doc_id, page_index, revision, 0 AS region_id, text AS x, region_id AS i FROM (SELECT DISTINCT doc_id, page_index, revision, region_id, text FROM text_region WHERE text IS NOT NULL)) GROUP BY ALL"""
)
def flat_text(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "text_region").where("text is not null").select(*PAGE, "region_id", "text").distinct()
    parts = F.array_sort(F.collect_list(F.struct("region_id", "text")))
    return x.groupBy(*PAGE).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("flat")).select(*PAGE, F.lit(0).alias("region_id"), "flat")


def _affine(x: Column, y: Column) -> tuple[Column, Column]:
    """A raster's pixel to points at 300 dpi, turned by a small angle: the map and its terms are fixed for the query."""
    return 0.24 * x - 0.01 * y + 3.0, 0.01 * x + 0.24 * y - 2.0


@query(
    f"""WITH {SQL_REGIONS}, q AS (SELECT *, l * 4 AS px, t * 4 AS py, r * 4 AS qx, b * 4 AS qy FROM rg),
m AS (SELECT *, [0.24 * px - 0.01 * py + 3, 0.24 * qx - 0.01 * py + 3, 0.24 * qx - 0.01 * qy + 3, 0.24 * px - 0.01 * qy + 3] AS xs, [0.01 * px + 0.24 * py - 2, 0.01 * qx + 0.24 * py - 2, 0.01 * qx + 0.24 * qy - 2, 0.01 * px + 0.24 * qy - 2] AS ys FROM q)
SELECT doc_id, page_index, revision, region_id, round(list_min(xs), 2) AS x0, round(list_min(ys), 2) AS y0, round(list_max(xs), 2) AS x1, round(list_max(ys), 2) AS y1,
  round((0.24 * (xs[1] - 3) + 0.01 * (ys[1] + 2)) / (0.24 * 0.24 + 0.01 * 0.01), 2) AS back_x, round((0.24 * (ys[1] + 2) - 0.01 * (xs[1] - 3)) / (0.24 * 0.24 + 0.01 * 0.01), 2) AS back_y FROM m"""
)
def affine_boxes(spark: SparkSession, d: str) -> DataFrame:
    l, t, r, b = (F.col(c) * 4 for c in ("l", "t", "r", "b"))
    corners = [_affine(x, y) for x, y in ((l, t), (r, t), (r, b), (l, b))]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    det = 0.24 * 0.24 + 0.01 * 0.01
    back_x, back_y = (0.24 * (xs[0] - 3) + 0.01 * (ys[0] + 2)) / det, (0.24 * (ys[0] + 2) - 0.01 * (xs[0] - 3)) / det
    out = [("x0", F.least(*xs)), ("y0", F.least(*ys)), ("x1", F.greatest(*xs)), ("y1", F.greatest(*ys)), ("back_x", back_x), ("back_y", back_y)]
    return corpus.boxes(spark, d).select(*PAGE, "region_id", *[F.round(v, 2).alias(n) for n, v in out])


@query(
    f"""WITH {SQL_PAGES}, s AS (SELECT DISTINCT doc_id, page_index, revision, width, height, CAST(ceil(width * 300 / 72) AS BIGINT) AS w, CAST(ceil(height * 300 / 72) AS BIGINT) AS h FROM pg WHERE width > 0 AND height > 0)
SELECT doc_id, page_index, revision, w, h, w <= 20000 AND h <= 20000 AND w * h <= 80000000 AND w * h * 3 <= 320000000 AS fits, round(w * 72.0 / width, 3) AS dpi_x, round(h * 72.0 / height, 3) AS dpi_y FROM s"""
)
def raster_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Raster size at 300 dpi against the four limits, and the resolution that whole pixels make of it."""
    x = corpus.pages(spark, d).where("width > 0 and height > 0").select(*PAGE, "width", "height", F.ceil(F.col("width") * 300 / 72).alias("w"), F.ceil(F.col("height") * 300 / 72).alias("h")).distinct()
    n = F.col("w") * F.col("h")
    fits = (F.col("w") <= 20000) & (F.col("h") <= 20000) & (n <= 80000000) & (n * 3 <= 320000000)
    return x.select(*PAGE, "w", "h", fits.alias("fits"), F.round(F.col("w") * 72.0 / F.col("width"), 3).alias("dpi_x"), F.round(F.col("h") * 72.0 / F.col("height"), 3).alias("dpi_y"))


@query(
    f"""WITH {SQL_REGIONS}, q AS (SELECT *, r - l AS w, b - t AS h FROM rg)
SELECT doc_id, page_index, revision, region_id, round(w * h * 1.4 / (2 * (w + h)), 6) AS unclip, h / w >= 1.5 AS turned, w > 3 AND h > 3 AS kept, CAST(greatest(w / h, 320.0::DOUBLE / 48) AS DOUBLE) AS ratio FROM q"""
)
def crop_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Offset by which a box grows, whether its crop is turned, whether it is large enough, and its width at the recogniser's height."""
    w, h = F.expr("r - l"), F.expr("b - t")
    return corpus.boxes(spark, d).select(*PAGE, "region_id", F.round(w * h * 1.4 / (2 * (w + h)), 6).alias("unclip"), (h / w >= 1.5).alias("turned"), ((w > 3) & (h > 3)).alias("kept"), F.greatest(w / h, F.lit(320.0 / 48)).alias("ratio"))


@query(
    f"""WITH {SQL_REGIONS}, q AS (SELECT *, (r - l) / (b - t) AS ratio, row_number() OVER (PARTITION BY doc_id, page_index, revision ORDER BY (r - l) / (b - t), region_id) AS rn FROM rg)
SELECT doc_id, page_index, revision, CAST((rn - 1) // 6 AS BIGINT) AS batch, count(*) AS n, CAST(ceil(48 * greatest(max(ratio), 320.0 / 48)) AS BIGINT) AS width FROM q GROUP BY ALL"""
)
def recognition_batches(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(*PAGE).orderBy(F.expr("(r - l) / (b - t)"), "region_id")
    x = corpus.boxes(spark, d).withColumn("ratio", F.expr("(r - l) / (b - t)")).withColumn("batch", F.floor((F.row_number().over(w) - 1) / 6))
    return x.groupBy(*PAGE, "batch").agg(F.count("*").alias("n"), F.ceil(48 * F.greatest(F.max("ratio"), F.lit(320.0 / 48))).alias("width"))


@query(
    """WITH s AS (SELECT vec_id, unnest(range(len(embedding) // 8)) AS step, embedding FROM embeddings),
c AS (SELECT vec_id, step, list_slice(embedding, step * 8 + 1, step * 8 + 8) AS p FROM s),
b AS (SELECT vec_id, step, list_position(p, list_max(p)) - 1 AS cls, CAST(list_max(p) AS DOUBLE) AS conf FROM c),
k AS (SELECT *, lag(cls) OVER (PARTITION BY vec_id ORDER BY step) AS before FROM b)
SELECT vec_id, coalesce(string_agg(CASE WHEN cls = 7 THEN ' ' ELSE chr(CAST(64 + cls AS INTEGER)) END, '' ORDER BY step) FILTER (kept), '') AS text, count(*) FILTER (kept) AS n, round(coalesce(avg(conf) FILTER (kept), 0), 5) AS confidence
FROM (SELECT *, cls <> 0 AND (before IS NULL OR before <> cls) AS kept FROM k) GROUP BY vec_id"""
)
def ctc_decode(spark: SparkSession, d: str) -> DataFrame:
    """Greedy decoding of each vector by itself, as steps of eight classes: the best class of a step, repeats and the blank 0 dropped, the last class a space."""
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 8).cast("int") - 1), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    best = F.transform(steps, lambda p: F.struct((F.array_position(p, F.array_max(p)) - 1).alias("cls"), F.array_max(p).cast("double").alias("conf")))
    x = read(spark, d, "embeddings").where(F.size("embedding") >= 8).select("vec_id", best.alias("s"))
    x = x.select("vec_id", F.filter("s", lambda e, i: (e["cls"] != 0) & ((i == 0) | (e["cls"] != F.element_at(F.col("s"), F.greatest(i, F.lit(1)))["cls"]))).alias("s"))
    letter = F.transform("s", lambda e: F.when(e["cls"] == 7, " ").otherwise(F.char((e["cls"] + 64).cast("int"))))
    n = F.size("s").cast("long")
    mean = F.aggregate("s", F.lit(0.0), lambda a, e: a + e["conf"]) / F.greatest(n, F.lit(1))
    return x.select("vec_id", F.array_join(letter, "").alias("text"), n.alias("n"), F.round(mean, 5).alias("confidence"))


SELECTIONS = "SELECT DISTINCT doc_id, page_count, CASE WHEN page_count % 4 = 0 THEN 'all' WHEN page_count % 4 = 1 THEN '1-' || least(page_count, 5) WHEN page_count % 4 = 2 THEN '2,' || page_count ELSE '1,3-4,' || page_count END AS sel FROM book WHERE page_count >= 6"


@query(
    f"""WITH s AS ({SELECTIONS}), p AS (SELECT doc_id, page_count, unnest(string_split(CASE WHEN sel = 'all' THEN '1-' || page_count ELSE sel END, ',')) AS piece FROM s),
q AS (SELECT doc_id, unnest(range(CAST(string_split(piece, '-')[1] AS BIGINT), CAST(string_split(piece, '-')[-1] AS BIGINT) + 1)) AS n FROM p)
SELECT doc_id, CAST(n - 1 AS BIGINT) AS page_index, count(*) AS times FROM q GROUP BY ALL"""
)
def page_selection(spark: SparkSession, d: str) -> DataFrame:
    """Pages named by ``all``, single numbers and ranges, counted from 1, as indices from 0; how often each is named."""
    n = F.col("page_count")
    text = F.when(n % 4 == 0, F.lit("all")).when(n % 4 == 1, F.concat(F.lit("1-"), F.least(n, F.lit(5)).cast("string"))).when(n % 4 == 2, F.concat(F.lit("2,"), n.cast("string"))).otherwise(F.concat(F.lit("1,3-4,"), n.cast("string")))
    x = read(spark, d, "book").where("page_count >= 6").select("doc_id", "page_count", text.alias("sel")).distinct()
    x = x.select("doc_id", F.explode(F.split(F.when(F.col("sel") == "all", F.concat(F.lit("1-"), F.col("page_count").cast("string"))).otherwise(F.col("sel")), ",")).alias("piece"))
    ends = F.split("piece", "-")
    x = x.select("doc_id", F.explode(F.sequence(ends[0].cast("long"), F.element_at(ends, -1).cast("long"))).alias("n"))
    return x.groupBy("doc_id", (F.col("n") - 1).alias("page_index")).agg(F.count("*").alias("times"))


FILE_CAP = 512 * 1024 * 1024


@query()
def file_identity(spark: SparkSession, d: str) -> DataFrame:
    """Digest and length of all files of the corpus's tables; rows only, as it reads files and not tables.

    A file above ``FILE_CAP`` is rejected by its length, before anything of
    it is read: its row has no digest. Empty files, which hold no table, aren't listed.
    ``file`` is the path below ``d``.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(d)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    x = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(d)
    file = F.substring("path", len(root) + 2, 1 << 20).alias("file")
    kept = x.where(F.col("length") <= FILE_CAP).select(file, "length", F.sha2("content", 256).alias("sha256"))
    return kept.unionByName(x.where(F.col("length") > FILE_CAP).select(file, "length", F.lit(None).cast("string").alias("sha256")))


@query(
    """SELECT doc_id, CAST(to_json({schema_version: 1, input: {sha256: sha256, page_count: page_count}, title: title}) AS VARCHAR) AS report FROM (SELECT DISTINCT doc_id, sha256, page_count, title FROM book)"""
)
def report_json(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "book").select("doc_id", "sha256", "page_count", "title").distinct()
    report = F.struct(F.lit(1).alias("schema_version"), F.struct("sha256", "page_count").alias("input"), "title")
    return x.select("doc_id", F.to_json(report, {"ignoreNullFields": "false"}).alias("report"))


@query(
    """WITH b AS (SELECT DISTINCT * FROM book), t AS (SELECT count(*) AS n FROM b), c AS (SELECT count(*) AS k FROM b WHERE title IS NOT NULL AND page_count % 5 = 0)
SELECT 'whole' AS copy, n AS expected, n AS stored, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, true AS equal FROM t UNION ALL SELECT 'changed', n, n, k, k, k = 0 FROM t, c"""
)
def write_verify(spark: SparkSession, d: str) -> DataFrame:
    """Books written beside their place, read again, compared both ways and put in place; a copy with changed titles must be told."""
    b = read(spark, d, "book").distinct()
    changed = b.withColumn("title", F.when(F.col("page_count") % 5 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    rows = []
    with folder(spark) as at:
        sinks.write_copy(b, f"{at}/book")
        rows.append(("whole", *sinks.compared(b, spark.read.schema(b.schema).parquet(f"{at}/book"))))
        rows.append(("changed", *sinks.compared(b, changed)))
    return spark.createDataFrame([(*r, r[3] == r[4] == 0) for r in rows], "copy string, expected long, stored long, missing long, extra long, equal boolean")
