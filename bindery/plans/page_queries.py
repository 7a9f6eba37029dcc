"""Pages: what is chosen of native and recognised text, geometry, sizes, caches and report, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.operators import acquire
from bindery.plans import query
from bindery.session import read
from bindery.sources import corpus
from bindery.sources.corpus import PAGE, SQL_PAGES, SQL_REGIONS

SPACES = acquire.SPACES
SQL_ASSESSED = f"""WITH {SQL_REGIONS}, {SQL_PAGES},
tv AS (SELECT doc_id, page_index, revision, region_id, replace(text, chr(10), '') AS v FROM (SELECT DISTINCT doc_id, page_index, revision, region_id, text FROM text_region WHERE text IS NOT NULL)),
tc AS (SELECT doc_id, page_index, revision, sum(length(v)) AS scalars, sum(length(regexp_replace(v, '[{SPACES}]', '', 'g'))) AS visible, sum(length(v) - length(replace(v, '�', ''))) AS replaced,
  sum(length(v) - length(regexp_replace(v, '[\\x00-\\x08\\x0A-\\x1F]', '', 'g'))) AS controls FROM tv GROUP BY ALL),
tb AS (SELECT doc_id, page_index, revision, max(b) - min(t) AS band FROM rg GROUP BY ALL),
aq AS (SELECT pg.doc_id, pg.page_index, pg.revision, source, outcome, coalesce(scalars, 0) AS scalars, coalesce(visible, 0) AS visible, coalesce(replaced, 0) AS replaced, coalesce(controls, 0) AS controls,
  coalesce(visible > 0 AND replaced * 2 < scalars AND controls * 2 < scalars, false) AS usable, coalesce(image_object_count * 0.5 >= 0.5 AND band < 0.25 * height, false) AS suspected
  FROM pg LEFT JOIN tc USING (doc_id, page_index, revision) LEFT JOIN tb USING (doc_id, page_index, revision)),
ar AS (SELECT *, CASE WHEN visible = 0 THEN 'unknown' WHEN usable AND replaced = 0 AND controls = 0 THEN 'acceptable' ELSE 'suspect' END AS readability,
  CASE WHEN suspected THEN 'suspected_incomplete' WHEN usable THEN 'no_omission_indicated' ELSE 'unknown' END AS coverage FROM aq)"""


@query(SQL_ASSESSED + " SELECT doc_id, page_index, revision, CAST(scalars AS BIGINT) AS scalars, CAST(visible AS BIGINT) AS visible, CAST(replaced AS BIGINT) AS replaced, CAST(controls AS BIGINT) AS controls, usable, readability, coverage FROM ar")
def page_assessment(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page's text can be used, its readability and coverage; an image object stands for half a page, as the tables have no image boxes."""
    x = acquire.assessed(corpus.pages(spark, d), corpus.texts(spark, d), corpus.regions(spark, d))
    return x.select(*PAGE, "scalars", "visible", "replaced", "controls", "usable", "readability", "coverage")


@query(
    SQL_ASSESSED
    + """, an AS (SELECT DISTINCT ON (doc_id, page_index) * FROM ar WHERE source <> 'ocr' AND outcome NOT IN ('failed', 'cancelled') ORDER BY doc_id, page_index, revision DESC, visible DESC, readability, coverage),
ao AS (SELECT DISTINCT ON (doc_id, page_index) * FROM ar WHERE source = 'ocr' AND outcome NOT IN ('failed', 'cancelled') ORDER BY doc_id, page_index, revision DESC, visible DESC, readability, coverage),
ap AS (SELECT DISTINCT doc_id, page_index FROM ar),
aj AS (SELECT doc_id, page_index, an.revision IS NOT NULL AS native, coalesce(an.usable, false) AS nu, coalesce(an.visible, 0) AS nv, an.readability AS nr, an.coverage AS nc, ao.revision IS NOT NULL AS seen, coalesce(ao.visible, 0) AS ov,
  ao.readability AS r2 FROM ap LEFT JOIN an USING (doc_id, page_index) LEFT JOIN ao USING (doc_id, page_index)),
ak AS (SELECT *, NOT nu OR nc = 'suspected_incomplete' AS need, seen AND ov > 0 AS ou, coalesce(nu AND seen AND ov > 0 AND nc = 'suspected_incomplete' AND ov > 2 * nv, false) AS prefer FROM aj)
SELECT doc_id, page_index, CASE WHEN nu AND NOT prefer THEN 'embedded_pdf' WHEN nu OR ou THEN 'ocr' END AS source,
  CASE WHEN nu THEN CASE WHEN nr = 'suspect' OR nc = 'suspected_incomplete' OR (need AND NOT ou) THEN 'degraded' ELSE 'ok' END WHEN ou THEN 'ok' WHEN (native AND nv = 0) OR (seen AND ov = 0) THEN CASE WHEN need AND NOT seen THEN 'failed' ELSE 'no_text_found' END ELSE 'failed' END AS outcome,
  prefer AS prefer_ocr FROM ak"""
)
def page_choice(spark: SparkSession, d: str) -> DataFrame:
    """Of each page the native or the recognised text, by what the latest attempt of each kind gave."""
    return acquire.choose(acquire.assessed(corpus.pages(spark, d), corpus.texts(spark, d), corpus.regions(spark, d)))


@query(f"WITH {SQL_PAGES}, p AS (SELECT DISTINCT doc_id, page_index, revision, width, height, 1 + page_index % 3 AS unit, CASE WHEN revision % 2 = 0 THEN 1 + page_index % 3 ELSE 1 END AS shown FROM pg WHERE width > 0 AND height > 0) SELECT doc_id, page_index, revision, CAST(unit AS BIGINT) AS unit, round(CASE WHEN abs(shown - unit) > 0.01 THEN width * unit ELSE width END, 3) AS w, round(CASE WHEN abs(shown - unit) > 0.01 THEN height * unit ELSE height END, 3) AS h FROM p")
def user_units(spark: SparkSession, d: str) -> DataFrame:
    """Page sizes that leave out the user unit are scaled by it; units and what odd revisions leave out are made of keys."""
    unit = 1 + F.col("page_index") % 3
    shown = F.when(F.col("revision") % 2 == 0, unit).otherwise(1)
    x = corpus.pages(spark, d).where("width > 0 and height > 0").select(*PAGE, "width", "height", unit.cast("long").alias("unit"), (F.col("width") / (F.col("width") / shown)).alias("ratio")).distinct()
    scaled = lambda c: F.round(F.when(F.abs(F.col("ratio") - F.col("unit")) > 0.01, F.col(c) * F.col("unit")).otherwise(F.col(c)), 3)
    return x.select(*PAGE, "unit", scaled("width").alias("w"), scaled("height").alias("h"))


@query(
    f"""WITH {SQL_PAGES}, p AS (SELECT DISTINCT doc_id, page_index, revision, width AS w, height AS h, page_index % 4 AS q FROM pg WHERE width > 0 AND height > 0),
m AS (SELECT *, CASE q WHEN 0 THEN [1, 0, 0, -1, 0, h] WHEN 1 THEN [0, 1, 1, 0, 0, 0] WHEN 2 THEN [-1, 0, 0, 1, w, 0] ELSE [0, -1, -1, 0, h, w] END AS t FROM p)
SELECT doc_id, page_index, revision, round(t[1], 2) AS a, round(t[2], 2) AS b, round(t[3], 2) AS c, round(t[4], 2) AS d, round(t[5], 1) AS e, round(t[6], 1) AS f, true AS invertible, 10.0::DOUBLE AS back_x, 20.0::DOUBLE AS back_y FROM m"""
)
def affine_fit(spark: SparkSession, d: str) -> DataFrame:
    """The map of a turned page from where three points come to lie on a device of a million steps, its inverse and a point there and back."""
    x = corpus.pages(spark, d).where("width > 0 and height > 0").select(*PAGE, "width", "height", (F.col("page_index") % 4).alias("q")).distinct()
    fit = acquire.fit(F.col("width"), F.col("height"), F.col("q"))
    x = x.withColumn("m", fit)
    det = F.col("m.a") * F.col("m.d") - F.col("m.b") * F.col("m.c")
    px, py = 10 * F.col("m.a") + 20 * F.col("m.c") + F.col("m.e"), 10 * F.col("m.b") + 20 * F.col("m.d") + F.col("m.f")
    bx, by = (F.col("m.d") * (px - F.col("m.e")) - F.col("m.c") * (py - F.col("m.f"))) / det, (F.col("m.a") * (py - F.col("m.f")) - F.col("m.b") * (px - F.col("m.e"))) / det
    r = lambda c, n: (F.round(c, n) + F.lit(0.0))
    return x.select(*PAGE, *[r(F.col(f"m.{c}"), 2 if c in "abcd" else 1).alias(c) for c in "abcdef"], (F.abs(det) >= 1e-12).alias("invertible"), r(bx, 3).alias("back_x"), r(by, 3).alias("back_y"))


@query(
    f"""WITH {SQL_PAGES}, s AS (SELECT DISTINCT doc_id, page_index, revision, CAST(ceil(width * 300 / 72) AS BIGINT) AS w0, CAST(ceil(height * 300 / 72) AS BIGINT) AS h0 FROM pg WHERE width > 0 AND height > 0),
t AS (SELECT *, CASE WHEN w0 + h0 < 64 THEN greatest(w0, 32) ELSE w0 END AS w, CASE WHEN w0 + h0 < 64 THEN greatest(h0, 32) ELSE h0 END AS h, unnest(['min', 'max', 'resize_long']) AS kind FROM s),
u AS (SELECT *, CASE WHEN kind = 'min' AND least(w, h) < 736 THEN 736.0::DOUBLE / least(w, h) WHEN kind = 'max' AND greatest(w, h) > 736 THEN 736.0::DOUBLE / greatest(w, h) WHEN kind = 'resize_long' THEN 736.0::DOUBLE / greatest(w, h) ELSE 1.0::DOUBLE END AS k FROM t),
v AS (SELECT *, floor(w * k) AS rw, floor(h * k) AS rh FROM u), x AS (SELECT *, CASE WHEN greatest(rw, rh) > 4000 THEN 4000.0::DOUBLE / greatest(rw, rh) ELSE 1.0::DOUBLE END AS cap FROM v)
SELECT doc_id, page_index, revision, kind, greatest(CAST(round_even(floor(rw * cap) / 32, 0) * 32 AS BIGINT), 32) AS det_w, greatest(CAST(round_even(floor(rh * cap) / 32, 0) * 32 AS BIGINT), 32) AS det_h FROM x"""
)
def detector_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The size that a detector takes by each of the three limits: smaller side at least, larger side at most, larger side exactly."""
    x = corpus.pages(spark, d).where("width > 0 and height > 0").select(*PAGE, F.ceil(F.col("width") * 300 / 72).alias("w"), F.ceil(F.col("height") * 300 / 72).alias("h")).distinct()
    return acquire.detector_sizes(x).select(*PAGE, "kind", "det_w", "det_h")


@query("SELECT vec_id, list_transform(range(1, len(embedding) + 1), lambda i: round((CAST(embedding[i] AS DOUBLE) / 255.0 - [0.485, 0.456, 0.406][(i - 1) % 3 + 1]) / [0.229, 0.224, 0.225][(i - 1) % 3 + 1], 4)) AS tensor FROM embeddings")
def normalized_tensor(spark: SparkSession, d: str) -> DataFrame:
    """Values of interleaved channels scaled to one and normalised by each channel's mean and deviation."""
    return read(spark, d, "embeddings").select("vec_id", F.transform(acquire.normalized(F.col("embedding")), lambda v: F.round(v, 4)).alias("tensor"))


QUADS = """qd AS (SELECT rg.*, region_id % 4 AS turn, [l, r, r, l] AS px, [t, t, b, b] AS py FROM rg),
qe AS (SELECT *, list_transform(range(4), lambda i: {x: px[CAST((i + turn) % 4 AS INTEGER) + 1], y: py[CAST((i + turn) % 4 AS INTEGER) + 1]}) AS pts FROM qd)"""


@query(
    f"""WITH {SQL_REGIONS}, {SQL_PAGES}, {QUADS},
pp AS (SELECT DISTINCT doc_id, page_index, revision, min(width) AS w, min(height) AS h FROM pg WHERE width >= 1 AND height >= 1 GROUP BY ALL),
qc AS (SELECT qe.*, trunc(greatest(0, least(l, floor(w) - 1))) AS x0, trunc(greatest(0, least(t, floor(h) - 1))) AS y0, trunc(greatest(0, least(r, floor(w) - 1))) AS x1, trunc(greatest(0, least(b, floor(h) - 1))) AS y1 FROM qe JOIN pp USING (doc_id, page_index, revision))
SELECT doc_id, page_index, revision, region_id, x0, y0, x1, y1 FROM qc WHERE x1 - x0 > 3 AND y1 - y0 > 3"""
)
def quad_order(spark: SparkSession, d: str) -> DataFrame:
    """Corners in any order put clockwise from the top left, cut at the page, boxes of three units or less left out.

    The corners are handed over beginning at another one for each region.
    """
    size = corpus.pages(spark, d).where("width >= 1 and height >= 1").groupBy(*PAGE).agg(F.min("width").alias("w"), F.min("height").alias("h"))
    k = F.col("region_id") % 4
    corner = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("l", "t"), ("r", "t"), ("r", "b"), ("l", "b"))])
    turned = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.element_at(corner, ((i + k) % 4 + 1).cast("int")))
    x = corpus.boxes(spark, d).join(size, PAGE).withColumn("q", acquire.clockwise(turned))
    cut_ = lambda v, top: F.floor(F.greatest(F.lit(0.0), F.least(v, F.floor(top) - 1))).cast("double")
    x = x.select(*PAGE, "region_id", cut_(F.col("q")[0]["x"], F.col("w")).alias("x0"), cut_(F.col("q")[0]["y"], F.col("h")).alias("y0"), cut_(F.col("q")[2]["x"], F.col("w")).alias("x1"), cut_(F.col("q")[2]["y"], F.col("h")).alias("y1"))
    return x.where("x1 - x0 > 3 and y1 - y0 > 3")


@query(
    f"""WITH RECURSIVE {SQL_REGIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index, revision ORDER BY t, l, region_id) AS i FROM rg),
f AS (SELECT doc_id, page_index, revision, i, [{{x: l, y: t, id: region_id}}] AS s FROM o WHERE i = 1
  UNION ALL SELECT o.doc_id, o.page_index, o.revision, o.i, list_concat(list_slice(s, 1, k), [{{x: l, y: t, id: region_id}}], list_slice(s, k + 1, len(s)))
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.page_index = f.page_index AND o.revision = f.revision AND o.i = f.i + 1,
  LATERAL (SELECT coalesce(list_max(list_filter(range(1, len(s) + 1), lambda j: NOT (abs(o.t - s[j].y) < 10 AND o.l < s[j].x))), 0) AS k))
SELECT doc_id, page_index, revision, CAST(arg_max(list_transform(s, lambda e: e.id), i) AS VARCHAR) AS ids FROM f GROUP BY ALL"""
)
def box_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Boxes from top to bottom; one that begins less than ten units below others but left of them goes before them."""
    x = acquire.reading_order(corpus.boxes(spark, d))
    return x.select(*PAGE, F.concat(F.lit("["), F.array_join(F.col("ids").cast("array<string>"), ", "), F.lit("]")).alias("ids"))


@query(
    """WITH m AS (SELECT vec_id, embedding AS e, CAST(vec_id % 5 AS BIGINT) AS x0, CAST(vec_id % 3 AS BIGINT) AS y0, CAST(least(7, vec_id % 5 + 1 + vec_id % 4) AS BIGINT) AS x1, CAST(least(7, vec_id % 3 + 2) AS BIGINT) AS y1 FROM embeddings WHERE len(embedding) >= 64)
SELECT vec_id, round(list_avg(list_transform(list_filter(range(64), lambda i: i % 8 BETWEEN x0 AND x1 AND i // 8 BETWEEN y0 AND y1), lambda i: CAST(e[i + 1] AS DOUBLE))), 5) AS score FROM m"""
)
def box_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean probability in a box of a map of eight by eight, the box's edges included; boxes are made of keys."""
    v = F.col("vec_id")
    x = read(spark, d, "embeddings").where(F.size("embedding") >= 64)
    return x.select("vec_id", F.round(acquire.box_score(F.col("embedding"), 8, v % 5, v % 3, F.least(F.lit(7), v % 5 + 1 + v % 4), F.least(F.lit(7), v % 3 + 2)), 5).alias("score"))


@query("SELECT DISTINCT doc_id, node_id, title AS label, false AS damaged FROM bookmark_node WHERE title IS NOT NULL AND node_id IS NOT NULL AND NOT contains(title, chr(0))")
def utf16_labels(spark: SparkSession, d: str) -> DataFrame:
    """Titles as bytes of UTF-16LE with an end mark, read back; an odd byte or half a pair would count as damage."""
    x = read(spark, d, "bookmark_node").where("title is not null and node_id is not null").where(~F.contains("title", F.lit("\x00")))
    raw = F.concat(F.encode("title", "UTF-16LE"), F.lit(bytearray(b"\x00\x00z\x00")))
    label, damaged = acquire.utf16(raw)
    return x.select("doc_id", "node_id", label.alias("label"), damaged.alias("damaged")).distinct()


@query(
    f"""WITH {SQL_PAGES} SELECT DISTINCT doc_id, page_index, revision, list_position(['ok', 'degraded', 'no_text_found', 'failed', 'cancelled'], outcome) - 1 AS outcome_code, outcome AS outcome_name,
  'mode=' || (list_position(['auto', 'embedded_pdf', 'ocr'], source) - 1) || ';dpi=300;max_pixels=80000000;max_bytes=320000000;max_dimension=20000;ocr_budget=64' AS configuration, CAST(least(greatest(page_index // 2, 1), 8) AS BIGINT) AS threads FROM pg WHERE outcome IS NOT NULL AND source IS NOT NULL"""
)
def configuration_ids(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes as codes and back, the settings a page was acquired with as one string, and threads for a number of cores (here the page's number)."""
    x = corpus.pages(spark, d).where("outcome is not null and source is not null")
    code = acquire.code(F.col("outcome"), acquire.OUTCOMES)
    threads = F.least(F.greatest(F.floor(F.col("page_index") / 2), F.lit(1)), F.lit(8)).cast("long")
    return x.select(*PAGE, code.alias("outcome_code"), acquire.name(code, acquire.OUTCOMES).alias("outcome_name"), acquire.configuration(F.col("source")).alias("configuration"), threads.alias("threads")).distinct()


@query(
    f"""WITH {SQL_PAGES}, p AS (SELECT DISTINCT doc_id, page_index, revision, source, outcome <> 'cancelled' AND NOT (source = 'ocr' AND outcome = 'failed') AS cacheable FROM pg WHERE outcome IS NOT NULL AND source IS NOT NULL)
SELECT doc_id, page_index, revision, source, bool_or(cacheable) AS cacheable, min(CASE WHEN min(CASE WHEN cacheable THEN revision END) IS NOT NULL THEN revision END) OVER (PARTITION BY doc_id, page_index, source ORDER BY revision ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cached FROM p GROUP BY doc_id, page_index, revision, source"""
)
def page_cache(spark: SparkSession, d: str) -> DataFrame:
    """For each acquisition the earlier one of the same page and kind that could have been taken again: neither cancelled nor a recognition that wasn't done."""
    x = corpus.pages(spark, d).where("outcome is not null and source is not null")
    x = x.groupBy(*PAGE, "source").agg(F.bool_or(acquire.cacheable(F.col("source"), F.col("outcome"))).alias("cacheable"))
    w = Window.partitionBy("doc_id", "page_index", "source").orderBy("revision").rowsBetween(Window.unboundedPreceding, -1)
    return x.select(*PAGE, "source", "cacheable", F.min(F.when(F.col("cacheable"), F.col("revision"))).over(w).alias("cached"))


@query(
    """WITH b AS (SELECT DISTINCT doc_id, least(page_count, 200) AS n FROM book WHERE page_count > 0)
SELECT doc_id, CAST(k AS BIGINT) AS batch, CAST(CASE WHEN k = 0 THEN 0 ELSE 20 + 20 * k END AS BIGINT) AS first, CAST(least(n, 40 + 20 * k) AS BIGINT) AS "end" FROM b, unnest(range(9)) r(k) WHERE k = 0 OR n > 20 + 20 * k"""
)
def search_batches(spark: SparkSession, d: str) -> DataFrame:
    """The prefixes in which a contents is searched: forty pages, then twenty more each time, two hundred at most, as the option says."""
    x = read(spark, d, "book").where("page_count > 0").select("doc_id", F.least("page_count", F.lit(200)).alias("n")).distinct()
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil((F.col("n") - 40) / 20)).cast("long")))
    x = x.select("doc_id", "n", k.alias("batch"))
    return x.select("doc_id", "batch", F.when(F.col("batch") == 0, 0).otherwise(20 + 20 * F.col("batch")).cast("long").alias("first"), F.least(F.col("n"), 40 + 20 * F.col("batch")).cast("long").alias("end"))


@query(
    f"""WITH {SQL_REGIONS}, {SQL_PAGES},
x AS (SELECT doc_id, page_index, revision, list({{id: region_id, text: text, box: [CAST(floor(l) AS BIGINT), CAST(floor(t) AS BIGINT), CAST(floor(r) AS BIGINT), CAST(floor(b) AS BIGINT)]}} ORDER BY region_id, text, l, t, r, b) AS regions FROM rg GROUP BY ALL),
p AS (SELECT DISTINCT doc_id, page_index, revision, outcome, source FROM la)
SELECT doc_id, CAST(to_json({{schema_version: 1, page_index_base: 0, pages: list({{page_index: page_index, revision: revision, outcome: outcome, source: source, regions: coalesce(regions, [])}} ORDER BY page_index, revision, outcome, source)}}) AS VARCHAR) AS report
FROM p LEFT JOIN x USING (doc_id, page_index, revision) GROUP BY doc_id"""
)
def text_report(spark: SparkSession, d: str) -> DataFrame:
    """The text of a book with outcomes, sources and regions as one JSON document."""
    return acquire.text_report(corpus.latest(spark, d), corpus.regions(spark, d))
