"""Contents detection over the corpus, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions import text as T
from bindery.operators import detect
from bindery.plans import query
from bindery.sources import corpus
from bindery.sources.corpus import PAGE, SQL_FRAGMENTS, SQL_PAGES

REF = "'^([0-9]{1,4}|[A-Za-z]{1,3}-[0-9]{1,4}|[IVXLCDMivxlcdm]{1,8})$'"
TAIL = r"'(?s)^(.*[ \t\n\r\f\v.])([A-Za-z0-9-]+)$'"
LETTERS = r"regexp_replace({}, '[\x00-@\[-`{{-\x7F]', '', 'g')"
SQL_ROWS = f"""WITH RECURSIVE {SQL_FRAGMENTS}, {SQL_PAGES},
fp AS (SELECT fr.*, pg.width, pg.height FROM fr JOIN (SELECT DISTINCT doc_id, page_index, revision, width, height FROM pg) pg USING (doc_id, page_index, revision)),
tk AS (SELECT *, (t + b) / 2 AS y, CASE WHEN regexp_matches(text, {TAIL}) AND regexp_matches(regexp_extract(text, {TAIL}, 2), {REF})
    AND length({LETTERS.format(f"regexp_extract(text, {TAIL}, 1)")}) >= 2 THEN regexp_extract(text, {TAIL}, 2) END AS token,
    coalesce(contains(regexp_extract(text, {TAIL}, 1), '...'), false) AS leader, length({LETTERS.format("text")}) >= 2 AS titled FROM fp),
pc AS (SELECT n.doc_id, n.page_index, n.revision, n.region_id AS nid, n.piece AS np, n.text AS token, n.l AS nl, n.r AS nr, n.y AS ny, o.region_id AS oid, o.piece AS op, o.r AS o_r, n.width,
    greatest(4.0, 0.6 * greatest(n.b - n.t, o.b - o.t)) AS band, n.l - o.r AS gap, o.token IS NOT NULL AS inl
  FROM tk n JOIN tk o USING (doc_id, page_index, revision)
  WHERE n.token IS NULL AND regexp_matches(n.text, {REF}) AND o.titled AND NOT (n.region_id = o.region_id AND n.piece = o.piece)
    AND n.l - o.r >= 0 AND abs(n.y - o.y) <= greatest(4.0, 0.6 * greatest(n.b - n.t, o.b - o.t))),
pq AS (SELECT * FROM pc WHERE gap <= 0.35 * width OR (gap <= 0.8 * width AND NOT inl AND NOT EXISTS (
    SELECT 1 FROM tk k WHERE k.doc_id = pc.doc_id AND k.page_index = pc.page_index AND k.revision = pc.revision AND abs(k.y - pc.ny) <= pc.band AND k.r > pc.o_r AND k.l < pc.nl
      AND NOT (k.region_id = pc.nid AND k.piece = pc.np) AND NOT (k.region_id = pc.oid AND k.piece = pc.op)))),
pr AS (SELECT DISTINCT ON (doc_id, page_index, revision, nid, np) doc_id, page_index, revision, ny AS y, nr AS r, nid, oid, token FROM pq ORDER BY doc_id, page_index, revision, nid, np, o_r DESC, oid, op),
rw AS (SELECT doc_id, page_index, revision, y, r, leader, 1 AS pieces FROM tk WHERE token IS NOT NULL UNION ALL SELECT doc_id, page_index, revision, y, r, false, 2 FROM pr),
ro AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index, revision ORDER BY r, y, leader, pieces) AS i FROM rw),
mg AS (SELECT doc_id, page_index, revision, i, r AS hr, y AS hy, i AS head, leader, pieces FROM ro WHERE i = 1
  UNION ALL SELECT ro.doc_id, ro.page_index, ro.revision, ro.i,
    CASE WHEN abs(mg.hr - ro.r) <= 3 AND abs(mg.hy - ro.y) <= 2 THEN mg.hr ELSE ro.r END, CASE WHEN abs(mg.hr - ro.r) <= 3 AND abs(mg.hy - ro.y) <= 2 THEN mg.hy ELSE ro.y END,
    CASE WHEN abs(mg.hr - ro.r) <= 3 AND abs(mg.hy - ro.y) <= 2 THEN mg.head ELSE ro.i END, ro.leader, ro.pieces
  FROM mg JOIN ro ON ro.doc_id = mg.doc_id AND ro.page_index = mg.page_index AND ro.revision = mg.revision AND ro.i = mg.i + 1),
un AS (SELECT doc_id, page_index, revision, head, hr AS r, hy AS y, bool_or(leader) AS leader, sum(pieces) AS pieces FROM mg GROUP BY ALL),
uo AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index, revision ORDER BY r, y, leader, pieces) AS i FROM un),
cl AS (SELECT doc_id, page_index, revision, i, r, leader, r AS first FROM uo WHERE i = 1
  UNION ALL SELECT uo.doc_id, uo.page_index, uo.revision, uo.i, uo.r, uo.leader, CASE WHEN uo.r - cl.first <= 18 THEN cl.first ELSE uo.r END
  FROM cl JOIN uo ON uo.doc_id = cl.doc_id AND uo.page_index = cl.page_index AND uo.revision = cl.revision AND uo.i = cl.i + 1),
co AS (SELECT doc_id, page_index, revision, first, count(*) AS n, count(*) FILTER (leader) AS leaders, avg(r) AS mean FROM cl GROUP BY ALL HAVING count(*) >= 2),
vo AS (SELECT *, b - t AS h, row_number() OVER (PARTITION BY doc_id, page_index, revision ORDER BY y, b - t) AS i FROM tk),
vl AS (SELECT doc_id, page_index, revision, i, y, h, 1 AS lines FROM vo WHERE i = 1
  UNION ALL SELECT vo.doc_id, vo.page_index, vo.revision, vo.i, CASE WHEN vo.y - vl.y > greatest(4.0, 0.6 * greatest(vo.h, vl.h)) THEN vo.y ELSE vl.y END,
    CASE WHEN vo.y - vl.y > greatest(4.0, 0.6 * greatest(vo.h, vl.h)) THEN vo.h ELSE vl.h END, vl.lines + CASE WHEN vo.y - vl.y > greatest(4.0, 0.6 * greatest(vo.h, vl.h)) THEN 1 ELSE 0 END
  FROM vl JOIN vo ON vo.doc_id = vl.doc_id AND vo.page_index = vl.page_index AND vo.revision = vl.revision AND vo.i = vl.i + 1),
ln AS (SELECT doc_id, page_index, revision, max(lines) AS lines FROM vl GROUP BY ALL)"""
SQL_SCORES = (
    SQL_ROWS
    + r""",
hs AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM tk WHERE t <= 0.25 * height AND strlen(text) <= 48),
ht AS (SELECT *, list_filter(string_split(low, ' '), lambda w: w <> '') AS tok FROM hs),
hu AS (SELECT *, contains(low, 'contents') AS has, list_contains(tok, 'contents') AND len(list_filter(tok, lambda w: regexp_matches(w, '^([0-9]{1,4}|[ivxlcdm]{1,8})$'))) > 0
   AND len(list_filter(tok, lambda w: w <> 'contents' AND NOT regexp_matches(w, '^([0-9]{1,4}|[ivxlcdm]{1,8})$'))) = 0 AS running,
   token IS NULL AND (low IN ('index', 'glossary') OR contains(low, 'list of figures') OR contains(low, 'list of tables')) AS veto FROM ht),
hc AS (SELECT doc_id, page_index, revision, bool_or(has AND NOT running) AS heading, bool_or(has AND running) AS running_head, bool_or(veto) AS excluded FROM hu GROUP BY ALL),
sc AS (SELECT p.doc_id, p.page_index, p.revision, p.outcome, p.width, p.height,
   coalesce(f.n, 0) AS n, coalesce(m.merged, 0) AS merged, coalesce(ln.lines, 0) AS lines, coalesce(c.nrows, 0) AS nrows, coalesce(c.leaders, 0) AS leaders, coalesce(c.anchors, []) AS anchors,
   coalesce(heading, false) OR coalesce(running_head, false) AS cue, coalesce(excluded, false) AS excluded,
   p.outcome = 'degraded' OR coalesce(p.readability = 'suspect', false) OR coalesce(p.coverage = 'suspected_incomplete', false) AS degraded
  FROM pg p LEFT JOIN (SELECT doc_id, page_index, revision, count(*) AS n FROM tk WHERE width > 0 AND height > 0 GROUP BY ALL) f USING (doc_id, page_index, revision)
  LEFT JOIN (SELECT doc_id, page_index, revision, sum(pieces - 1) AS merged FROM un GROUP BY ALL) m USING (doc_id, page_index, revision)
  LEFT JOIN ln USING (doc_id, page_index, revision)
  LEFT JOIN (SELECT co.doc_id, co.page_index, co.revision, sum(co.n) AS nrows, sum(co.leaders) AS leaders, list_sort(list(co.mean / pg.width)) AS anchors FROM co JOIN pg USING (doc_id, page_index, revision) GROUP BY ALL) c USING (doc_id, page_index, revision)
  LEFT JOIN hc USING (doc_id, page_index, revision)),
sd AS (SELECT *, CASE WHEN n > merged THEN n - merged ELSE 1 END AS flat FROM sc),
se AS (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE least(1.0, nrows::DOUBLE / CASE WHEN len(anchors) <= 2 THEN greatest(least(flat, lines), 1) ELSE flat END) END AS density FROM sd),
sf AS (SELECT *, 2.0::DOUBLE * nrows + least(leaders, 3) + 2.0 * density + CASE WHEN cue THEN 2.0 ELSE 0.0 END - CASE WHEN excluded THEN 8.0 ELSE 0.0 END AS score FROM se),
ps AS (SELECT *, CASE WHEN outcome IS DISTINCT FROM 'no_text_found' AND outcome IS NOT NULL AND (outcome IN ('failed', 'cancelled') OR coalesce(width <= 0, true) OR coalesce(height <= 0, true)) THEN 'skipped'
   WHEN nrows >= 3 AND density >= 0.45 AND score >= 7 AND NOT excluded THEN 'candidate' ELSE 'rejected' END AS status FROM sf)"""
)
SQL_CANDIDATES = (
    SQL_SCORES
    + """,
pl AS (SELECT ps.* FROM ps JOIN la USING (doc_id, page_index, revision)),
cd AS (SELECT *, lag(page_index) OVER w AS prev, lag(anchors) OVER w AS pa FROM pl WHERE status = 'candidate' WINDOW w AS (PARTITION BY doc_id ORDER BY page_index)),
cm AS (SELECT cd.*, m.status AS ms, m.score AS mscore, m.anchors AS ma, m.nrows >= 3 AND NOT m.excluded AS mrows, page_index - prev AS far, prev IS NOT NULL AND EXISTS (SELECT 1 FROM unnest(cd.anchors) a(x), unnest(pa) b(y) WHERE abs(x - y) <= 0.08) AS agree
  FROM cd LEFT JOIN (SELECT doc_id, page_index + 1 AS nextp, status, score, anchors, nrows, excluded FROM pl) m ON m.doc_id = cd.doc_id AND m.nextp = cd.page_index AND m.status <> 'candidate'),
cn AS (SELECT *, coalesce(agree AND far = 2 AND ms = 'rejected' AND mrows AND EXISTS (SELECT 1 FROM unnest(pa) a(x), unnest(ma) b(y) WHERE abs(x - y) <= 0.08) AND EXISTS (SELECT 1 FROM unnest(ma) a(x), unnest(anchors) b(y) WHERE abs(x - y) <= 0.08), false) AS bridged FROM cm),
ce AS (SELECT *, coalesce(agree AND (far = 1 OR (far = 2 AND ms = 'skipped')), false) OR bridged AS joined FROM cn),
cf AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page_index) AS island FROM ce),
cg AS (SELECT doc_id, island, min(page_index) AS first, max(page_index) AS last, count(*) + count(*) FILTER (bridged) AS n_pages, (sum(score) + coalesce(sum(mscore) FILTER (bridged), 0)) / (count(*) + count(*) FILTER (bridged)) AS mean FROM cf GROUP BY ALL),
ca AS (SELECT g.doc_id, first, last, n_pages, last - first + 1 - n_pages AS gaps, mean + 0.5 * (n_pages - 1) - (last - first + 1 - n_pages) AS score,
   CASE WHEN first = 0 THEN 'closed' WHEN a.status IS NULL THEN 'may_continue' WHEN a.status = 'skipped' THEN 'unknown' ELSE 'closed' END AS start,
   CASE WHEN z.status IS NULL THEN 'may_continue' WHEN z.status = 'skipped' THEN 'unknown' ELSE 'closed' END AS "end"
  FROM cg g LEFT JOIN pl a ON a.doc_id = g.doc_id AND a.page_index = g.first - 1 LEFT JOIN pl z ON z.doc_id = g.doc_id AND z.page_index = g.last + 1)"""
)


@query(f"WITH {SQL_FRAGMENTS} SELECT doc_id, page_index, revision, region_id, piece, text, l, r, round(t, 3) AS t, round(b, 3) AS b FROM fr")
def corpus_fragments(spark: SparkSession, d: str) -> DataFrame:
    return corpus.fragments(spark, d).select(*PAGE, "region_id", "piece", "text", "l", "r", F.round("t", 3).alias("t"), F.round("b", 3).alias("b"))


@query(SQL_ROWS + " SELECT doc_id, page_index, revision, region_id, token, leader, r FROM tk WHERE token IS NOT NULL")
def toc_rows_inline(spark: SparkSession, d: str) -> DataFrame:
    f = corpus.fragments(spark, d).join(corpus.pages(spark, d).select(*PAGE, "width", "height").distinct(), PAGE)
    return detect.inline_rows(f).select(*PAGE, "region_id", "token", "leader", "r")


SPLIT = r"'(?s)^(.*[ \t\n\r\f\v.])([A-Za-z0-9-]+)$'"
SQL_APART = SQL_ROWS.replace(
    "tk AS (SELECT *",
    f"""fa AS (SELECT * FROM fp WHERE regexp_matches(text, {SPLIT}) AND r - l > 40),
fq AS (SELECT doc_id, page_index, -revision AS revision, region_id * 4 AS region_id, piece, trim(regexp_extract(text, {SPLIT}, 1), {corpus.SQL_SPACES}) AS text, l, l + (r - l) * CASE WHEN region_id % 2 = 0 THEN 0.6 ELSE 0.1 END AS r, t, b, width * CASE WHEN region_id % 2 = 0 THEN 1.0 ELSE 0.6 END AS width, height FROM fa
  UNION ALL SELECT doc_id, page_index, -revision, region_id * 4 + 1, piece, regexp_extract(text, {SPLIT}, 2), r - 12, r, t, b, width * CASE WHEN region_id % 2 = 0 THEN 1.0 ELSE 0.6 END, height FROM fa
  UNION ALL SELECT doc_id, page_index, -revision, region_id * 4 + 2, piece, '*', (l + r) / 2, (l + r) / 2 + 5, t, b, width * 0.6, height FROM fa WHERE region_id % 4 = 1),
fw AS (SELECT * REPLACE (max(width) OVER (PARTITION BY doc_id, page_index, revision) AS width) FROM fq WHERE text <> ''),
fu AS (SELECT doc_id, page_index, revision, region_id, piece, text, l, r, t, b, width, height FROM fp UNION ALL SELECT doc_id, page_index, revision, region_id, piece, text, l, r, t, b, width, height FROM fw),
tk AS (SELECT *""",
).replace("AS titled FROM fp)", "AS titled FROM fu)")


def apart(f: DataFrame) -> DataFrame:
    """Rows with a reference, set as the table of some books is: title and number in fragments of their own, wide apart on odd regions, with a mark between on some.

    The corpus has no such pages; these copies stand beside them under negative revisions.
    """
    pattern = r"^([\s\S]*[ \t\n\r\f\x0B.])([A-Za-z0-9-]+)$"
    x = f.where(F.col("text").rlike(pattern) & F.expr("r - l > 40")).withColumn("revision", -F.col("revision"))
    odd = F.col("region_id") % 2 != 0
    x = x.withColumn("width", F.when(odd, F.col("width") * 0.6).otherwise(F.col("width")))
    cols = ["region_id", "text", "l", "r"]
    made = lambda df, i, text, left, right: df.select(*[c for c in df.columns if c not in cols], (F.col("region_id") * 4 + i).alias("region_id"), text.alias("text"), left.alias("l"), right.alias("r"))
    title = made(x, 0, T.trim(F.regexp_extract("text", pattern, 1)), F.col("l"), F.col("l") + F.expr("r - l") * F.when(odd, 0.1).otherwise(0.6))
    number = made(x, 1, F.regexp_extract("text", pattern, 2), F.col("r") - 12, F.col("r"))
    mark = made(x.where("region_id % 4 = 1"), 2, F.lit("*"), F.expr("(l + r) / 2"), F.expr("(l + r) / 2 + 5"))
    return title.unionByName(number).unionByName(mark).where("text <> ''")


@query(SQL_APART + " SELECT doc_id, page_index, revision, nid AS region_id, oid AS title_id, token FROM pr")
def pair_title_reference(spark: SparkSession, d: str) -> DataFrame:
    f = corpus.fragments(spark, d).join(corpus.pages(spark, d).select(*PAGE, "width", "height").distinct(), PAGE)
    return detect.paired_rows(f.unionByName(apart(f)))


@query(SQL_ROWS + " SELECT doc_id, page_index, revision, round(y, 3) AS y, r, leader, CAST(pieces AS INTEGER) AS pieces FROM un")
def row_dedupe(spark: SparkSession, d: str) -> DataFrame:
    f = corpus.fragments(spark, d).join(corpus.pages(spark, d).select(*PAGE, "width", "height").distinct(), PAGE)
    return detect.reference_rows(f).select(*PAGE, F.round("y", 3).alias("y"), "r", "leader", "pieces")


@query(SQL_ROWS + " SELECT doc_id, page_index, revision, CAST(lines AS INTEGER) AS lines FROM ln")
def visual_lines(spark: SparkSession, d: str) -> DataFrame:
    f = corpus.fragments(spark, d).join(corpus.pages(spark, d).select(*PAGE, "width", "height").distinct(), PAGE)
    return detect.visual_lines(f)


@query(SQL_ROWS + " SELECT doc_id, page_index, revision, first, n, leaders, round(mean, 3) AS mean FROM co")
def reference_columns(spark: SparkSession, d: str) -> DataFrame:
    f = corpus.fragments(spark, d).join(corpus.pages(spark, d).select(*PAGE, "width", "height").distinct(), PAGE)
    return detect.columns(f).select(*PAGE, "first", "n", "leaders", F.round("mean", 3).alias("mean"))


@query(SQL_SCORES + " SELECT doc_id, page_index, revision, status, round(score, 3) AS score, CAST(nrows AS BIGINT) AS n_rows, CAST(leaders AS BIGINT) AS leaders, round(density, 3) AS density, len(anchors) AS n_anchors, degraded FROM ps")
def toc_page_score(spark: SparkSession, d: str) -> DataFrame:
    x = detect.page_scores(corpus.pages(spark, d), corpus.fragments(spark, d))
    return x.select(*PAGE, "status", F.round("score", 3).alias("score"), F.col("rows").alias("n_rows"), "leaders", F.round("density", 3).alias("density"), F.size("anchors").alias("n_anchors"), "degraded")


def scored(spark: SparkSession, d: str) -> DataFrame:
    pages = corpus.latest(spark, d)
    return detect.page_scores(pages, corpus.fragments(spark, d).join(pages.select(*PAGE), PAGE, "left_semi"))


@query(SQL_CANDIDATES + ' SELECT doc_id, first, last, n_pages, CAST(gaps AS BIGINT) AS gaps, round(score, 3) AS score, start, "end" FROM ca')
def toc_candidates(spark: SparkSession, d: str) -> DataFrame:
    return detect.candidates(scored(spark, d)).withColumn("score", F.round("score", 3)).withColumn("gaps", F.col("gaps").cast("long"))


@query(
    SQL_CANDIDATES
    + """ SELECT doc_id, first, round(score, 3) AS score, next IS NULL OR next < 0.9 * score AS chosen FROM (
  SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS next FROM ca WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, first)) WHERE rn = 1"""
)
def choose_candidate(spark: SparkSession, d: str) -> DataFrame:
    return detect.choose(detect.candidates(scored(spark, d))).withColumn("score", F.round("score", 3))
