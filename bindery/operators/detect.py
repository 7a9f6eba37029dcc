"""Which pages are contents pages: rows that end in a reference, their columns, page scores and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions.text import REFERENCE, inline_leader, inline_token, lower_ascii, title_like
from bindery.session import cut
from bindery.sources.corpus import PAGE

ALIGN = 18.0
MIN_ROWS, MIN_RATIO, MIN_SCORE, MAX_GAP = 3, 0.45, 7.0, 1


def marked(fragments: DataFrame) -> DataFrame:
    """Fragments (with the page's ``width, height``) with what is asked of their text, each question once."""
    t = F.col("text")
    x = fragments.withColumn("token", inline_token(t)).withColumn("leader", inline_leader(t)).withColumn("titled", title_like(t))
    x = x.withColumn("alone", F.col("token").isNull() & t.rlike(REFERENCE)).withColumn("y", (F.col("t") + F.col("b")) / 2).withColumn("h", F.expr("b - t"))
    low = lower_ascii(t)
    words = F.filter(F.split(low, " "), lambda w: w != "")
    folio = lambda w: w.rlike("^[0-9]{1,4}$") | w.rlike("^[ivxlcdm]{1,8}$")
    running = F.forall(words, lambda w: (w == "contents") | folio(w)) & F.exists(words, folio) & F.array_contains(words, "contents")
    top = (F.col("t") <= 0.25 * F.col("height")) & (F.octet_length("text") <= 48)
    has = top & F.contains(low, F.lit("contents"))
    veto = top & F.col("token").isNull() & (low.isin("index", "glossary") | F.contains(low, F.lit("list of figures")) | F.contains(low, F.lit("list of tables")))
    return x.withColumn("heading", has & ~running).withColumn("running_head", has & running).withColumn("excluded", veto)


def packed(fragments: DataFrame) -> DataFrame:
    """A row for each page: ``f`` (its fragments), ``found`` (rows with a reference), ``lines``, and the cues of its headings.

    Everything about a page is a fold over its fragments, so the corpus is
    grouped by page once and nothing is joined.
    """
    f = F.array_sort(F.collect_list(F.struct("y", "h", "l", "r", "region_id", "piece", "token", "leader", "titled", "alone", "text")))
    g = marked(fragments).groupBy(*PAGE).agg(f.alias("f"), F.max("width").alias("w"), F.bool_or("heading").alias("heading"), F.bool_or("running_head").alias("running_head"), F.bool_or("excluded").alias("excluded"))
    inline = "transform(filter(f, x -> x.token is not null), x -> named_struct('r', x.r, 'y', x.y, 'leader', x.leader, 'pieces', 1, 'region_id', x.region_id, 'title_id', cast(null as int), 'token', x.token))"
    # of the titles to the left of a reference the nearest: wide gaps only for titles without a reference and with nothing between
    between = "exists(f, k -> abs(k.y - n.y) <= greatest(4.0D, 0.6D * greatest(n.h, o.h)) and k.r > o.r and k.l < n.l and not (k.region_id = n.region_id and k.piece = n.piece) and not (k.region_id = o.region_id and k.piece = o.piece))"
    beside = "o.titled and n.l - o.r >= 0 and n.l - o.r <= 0.8D * w and abs(n.y - o.y) <= greatest(4.0D, 0.6D * greatest(n.h, o.h)) and not (o.region_id = n.region_id and o.piece = n.piece)"
    best = f"array_max(transform(filter(f, o -> {beside} and (n.l - o.r <= 0.35D * w or (o.token is null and not {between}))), o -> struct(o.r as r, -o.region_id as id, -o.piece as piece)))"
    pairs = f"transform(filter(f, n -> n.alone), n -> named_struct('n', n, 'o', {best}))"
    paired = "transform(filter(p, x -> x.o is not null), x -> named_struct('r', x.n.r, 'y', x.n.y, 'leader', false, 'pieces', 2, 'region_id', x.n.region_id, 'title_id', -x.o.id, 'token', x.n.text))"
    g = g.withColumn("p", F.expr(pairs)).withColumn("found", F.expr(f"concat({inline}, {paired})")).drop("p")
    lines = """
        aggregate(f, named_struct('n', 0, 'y', cast(0 as double), 'h', cast(0 as double)), (a, x) ->
          if(a.n = 0 or x.y - a.y > greatest(4.0D, 0.6D * greatest(x.h, a.h)), named_struct('n', a.n + 1, 'y', x.y, 'h', x.h), a), a -> a.n)"""
    return g.withColumn("lines", F.expr(lines))


def folded(pages: DataFrame) -> DataFrame:
    """``packed`` pages with ``rows``, those that describe one line merged, and ``cols``, the columns of right edges.

    Rows within three units of the one before merge with it. A column begins
    where a right edge lies further than 18 units from the column's first; of
    one row there is none.
    """
    merged = """
        aggregate(array_sort(transform(found, x -> named_struct('r', x.r, 'y', x.y, 'leader', x.leader, 'pieces', x.pieces))), cast(array() as array<struct<r:double,y:double,leader:boolean,pieces:int>>), (out, x) ->
          if(size(out) > 0 and abs(element_at(out, -1).r - x.r) <= 3 and abs(element_at(out, -1).y - x.y) <= 2,
             concat(slice(out, 1, size(out) - 1), array(named_struct('r', element_at(out, -1).r, 'y', element_at(out, -1).y,
               'leader', element_at(out, -1).leader or x.leader, 'pieces', element_at(out, -1).pieces + x.pieces))),
             concat(out, array(x))))"""
    cols = f"""
        filter(aggregate(rows, cast(array() as array<struct<first:double,n:bigint,leaders:bigint,total:double>>), (out, x) ->
          if(size(out) > 0 and x.r - element_at(out, -1).first <= {ALIGN}D,
             concat(slice(out, 1, size(out) - 1), array(named_struct('first', element_at(out, -1).first, 'n', element_at(out, -1).n + 1L, 'leaders', element_at(out, -1).leaders + if(x.leader, 1L, 0L), 'total', element_at(out, -1).total + x.r))),
             concat(out, array(named_struct('first', x.r, 'n', 1L, 'leaders', if(x.leader, 1L, 0L), 'total', x.r))))), c -> c.n >= 2)"""
    return pages.withColumn("rows", F.expr(merged)).withColumn("cols", F.expr(cols))


def inline_rows(fragments: DataFrame) -> DataFrame:
    """Fragments that end in a reference of their own."""
    return marked(fragments).where("token is not null").select(*PAGE, "y", "r", "leader", "region_id", "token")


def paired_rows(fragments: DataFrame) -> DataFrame:
    """``page, region_id, title_id, token``: references alone in a fragment with the nearest title to their left."""
    x = packed(fragments).select(*PAGE, F.explode("found").alias("x")).where("x.title_id is not null")
    return x.select(*PAGE, "x.region_id", "x.title_id", "x.token")


def reference_rows(fragments: DataFrame) -> DataFrame:
    """``page, y, r, leader, pieces``: rows with a reference, those that describe one line merged."""
    return folded(packed(fragments)).select(*PAGE, F.explode("rows").alias("x")).select(*PAGE, "x.y", "x.r", "x.leader", "x.pieces")


def columns(fragments: DataFrame) -> DataFrame:
    """``page, first, n, leaders, mean``: clusters of right edges within 18 points of their first, of two rows or more."""
    x = folded(packed(fragments)).select(*PAGE, F.explode("cols").alias("x"))
    return x.select(*PAGE, "x.first", "x.n", "x.leaders", (F.col("x.total") / F.col("x.n")).alias("mean"))


def visual_lines(fragments: DataFrame) -> DataFrame:
    """``page, lines``: a line begins where a centre is further than ``max(4, .6 h)`` below the line's first."""
    return packed(fragments).select(*PAGE, "lines")


def page_scores(pages: DataFrame, fragments: DataFrame) -> DataFrame:
    """``page, status, score, rows, leaders, density, anchors, excluded`` of every page.

    Failed and cancelled pages and pages without size are skipped, pages
    without text rejected. Anchors are the columns' mean right edges as shares
    of the width.
    """
    f = fragments.join(pages.select(*PAGE, "width", "height").distinct(), PAGE).where("width > 0 and height > 0")
    p = folded(packed(f))
    sums = {"n": F.size("f").cast("long"), "merged": F.expr("aggregate(rows, 0, (s, x) -> s + x.pieces - 1)").cast("long"), "rows": F.expr("aggregate(cols, 0L, (s, c) -> s + c.n)"), "leaders": F.expr("aggregate(cols, 0L, (s, c) -> s + c.leaders)"), "anchors": F.array_sort(F.transform("cols", lambda c: c["total"] / c["n"] / F.col("w")))}
    p = p.select(*PAGE, "lines", "heading", "running_head", "excluded", *[v.alias(k) for k, v in sums.items()])
    x = pages.join(p, PAGE, "left")
    x = x.fillna({"n": 0, "merged": 0, "lines": 0, "rows": 0, "leaders": 0, "heading": False, "running_head": False, "excluded": False}).withColumn("anchors", F.coalesce("anchors", F.array().cast("array<double>")))
    flat = F.when(F.col("n") > F.col("merged"), F.col("n") - F.col("merged")).otherwise(1)
    lines = F.when(F.size("anchors") <= 2, F.greatest(F.least(flat, F.col("lines")), F.lit(1))).otherwise(flat)
    x = x.withColumn("density", F.when(F.col("n") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("rows") / lines)))
    score = 2.0 * F.col("rows") + F.least("leaders", F.lit(3)) + 2.0 * F.col("density") + F.when(F.col("heading") | F.col("running_head"), 2.0).otherwise(0.0) - F.when(F.col("excluded"), 8.0).otherwise(0.0)
    x = x.withColumn("score", score)
    good = (F.col("rows") >= MIN_ROWS) & (F.col("density") >= MIN_RATIO) & (F.col("score") >= MIN_SCORE) & ~F.col("excluded")
    skipped = F.col("outcome").isin("failed", "cancelled") | F.col("outcome").isNull() | F.coalesce(F.col("width") <= 0, F.lit(True)) | F.coalesce(F.col("height") <= 0, F.lit(True))
    status = F.when((F.col("outcome") != "no_text_found") & skipped, "skipped").when(good, "candidate").otherwise("rejected")
    degraded = (F.col("outcome") == "degraded") | F.coalesce(F.col("readability") == "suspect", F.lit(False)) | F.coalesce(F.col("coverage") == "suspected_incomplete", F.lit(False))
    return x.select(*PAGE, status.alias("status"), "score", "rows", "leaders", "density", "anchors", "excluded", degraded.alias("degraded"))


def candidates(scores: DataFrame) -> DataFrame:
    """``doc_id, first, last, n_pages, gaps, score, start, end``: islands of candidate pages.

    Pages join where their anchors agree within .08 of the width and at most
    one page lies between them: one that was skipped, which is a gap, or one
    that was rejected though it has rows enough in the same columns, which then
    belongs to them. ``scores`` has one row per page.
    """
    scores = cut(scores.select("doc_id", "page_index", "status", "score", "anchors", "rows", "excluded"))  # read four times; a row for each page
    doc = Window.partitionBy("doc_id").orderBy("page_index")
    around = scores.select("doc_id", (F.col("page_index")).alias("p"), F.col("status").alias("s"))
    alike = lambda one, other: F.exists(one, lambda a: F.exists(other, lambda b: F.abs(a - b) <= 0.08))
    middle = scores.where("status <> 'candidate'").select("doc_id", (F.col("page_index") + 1).alias("page_index"), F.col("status").alias("m"), F.col("score").alias("m_score"), F.col("anchors").alias("m_anchors"), ((F.col("rows") >= MIN_ROWS) & ~F.col("excluded")).alias("m_rows"))
    c = scores.where("status = 'candidate'").withColumn("prev", F.lag("page_index").over(doc)).withColumn("prev_anchors", F.lag("anchors").over(doc))
    c = c.join(middle, ["doc_id", "page_index"], "left")
    far = F.col("page_index") - F.col("prev")
    agree = alike("anchors", "prev_anchors")
    bridged = agree & (far == 2) & (F.col("m") == "rejected") & F.col("m_rows") & alike("prev_anchors", "m_anchors") & alike("m_anchors", "anchors")
    joined = agree & ((far == 1) | ((far == 2) & (F.col("m") == "skipped"))) | bridged
    c = c.withColumn("bridged", F.coalesce(bridged, F.lit(False))).withColumn("island", F.sum(F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).over(doc))
    n = F.count("*") + F.count_if("bridged")
    g = c.groupBy("doc_id", "island").agg(F.min("page_index").alias("first"), F.max("page_index").alias("last"), n.alias("n_pages"), ((F.sum("score") + F.coalesce(F.sum(F.when(F.col("bridged"), F.col("m_score"))), F.lit(0.0))) / n).alias("mean"))
    g = g.withColumn("gaps", F.col("last") - F.col("first") + 1 - F.col("n_pages")).withColumn("score", F.col("mean") + 0.5 * (F.col("n_pages") - 1) - F.col("gaps"))
    before = around.select("doc_id", (F.col("p") + 1).alias("first"), F.col("s").alias("s0"))
    after = around.select("doc_id", (F.col("p") - 1).alias("last"), F.col("s").alias("s1"))
    edge = lambda s: F.when(s.isNull(), "may_continue").when(s == "skipped", "unknown").otherwise("closed")
    g = g.join(before, ["doc_id", "first"], "left").join(after, ["doc_id", "last"], "left")
    return g.select("doc_id", "first", "last", "n_pages", "gaps", "score", F.when(F.col("first") == 0, "closed").otherwise(edge(F.col("s0"))).alias("start"), edge(F.col("s1")).alias("end"))


def choose(candidates_: DataFrame) -> DataFrame:
    """``doc_id, first, score, chosen``: the best candidate, unless the second reaches nine tenths of its score."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "first")
    x = candidates_.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where("rn = 1")
    return x.select("doc_id", "first", "score", F.when(F.col("next").isNull() | (F.col("next") < 0.9 * F.col("score")), True).otherwise(False).alias("chosen"))
