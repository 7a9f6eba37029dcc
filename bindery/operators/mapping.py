"""Printed references to physical pages: margin numbers, offsets, headings and the decision per entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions import text as T
from bindery.session import cut
from bindery.sources.corpus import PAGE

HEADER, FOOTER = 0.10, 0.15


def margin_numbers(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """``page, kind, literal, style, ordinal``: the one number of a page's header or footer band.

    A region is a number itself, or, the outermost of its band only, a short
    line whose last or first word is one; that form wins alone. Two numbers in
    a band make none.
    """
    x = regions.join(pages.select(*PAGE, "height").where("height > 0"), PAGE)
    center = (F.col("t") + F.col("b")) / 2
    head = x.where(center <= HEADER * F.col("height")).withColumn("kind", F.lit("header")).withColumn("out", F.col("t"))
    foot = x.where(center >= (1 - FOOTER) * F.col("height")).withColumn("kind", F.lit("footer")).withColumn("out", -F.col("b"))
    band = head.unionByName(foot).where("text <> ''")
    w = Window.partitionBy(*PAGE, "kind").orderBy("out", "region_id")
    band = band.withColumn("outermost", F.row_number().over(w) == 1).withColumn("v", T.trim(F.col("text")))
    v = F.col("v")
    last, first = F.regexp_extract(v, r"^([\s\S]*) ([^ ]*)$", 2), F.regexp_extract(v, r"^([^ ]*) ([\s\S]*)$", 1)
    before, after = F.regexp_extract(v, r"^([\s\S]*) ([^ ]*)$", 1), F.regexp_extract(v, r"^([^ ]*) ([\s\S]*)$", 2)
    short = F.col("outermost") & T.token_kind(v).isNull() & (F.octet_length(v) <= 80) & ~F.contains(v, F.lit("\n"))
    running = F.when(short & T.title_like(before) & ~F.coalesce(T.ends_with_label(before), F.lit(False)) & T.token_kind(last).isNotNull(), last).when(short & T.title_like(after) & T.token_kind(first).isNotNull(), first)
    x = band.withColumn("running", running).withColumn("literal", F.coalesce(F.when(T.token_kind(v).isNotNull(), v), F.col("running")))
    x = x.withColumn("ordinal", T.token_ordinal(F.col("literal"))).where("literal is not null and ordinal > 0")
    g = x.groupBy(*PAGE, "kind").agg(F.count("*").alias("n"), F.max(F.when(F.col("running").isNotNull(), F.col("literal"))).alias("alone"), F.max("literal").alias("literal"))
    g = g.where("alone is not null or n = 1").withColumn("literal", F.coalesce("alone", "literal"))
    return g.select(*PAGE, "kind", "literal", T.token_kind(F.col("literal")).alias("style"), T.token_ordinal(F.col("literal")).alias("ordinal"))


def offsets(observations: DataFrame, body: DataFrame) -> DataFrame:
    """``doc_id, n_pages, n_offsets, contradictory, offset, support, method``: what the margin numbers of the body say.

    ``body`` has ``doc_id, first``. One offset on two pages or more is strong;
    else the offset of at least three pages and four fifths of the anchor pages
    dominates, the smallest at ties.
    """
    a = observations.where("style = 'decimal'").join(body, "doc_id").where("page_index >= first").select("doc_id", "page_index", (F.col("page_index") - F.col("ordinal")).alias("offset")).distinct()
    a = cut(a)  # read three times; a row for each page with a number
    per = a.groupBy("doc_id", "page_index").agg(F.count("*").alias("k"), F.min("offset").alias("offset"))
    total = per.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.bool_or(F.col("k") > 1).alias("split"))
    n = a.groupBy("doc_id").agg(F.countDistinct("offset").alias("n_offsets"))
    votes = per.where("k = 1").groupBy("doc_id", "offset").agg(F.count("*").alias("support"))
    best = votes.groupBy("doc_id").agg(F.max(F.struct("support", (-F.col("offset")).alias("o"))).alias("m")).select("doc_id", (-F.col("m.o")).alias("offset"), F.col("m.support").alias("support"))
    x = total.join(n, "doc_id").join(best, "doc_id", "left")
    method = F.when((F.col("n_offsets") == 1) & (F.col("n_pages") >= 2), "strong").when((F.col("support") >= 3) & (F.col("support") >= 0.8 * F.col("n_pages")), "dominant")
    return x.select("doc_id", "n_pages", "n_offsets", (F.col("n_offsets") > 1).alias("contradictory"), F.when(method.isNotNull(), F.col("offset")).alias("offset"), "support", method.alias("method"))


def headings(fragments: DataFrame, entries: DataFrame, toc_pages: DataFrame) -> DataFrame:
    """``doc_id, entry_id, page_index``: pages outside the contents where one to three lines in a row read like the entry's title."""
    w = Window.partitionBy(*PAGE).orderBy("t", "l", "region_id", "piece")
    f = fragments.join(toc_pages, ["doc_id", "page_index"], "left_anti").withColumn("k1", T.key(F.col("text")))
    f = f.withColumn("k2", F.lead("k1").over(w)).withColumn("k3", F.lead("k1", 2).over(w)).withColumn("t2", F.lead("t").over(w)).withColumn("b2", F.lead("b").over(w)).withColumn("t3", F.lead("t", 2).over(w))
    size = F.expr("b - t")
    near2 = F.expr("t2 - b").between(-size, 1.5 * size)
    near3 = near2 & F.expr("t3 - b2").between(-size, 1.5 * size)
    keys = F.array_compact(F.array(F.col("k1"), F.when(near2, F.concat_ws(" ", "k1", "k2")), F.when(near3, F.concat_ws(" ", "k1", "k2", "k3"))))
    lines = f.select("doc_id", "page_index", F.explode(keys).alias("key")).where("key <> ''").distinct()
    e = entries.select("doc_id", "entry_id", T.key(F.col("title")).alias("key")).where("key <> ''").distinct()
    return e.join(lines, ["doc_id", "key"]).select("doc_id", "entry_id", "page_index").distinct()


def map_entries(entries: DataFrame, offsets_: DataFrame, observations: DataFrame, headings_: DataFrame, body: DataFrame) -> DataFrame:
    """``doc_id, entry_id, status, page, method``: one decision per entry.

    An offset's target must be confirmed by the number in its margin or by a
    heading; otherwise headings alone decide: one page resolves, several are
    ambiguous, none leaves the entry unresolved.
    """
    e = entries.select("doc_id", "entry_id", "ordinal", "numbering").distinct()
    x = e.join(offsets_.select("doc_id", "offset"), "doc_id", "left").join(body, "doc_id", "left")
    x = x.withColumn("target", F.when((F.col("numbering") == "decimal") & (F.col("ordinal") + F.col("offset") >= F.col("first")), F.col("ordinal") + F.col("offset")))
    seen = observations.where("style = 'decimal'").select("doc_id", F.col("page_index").alias("target"), "ordinal", F.lit(True).alias("by_number")).distinct()
    head = headings_.select("doc_id", "entry_id", F.col("page_index").alias("target"), F.lit(True).alias("by_heading")).distinct()
    x = x.join(seen, ["doc_id", "target", "ordinal"], "left").join(head, ["doc_id", "entry_id", "target"], "left")
    h = headings_.groupBy("doc_id", "entry_id").agg(F.countDistinct("page_index").alias("n_head"), F.min("page_index").alias("only"))
    x = x.join(h, ["doc_id", "entry_id"], "left")
    confirmed = F.col("target").isNotNull() & (F.col("by_number").isNotNull() | F.col("by_heading").isNotNull())
    status = F.when(confirmed | (F.col("n_head") == 1), "resolved").when(F.col("n_head") > 1, "ambiguous").otherwise("unresolved")
    page = F.when(confirmed, F.col("target")).when(F.col("n_head") == 1, F.col("only"))
    method = F.when(confirmed, "inferred_offset").when(F.col("n_head") == 1, "heading")
    return x.select("doc_id", "entry_id", status.alias("status"), page.cast("int").alias("page"), method.alias("method"))
