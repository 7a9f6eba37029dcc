"""Entries to pages by numbering sections: anchors of each section, labels, links and headings as choices, one decision per entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions import text as T
from bindery.sources.corpus import PAGE

ENTRY = ["doc_id", "entry_id"]
HEADING = 0.25
# Methods in the order in which they name a destination.
METHODS = ["associated_local_link", "viewer_label", "inferred_offset", "heading_match"]


def sections(entries: DataFrame, body: DataFrame, counts: DataFrame) -> DataFrame:
    """``doc_id, section, first, end, style, prefix``: half-open ranges of pages.

    ``body`` has ``doc_id, first``, ``counts`` ``doc_id, count``. The body is
    decimal from behind the contents; books whose entries cite Roman numbers
    have a front before it; each prefix has a section over the body.
    """
    x = body.join(counts, "doc_id")
    row = lambda df, name, first, end, style, prefix: df.select("doc_id", name.alias("section"), first.cast("int").alias("first"), end.cast("int").alias("end"), F.lit(style).alias("style"), prefix.alias("prefix"))
    roman = entries.where("numbering = 'roman'").select("doc_id").distinct()
    named = entries.where("numbering = 'prefixed_decimal' and prefix is not null").select("doc_id", F.upper("prefix").alias("prefix")).distinct()
    out = row(x, F.lit("body"), F.col("first"), F.col("count"), "decimal", F.lit(""))
    out = out.unionByName(row(x.join(roman, "doc_id", "left_semi"), F.lit("front"), F.lit(0), F.col("first"), "roman", F.lit("")))
    out = out.unionByName(row(x.join(named, "doc_id"), F.concat(F.lit("prefix "), "prefix"), F.col("first"), F.col("count"), "prefixed_decimal", F.col("prefix")))
    return out.where("first < end")


def tokens(observations: DataFrame) -> DataFrame:
    """``doc_id, page_index, style, prefix, ordinal`` of printed margin numbers."""
    prefix = F.when(F.col("style") == "prefixed_decimal", F.upper(F.regexp_extract("literal", "^([A-Za-z]{1,3})-", 1))).otherwise("")
    return observations.select("doc_id", "page_index", "style", prefix.alias("prefix"), "ordinal").where("ordinal is not null").distinct()


def anchors(tokens_: DataFrame, sections_: DataFrame) -> DataFrame:
    """``doc_id, section, n_pages, n_offsets, offset, contradictory, outliers``: what the printed numbers of a section say.

    One offset on two pages or more is strong. Of several the one of at least
    three pages and four fifths of all is, the smallest at ties; pages that
    disagree are its outliers. ``offset`` is the strong one.
    """
    s = sections_.select("doc_id", "section", "first", "end", "style", "prefix")
    a = tokens_.join(s, ["doc_id", "style", "prefix"]).where("page_index >= first and page_index < end")
    a = a.select("doc_id", "section", "page_index", (F.col("page_index").cast("long") - F.col("ordinal")).alias("offset")).distinct()
    per = a.groupBy("doc_id", "section", "page_index").agg(F.count("*").alias("k"), F.min("offset").alias("offset"), F.max("offset").alias("top"))
    votes = per.groupBy("doc_id", "section", "offset").agg(F.count_if(F.col("k") == 1).alias("n"), F.count("*").alias("pages"), F.count_if(F.col("k") > 1).alias("split"), F.max("top").alias("top"), F.collect_list(F.struct("page_index", "k")).alias("at"))
    g = votes.groupBy("doc_id", "section").agg(F.sum("pages").alias("n_pages"), F.sum("split").alias("split"), F.min("offset").alias("low"), F.max("top").alias("high"), F.max(F.struct("n", (-F.col("offset")).alias("o"))).alias("best"), F.flatten(F.collect_list(F.transform("at", lambda p: F.struct(p["page_index"].alias("page_index"), p["k"].alias("k"), F.col("offset").alias("offset"))))).alias("all"))
    one = F.col("low") == F.col("high")
    best, n = -F.col("best.o"), F.col("best.n")
    dominant = ~one & (n >= 3) & (n * 5 >= F.col("n_pages") * 4)
    strong = F.when(one & (F.col("n_pages") >= 2), F.col("low")).when(dominant, best)
    out = F.when(dominant, F.array_sort(F.transform(F.filter("all", lambda p: (p["k"] != 1) | (p["offset"] != best)), lambda p: p["page_index"]))).otherwise(F.array().cast("array<int>"))
    return g.select("doc_id", "section", "n_pages", strong.alias("offset"), (~one & ~dominant).alias("contradictory"), out.alias("outliers"))


def headings(regions: DataFrame, pages: DataFrame, entries: DataFrame, contents: DataFrame) -> DataFrame:
    """``doc_id, entry_id, page_index``: pages on which one to three regions in a row read like the entry's title.

    A title without a number must stand in the page's top quarter; one with a
    number may also follow "chapter" and stand anywhere. Contents pages don't count.
    """
    x = regions.join(pages.select(*PAGE, "height").where("height > 0").distinct(), PAGE).join(contents, ["doc_id", "page_index"], "left_anti")
    x = x.withColumn("k1", T.heading_key(F.col("text"))).where("k1 <> ''").withColumn("h", F.expr("b - t"))
    w = Window.partitionBy(*PAGE).orderBy("t", "l", "region_id")
    for i in (1, 2):
        x = x.withColumn(f"k{i + 1}", F.lead("k1", i).over(w)).withColumn(f"t{i + 1}", F.lead("t", i).over(w)).withColumn(f"b{i + 1}", F.lead("b", i).over(w)).withColumn(f"h{i + 1}", F.lead("h", i).over(w))
    near = lambda gap, a, b: gap.between(-F.greatest(a, b), 1.5 * F.greatest(a, b))
    two = near(F.col("t2") - F.col("b"), F.col("h"), F.col("h2"))
    three = two & near(F.col("t3") - F.col("b2"), F.col("h2"), F.col("h3"))
    keys = F.array_compact(F.array(F.col("k1"), F.when(two, F.concat_ws(" ", "k1", "k2")), F.when(three, F.concat_ws(" ", "k1", "k2", "k3"))))
    high = (F.col("t") + F.col("b")) / 2 <= HEADING * F.col("height")
    lines = x.select("doc_id", "page_index", high.alias("high"), F.explode(keys).alias("key"))
    lines = lines.groupBy("doc_id", "page_index", "key").agg(F.bool_or("high").alias("high"))
    e = entries.select(*ENTRY, T.heading_key(F.col("title")).alias("key")).where("key <> ''").withColumn("numbered", F.col("key").rlike("^[0-9]"))
    e = e.select(*ENTRY, "numbered", F.explode(F.array_compact(F.array(F.col("key"), F.when(F.col("numbered"), F.concat(F.lit("chapter "), "key"))))).alias("key"))
    return e.join(lines, ["doc_id", "key"]).where("numbered or high").select(*ENTRY, "page_index").distinct()


def resolve(entries: DataFrame, sections_: DataFrame, anchors_: DataFrame, tokens_: DataFrame, headings_: DataFrame, labels: DataFrame, links: DataFrame, whole: DataFrame) -> DataFrame:
    """``doc_id, entry_id, section, status, page, method, n_choices, n_hints, reason``: one decision per entry.

    ``entries`` has ``doc_id, entry_id, numbering, ordinal, range_end, prefix,
    uncertain``, each key once; ``labels`` ``doc_id, section, page_index, style,
    prefix, ordinal`` of sections labelled throughout; ``links`` ``doc_id,
    entry_id, page_index``; ``whole`` ``doc_id, section`` of sections of which
    all pages are known. A destination counts if the page's content confirms
    it, by the entry's heading or its number in a margin. Links and labels that
    aren't confirmed are hints. One destination resolves, several are ambiguous.
    """
    known = F.col("ordinal").isNotNull() & ~F.coalesce("uncertain", F.lit(False)) & F.col("numbering").isin("decimal", "roman", "prefixed_decimal")
    e = entries.withColumn("known", known).withColumn("style", F.when(known, F.col("numbering"))).withColumn("pre", F.when(F.col("numbering") == "prefixed_decimal", F.upper("prefix")).otherwise(""))
    s = sections_.select("doc_id", "section", "first", "end", "style", F.col("prefix").alias("pre"))
    x = e.join(s, ["doc_id", "style", "pre"], "left").join(anchors_.select("doc_id", "section", "offset", "contradictory", "n_pages", F.size("outliers").alias("n_outliers")), ["doc_id", "section"], "left")
    target = F.col("ordinal").cast("long") + F.col("offset")
    last = F.col("range_end").cast("long") + F.col("offset")
    inside = lambda p: (p >= F.col("first")) & (p < F.col("end"))
    fits = inside(target) & F.when(F.col("range_end").isNotNull(), (F.col("range_end") >= F.col("ordinal")) & inside(last)).otherwise(True)
    x = x.withColumn("target", F.when(F.col("known"), target)).withColumn("fits", F.coalesce(fits, F.lit(False)))
    own = x.select(*ENTRY, "section", "known", "style", "pre", "ordinal", "target", "fits")
    wanted = own.where("fits").select(*ENTRY, F.col("target").cast("int").alias("page_index"), F.lit("inferred_offset").alias("method"))
    by_label = own.where("known").join(labels.select("doc_id", "section", "page_index", "style", F.col("prefix").alias("pre"), "ordinal"), ["doc_id", "section", "style", "pre", "ordinal"]).select(*ENTRY, "page_index", F.lit("viewer_label").alias("method"))
    by_link = links.select(*ENTRY, "page_index", F.lit("associated_local_link").alias("method"))
    asked = wanted.unionByName(by_label).unionByName(by_link).distinct()
    heading = headings_.select(*ENTRY, "page_index", F.lit(True).alias("read"))
    number = tokens_.select("doc_id", "page_index", "style", F.col("prefix").alias("pre"), "ordinal", F.lit(True).alias("printed")).distinct()
    asked = asked.join(own.select(*ENTRY, "style", "pre", "ordinal"), ENTRY).join(heading, [*ENTRY, "page_index"], "left").join(number, ["doc_id", "page_index", "style", "pre", "ordinal"], "left")
    asked = asked.withColumn("confirmed", F.col("read").isNotNull() | F.col("printed").isNotNull())
    # entries without a usable number belong to the body, and are found there by heading if all of it is known
    loose = own.where("not known").select(*ENTRY).join(headings_, ENTRY).join(sections_.where("section = 'body'").join(whole, ["doc_id", "section"], "left_semi").select("doc_id", "first", "end"), "doc_id").where("page_index >= first and page_index < end")
    choices = asked.where("confirmed").select(*ENTRY, "page_index", "method").unionByName(loose.select(*ENTRY, "page_index", F.lit("heading_match").alias("method"))).distinct()
    rank = F.array_position(F.array(*map(F.lit, METHODS)), F.col("method"))
    c = choices.groupBy(*ENTRY).agg(F.countDistinct("page_index").alias("n_dest"), F.count("*").alias("n_choices"), F.min("page_index").alias("only"), F.min_by("method", rank).alias("method"))
    hints = asked.where("not confirmed and method <> 'inferred_offset'").groupBy(*ENTRY).agg(F.count("*").alias("n_hints"))
    x = x.join(c, ENTRY, "left").join(hints, ENTRY, "left").fillna({"n_dest": 0, "n_choices": 0, "n_hints": 0})
    conflict = F.coalesce("contradictory", F.lit(False))
    done = (F.col("n_dest") == 1) & ~conflict
    status = F.when(F.col("n_dest") > 1, "ambiguous").when(done, "resolved").otherwise("unresolved")
    reason = F.when(F.col("n_dest") > 1, "several_destinations").when(done & (F.col("n_choices") > 1), "methods_agree").when(done & (F.col("n_outliers") > 0), "outliers_ignored").when(done, "confirmed")
    reason = reason.when(~F.col("known"), "no_reference").when(F.col("section").isNull(), "no_section").when(conflict, "conflicting_offsets").when(F.col("offset").isNull(), "few_anchors").when(~F.col("fits"), "outside_section").otherwise("target_not_confirmed")
    return x.select(*ENTRY, "section", status.alias("status"), F.when(done, F.col("only")).alias("page"), F.when(done, F.col("method")).alias("method"), "n_choices", "n_hints", reason.alias("reason"))


def label_tokens(pages: DataFrame, sections_: DataFrame) -> DataFrame:
    """``doc_id, section, page_index, style, prefix, ordinal``: labels (column ``label``) as tokens, of sections all of whose pages have one."""
    x = pages.join(sections_, "doc_id").where("page_index >= first and page_index < end")
    full = x.where("label is not null").groupBy("doc_id", "section").agg(F.countDistinct("page_index").alias("n"), F.max(F.col("end") - F.col("first")).alias("size")).where("n = size").select("doc_id", "section")
    v = F.col("label")
    style = T.token_kind(v)
    prefix: Column = F.when(style == "prefixed_decimal", F.upper(F.regexp_extract(v, "^([A-Za-z]{1,3})-", 1))).otherwise("")
    return x.join(full, ["doc_id", "section"], "left_semi").select("doc_id", "section", "page_index", style.alias("style"), prefix.alias("prefix"), T.token_ordinal(v).alias("ordinal")).where("ordinal is not null").distinct()
