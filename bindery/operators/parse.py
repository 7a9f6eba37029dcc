"""Rows of contents pages, wrapped titles and the hierarchy of entries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions import text as T
from bindery.sources.corpus import PAGE

ROW_TOLERANCE = 5.0
ROOT_INDENT, CHILD_INDENT = 8.0, 16.0


def assemble_rows(fragments: DataFrame) -> DataFrame:
    """``page, row, text, l, r, t, b``: fragments within 5 points of a row's first, from left to right."""
    packed = fragments.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(((F.col("t") + F.col("b")) / 2).alias("y"), "l", "region_id", "piece", "text", "r", "t", "b"))).alias("f"))
    rows = F.expr(f"""
        aggregate(f, named_struct('n', 0, 'y', cast(0 as double), 'ids', cast(array() as array<int>)), (a, x) ->
          if(a.n = 0 or x.y - a.y > {ROW_TOLERANCE}D, named_struct('n', a.n + 1, 'y', x.y, 'ids', concat(a.ids, array(a.n + 1))), named_struct('n', a.n, 'y', a.y, 'ids', concat(a.ids, array(a.n)))), a -> a.ids)""")
    x = packed.select(*PAGE, F.explode(F.arrays_zip(F.col("f"), rows.alias("row"))).alias("z")).select(*PAGE, "z.row", "z.f.*")
    parts = F.array_sort(F.collect_list(F.struct("l", "region_id", "piece", "text")))
    return x.groupBy(*PAGE, "row").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.min("l").alias("l"), F.max("r").alias("r"), F.min("t").alias("t"), F.max("b").alias("b"))


def wrapped(rows: DataFrame) -> DataFrame:
    """``page, row, title, token, wrapped``: rows with a reference, a title's first line joined where it has none itself.

    A row is used once: one that another took as its continuation can't begin an entry, so runs of rows are folded.
    """
    v = T.trim(F.col("text"))
    token = T.inline_token(v)
    w = Window.partitionBy(*PAGE).orderBy("row")
    x = rows.withColumn("token", token).withColumn("title", T.clean_title(F.when(token.isNotNull(), F.regexp_replace(v, r"[^ \t\n\r\f\x0B.]+$", "")).otherwise(v)))
    x = x.withColumn("p_token", F.lag("token").over(w)).withColumn("p_title", F.lag("title").over(w)).withColumn("p_text", F.lag("text").over(w)).withColumn("p_l", F.lag("l").over(w)).withColumn("p_b", F.lag("b").over(w)).withColumn("p_t", F.lag("t").over(w))
    height = F.greatest(F.expr("b - t"), F.expr("p_b - p_t"))
    starts = (T.heading_label(v) > 0) | (T.section_number(v) != "")
    take = F.col("p_token").isNull() & F.col("p_text").isNotNull() & (F.octet_length("p_text") >= 18) & ~T.lower_ascii(T.trim(F.col("p_text"))).isin("contents", "table of contents") & ~starts & ~T.section_heading(F.col("p_text"))
    take &= (F.abs(F.col("l") - F.col("p_l")) <= CHILD_INDENT) & (F.col("t") >= F.col("p_t")) & (F.col("t") - F.col("p_b") <= 1.8 * height)
    x = x.where("token is not null").withColumn("take", F.coalesce(take, F.lit(False)))
    return x.select(*PAGE, "row", F.when(F.col("take"), F.concat_ws(" ", "p_title", "title")).otherwise(F.col("title")).alias("title"), "token", F.col("take").alias("wrapped"))


def by_indent(entries: DataFrame) -> DataFrame:
    """``doc_id, entry_id, indent, kind, parent_id``: the parent is the latest earlier entry of the column at least 16 points to the left.

    ``entries`` has ``doc_id, entry_id, ord, left`` and may have ``column``.
    Within 8 points of the column's smallest left an entry is a root; without a
    parent it is unknown. A book's entries are read once in order; only those
    that later ones may still go below are kept, so a book of any length will do.
    """
    x = entries if "column" in entries.columns else entries.withColumn("column", F.lit(0))
    base = x.withColumn("indent", F.col("left") - F.min("left").over(Window.partitionBy("doc_id", "column")))
    base = base.select("doc_id", F.col("column").cast("int").alias("column"), "ord", "entry_id", "indent")
    base = base.repartition(F.col("doc_id"), F.col("column")).sortWithinPartitions("doc_id", "column", "ord", "entry_id")
    x = base.mapInPandas(_parents, "doc_id string, entry_id string, indent double, p string")
    root = F.col("indent") <= ROOT_INDENT
    return x.select("doc_id", "entry_id", "indent", F.when(root, "root").when(F.col("p").isNotNull(), "known_parent").otherwise("unknown").alias("kind"), F.when(~root, F.col("p")).alias("parent_id"))


def _parents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, open_ = None, []
    for b in batches:
        rows = []
        for d, c, e, i in zip(b["doc_id"], b["column"], b["entry_id"], b["indent"]):
            if (d, c) != now:
                now, open_ = (d, c), []
            # an earlier entry that isn't further left than this one can't be a parent after it
            up = next((p for at, p in reversed(open_) if at + CHILD_INDENT <= i), None)
            while open_ and open_[-1][0] >= i:
                open_.pop()
            open_.append((i, e))
            rows.append((d, e, i, up))
        yield pd.DataFrame(rows, columns=["doc_id", "entry_id", "indent", "p"])


def merged_hierarchy(indent: DataFrame, number: DataFrame) -> DataFrame:
    """``doc_id, entry_id, kind, parent_id, reason``: a parent by number goes before one by indentation."""
    n = number.where("parent_id is not null").select("doc_id", "entry_id", F.col("parent_id").alias("by_number"))
    x = indent.join(n, ["doc_id", "entry_id"], "left")
    told = F.col("by_number").isNotNull()
    reason = F.when(told & F.col("parent_id").eqNullSafe(F.col("by_number")), "both").when(told & (F.col("kind") != "unknown"), "number_overrides").when(told, "number").when(F.col("kind") == "unknown", "none").otherwise("indent")
    return x.select("doc_id", "entry_id", F.when(told, "known_parent").otherwise(F.col("kind")).alias("kind"), F.coalesce("by_number", "parent_id").alias("parent_id"), reason.alias("reason"))


def page_columns(fragments: DataFrame) -> DataFrame:
    """``page, n_clusters, two_columns, divider``: two columns if the right edges of references part in two.

    ``fragments`` has the page's ``width``. Edges are clustered by a running
    mean within 18 points; the outer clusters need two references each and a
    quarter of the width between them. The divider lies between the left one
    and what begins right of it.
    """
    cited = T.inline_token(F.col("text")).isNotNull() | F.col("text").rlike(T.REFERENCE)
    g = fragments.groupBy(*PAGE).agg(F.max("width").alias("w"), F.array_sort(F.collect_list(F.when(cited, F.col("r")))).alias("e"), F.collect_list("l").alias("ls"))
    fold = F.expr("""
        aggregate(e, cast(array() as array<struct<mean:double,n:int>>), (out, r) ->
          if(size(out) > 0 and r - element_at(out, -1).mean <= 18,
             concat(slice(out, 1, size(out) - 1), array(named_struct('mean', (element_at(out, -1).mean * element_at(out, -1).n + r) / (element_at(out, -1).n + 1), 'n', element_at(out, -1).n + 1))),
             concat(out, array(named_struct('mean', r, 'n', 1)))))""")
    g = g.withColumn("c", fold)
    first, last = F.col("c")[0], F.element_at("c", -1)
    two = (F.size("c") >= 2) & (first["n"] >= 2) & (last["n"] >= 2) & ((last["mean"] - first["mean"]) / F.col("w") >= 0.25)
    two = F.when(F.size("c") >= 2, two).otherwise(F.lit(False))
    start = F.array_min(F.filter("ls", lambda l: l > F.col("c")[0]["mean"] + 0.02 * F.col("w")))
    divider = F.when(two, (first["mean"] + F.coalesce(start, last["mean"])) / 2)
    return g.select(*PAGE, F.size("c").alias("n_clusters"), two.alias("two_columns"), divider.alias("divider"))


def in_columns(fragments: DataFrame, columns: DataFrame) -> DataFrame:
    """Fragments with their ``column``: 1 right of a page's divider, else 0."""
    x = fragments.join(columns.select(*PAGE, "divider"), PAGE)
    return x.withColumn("column", F.when(F.col("l") >= F.col("divider"), 1).otherwise(0)).drop("divider")


def entry_ids(rows: DataFrame) -> DataFrame:
    """``rows`` with ``ord`` in the order of page, revision and row, and the id made of these."""
    w = Window.partitionBy("doc_id").orderBy("page_index", "revision", "row")
    x = rows.withColumn("ord", F.row_number().over(w) - 1)
    return x.withColumn("entry_id", F.concat(F.lit("toc/p"), F.col("page_index"), F.lit("r"), F.col("revision"), F.lit("e"), F.col("ord")))


def heading_with_reference(title: Column) -> Column:
    """Whether a heading's words can have a reference behind them: three words, or two of which the first is no label."""
    words = F.filter(F.split(T.lower_ascii(T.trim(title)), " "), lambda w: w != "")
    n = F.size(words)
    return (n >= 3) | ((n == 2) & ~F.coalesce(words[0].isin("part", "chapter", "section", "appendix"), F.lit(False)))


def by_number(entries: DataFrame) -> DataFrame:
    """``doc_id, entry_id, number, parent_id``: the latest earlier entry whose number is this one's without its last part."""
    number = F.coalesce(F.nullif(T.section_number(F.col("title")), F.lit("")), F.nullif(F.regexp_extract("title", r"^(?:Chapter |Appendix |Part )?([A-Z]|[0-9]+)[.: ]", 1), F.lit("")))
    x = entries.select("doc_id", "entry_id", "ord", number.alias("number")).where("number is not null")
    child = x.withColumn("up", F.when(F.contains("number", F.lit(".")), F.regexp_replace("number", r"\.[^.]*$", "")))
    parents = x.select("doc_id", F.col("number").alias("up"), F.col("ord").alias("p_ord"), F.col("entry_id").alias("p_id"))
    j = child.join(parents, ["doc_id", "up"], "left").where("p_ord is null or p_ord < ord")
    best = j.groupBy("doc_id", "entry_id").agg(F.max_by("p_id", F.struct("p_ord", "p_id")).alias("parent_id"))
    return x.join(best, ["doc_id", "entry_id"], "left").select("doc_id", "entry_id", "number", "parent_id")
