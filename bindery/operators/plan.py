"""Bookmark plans: validation, promotion of nodes, outline links and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions.text import trim
from bindery.operators.hierarchy import by_merge, hierarchy
from bindery.session import kept

NODE = ["doc_id", "node_id"]


def validate(nodes: DataFrame, books: DataFrame, omitted: DataFrame, promotions: DataFrame) -> DataFrame:
    """``doc_id, node_id, code``: one row per issue, fifteen codes.

    ``nodes`` has ``doc_id, ord, node_id, parent_id, title (binary), dest``,
    ``books`` ``doc_id, page_count, sha256, schema_version, page_index_base``,
    each key once; ``omitted`` ``doc_id, entry_id``, ``promotions`` ``doc_id,
    node_id, original_id, new_id``. A cycle is reported once, at its node of the
    lowest order. Repeated ids are reported per id.
    """
    text = F.col("title").cast("string")
    n = nodes.join(books.select("doc_id", "page_count"), "doc_id", "left").withColumn("valid", F.is_valid_utf8(text)).withColumn("blank", F.coalesce(trim(F.make_valid_utf8(text)), F.lit("")) == "")
    issue = lambda df, code: df.select("doc_id", "node_id", F.lit(code).alias("code"))
    ids = nodes.where("node_id <> ''").select(*NODE).distinct()
    real = n.where("parent_id is not null and parent_id <> ''")
    rings = hierarchy(nodes, ["doc_id"], "node_id", "parent_id", "ord").where("state = 'cycle'").select("doc_id", F.col("rec_id").alias("node_id"), "root_id")
    rings = rings.join(nodes.select(*NODE, "ord", "parent_id"), NODE).where("parent_id <> node_id").groupBy("doc_id", "root_id").agg(F.min_by("node_id", F.struct("ord", "node_id")).alias("node_id"))
    none = F.lit(None).cast("string").alias("node_id")
    book = lambda cond, code: books.where(cond).select("doc_id", none, F.lit(code).alias("code"))
    gone = omitted.select("doc_id", F.col("entry_id").alias("node_id"))
    moved = promotions.join(nodes.select(*NODE, F.nullif("parent_id", F.lit("")).alias("now"), F.lit(True).alias("there")), NODE, "left")
    wrong = F.col("there").isNull() | ~F.col("now").eqNullSafe(F.col("new_id")) | F.col("original_id").eqNullSafe(F.col("new_id"))
    out = [
        book("schema_version <> 1", "unsupported_schema_version"),
        book("page_index_base <> 0", "unsupported_page_index_base"),
        book("sha256 is null or sha256 rlike '^0*$'", "missing_input_digest"),
        book("page_count is null or page_count <= 0", "invalid_page_count"),
        books.join(nodes.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", none, F.lit("empty_plan").alias("code")),
        issue(n.where("node_id is null or node_id = ''"), "empty_node_id"),
        nodes.where("node_id <> ''").groupBy(*NODE).count().where("count > 1").select(*NODE, F.lit("duplicate_node_id").alias("code")),
        issue(n.where("valid is null or valid").where("blank"), "empty_title"),
        issue(n.where("not valid"), "invalid_utf8_title"),
        issue(n.where("page_count > 0 and (dest < 0 or dest >= page_count)"), "destination_out_of_range"),
        issue(real.where("parent_id = node_id"), "self_parent"),
        issue(real.where("parent_id <> node_id").join(ids.withColumnRenamed("node_id", "parent_id"), ["doc_id", "parent_id"], "left_anti"), "missing_parent"),
        issue(rings, "parent_cycle"),
        issue(gone.where("node_id = ''").unionByName(gone.where("node_id <> ''").join(ids, NODE, "left_semi")), "invalid_omission"),
        issue(moved.where(wrong), "invalid_promotion"),
    ]
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def promote(nodes: DataFrame) -> DataFrame:
    """``doc_id, node_id, parent_id``: nodes with a destination below their nearest ancestor that has one.

    Nodes that lead into a cycle are left out. Records whose parents end in a
    missing one become top level where no ancestor with a destination is found.
    A repeated id has a destination if one of its rows has; each such row stays
    a row. Paths aren't needed: the nodes without a destination are a forest of
    their own, and the parent of its top is the ancestor of all below.
    """
    link = F.min(F.struct(F.nullif("parent_id", F.lit("")).alias("parent_id"), "ord")).alias("link")
    ids = kept(nodes.groupBy(*NODE).agg(link, F.count("dest").alias("n")).select(*NODE, "link.parent_id", "link.ord", "n"))
    stay, gone = ids.where("n > 0"), ids.where("n = 0")
    stuck = hierarchy(ids, ["doc_id"], "node_id", "parent_id", "ord").where("state in ('cycle', 'below_cycle')").select("doc_id", F.col("rec_id").alias("node_id"))
    tops = hierarchy(gone, ["doc_id"], "node_id", "parent_id", "ord").where("state = 'orphan'").select("doc_id", F.col("rec_id").alias("up"), F.col("root_id").alias("node_id"))
    past = tops.join(by_merge(gone.select(*NODE, "parent_id")), NODE).select("doc_id", "up", F.col("parent_id").alias("node_id")).join(by_merge(stay.select(*NODE)), NODE, "left_semi")
    above = stay.select("doc_id", F.col("node_id").alias("up"), F.col("node_id").alias("parent_id")).unionByName(past.select("doc_id", "up", F.col("node_id").alias("parent_id")))
    named = F.when(F.col("node_id").isNotNull(), F.col("parent_id"))
    x = stay.select(*NODE, named.alias("up"), "n").join(by_merge(above), ["doc_id", "up"], "left").join(by_merge(stuck), NODE, "left_anti")
    return x.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select(*NODE, "parent_id")


def outline_links(nodes: DataFrame) -> DataFrame:
    """``doc_id, node_id, parent, prev, next, first, last, n_children``: an outline's links in sibling order."""
    sib = Window.partitionBy("doc_id", F.coalesce("parent_id", F.lit(""))).orderBy("ord", "node_id")
    x = nodes.select("doc_id", "node_id", F.when(F.col("parent_id") != "", F.col("parent_id")).alias("parent_id"), "ord")
    x = x.withColumn("prev", F.lag("node_id").over(sib)).withColumn("next", F.lead("node_id").over(sib))
    kids = x.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.min_by("node_id", F.struct("ord", "node_id")).alias("first"), F.max_by("node_id", F.struct("ord", "node_id")).alias("last"), F.count("*").alias("n_children"))
    x = x.join(kids, NODE, "left")
    return x.select("doc_id", "node_id", F.col("parent_id").alias("parent"), "prev", "next", "first", "last", F.coalesce("n_children", F.lit(0)).alias("n_children"))


def verify(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """``doc_id, expected, stored, missing, extra, equal``: rows on either side and those that only one side has, repeated rows counted.

    One pass over both sides: rows are counted with a sign, so nothing is joined.
    """
    cols = expected.columns
    both = expected.withColumn("_n", F.lit(1)).unionByName(stored.select(*cols).withColumn("_n", F.lit(-1)))
    per = both.groupBy(*cols).agg(F.sum("_n").alias("_d"), F.count_if(F.col("_n") > 0).alias("_a"), F.count_if(F.col("_n") < 0).alias("_b"))
    g = per.groupBy("doc_id").agg(F.sum("_a").alias("expected"), F.sum("_b").alias("stored"), F.sum(F.greatest("_d", F.lit(0))).alias("missing"), F.sum(F.greatest(-F.col("_d"), F.lit(0))).alias("extra"))
    return g.withColumn("equal", (F.col("missing") == 0) & (F.col("extra") == 0))
