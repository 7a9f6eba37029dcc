"""Plans from mapped entries: which become nodes, below whom, what is left out, and whether the plan is ready."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.operators.hierarchy import hierarchy

ENTRY = ["doc_id", "entry_id"]


def assemble(entries: DataFrame, mapped: DataFrame) -> DataFrame:
    """``doc_id, entry_id, ord, title, status, page, parent_id, original_id, flattened, promoted, blocked``, a row for each entry.

    ``entries`` has ``doc_id, entry_id, ord, title, kind, parent_id``, each key
    once, ``mapped`` ``status, page``. Resolved entries are nodes; an ancestor
    that isn't resolved gives its children to the nearest one that is. Where
    the hierarchy is unknown, the entry's own or that of an ancestor left out,
    it goes to the top level (``flattened``). ``blocked``: a parent that is no
    entry, or a cycle; such entries become no nodes.
    """
    e = entries.withColumn("_up", F.when(F.col("kind") == "known_parent", F.nullif("parent_id", F.lit(""))))
    tree = hierarchy(e, ["doc_id"], "entry_id", "_up", "ord", paths=True).withColumnRenamed("rec_id", "entry_id")
    x = e.join(mapped.select(*ENTRY, "status", "page"), ENTRY, "left").join(tree.select(*ENTRY, "state", "path"), ENTRY, "left")
    kept = F.col("status") == "resolved"
    marks = x.select("doc_id", F.col("entry_id").alias("above"), F.coalesce(kept, F.lit(False)).alias("_kept"), F.col("kind").alias("_kind"))
    up = x.where(kept & (F.size("path") > 1)).select(*ENTRY, F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("_at", "above")).join(marks, ["doc_id", "above"])
    best = up.groupBy(*ENTRY).agg(F.max(F.when(F.col("_kept"), F.struct("_at", "above")))["above"].alias("_found"), F.min_by("_kind", "_at").alias("_root"))
    x = x.join(best, ENTRY, "left")
    none = F.lit(None).cast("string")
    blocked = F.when(F.col("state").isin("cycle", "below_cycle"), "cycle").when((F.col("state") == "orphan") & F.col("_found").isNull(), "missing_parent")
    flat = (F.col("kind") == "unknown") | (F.col("_found").isNull() & F.coalesce(F.col("_root") == "unknown", F.lit(False)))
    x = x.withColumn("blocked", F.when(kept, blocked)).withColumn("original_id", F.col("_up"))
    node = kept & F.col("blocked").isNull()
    x = x.withColumn("parent_id", F.when(node, F.col("_found")).otherwise(none))
    promoted = node & F.col("original_id").isNotNull() & ~F.col("original_id").eqNullSafe(F.col("parent_id"))
    no = F.lit(False)
    return x.select(*ENTRY, "ord", "title", "status", "page", "parent_id", "original_id", F.coalesce(node & flat, no).alias("flattened"), F.coalesce(promoted, no).alias("promoted"), "blocked")


def readiness(assembled: DataFrame) -> DataFrame:
    """``doc_id, n_nodes, n_omitted, n_promoted, n_flattened, n_blocked, ready, ready_strict``.

    Lenient plans leave out what isn't resolved and flatten what is unknown;
    strict ones are blocked by either. A plan without nodes is never ready.
    """
    kept = F.coalesce(F.col("status") == "resolved", F.lit(False))
    node = kept & F.col("blocked").isNull()
    g = assembled.groupBy("doc_id").agg(F.count_if(node).alias("n_nodes"), F.count_if(~kept).alias("n_omitted"), F.count_if("promoted").alias("n_promoted"), F.count_if("flattened").alias("n_flattened"), F.count_if(F.col("blocked").isNotNull()).alias("n_blocked"))
    ready = (F.col("n_nodes") > 0) & (F.col("n_blocked") == 0)
    return g.withColumn("ready", ready).withColumn("ready_strict", ready & (F.col("n_omitted") == 0) & (F.col("n_flattened") == 0))


def _ordered(keep: Column, value: Column, kind: str) -> Column:
    return F.coalesce(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("ord", "entry_id", value.alias("v"))))), lambda r: r["v"]), F.array().cast(f"array<{kind}>"))


def plan_json(assembled: DataFrame, books: DataFrame) -> DataFrame:
    """``doc_id, plan``: the whole plan as JSON, its members in a fixed order, absent values null."""
    kept = F.coalesce(F.col("status") == "resolved", F.lit(False))
    node_ = F.struct(F.col("entry_id").alias("id"), "parent_id", "title", F.struct(F.col("page").alias("pdf_page_index")).alias("destination"))
    gone = F.struct("entry_id", F.coalesce("status", F.lit("unmapped")).alias("reason"))
    moved = F.struct(F.col("entry_id").alias("node_id"), F.col("original_id").alias("original_parent_id"), F.col("parent_id").alias("new_parent_id"), F.when(F.col("parent_id").isNull(), "top_level").otherwise("nearest_retained").alias("reason"))
    g = assembled.groupBy("doc_id").agg(
        _ordered(kept & F.col("blocked").isNull(), node_, "struct<id:string,parent_id:string,title:string,destination:struct<pdf_page_index:int>>").alias("nodes"),
        _ordered(~kept, gone, "struct<entry_id:string,reason:string>").alias("omitted_entries"),
        _ordered(F.col("promoted"), moved, "struct<node_id:string,original_parent_id:string,new_parent_id:string,reason:string>").alias("promotions"),
    )
    x = g.join(books, "doc_id")
    whole = F.struct(F.lit(1).alias("schema_version"), F.lit(0).alias("page_index_base"), F.struct("sha256", "page_count").alias("input"), F.lit("replace_in_copy").alias("existing_outline_policy"), "nodes", "omitted_entries", "promotions")
    return x.select("doc_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("plan"))


# Members of a plan and of its parts, and the one policy for outlines that exist.
PLAN = ["existing_outline_policy", "input", "nodes", "omitted_entries", "page_index_base", "promotions", "schema_version"]
NODE = ["destination", "id", "parent_id", "title"]
OMITTED = ["entry_id", "reason"]
PROMOTION = ["new_parent_id", "node_id", "original_parent_id", "reason"]
POLICY = "replace_in_copy"


def decode_plan(text: Column) -> Column:
    """The first thing that is wrong with a plan's JSON, null if nothing is: members, version, digest, page count, policy."""

    def exact(x: Column, names: list[str]) -> Column:
        return F.coalesce(F.array_sort(F.json_object_keys(x)) == F.array(*map(F.lit, names)), F.lit(False))

    def all_exact(path: str, names: list[str]) -> Column:
        items = F.from_json(F.get_json_object(text, path), "array<map<string,string>>")
        return F.coalesce(F.forall(items, lambda m: F.array_sort(F.map_keys(m)) == F.array(*map(F.lit, names))), F.lit(False))

    at = lambda path: F.get_json_object(text, path)
    whole = lambda path: F.coalesce(at(path).rlike("^-?(0|[1-9][0-9]{0,9})$") & at(path).cast("long").between(-(2**31), 2**31 - 1), F.lit(False))
    wrong = F.when(~exact(text, PLAN), "members").when(~whole("$.schema_version") | ~whole("$.page_index_base"), "type").when(at("$.schema_version") != "1", "schema_version")
    wrong = wrong.when(~exact(at("$.input"), ["page_count", "sha256"]), "members").when(~whole("$.input.page_count"), "type").when(~F.coalesce(at("$.input.sha256").rlike("^[0-9A-Fa-f]{64}$"), F.lit(False)), "sha256")
    wrong = wrong.when(at("$.existing_outline_policy") != POLICY, "policy")
    return wrong.when(~(all_exact("$.nodes", NODE) & all_exact("$.omitted_entries", OMITTED) & all_exact("$.promotions", PROMOTION)), "members")
