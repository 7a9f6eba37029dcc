"""Assembled plans, their JSON and its strict reading, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.operators import assemble
from bindery.plans import query
from bindery.plans.section_queries import SQL_SECTIONS, resolved
from bindery.session import cut, kept, read
from bindery.sources import strict

SQL_ASSEMBLED = (
    SQL_SECTIONS.replace("WITH ", "WITH RECURSIVE ", 1)
    + """,
ea AS (SELECT doc_id, entry_id, min(ord) AS ord, min(title) AS title, min(kind) AS kind, min(nullif(parent, '')) AS parent FROM (SELECT DISTINCT doc_id, entry_id, ord, title, hierarchy.kind AS kind, hierarchy.parent_id AS parent FROM toc_entry) WHERE doc_id IS NOT NULL AND entry_id IS NOT NULL GROUP BY ALL),
eb AS (SELECT doc_id, entry_id, ord, title, kind, CASE WHEN kind = 'known_parent' THEN parent END AS up FROM ea),
ms AS (SELECT doc_id, entry_id, min(status) AS status, min(page) AS page FROM er GROUP BY ALL),
ec AS (SELECT eb.*, status, page, coalesce(status = 'resolved', false) AS kept FROM eb LEFT JOIN ms USING (doc_id, entry_id)),
wa AS (SELECT doc_id, entry_id, entry_id AS cur, up AS nxt, [entry_id] AS seen FROM ec
  UNION ALL SELECT wa.doc_id, wa.entry_id, ec.entry_id, ec.up, list_append(seen, ec.entry_id) FROM wa JOIN ec ON ec.doc_id = wa.doc_id AND ec.entry_id = wa.nxt WHERE NOT list_contains(seen, ec.entry_id)),
wc AS (SELECT doc_id, entry_id, bool_or(nxt IS NOT NULL AND list_contains(seen, nxt)) AS ring, bool_or(nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ec p WHERE p.doc_id = wa.doc_id AND p.entry_id = wa.nxt)) AS orphan FROM wa GROUP BY ALL),
wn AS (SELECT wa.doc_id, wa.entry_id, arg_min(cur, len(seen)) FILTER (p.kept) AS found, arg_max(p.kind, len(seen)) AS root FROM wa JOIN ec p ON p.doc_id = wa.doc_id AND p.entry_id = wa.cur WHERE len(seen) > 1 GROUP BY ALL),
wd AS (SELECT ec.*, found, root, CASE WHEN kept THEN CASE WHEN ring THEN 'cycle' WHEN orphan AND found IS NULL THEN 'missing_parent' END END AS blocked FROM ec LEFT JOIN wc USING (doc_id, entry_id) LEFT JOIN wn USING (doc_id, entry_id)),
pa AS (SELECT doc_id, entry_id, ord, title, status, page, CASE WHEN kept AND blocked IS NULL THEN found END AS parent_id, up AS original_id,
  coalesce(kept AND blocked IS NULL AND (kind = 'unknown' OR (found IS NULL AND coalesce(root = 'unknown', false))), false) AS flattened,
  coalesce(kept AND blocked IS NULL AND up IS NOT NULL AND up IS DISTINCT FROM found, false) AS promoted, blocked FROM wd),
pb AS (SELECT doc_id, min(sha256) AS sha256, min(page_count) AS page_count FROM book GROUP BY ALL)"""
)


def entries(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "toc_entry").select("doc_id", "entry_id", "ord", "title", F.col("hierarchy.kind").alias("kind"), F.nullif("hierarchy.parent_id", F.lit("")).alias("parent_id")).where("doc_id is not null and entry_id is not null")
    return x.groupBy("doc_id", "entry_id").agg(*[F.min(c).alias(c) for c in ("ord", "title", "kind", "parent_id")])


def assembled(spark: SparkSession, d: str) -> DataFrame:
    m = resolved(spark, d).groupBy("doc_id", "entry_id").agg(F.min("status").alias("status"), F.min("page").alias("page"))
    return assemble.assemble(kept(entries(spark, d)), m)


def inputs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "book").groupBy("doc_id").agg(F.min("sha256").alias("sha256"), F.min("page_count").alias("page_count"))


@query(SQL_ASSEMBLED + " SELECT * FROM pa")
def plan_assemble(spark: SparkSession, d: str) -> DataFrame:
    """Every entry as node, promoted, flattened, left out or blocked."""
    return assembled(spark, d)


@query(
    SQL_ASSEMBLED
    + """ SELECT *, n_nodes > 0 AND n_blocked = 0 AS ready, n_nodes > 0 AND n_blocked = 0 AND n_omitted = 0 AND n_flattened = 0 AS ready_strict FROM (
  SELECT doc_id, count(*) FILTER (coalesce(status = 'resolved', false) AND blocked IS NULL) AS n_nodes, count(*) FILTER (NOT coalesce(status = 'resolved', false)) AS n_omitted, count(*) FILTER (promoted) AS n_promoted,
    count(*) FILTER (flattened) AS n_flattened, count(*) FILTER (blocked IS NOT NULL) AS n_blocked FROM pa GROUP BY doc_id)"""
)
def plan_readiness(spark: SparkSession, d: str) -> DataFrame:
    return assemble.readiness(assembled(spark, d))


SQL_PLAN = (
    SQL_ASSEMBLED
    + """,
pj AS (SELECT pa.doc_id, CAST(to_json({schema_version: 1, page_index_base: 0, input: {sha256: sha256, page_count: page_count}, existing_outline_policy: 'replace_in_copy',
   nodes: coalesce(list({id: entry_id, parent_id: parent_id, title: title, destination: {pdf_page_index: page}} ORDER BY ord, entry_id) FILTER (coalesce(status = 'resolved', false) AND blocked IS NULL), []),
   omitted_entries: coalesce(list({entry_id: entry_id, reason: coalesce(status, 'unmapped')} ORDER BY ord, entry_id) FILTER (NOT coalesce(status = 'resolved', false)), []),
   promotions: coalesce(list({node_id: entry_id, original_parent_id: original_id, new_parent_id: parent_id, reason: CASE WHEN parent_id IS NULL THEN 'top_level' ELSE 'nearest_retained' END} ORDER BY ord, entry_id) FILTER (promoted), [])}) AS VARCHAR) AS plan
  FROM pa JOIN pb USING (doc_id) GROUP BY pa.doc_id, sha256, page_count)"""
)


def plans(spark: SparkSession, d: str) -> DataFrame:
    return assemble.plan_json(assembled(spark, d), inputs(spark, d))


@query(SQL_PLAN + " SELECT doc_id, plan FROM pj")
def plan_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole plan of each book as JSON: input, nodes, what is left out and what was promoted."""
    return plans(spark, d)


@query(
    SQL_PLAN
    + """ SELECT doc_id, CAST(v AS BIGINT) AS variant, CASE v WHEN 1 THEN 'members' WHEN 2 THEN 'members' WHEN 3 THEN 'schema_version' WHEN 4 THEN 'sha256' WHEN 5 THEN 'policy' WHEN 6 THEN 'type' ELSE CASE WHEN page_count IS NULL THEN 'type' WHEN sha256 IS NULL THEN 'sha256' END END AS wrong
  FROM (SELECT pj.doc_id, sha256, page_count, unnest(range(7)) AS v FROM pj JOIN pb USING (doc_id))
  WHERE NOT (v IN (5) AND (page_count IS NULL OR sha256 IS NULL)) AND NOT (v = 4 AND page_count IS NULL)"""
)
def plan_decode(spark: SparkSession, d: str) -> DataFrame:
    """Plans read back strictly, whole and damaged in six ways: a member too many or too few, another version, a short digest, another policy, a number as text."""
    p = F.col("plan")
    damaged = [
        p, F.regexp_replace(p, r'^\{"schema_version"', '{"more":1,"schema_version"'), F.replace(p, F.lit('"page_index_base":0,'), F.lit("")), F.regexp_replace(p, r'^\{"schema_version":1', '{"schema_version":2'),
        F.regexp_replace(p, '"sha256":"[0-9a-fA-F]{2}', '"sha256":"'), F.replace(p, F.lit("replace_in_copy"), F.lit("merge")), F.replace(p, F.lit('"page_index_base":0,'), F.lit('"page_index_base":"zero",')),
    ]
    x = cut(plans(spark, d).join(inputs(spark, d), "doc_id"))
    rows = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("variant"), t.alias("text")) for i, t in enumerate(damaged)])).alias("x")
    x = x.select("doc_id", "sha256", "page_count", rows).select("doc_id", "sha256", "page_count", "x.variant", assemble.decode_plan(F.col("x.text")).alias("wrong"))
    # a book without digest or page count has that fault first, whatever else is wrong
    return x.where("not (variant = 5 and (page_count is null or sha256 is null)) and not (variant = 4 and page_count is null)").select("doc_id", "variant", "wrong")


@query(
    SQL_ASSEMBLED
    + """ SELECT doc_id, CAST(to_json({schema_version: 1, outcome: CASE WHEN count(*) FILTER (coalesce(status = 'resolved', false) AND blocked IS NULL) > 0 AND count(*) FILTER (blocked IS NOT NULL) = 0 THEN 'plan_ready' ELSE 'analysis_partial' END,
   entries: list({entry_id: entry_id, title: title, status: coalesce(status, 'unmapped'), pdf_page_index: page} ORDER BY ord, entry_id), blockers: coalesce(list({entry_id: entry_id, reason: blocked} ORDER BY ord, entry_id) FILTER (blocked IS NOT NULL), [])}) AS VARCHAR) AS report FROM pa GROUP BY doc_id"""
)
def analysis_report(spark: SparkSession, d: str) -> DataFrame:
    """The analysis of each book as JSON: outcome, entries with status and page, blockers."""
    kept_ = F.coalesce(F.col("status") == "resolved", F.lit(False))
    entry = F.struct("entry_id", "title", F.coalesce("status", F.lit("unmapped")).alias("status"), F.col("page").alias("pdf_page_index"))
    blocker = F.struct("entry_id", F.col("blocked").alias("reason"))
    g = assembled(spark, d).groupBy("doc_id").agg(
        F.count_if(kept_ & F.col("blocked").isNull()).alias("n"), F.count_if(F.col("blocked").isNotNull()).alias("k"),
        assemble._ordered(F.lit(True), entry, "struct<entry_id:string,title:string,status:string,pdf_page_index:int>").alias("entries"), assemble._ordered(F.col("blocked").isNotNull(), blocker, "struct<entry_id:string,reason:string>").alias("blockers"),
    )
    outcome = F.when((F.col("n") > 0) & (F.col("k") == 0), "plan_ready").otherwise("analysis_partial")
    return g.select("doc_id", F.to_json(F.struct(F.lit(1).alias("schema_version"), outcome.alias("outcome"), "entries", "blockers"), {"ignoreNullFields": "false"}).alias("report"))


@query(
    """SELECT event_id, CAST(v AS BIGINT) AS variant, CASE v WHEN 1 THEN 'end' WHEN 2 THEN 'duplicate' WHEN 3 THEN 'trailing' WHEN 4 THEN 'number' WHEN 5 THEN 'surrogate' WHEN 6 THEN 'depth' END AS fault, CASE WHEN v = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k
  FROM (SELECT event_id, props, event_id % 7 AS v FROM events WHERE props IS NOT NULL)"""
)
def strict_json(spark: SparkSession, d: str) -> DataFrame:
    """Strict reading of a JSON column of which six in seven are damaged: cut off, a key twice, text behind, a leading zero, half a surrogate pair, nested too deep."""
    v, p = F.col("variant"), F.col("props")
    inner = F.regexp_extract(p, r"^\{(.*)\}$", 1)
    text = F.when(v == 1, F.concat(F.lit("{"), inner)).when(v == 2, F.concat(F.lit("{"), inner, F.lit(","), inner, F.lit("}"))).when(v == 3, F.concat(p, F.lit(" x"))).when(v == 4, F.lit('{"k":01}')).when(v == 5, F.lit('{"k":"\\ud800"}')).when(v == 6, F.concat(F.repeat(F.lit("["), 200), F.repeat(F.lit("]"), 200))).otherwise(p)
    x = read(spark, d, "events").where("props is not null").select("event_id", (F.col("event_id") % 7).cast("long").alias("variant"), "props").withColumn("text", text)
    return x.select("event_id", "variant", strict.fault(F.col("text")).alias("fault"), "text").select("event_id", "variant", "fault", F.when(F.col("fault").isNull(), F.get_json_object("text", "$.k").cast("long")).alias("k"))
