"""Problem 2: parent-child links to full hierarchies.

A weighted disjoint-set forest in levels. The links are split by ranges of
(tree, order), so that no tree has to fit into one task and parents mostly lie
in the part of their children. Each part compresses its own links: every
record learns its top within the part and the number of links up to it. Only
tops whose parent lies in another part go on to the next level, as links of
the weight found so far; levels repeat until the rest fits into one task.
Where a level doesn't shrink the links, a pointer-doubling join halves all
walks instead. Paths are put together from the parts' own paths.

Records on or below cycles are found as those that reach no top. Their cycles
are the image of 2**k steps of their links; with the cycles cut open, the
same forest gives the records below.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.session import cut, kept, partitions

ROWS_PER_TASK = 200_000
SEP = "\x1f"
SCHEMA = "t string, a string, ord long, w long, step long, top string, up long, out string, path array<string>"


def by_merge(df: DataFrame) -> DataFrame:
    """``df`` for a join that sorts both sides: Spark takes a kept table for as small as its compressed files and would send the driver all of it."""
    return df.hint("merge")


def _compress(paths: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        x = pd.concat(parts, ignore_index=True)
        n = len(x)
        index = pd.Index(x["t"] + SEP + x["a"])
        link = index.get_indexer(x["t"] + SEP + x["b"].fillna(""))
        link[x["b"].isna().to_numpy()] = -1
        here = np.arange(n)
        w = x["w"].to_numpy(np.int64)
        to, up = np.where(link < 0, here, link), np.where(link < 0, 0, w)
        for _ in range(max(1, math.ceil(math.log2(n + 1))) + 1):
            far = to[to]
            if (far == to).all():  # flat trees are done after a step or two
                break
            up, to = up + up[to], far
        ends = link[to] < 0
        a, b = x["a"].to_numpy(object), x["b"].to_numpy(object)
        x["top"] = np.where(ends, a[to], None)
        x["up"] = np.where(ends, up, 0)
        x["out"] = np.where(ends, b[to], None)
        x["step"] = w
        if paths:
            seg, made = x["seg"].to_list(), [None] * n
            for i in np.argsort(up, kind="stable"):  # a parent has a smaller distance than its children
                if ends[i]:
                    made[i] = [a[i]] if link[i] < 0 else made[link[i]] + list(seg[i])
            x["path"] = made
        else:
            x["path"] = None
        yield x[["t", "a", "ord", "w", "step", "top", "up", "out", "path"]]

    return run


def _forest(links: DataFrame, paths: bool, level: int = 0, before: int | None = None) -> DataFrame:
    """``t, a, end, depth, lost, path`` for links ``t, a, b, ord, w, seg``; ``end`` is null where the walk ends in a cycle.

    ``lost``: the walk ends at a record whose parent doesn't exist. In the
    first level a parent that isn't there makes an orphan; in the others only
    orphans have no ``b``, and a ``b`` that isn't there is a top.
    """
    spark = links.sparkSession
    n = links.count()
    parts = 1 if n <= ROWS_PER_TASK else max(partitions(spark), math.ceil(n / ROWS_PER_TASK))
    if level and before and n > ROWS_PER_TASK and n > 0.7 * before:
        far = links.select("t", F.col("a").alias("b"), F.col("b").alias("b2"), F.col("w").alias("w2"), F.col("seg").alias("seg2"))
        joined = links.join(by_merge(far), ["t", "b"], "left")
        on = F.col("b2").isNotNull()
        links = cut(joined.select("t", "a", F.when(on, F.col("b2")).otherwise(F.col("b")).alias("b"), "ord", F.when(on, F.col("w") + F.col("w2")).otherwise(F.col("w")).alias("w"), F.when(on, F.concat("seg2", "seg")).otherwise(F.col("seg")).alias("seg")))
    split = links.coalesce(1) if parts == 1 else links.repartitionByRange(parts, "t", "ord", "a")
    local = kept(split.mapInPandas(_compress(paths), SCHEMA))
    tops = local.where("a = top and out is not null").select("t", "a", "out", "ord", "step", "path")
    if parts == 1:  # all links were here: what leads out is a top above, or in the first level a missing parent
        end, more = (F.col("out"), F.col("step")) if level else (F.col("a"), F.lit(0).cast("long"))
        over = tops.select("t", F.col("a").alias("top"), end.alias("end2"), more.alias("more"), F.lit(not level).alias("lost2"), F.lit(False).alias("ring"), F.lit(None).cast("array<string>").alias("path2"))
        return _apply(local, over, links, level, paths)
    own = links.select("t", "a", F.col("seg").alias("own"))
    by = local.select("t", F.col("a").alias("out"), F.col("top").alias("b"), F.col("up").alias("up2"), F.col("path").alias("path2"), F.lit(True).alias("hit"))
    met = cut(tops.join(by_merge(by), ["t", "out"], "left").join(by_merge(own), ["t", "a"]))
    pending = met.where("hit is not null") if level else met
    none = F.lit(None).cast("array<string>")
    seg = F.when(F.col("hit").isNotNull(), F.concat(F.slice("path2", 2, F.greatest(F.size("path2") - 1, F.lit(0))), "own")).otherwise(F.col("own")) if paths else none
    onward = pending.where("hit is null or b is not null").select("t", "a", "b", "ord", (F.col("step") + F.coalesce("up2", F.lit(0))).alias("w"), seg.alias("seg"))
    # tops that end here and that others lead to go on with them; one that ends in a cycle goes on as a cycle of its own
    asked = by_merge(onward.select("t", F.col("b").alias("a")).distinct())
    ring = pending.where("hit is not null and b is null").select("t", "a", "ord")
    over = ring.join(asked, ["t", "a"], "left_anti").select("t", F.col("a").alias("top"), F.lit(None).cast("string").alias("end2"), F.lit(0).cast("long").alias("more"), F.lit(False).alias("lost2"), F.lit(True).alias("ring"), none.alias("path2"))
    onward = onward.unionByName(ring.join(asked, ["t", "a"], "left_semi").select("t", "a", F.col("a").alias("b"), "ord", F.lit(1).cast("long").alias("w"), none.alias("seg")))
    if level:
        ended = met.where("hit is null")
        over = over.unionByName(ended.join(asked, ["t", "a"], "left_anti").select("t", F.col("a").alias("top"), F.col("out").alias("end2"), F.col("step").alias("more"), F.lit(False).alias("lost2"), F.lit(False).alias("ring"), none.alias("path2")))
        leave = ended.join(asked, ["t", "a"], "left_semi").select("t", "a", F.col("out").alias("b"), "ord", F.col("step").alias("w"), (F.col("own") if paths else none).alias("seg"))
        orphans = local.where("a = top and out is null").join(asked, ["t", "a"], "left_semi").select("t", "a", F.lit(None).cast("string").alias("b"), "ord", F.col("step").alias("w"), none.alias("seg"))
        onward = onward.unionByName(leave).unionByName(orphans)
    onward = cut(onward)
    above = _forest(onward, paths, level + 1, n).select("t", F.col("a").alias("top"), F.col("end").alias("end2"), F.col("depth").alias("more"), F.col("lost").alias("lost2"), F.col("end").isNull().alias("ring"), F.col("path").alias("path2"))
    return _apply(local, over.unionByName(above), links, level, paths)


def _apply(local: DataFrame, over: DataFrame, links: DataFrame, level: int, paths: bool) -> DataFrame:
    """The part's own results carried on by what is known about the tops that leave it."""
    x = local.join(by_merge(over), ["t", "top"], "left")
    known = F.col("more").isNotNull()
    end = F.when(F.col("ring"), F.lit(None)).when(known, F.col("end2")).otherwise(F.col("top"))
    # in the levels above the first only orphans have no link out
    lost = F.when(known, F.col("lost2")).otherwise(F.lit(bool(level)) & F.col("out").isNull())
    path = F.lit(None).cast("array<string>")
    if paths:
        path = F.when(F.col("path2").isNotNull(), F.concat("path2", F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))))).otherwise(F.col("path"))
        if level:  # the top's own link leads to a record that isn't among these links
            seg = links.select("t", F.col("a").alias("top"), F.col("seg").alias("_seg"))
            x = x.join(by_merge(seg), ["t", "top"], "left")
            path = F.when(F.col("path2").isNotNull(), path).when(known & ~F.col("ring"), F.concat(F.array("end2"), "_seg", F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))))).otherwise(path)
    return x.select("t", "a", end.alias("end"), F.when(end.isNull(), 0).otherwise(F.col("up") + F.coalesce("more", F.lit(0))).alias("depth"), lost.alias("lost"), F.when(end.isNull(), F.lit(None)).otherwise(path).alias("path"))


def _ring_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    x = pd.concat(parts, ignore_index=True)
    to = pd.Index(x["t"] + SEP + x["a"]).get_indexer(x["t"] + SEP + x["b"])
    order = x["a"].str.encode("utf-8").rank(method="dense").to_numpy()
    least = order.copy()
    names = dict(zip(order, x["a"]))
    for _ in range(math.ceil(math.log2(len(x) + 1)) + 1):
        least = np.minimum(least, least[to])
        to = to[to]
    on = np.unique(to)
    yield pd.DataFrame({"t": x["t"].to_numpy()[on], "a": x["a"].to_numpy()[on], "least": [names[v] for v in least[on]]})


def _rings(links: DataFrame) -> DataFrame:
    """``t, a, least`` of the records on cycles, for links that all end in one: the image of 2**k steps."""
    n = links.count()
    if n <= ROWS_PER_TASK:
        return links.select("t", "a", "b").coalesce(1).mapInPandas(_ring_part, "t string, a string, least string")
    now = cut(links.select("t", "a", "b", F.col("a").alias("least")))
    for _ in range(math.ceil(math.log2(n + 1)) + 1):
        far = now.select("t", F.col("a").alias("b"), F.col("b").alias("b2"), F.col("least").alias("l2"))
        now = cut(now.join(by_merge(far), ["t", "b"]).select("t", "a", F.col("b2").alias("b"), F.least("least", "l2").alias("least")))
    on = now.select("t", F.col("b").alias("a")).distinct()
    return now.select("t", "a", "least").join(by_merge(on), ["t", "a"], "left_semi")


def _links(df: DataFrame, by: list[str], rec: str, parent: str, order: str | None) -> DataFrame:
    """The one link of every usable record."""
    t = F.concat_ws(SEP, *[F.col(c).cast("string") for c in by])
    usable = F.col(rec).isNotNull()
    for c in by:
        usable &= F.col(c).isNotNull()
    up = F.when(F.col(parent) != "", F.col(parent).cast("string"))
    near = F.col(order).cast("long") if order else F.lit(0).cast("long")
    nodes = df.where(usable).select(t.alias("t"), F.col(rec).cast("string").alias("a"), up.alias("b"), F.coalesce(near, F.lit(0)).alias("ord"))
    return nodes.groupBy("t", "a").agg(F.min(F.struct("b", "ord")).alias("m")).select("t", "a", "m.b", "m.ord", F.lit(1).cast("long").alias("w"), F.array("a").alias("seg"))


def hierarchy(df: DataFrame, by: list[str], rec: str, parent: str, order: str | None = None, paths: bool = False) -> DataFrame:
    """Root, depth, state and (if asked for) path of every record of a parent-pointer table.

    Result: the columns of ``by`` as strings, ``rec_id``, ``root_id``,
    ``depth`` (int), ``state`` and, with ``paths``, ``path`` (ids from the root
    or the first record on a cycle down to the record). Other columns are left
    out, whatever their names. ``order`` only tells which records lie near each
    other. States: ``tree``, ``orphan``, ``cycle``, ``below_cycle``; see README.

    Null or empty parents mean top level. Rows with a null id or a null in
    ``by`` take no part. Repeated rows count once; of rows that repeat an id
    with different parents the smallest parent counts, none being smallest. An
    empty table gives an empty result.
    """
    links = kept(_links(df, by, rec, parent, order))
    all_ = kept(_forest(links, paths))
    state = F.when(F.col("lost"), "orphan").otherwise("tree")
    done = all_.where("end is not null").select("t", "a", F.col("end").alias("root_id"), "depth", state.alias("state"), "path")
    stuck = all_.where("end is null").select("t", "a")
    if not stuck.isEmpty():
        rest = cut(links.join(by_merge(stuck), ["t", "a"], "left_semi"))
        rings = cut(_rings(rest))
        opened = rest.join(by_merge(rings.select("t", "a", "least")), ["t", "a"], "left").select("t", "a", F.when(F.col("least").isNull(), F.col("b")).alias("b"), "ord", "w", "seg")
        below = _forest(cut(opened), paths).join(by_merge(rings.select("t", F.col("a").alias("end"), "least")), ["t", "end"])
        kind = F.when(F.col("a") == F.col("end"), "cycle").otherwise("below_cycle")
        done = done.unionByName(below.select("t", "a", F.col("least").alias("root_id"), "depth", kind.alias("state"), "path"))
    out = [F.split("t", SEP)[i].alias(c) for i, c in enumerate(by)] + [F.col("a").alias("rec_id"), "root_id", F.col("depth").cast("int").alias("depth"), "state"]
    return done.select(*out, *(["path"] if paths else []))


def descendants(tree: DataFrame, by: list[str], states: tuple[str, ...] = ("tree", "orphan")) -> DataFrame:
    """``by, rec_id, descendant, distance`` for each record and each record of ``states`` below it, from ``hierarchy(..., paths=True)``.

    As many rows as the sum of these records' depths. What lies on and below
    cycles is in ``all_descendants``.
    """
    up = F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("_at", "above")
    x = tree.where((F.size("path") > 1) & F.col("state").isin(*states)).select(*by, F.col("rec_id").alias("descendant"), F.size("path").alias("_n"), up)
    return x.select(*by, F.col("above").alias("rec_id"), "descendant", (F.col("_n") - 1 - F.col("_at")).alias("distance"))


def all_descendants(df: DataFrame, by: list[str], rec: str, parent: str, order: str | None = None) -> DataFrame:
    """``by, rec_id, descendant, distance`` for each record and each other record from which following parents leads to it.

    ``distance`` counts the links, each record being passed once at most. The
    records of a cycle so are descendants of each other, and what lies below
    one of them is below all. A record is no descendant of its own.
    """
    tree = kept(hierarchy(df, by, rec, parent, order, paths=True))
    out = descendants(tree, by, ("tree", "orphan", "below_cycle"))
    inner = tree.where("state in ('cycle', 'below_cycle')").select(F.concat_ws(SEP, *by).alias("t"), "rec_id", "root_id", "depth", "state", F.col("path")[0].alias("gate"))
    if inner.isEmpty():
        return out
    ring = inner.where("state = 'cycle'").select("t", F.col("rec_id").alias("a"), "root_id")
    links = _links(df, by, rec, parent, order).join(ring, ["t", "a"])
    # cut open at its least record, a cycle is a chain whose depths are the places on it
    chain = cut(links.select("t", "a", F.when(F.col("a") != F.col("root_id"), F.col("b")).alias("b"), "ord", "w", "seg"))
    place = cut(_forest(chain, False).select("t", F.col("end").alias("root_id"), F.col("a").alias("above"), F.col("depth").alias("place")))
    size = place.groupBy("t", "root_id").agg(F.count("*").alias("size"))
    gate = place.select("t", "root_id", F.col("above").alias("gate"), F.col("place").alias("gate_place"))
    x = inner.join(gate, ["t", "root_id", "gate"]).join(size, ["t", "root_id"]).join(place, ["t", "root_id"]).where("above <> gate")
    far = F.col("depth") + F.pmod(F.col("gate_place") - F.col("place"), F.col("size"))
    names = [F.split("t", SEP)[i].alias(c) for i, c in enumerate(by)]
    return out.unionByName(x.select(*names, F.col("above").alias("rec_id"), F.col("rec_id").alias("descendant"), far.cast("int").alias("distance")))
