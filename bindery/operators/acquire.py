"""Acquisition of pages: what text is worth, which attempt is taken, geometry and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.sources.corpus import PAGE

# Blanks as Unicode counts them on a line.
SPACES = "\t                  　"
# Names of outcomes and modes in the order of their codes; limits of a raster.
OUTCOMES = ["ok", "degraded", "no_text_found", "failed", "cancelled"]
MODES = ["auto", "embedded_pdf", "ocr"]
LIMITS = "dpi=300;max_pixels=80000000;max_bytes=320000000;max_dimension=20000;ocr_budget=64"
# Mean and deviation of the three channels of an image.
MEAN, DEVIATION = [0.485, 0.456, 0.406], [0.229, 0.224, 0.225]
SIDE, CAP, STEP, TINY = 736, 4000, 32, 64
DEVICE = 1_000_000


def assessed(pages: DataFrame, texts: DataFrame, regions: DataFrame) -> DataFrame:
    """Each page with its characters counted, whether they can be used, readability and coverage.

    ``texts`` are all texts, ``regions`` those with a box. Text can be used if
    some of it is visible and fewer than half of its characters are lost or
    controls. A large image over a narrow band of text makes an omission likely.
    """
    v = F.replace("text", F.lit("\n"), F.lit(""))
    n = F.length(v)
    without = lambda x: n - F.length(x)
    count = texts.groupBy(*PAGE).agg(
        F.sum(n).alias("scalars"), F.sum(F.length(F.regexp_replace(v, f"[{SPACES}]", ""))).alias("visible"),
        F.sum(without(F.replace(v, F.lit("�"), F.lit("")))).alias("replaced"), F.sum(without(F.regexp_replace(v, r"[\x00-\x08\x0A-\x1F]", ""))).alias("controls"),
    )
    band = regions.groupBy(*PAGE).agg((F.max("b") - F.min("t")).alias("band"))
    x = pages.join(count, PAGE, "left").join(band, PAGE, "left").fillna({"scalars": 0, "visible": 0, "replaced": 0, "controls": 0})
    x = x.withColumn("usable", (F.col("visible") > 0) & (F.col("replaced") * 2 < F.col("scalars")) & (F.col("controls") * 2 < F.col("scalars")))
    suspected = F.coalesce((F.col("image_object_count") * 0.5 >= 0.5) & (F.col("band") < 0.25 * F.col("height")), F.lit(False))
    clean = F.col("usable") & (F.col("replaced") == 0) & (F.col("controls") == 0)
    x = x.withColumn("readability", F.when(F.col("visible") == 0, "unknown").when(clean, "acceptable").otherwise("suspect"))
    return x.withColumn("coverage", F.when(suspected, "suspected_incomplete").when(F.col("usable"), "no_omission_indicated").otherwise("unknown"))


def choose(pages: DataFrame) -> DataFrame:
    """``doc_id, page_index, source, outcome, prefer_ocr`` from assessed attempts.

    Usable native text is taken, unless an omission is likely and recognised
    text shows more than twice as many characters; without usable native text
    recognised text is. What stays doubtful is degraded.
    """
    done = pages.where("outcome not in ('failed', 'cancelled')")
    order = [F.col("revision"), F.col("visible")]

    def last(cond: Column, prefix: str) -> DataFrame:
        w = Window.partitionBy("doc_id", "page_index").orderBy(*[c.desc() for c in order], "readability", "coverage")
        x = done.where(cond).withColumn("_n", F.row_number().over(w)).where("_n = 1")
        return x.select("doc_id", "page_index", F.lit(True).alias(f"{prefix}_there"), *[F.col(c).alias(f"{prefix}_{c}") for c in ("usable", "visible", "readability", "coverage")])

    x = pages.select("doc_id", "page_index").distinct()
    x = x.join(last(F.col("source") != "ocr", "n"), ["doc_id", "page_index"], "left").join(last(F.col("source") == "ocr", "o"), ["doc_id", "page_index"], "left")
    no, zero = F.lit(False), F.lit(0)
    usable, native, tried = F.coalesce("n_usable", no), F.coalesce("n_there", no), F.coalesce("o_there", no)
    seen, shown = F.coalesce("n_visible", zero), F.coalesce("o_visible", zero)
    omitted = F.coalesce(F.col("n_coverage") == "suspected_incomplete", no)
    need, recognised = ~usable | omitted, tried & (shown > 0)
    prefer = usable & recognised & omitted & (shown > 2 * seen)
    doubtful = F.coalesce(F.col("n_readability") == "suspect", no) | omitted | (need & ~recognised)
    empty = (native & (seen == 0)) | (tried & (shown == 0))
    outcome = F.when(usable, F.when(doubtful, "degraded").otherwise("ok")).when(recognised, "ok").when(empty, F.when(need & ~tried, "failed").otherwise("no_text_found")).otherwise("failed")
    source = F.when(usable & ~prefer, "embedded_pdf").when(usable | recognised, "ocr")
    return x.select("doc_id", "page_index", source.alias("source"), outcome.alias("outcome"), prefer.alias("prefer_ocr"))


def fit(width: Column, height: Column, quarters: Column) -> Column:
    """``struct(a, b, c, d, e, f)``: a page's map to points from the top left, from where (0, 0), (1, 0) and (0, 1) fall on the device."""
    turned = quarters % 2 == 1
    wide, high = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)

    def at(x: float, y: float) -> tuple[Column, Column]:
        right = F.when(quarters == 0, F.lit(x)).when(quarters == 1, F.lit(y)).when(quarters == 2, width - x).otherwise(height - y)
        down = F.when(quarters == 0, height - y).when(quarters == 1, F.lit(x)).when(quarters == 2, F.lit(y)).otherwise(width - x)
        return F.rint(right / wide * DEVICE) * wide / DEVICE, F.rint(down / high * DEVICE) * high / DEVICE

    (ox, oy), (ux, uy), (vx, vy) = at(0.0, 0.0), at(1.0, 0.0), at(0.0, 1.0)
    return F.struct((ux - ox).alias("a"), (uy - oy).alias("b"), (vx - ox).alias("c"), (vy - oy).alias("d"), ox.alias("e"), oy.alias("f"))


def detector_sizes(x: DataFrame) -> DataFrame:
    """``x`` (``w, h`` in pixels) once for each ``kind`` of limit with ``det_w, det_h``: steps of 32, halves to even."""
    tiny = F.col("w") + F.col("h") < TINY
    pad = lambda c: F.when(tiny, F.greatest(F.col(c), F.lit(STEP))).otherwise(F.col(c))
    x = x.withColumn("_w", pad("w")).withColumn("_h", pad("h")).withColumn("kind", F.explode(F.array(*map(F.lit, ("min", "max", "resize_long")))))
    low, high, side = F.least("_w", "_h"), F.greatest("_w", "_h"), F.lit(float(SIDE))
    k = F.when((F.col("kind") == "min") & (low < SIDE), side / low).when((F.col("kind") == "max") & (high > SIDE), side / high).when(F.col("kind") == "resize_long", side / high).otherwise(1.0)
    x = x.withColumn("_rw", F.floor(F.col("_w") * k)).withColumn("_rh", F.floor(F.col("_h") * k))
    top = F.greatest("_rw", "_rh")
    cap = F.when(top > CAP, F.lit(float(CAP)) / top).otherwise(1.0)
    step = lambda c: F.greatest((F.rint(F.floor(F.col(c) * cap) / STEP) * STEP).cast("long"), F.lit(STEP).cast("long"))
    return x.withColumn("det_w", step("_rw")).withColumn("det_h", step("_rh"))


def normalized(values: Column) -> Column:
    mean, deviation = F.array(*map(F.lit, MEAN)), F.array(*map(F.lit, DEVIATION))
    return F.transform(values, lambda v, i: (v.cast("double") / 255.0 - F.element_at(mean, i % 3 + 1)) / F.element_at(deviation, i % 3 + 1))


def clockwise(points: Column) -> Column:
    """Four points as top left, top right, bottom right, bottom left: least and greatest sum, and of the others the difference."""
    by_sum = F.array_sort(F.transform(points, lambda p, i: F.struct((p["x"] + p["y"]).alias("s"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y"))))
    first = by_sum[0]
    # of equal sums the one named first counts as the greatest, too
    last = F.array_max(F.transform(by_sum, lambda p: F.struct(p["s"].alias("s"), (-p["i"]).alias("i"), p["x"].alias("x"), p["y"].alias("y"))))
    rest = F.array_sort(F.transform(F.filter(by_sum, lambda p: (p["i"] != first["i"]) & (p["i"] != -last["i"])), lambda p: F.struct((p["y"] - p["x"]).alias("d"), (-p["i"]).alias("i"), p["x"].alias("x"), p["y"].alias("y"))))
    point = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
    return F.array(point(first), point(rest[0]), point(last), point(rest[1]))


def reading_order(regions: DataFrame, near: float = 10.0) -> DataFrame:
    """``page, ids``: regions from top to bottom, those in about one row from left to right."""
    packed = regions.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(F.col("t").alias("y"), F.col("l").alias("x"), F.col("region_id").alias("id")))).alias("s"))
    ids = F.expr(f"""
        aggregate(s, cast(array() as array<struct<y:double,x:double,id:int>>), (out, e) ->
          concat(slice(out, 1, coalesce(array_max(filter(sequence(0, size(out)), j -> j = 0 or not (abs(e.y - out[j - 1].y) < {near}D and e.x < out[j - 1].x))), 0)), array(e),
                 slice(out, coalesce(array_max(filter(sequence(0, size(out)), j -> j = 0 or not (abs(e.y - out[j - 1].y) < {near}D and e.x < out[j - 1].x))), 0) + 1, size(out))),
          out -> transform(out, e -> e.id))""")
    return packed.select(*PAGE, ids.alias("ids"))


def box_score(values: Column, width: int, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Mean of a map's values in a box, edges included."""
    inside = F.filter(F.transform(values, lambda v, i: F.struct(v.cast("double").alias("v"), i.alias("i"))), lambda e: (e["i"] % width).between(x0, x1) & F.floor(e["i"] / width).between(y0, y1))
    return F.aggregate(inside, F.lit(0.0), lambda s, e: s + e["v"]) / F.size(inside)


def utf16(raw: Column) -> tuple[Column, Column]:
    """Text of little-endian UTF-16 bytes up to a zero unit, and whether something was lost: an odd byte or half a pair."""
    code = F.hex(raw)
    units = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length(code) / 4) - 1, F.lit(0)).cast("int")), lambda i: F.substring(code, i * 4 + 1, F.lit(4))), lambda u: u != "")
    end = F.array_position(units, "0000")
    kept = F.when(end > 0, F.slice(units, F.lit(1), (end - 1).cast("int"))).otherwise(units)
    odd = (F.length(code) % 4 != 0) & (end == 0)
    text = F.decode(F.unhex(F.array_join(kept, "")), "UTF-16LE")
    text = F.when(odd, F.concat(text, F.lit("�"))).otherwise(text)
    high = F.size(F.filter(kept, lambda u: F.substring(u, 3, 2).between("D8", "DB")))
    low = F.size(F.filter(kept, lambda u: F.substring(u, 3, 2).between("DC", "DF")))
    return text, odd | (high != low)


def code(name_: Column, names: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), name_) - 1


def name(code_: Column, names: list[str]) -> Column:
    return F.try_element_at(F.array(*map(F.lit, names)), (code_ + 1).cast("int"))


def configuration(source: Column) -> Column:
    return F.concat(F.lit("mode="), code(source, MODES).cast("string"), F.lit(f";{LIMITS}"))


def cacheable(source: Column, outcome: Column) -> Column:
    return (outcome != "cancelled") & ~((source == "ocr") & (outcome == "failed"))


def text_report(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """``doc_id, report``: pages with their regions, in order, as JSON; absent values are null."""
    whole = lambda c: F.floor(c).cast("long")
    region = F.struct(F.col("region_id").alias("id"), "text", F.array(*[whole(c) for c in "ltrb"]).alias("box"))
    per = regions.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("region_id", "text", "l", "t", "r", "b", region.alias("_x")))), lambda e: e["_x"]).alias("regions"))
    x = pages.select(*PAGE, "outcome", "source").distinct().join(per, PAGE, "left")
    page = F.struct("page_index", "revision", "outcome", "source", F.coalesce("regions", F.array()).alias("regions"))
    ordered = F.array_sort(F.collect_list(page))
    return x.groupBy("doc_id").agg(ordered.alias("p")).select("doc_id", F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(0).alias("page_index_base"), F.col("p").alias("pages")), {"ignoreNullFields": "false"}).alias("report"))
