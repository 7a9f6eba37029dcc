"""Lines of pages, for what is read from their layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.sources.corpus import PAGE


def page_lines(fragments: DataFrame) -> DataFrame:
    """``page, line, text, t, b, h``: fragments whose centre lies within .4 of the larger height of a growing group; ``h`` is the tallest's."""
    packed = fragments.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(((F.col("t") + F.col("b")) / 2).alias("y"), "l", "region_id", "piece", "text", "t", "b"))).alias("f"))
    ids = F.expr("""
        aggregate(f, named_struct('n', 0, 't', cast(0 as double), 'b', cast(0 as double), 'ids', cast(array() as array<int>)), (a, x) ->
          if(a.n > 0 and abs(x.y - (a.t + a.b) / 2) <= 0.4D * greatest(x.b - x.t, a.b - a.t),
             named_struct('n', a.n, 't', least(a.t, x.t), 'b', greatest(a.b, x.b), 'ids', concat(a.ids, array(a.n))),
             named_struct('n', a.n + 1, 't', x.t, 'b', x.b, 'ids', concat(a.ids, array(a.n + 1)))), a -> a.ids)""")
    x = packed.select(*PAGE, F.explode(F.arrays_zip(F.col("f"), ids.alias("line"))).alias("z")).select(*PAGE, "z.line", "z.f.*")
    parts = F.array_sort(F.collect_list(F.struct("l", "region_id", "piece", "text")))
    g = x.groupBy(*PAGE, "line").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.min("t").alias("t"), F.max("b").alias("b"), F.max(F.expr("b - t")).alias("h"))
    return g
