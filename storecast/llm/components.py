"""Connected components of an edge table by repeated contraction.

Each round gives every node the smallest node among itself and its neighbours
(one aggregation with map-side combine), replaces the ends of each edge by
those, and drops edges that closed.  With node ids that are hashes the edge set
shrinks by a constant factor a round.  Every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storecast.llm.common import saved, small


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` (u, v longs) -> (node, root): every node that has an edge, and
    the same root for two nodes exactly if a path joins them."""
    edges = saved(edges.where("u <> v").select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), name)
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = saved(ends.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
                         .select("node", F.least("node", "low").alias("root")), name)
        steps.append(step)
        to = small(step)
        edges = saved(edges.join(to.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u")
                           .join(to.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v")
                           .where("ru <> rv")
                           .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
                           .distinct(), name)
    if not steps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = steps[0]
    for step in steps[1:]:
        nxt = small(step).select(F.col("node").alias("root"), F.col("root").alias("_next"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    return saved(out, name)
