"""An exact, repeatable draw of n rows with replacement.

Rows stand in the order of the md5 of their key, and draw ``i`` takes the row
at position ``md5(seed, i) mod rows``.  The result depends on the keys and the
seed only, never on the partitioning.  No global sort is needed: rows are
counted by the first four hex digits of their md5 (65,536 buckets at most), a
running sum over those counts turns a position into a bucket and an offset,
and md5s alone are ranked within the buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storecast.operators.joins import broadcast_if_small

BUCKET_DIGITS = 4      # 16^4 buckets


def draw_with_replacement(df: DataFrame, key: Column, n: int, seed: int) -> DataFrame:
    """``n`` rows of ``df`` with the draw's number in ``draw`` (0..n-1).  ``key``
    is a unique string per row; an empty ``df`` or ``n = 0`` gives no rows."""
    rows = df.withColumn("_h", F.md5(key.cast("binary"))).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).checkpoint(eager=True)
    total = counts.agg(F.sum("_n")).first()[0]
    if not total or n <= 0:
        return df.select(F.lit(0).cast("bigint").alias("draw"), "*").where(F.lit(False))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)    # one row per bucket
    starts = counts.select("_b", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # Positions meet buckets by an equality on cells of equal width; a bucket
    # covers few cells, and at most two cells a bucket are made in all.
    width = total // 16 ** BUCKET_DIGITS + 1
    cell = F.explode(F.sequence(F.floor(F.col("_start") / width), F.floor((F.col("_start") + F.col("_n") - 1) / width)))
    cells = F.broadcast(starts.withColumn("_cell", cell))
    pick = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string")).cast("binary")), 1, 15),
                  16, 10).cast("bigint")
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(pick, F.lit(total)).alias("_pos"))
    draws = (draws.withColumn("_cell", F.floor(F.col("_pos") / width)).join(cells, "_cell")
                  .where((F.col("_pos") >= F.col("_start")) & (F.col("_pos") < F.col("_start") + F.col("_n")))
                  .select("draw", "_b", (F.col("_pos") - F.col("_start")).cast("bigint").alias("_at")))
    # Only the md5s are put in order; the drawn ones then fetch their rows.  Rows
    # of one md5 (a repeated key) stand in the order of their columns.
    ranks = rows.select("_b", F.unhex("_h").alias("_m")).withColumns({
        "_at": (F.row_number().over(_in_bucket()) - 1).cast("bigint"),
        "_nth": (F.row_number().over(_in_bucket()) - F.rank().over(_in_bucket())).cast("bigint")})
    picked = broadcast_if_small(draws.checkpoint(eager=True)).join(ranks, ["_b", "_at"]).select("draw", "_m", "_nth")
    picked = picked.checkpoint(eager=True)
    drawn = broadcast_if_small(picked.select("_m").distinct())
    found = rows.select(F.unhex("_h").alias("_m"), *df.columns).join(drawn, "_m", "left_semi").withColumn(
        "_nth", (F.row_number().over(Window.partitionBy("_m").orderBy(*df.columns)) - 1).cast("bigint"))
    return picked.join(found, ["_m", "_nth"]).select("draw", *[F.col(c) for c in df.columns])


def _in_bucket():
    return Window.partitionBy("_b").orderBy("_m")
