"""Sales records to text, ids and metadata for the vector index, plus
the index table operations (S16-S18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storecast.functions.text import record_id, record_text
from storecast.operators import joins
from storecast.operators.ordering import newest_rows
from storecast.sources import fixtures as fx
from storecast.sources.tables import Tables

# Row key of a sale (unique in the fact) and tie-break order after the date.
TIE_COLS = ("order_id", "line_no", "part_id", "store_nbr")
NEWEST_RECORDS = 500_000       # N of the newest-N selection (source default)
DAILY_DAYS = 1                 # days loaded by the daily update (source default)
INDEX_CAPACITY = 1_000_000     # our configured index capacity, for fullness


def sales_with_stores(t: Tables) -> DataFrame:
    return joins.join_stores(fx.r_sales(t), fx.r_stores(t))


def row_key():
    return F.concat_ws("-", *[F.col(c).cast("string") for c in TIE_COLS])


def latest_days(df: DataFrame, days: int = DAILY_DAYS) -> DataFrame:
    """Rows with ``date > max(date) - days`` (strict); max is a scalar
    subquery over the fact's date column only."""
    newest = df.agg(F.max("date")).scalar()
    return df.where(F.col("date") > F.date_sub(newest, days))


def to_records(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text, id and metadata columns of each sale.  City and state
    are optional (null = absent); the loads never set a holiday flag."""
    text = record_text(F.col("date"), F.col("store_nbr"), F.col("city"), F.col("family"),
                       F.col("sales"), F.col("onpromotion"))
    return df.select(
        *keep,
        record_id(F.col("date"), F.col("store_nbr"), F.col("family"), row_key()).alias("id"),
        F.col("date").cast("string").alias("date"),
        F.col("store_nbr").cast("int").alias("store_nbr"),
        F.col("family"),
        F.col("sales").cast("double").alias("sales"),
        text.alias("text"),
        F.col("city"), F.col("state"),
        F.col("onpromotion").cast("int").alias("onpromotion"),
        F.lit(None).cast("int").alias("is_holiday"),
    )


def newest(t: Tables, n: int = NEWEST_RECORDS) -> DataFrame:
    """L1: the newest ``n`` sales with stores.  The cut is made on the fact
    alone (a store joins once, so the join changes no row count)."""
    return joins.join_stores(newest_rows(fx.r_sales(t), n, "date", TIE_COLS), fx.r_stores(t))


def initial_selection(t: Tables, max_records: int | None = None) -> DataFrame:
    """The sales of the initial load: all of them, or the newest
    ``max_records`` where a caller asks for that."""
    return sales_with_stores(t) if max_records is None else newest(t, max_records)


def initial_load(t: Tables, max_records: int | None = None) -> DataFrame:
    return to_records(initial_selection(t, max_records))


def daily_load(t: Tables, days: int = DAILY_DAYS) -> DataFrame:
    return to_records(joins.join_stores(latest_days(fx.r_sales(t), days), fx.r_stores(t)))


def upsert(index: DataFrame, batch: DataFrame, order_col: str) -> DataFrame:
    """Rows of ``batch`` replace index rows with the same id; within the
    batch the last row by ``order_col`` wins (rows equal in it: by a hash of
    the whole row, so the winner never depends on partitions).

    Only the batch is grouped by id.  The index (large, ids unique) loses the
    replaced ids through a left anti join with the batch ids; those are
    broadcast when they pass the size check, so the index is not shuffled.
    """
    cols = index.columns
    seq = F.struct(F.col(order_col).cast("bigint"), F.xxhash64(*cols))
    latest = (batch.select(*cols, seq.alias("_seq")).groupBy("id")
                   .agg(F.max_by(F.struct(*cols), F.col("_seq")).alias("_r"))
                   .select("_r.*").checkpoint(eager=True))       # read by the size check and by both sides
    ids = joins.broadcast_if_small(latest.select("id"))
    kept = index.join(ids, "id", "left_anti")
    return kept.select(*cols).unionByName(latest.select(*cols))


def empty_like(index: DataFrame) -> DataFrame:
    """An index with no rows and the same schema."""
    return index.limit(0)


def index_stats(index: DataFrame, capacity: int = INDEX_CAPACITY) -> DataFrame:
    """Vector count, dimension and fullness against our capacity."""
    return index.agg(
        F.count(F.lit(1)).alias("total_vectors"),
        F.max(F.size("values")).cast("int").alias("dimension"),
        (F.count(F.lit(1)) / F.lit(capacity)).cast("decimal(18,6)").alias("index_fullness"))


def write_index(index: DataFrame, path: str) -> None:
    """Persist an index version (a new folder per version; never in place)."""
    index.write.mode("overwrite").parquet(path)


# -- the bucketed store ------------------------------------------------------------

BUCKETS = 256          # folders of a store; an upsert rewrites only those it touches


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def create_store(index: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """An index as one folder per hash bucket of the id.  One shuffle puts a
    bucket's rows together, so each folder holds one file."""
    (index.withColumn("bucket", _bucket(buckets)).repartition("bucket")
     .write.mode("overwrite").partitionBy("bucket").parquet(path))


def read_store(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def upsert_store(spark, path: str, batch: DataFrame, order_col: str, staging: str,
                 buckets: int = BUCKETS) -> list[int]:
    """Upsert ``batch`` into the store at ``path``: only the buckets of its ids are
    read and rewritten (dynamic partition overwrite); the files of all others stay.
    The merged buckets are written to ``staging`` first, so an upsert that fails
    half-way is repeated with the same result.  Returns the buckets rewritten."""
    touched = sorted(r[0] for r in batch.select(_bucket(buckets)).distinct().collect())     # at most ``buckets``
    if not touched:
        return []
    stored = spark.read.parquet(path)
    old = stored.where(F.col("bucket").isin(touched)).drop("bucket")
    merged = upsert(old, batch.select(*old.columns), order_col).withColumn("bucket", _bucket(buckets))
    merged.repartition("bucket").write.mode("overwrite").parquet(staging)
    (spark.read.schema(merged.schema).parquet(staging).repartition("bucket").write
     .mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))
    return touched


def delete_store(spark, path: str) -> None:
    """All rows out, schema and layout kept."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
