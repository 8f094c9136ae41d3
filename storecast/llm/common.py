"""Session set-up, shared-folder tables and code shipping for the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storecast.session import apply_conf, ensure_checkpoint_dir, ship_package

# White space and words of the text contracts: ASCII blanks only.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# A side is broadcast only up to this many narrow rows (a few longs each).
BROADCAST_ROWS = 500_000


def start(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on, the shared folder, and the package on
    the Python workers' path."""
    apply_conf(spark)
    ensure_checkpoint_dir(spark)
    # Whole texts travel in Arrow batches: bound them by bytes, not only rows.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    except Exception:  # setting absent in older releases
        pass
    ship_package(spark)
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark)}/storecast/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, and
    survives the loss of an executor."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` marked for broadcast if it is counted to hold at most ``rows``
    rows; otherwise unchanged, so that the join shuffles (skewed keys are split
    by adaptive execution).  Only for narrow, already saved tables."""
    return F.broadcast(side) if side.count() <= rows else side


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


ROW_ID, ROW_TEXT = "__row_id", "__row_text"


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a row key: the id and a hash of the text, so that rows that
    share an id but not a text are told apart."""
    return docs.withColumns({ROW_ID: F.col("doc_id").cast("long"), ROW_TEXT: F.xxhash64(text_or_empty())})


def on_key(table: DataFrame) -> DataFrame:
    """A table with doc_id and text_key, its key renamed for a join with ``keyed``."""
    return table.withColumnsRenamed({"doc_id": "__k_id", "text_key": "__k_text"})


def key_match():
    return F.col(ROW_ID).eqNullSafe(F.col("__k_id")) & (F.col(ROW_TEXT) == F.col("__k_text"))


def one_row_per_key(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``keyed(docs)`` with rows of equal id and text collapsed to one.  ``rows``
    (doc_id, text_key, one row per document) says whether there are any; without
    them no shuffle is added."""
    repeated = saved(rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1")
                     .select("doc_id", "text_key"), "repeated-rows")
    k = keyed(docs)
    if repeated.isEmpty():
        return k
    side = small(on_key(repeated))
    return (k.join(side, key_match(), "left_anti")
            .unionByName(k.join(side, key_match(), "left_semi").dropDuplicates([ROW_ID, ROW_TEXT])))


def keep_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that ``decisions`` (doc_id, text_key,
    kept; one row per document) keeps; of equal rows one."""
    kept = saved(decisions.where("kept").select("doc_id", "text_key").distinct(), "kept-rows")
    rows = one_row_per_key(docs, decisions.select("doc_id", "text_key"))
    return rows.join(small(on_key(kept)), key_match(), "left_semi").drop(ROW_ID, ROW_TEXT)
