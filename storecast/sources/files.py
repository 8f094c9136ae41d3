"""File sources and small tables the jobs persist: CSV scan (S1/S2), fitted
codes (S12) and the run log (S15).  Model files are in ``storecast.models``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column types of the sales inputs (explicit schemas; no inference at scale).
SALES_SCHEMA = "date date, store_nbr int, family string, sales double, onpromotion int"
FUTURE_SCHEMA = "id long, date date, store_nbr int, family string, onpromotion int"
OIL_SCHEMA = "date date, dcoilwtico double"
STORES_SCHEMA = "store_nbr int, city string, state string, type string, cluster int"
HOLIDAYS_SCHEMA = ("date date, type string, locale string, locale_name string, "
                   "description string, transferred boolean")
TRANSACTIONS_SCHEMA = "date date, store_nbr int, transactions int"
CODES_SCHEMA = "col string, value string, code int"
RUN_LOG_SCHEMA = "run_id string, parent_id string, kind string, name string, value string, logged_at timestamp"


def read_csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8",
             date_format: str = "yyyy-MM-dd") -> DataFrame:
    """The columns of ``schema`` by their header names, in that order,
    whatever the file's own order; other columns are left out and a missing one
    is an error.  ``encoding='ISO-8859-1'`` for Latin-1 files.  A malformed cell
    is null here; ``csv_rejects`` lists the rows that have one."""
    raw = _csv_strings(spark, path, encoding)
    return raw.select(*[_typed(f, date_format).alias(f.name) for f in _fields(schema)])


def csv_rejects(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8",
                date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Rows with a cell that does not fit its column's type, as read (strings),
    and ``bad_columns``, the names of those columns."""
    raw = _csv_strings(spark, path, encoding)
    bad = F.filter(F.array(*[F.when(F.col(f.name).isNotNull() & _typed(f, date_format).isNull(), F.lit(f.name))
                             for f in _fields(schema)]), lambda c: c.isNotNull())
    return raw.withColumn("bad_columns", bad).where(F.size("bad_columns") > 0)


# Cells that read as null (fixed values: the usual markers).
NULL_CELLS = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "<NA>", "#N/A")
# From narrow to wide; a column takes the narrowest kind that holds all its cells.
KINDS = ("boolean", "bigint", "double", "date", "string")


def _cell(c: str) -> Column:
    cell = F.trim(F.col(f"`{c}`"))
    return F.when(cell.isNull() | cell.isin(*NULL_CELLS), None).otherwise(cell)


def inferred_schema(spark: SparkSession, path: str, encoding: str = "UTF-8",
                    date_format: str = "yyyy-MM-dd") -> T.StructType:
    """Column types by content.  One aggregate over the whole file merges, per
    column, whether every cell so far fits each kind; a column of nulls alone is a
    double, one that fits no narrower kind a string.  Nothing is sampled, so a
    value that appears late counts like any other."""
    raw = _csv_strings(spark, path, encoding)

    def fits(c: str) -> list[Column]:
        cell = _cell(c)
        tests = {"boolean": F.lower(cell).isin("true", "false"),
                 "bigint": cell.rlike(r"^[+-]?[0-9]+$") & cell.try_cast("bigint").isNotNull(),
                 "double": cell.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(inf|Infinity)$"),
                 "date": F.try_to_timestamp(cell, F.lit(date_format)).isNotNull()}
        return [F.bool_and(F.when(cell.isNotNull(), t)).alias(k) for k, t in tests.items()] + [F.count(cell).alias("n")]

    found = raw.agg(*[F.struct(*fits(c)).alias(f"c{i}") for i, c in enumerate(raw.columns)]).first()
    kinds = ["double" if not r["n"] else next((k for k in KINDS[:-1] if r[k]), "string") for r in found]
    return T.StructType([T.StructField(c, T.StructType.fromDDL(f"x {k}")["x"].dataType)
                         for c, k in zip(raw.columns, kinds)])


def read_csv_inferred(spark: SparkSession, path: str, encoding: str = "UTF-8",
                      date_format: str = "yyyy-MM-dd") -> DataFrame:
    """The file with the types of ``inferred_schema``; null markers are null."""
    raw = _csv_strings(spark, path, encoding)
    out = []
    for f in inferred_schema(spark, path, encoding, date_format).fields:
        cell = _cell(f.name)
        if isinstance(f.dataType, T.DateType):
            cell = F.try_to_timestamp(cell, F.lit(date_format)).cast("date")
        out.append(cell.try_cast(f.dataType).alias(f.name))
    return raw.select(*out)


def _csv_strings(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    return spark.read.option("header", True).option("encoding", encoding).csv(path)


def _fields(schema: str) -> list[T.StructField]:
    return T.StructType.fromDDL(schema).fields


def _typed(field: T.StructField, date_format: str) -> Column:
    cell = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.DateType):
        return F.try_to_timestamp(cell, F.lit(date_format)).cast("date")
    return cell.try_cast(field.dataType)


def save_codes(codes: DataFrame, path: str) -> None:
    """The fitted encoders as one small parquet table."""
    codes.select("col", "value", F.col("code").cast("int")).write.mode("overwrite").parquet(path)


def load_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CODES_SCHEMA).parquet(path)


def log_run(spark: SparkSession, path: str, run_id: str, entries: dict[str, object],
            kind: str = "metric", parent_id: str | None = None) -> None:
    """Append parameters or metrics of a (possibly nested) run."""
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = [(run_id, parent_id, kind, k, str(v), now) for k, v in entries.items()]
    spark.createDataFrame(rows, RUN_LOG_SCHEMA).write.mode("append").parquet(path)


def run_tree(runs: DataFrame, max_depth: int = 64) -> DataFrame:
    """Every run with its root, its depth and the path of ids from the root.
    Levels are joined one by one (a narrow table of run ids); a run whose parent
    is unknown is a root, and runs on a cycle, which have no root, are left out of
    every level and reported with a null root."""
    links = runs.select("run_id", "parent_id").groupBy("run_id").agg(F.max("parent_id").alias("parent_id"))
    links = links.checkpoint(eager=True)
    known = links.select(F.col("run_id").alias("_known"))
    roots = links.join(known, links["parent_id"] == known["_known"], "left").where("_known is null")
    level = roots.select("run_id", F.col("run_id").alias("root_id"), F.lit(0).alias("depth"),
                         F.array("run_id").alias("path")).checkpoint(eager=True)
    found = level
    for depth in range(1, max_depth + 1):
        up = level.select(F.col("run_id").alias("_up"), "root_id", "path")
        level = links.join(up, links["parent_id"] == up["_up"]).select(
            "run_id", "root_id", F.lit(depth).alias("depth"), F.concat("path", F.array("run_id")).alias("path")
        ).checkpoint(eager=True)
        if level.isEmpty():
            break
        found = found.unionByName(level)
    lost = links.join(found.select("run_id"), "run_id", "left_anti").select(
        "run_id", F.lit(None).cast("string").alias("root_id"), F.lit(None).cast("int").alias("depth"),
        F.lit(None).cast("array<string>").alias("path"))
    return found.unionByName(lost)


def metric_rollup(runs: DataFrame, max_depth: int = 64) -> DataFrame:
    """Per run and metric, the entries and the sum over the run and all runs below it."""
    tree = run_tree(runs, max_depth).where("path is not null")
    metrics = runs.where("kind = 'metric'").select("run_id", "name", F.col("value").try_cast("double").alias("value"))
    return (metrics.join(tree, "run_id").select(F.explode("path").alias("run_id"), "name", "value")
            .groupBy("run_id", "name").agg(F.count("value").alias("n"), F.sum("value").alias("total")))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG_SCHEMA).parquet(path)
