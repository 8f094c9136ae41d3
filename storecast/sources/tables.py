"""Parquet scans of the input tables.

Each table is one parquet file (or folder) under ``sf_dir``.  Reads are lazy;
column pruning and filter pushdown are left to Catalyst.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ("region nation customer supplier part orders lineitem events "
               "documents embeddings pages benchmark labels conversations").split()


class Tables:
    """Lazy accessor: ``Tables(spark, sf_dir).lineitem`` is a parquet scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_NAMES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(
                os.path.join(self.sf_dir, f"{name}.parquet"))
        return self._cache[name]
