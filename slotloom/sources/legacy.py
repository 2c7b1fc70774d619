"""The legacy table of whole documents, looked for in the catalogue and among files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slotloom.plans.schema import LEGACY


def probe(spark: SparkSession, name: str) -> DataFrame | None:
    """file_key, content of a legacy table or Parquet folder; None if there is none, or it lacks these columns."""
    if "/" not in name:
        found = spark.table(name) if spark.catalog.tableExists(name) else None
    else:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        found = spark.read.parquet(name) if there else None
    return found.select(*LEGACY.names) if found is not None and set(LEGACY.names) <= set(found.columns) else None
