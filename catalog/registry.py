"""Collects the queries and their SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from abspark.session import stage_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that must give the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for files a query writes and reads. One machine's session (a test) may
    have no shared folder; a cluster must name one in spark.checkpoint.dir."""
    alone = spark.sparkContext.master.startswith("local[")
    if alone and not spark.conf.get("spark.checkpoint.dir", None):
        return stage_folder(spark, tempfile.mkdtemp(prefix="stage-"))
    return stage_folder(spark)


def placed(ordered: DataFrame) -> DataFrame:
    """A sorted frame with column place, the position (from 1) each row came out at. The sorted
    rows are written, and the rows of earlier partitions counted, so no task sees all."""
    spark = ordered.sparkSession
    folder = scratch_folder(spark)
    at = F.monotonically_increasing_id()  # partition number, then 33 bits of row number
    ordered.withColumn("at", at).write.parquet(folder)
    rows = spark.read.parquet(folder).withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("at") - F.shiftleft(F.col("part"), 33) + 1
    return rows.join(before, "part").withColumn("place", place).select(*ordered.columns, "place")
