"""Scans of the event tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abspark.sources.layouts import (
    FlatLayout,
    NestedLayout,
    OneBagLayout,
    TwoBagLayout,
)

# Names of the two shard families, near-real-time first.
FRESH_PREFIX = "events_fresh_"
DAILY_PREFIX = "events_"


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Day shards stored as ``table_suffix=YYYYMMDD`` folders. The suffix stays text, so
    a suffix range prunes folders before any file is opened."""
    df = spark.read.parquet(path)
    if dict(df.dtypes).get("table_suffix") == "string":
        return df
    return df.withColumn("table_suffix", F.col("table_suffix").cast("string"))


def read_chosen_shards(spark: SparkSession, catalog: DataFrame, root: str) -> DataFrame:
    """The nested event table read through the choice of family: ``root`` holds one folder
    of day shards per family, named like its prefix. Only the choice reaches the driver."""
    fresh = F.col("table_name").startswith(FRESH_PREFIX)
    any_fresh = not catalog.where(fresh).isEmpty()
    prefix = FRESH_PREFIX if any_fresh else DAILY_PREFIX
    return read_shards(spark, f"{root.rstrip('/')}/{prefix}")


def scan_chosen_shards(spark: SparkSession, root: str, start: dt.date, end: dt.date) -> DataFrame:
    """Shards of the days start..end, each day from one family: the daily shard where there
    is one, else the fresh one. (``choose_fresh_shards`` decides for all days at once, so a
    day that only the other family holds would be missing.) The days either family has reach
    the driver, some hundreds; both readers then list and open only the days chosen for them."""
    daily, fresh = (read_shards(spark, f"{root.rstrip('/')}/{p}") for p in (DAILY_PREFIX, FRESH_PREFIX))
    days = [
        scan_sharded_events(family, start, end).select("table_suffix").distinct() for family in (daily, fresh)
    ]
    only_fresh = [r.table_suffix for r in days[1].join(days[0], "table_suffix", "left_anti").collect()]
    chosen = scan_sharded_events(daily, start, end)
    if not only_fresh:
        return chosen
    return chosen.unionByName(
        fresh.where(F.col("table_suffix").isin(*sorted(only_fresh))), allowMissingColumns=True
    )


def scan_sharded_events(
    events: DataFrame, start: dt.date, end: dt.date
) -> DataFrame:
    """Shards whose suffix lies in start..end, both included."""
    return events.where(NestedLayout(events.schema).in_window(start, end))


def choose_fresh_shards(names: list[str]) -> str:
    """Prefix of the shard family to read, given the table names that exist."""
    fresh = any(name.startswith(FRESH_PREFIX) for name in names)
    return FRESH_PREFIX if fresh else DAILY_PREFIX


def chosen_shards(catalog: DataFrame) -> DataFrame:
    """The same choice over a table of table names: the rows of the chosen family, with
    the day suffix split off."""
    name = F.col("table_name")
    fresh = name.startswith(FRESH_PREFIX)
    daily = name.startswith(DAILY_PREFIX) & ~fresh
    any_fresh = catalog.agg(F.coalesce(F.bool_or(fresh), F.lit(False))).scalar()
    begin = F.when(fresh, len(FRESH_PREFIX) + 1).otherwise(len(DAILY_PREFIX) + 1)
    return (
        catalog.where(fresh | daily)
        .where(fresh == any_fresh)
        .select("table_name", F.substr(name, begin).alias("table_suffix"))
    )


def scan_flat_events(events: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return events.where(FlatLayout(events.schema).in_window(start, end))


def scan_json2_events(events: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return events.where(TwoBagLayout(events.schema).in_window(start, end))


def scan_json1_events(events: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return events.where(OneBagLayout(events.schema).in_window(start, end))
