"""Who counts for a variant when a key saw more than one.

Input is always ``key, exposure_time, variant`` and output ``key, exposure_time``: one row
per credited unit. Ties on time go to the smaller variant text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abspark.operators.exposures import matches_variant
from abspark.spec import BOTH, EXCLUDE, FIRST, LAST, POLICIES


# Exposures of a key within so many microseconds are numbered in one task.
BUCKET_MICROS = 3_600_000_000


def _ranked(exposures: DataFrame, latest_first: bool) -> DataFrame:
    """Exposures numbered per key. A key's exposures are cut into buckets of time, so that a
    key (or NULL) that holds a third of all rows is numbered by as many tasks as it has
    buckets: a row's number is its place in the bucket plus the rows of the buckets before.
    Rows that agree in time and text are counted before the shuffle and get consecutive
    numbers. Both uses of the counts share one exchange."""
    counted = exposures.groupBy("key", "exposure_time", "variant").agg(F.count("*").alias("times"))
    micros = F.unix_micros(F.col("exposure_time").cast("timestamp"))
    counted = counted.withColumn("bucket", F.floor(micros / BUCKET_MICROS))
    in_turn = (lambda c: F.col(c).desc_nulls_last()) if latest_first else (lambda c: F.col(c).asc_nulls_last())
    totals = counted.groupBy("key", "bucket").agg(F.sum("times").alias("total"))
    earlier = Window.partitionBy("key").orderBy(in_turn("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        F.col("key").alias("of_key"), F.col("bucket").alias("of_bucket"),
        F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"),
    )
    order = Window.partitionBy("key", "bucket").orderBy(in_turn("exposure_time"), "variant")
    within = F.sum("times").over(order.rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("key").eqNullSafe(F.col("of_key")) & F.col("bucket").eqNullSafe(F.col("of_bucket"))
    rows = counted.withColumn("within", within).join(before, same)
    last = F.col("before") + F.col("within")
    rows = rows.withColumn("rn", F.explode(F.sequence(last - F.col("times") + 1, last)))
    return rows.select("key", "exposure_time", "variant", F.col("rn").cast("int").alias("rn"))


def first_exposure_rank(exposures: DataFrame) -> DataFrame:
    """Exposures numbered per key, earliest first."""
    return _ranked(exposures, latest_first=False)


def last_exposure_rank(exposures: DataFrame) -> DataFrame:
    """Exposures numbered per key, latest first."""
    return _ranked(exposures, latest_first=True)


def variant_spans(exposures: DataFrame) -> DataFrame:
    """First and last time per key and variant text. This is the step that shrinks the
    data: fixed-width buffers, so a hash aggregate with map-side combine, and a key that
    holds a large share of all rows leaves each map task as a handful of rows."""
    return exposures.groupBy("key", "variant").agg(
        F.min("exposure_time").alias("first_time"),
        F.max("exposure_time").alias("last_time"),
    )


def overlap_first_exposure(exposures: DataFrame, pattern: str) -> DataFrame:
    """A1: the earliest labelled exposure decides."""
    first = F.min(F.struct("first_time", "variant"))
    return (
        variant_spans(exposures)
        .groupBy("key")
        .agg(first.alias("pick"))
        .where(matches_variant(F.col("pick.variant"), pattern))
        .select("key", F.col("pick.first_time").alias("exposure_time"))
    )


def overlap_last_exposure(exposures: DataFrame, pattern: str) -> DataFrame:
    """A2: the latest labelled exposure decides, and conversions count from it on."""
    newest_first = F.struct(
        (-F.unix_micros(F.col("last_time").cast("timestamp"))).alias("age"),
        F.col("variant"),
        F.col("last_time"),
    )
    return (
        variant_spans(exposures)
        .groupBy("key")
        .agg(F.min(newest_first).alias("pick"))
        .where(matches_variant(F.col("pick.variant"), pattern))
        .select("key", F.col("pick.last_time").alias("exposure_time"))
    )


def overlap_exclude(exposures: DataFrame, pattern: str) -> DataFrame:
    """A3: only keys that saw exactly one variant text; a NULL key is no unit."""
    return (
        variant_spans(exposures.where(F.col("key").isNotNull()))
        .groupBy("key")
        .agg(
            F.count("*").alias("texts"),
            F.min("variant").alias("variant"),
            F.min("first_time").alias("exposure_time"),
        )
        .where((F.col("texts") == 1) & matches_variant(F.col("variant"), pattern))
        .select("key", "exposure_time")
    )


def overlap_credit_both(exposures: DataFrame, pattern: str) -> DataFrame:
    """A4: first matching exposure, whatever else the key saw."""
    return (
        exposures.where(matches_variant(F.col("variant"), pattern))
        .groupBy("key")
        .agg(F.min("exposure_time").alias("exposure_time"))
    )


OVERLAP = {
    FIRST: overlap_first_exposure,
    LAST: overlap_last_exposure,
    EXCLUDE: overlap_exclude,
    BOTH: overlap_credit_both,
}


def split_by_policy(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A5: rows with a known overlap policy, and the rows that are skipped."""
    known = F.coalesce(F.col("user_overlap").isin(POLICIES), F.lit(False))
    return registry.where(known), registry.where(~known)


def exclude_join(exposures: DataFrame, pattern: str) -> DataFrame:
    """First exposure per key and variant beside the number of variants the key saw.
    A join of two uses of the same rows would read the events twice; the count and the one
    row it is joined to come from one aggregate instead."""
    return overlap_exclude(exposures, pattern)


def post_exposure_join(units: DataFrame, conversions: DataFrame, strict: bool) -> DataFrame:
    """Conversions of a unit after (strict) or not before its exposure. An equi-join
    on the key with the time test as residual; NULL keys never match. A key with very many
    conversions is split by adaptive execution, its one unit row being repeated."""
    after = (
        F.col("conv_time") > F.col("exposure_time")
        if strict
        else F.col("conv_time") >= F.col("exposure_time")
    )
    return units.join(conversions, "key").where(after)
