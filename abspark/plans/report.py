"""Report pipeline: pivoted results, the fitting test, one row per experiment."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abspark.functions import stats
from abspark.operators.aggregates import (
    has_value_test,
    pivot_ab,
    results_to_registry,
    with_moments,
)
from abspark.plans.analyze import analyze_all
from abspark.schemas import REPORT

# Fixed value: text of a report row without value test.
NOT_TESTED = "Not tested"

_RATE_FIELDS = {
    "rate_a": "conv_rate_a",
    "rate_b": "conv_rate_b",
    "z_val": "conv_z_score",
    "p_val": "conv_p_value",
    "significance": "conv_significance",
    "details": "conv_details",
}
_WELCH_FIELDS = {
    "metric_a": "mean_value_a",
    "metric_b": "mean_value_b",
    "stat": "t_value",
    "p_value": "value_p_value",
    "significance": "value_significance",
    "details": "value_details",
}


def is_rate_mode() -> Column:
    return F.col("conversions_counting_mode") == "Once per Event"


def valid_for_proportions() -> Column:
    """R2: once mode, somebody on both sides, and no more conversions than units."""
    return (
        ~is_rate_mode()
        & (F.col("test_a") > 0)
        & (F.col("test_b") > 0)
        & F.col("conversion_a").between(0, F.col("test_a"))
        & F.col("conversion_b").between(0, F.col("test_b"))
    )


def valid_for_rates() -> Column:
    """Count-all mode and somebody on both sides."""
    return is_rate_mode() & (F.col("test_a") > 0) & (F.col("test_b") > 0)


def _double(name: str) -> Column:
    return F.col(name).cast("double")


def _bigint(name: str) -> Column:
    return F.col(name).cast("bigint")


def test_proportions(ab: DataFrame) -> DataFrame:
    """Struct ``proportion``, NULL on rows the test does not fit."""
    stats.register(ab.sparkSession)
    result = stats.ab_result(
        _double("test_a"), _double("conversion_a"), _double("test_b"),
        _double("conversion_b"), _double("confidence_level"), F.col("hypothesis"),
    )
    return ab.withColumn("proportion", F.when(valid_for_proportions(), result))


def test_rates(ab: DataFrame) -> DataFrame:
    """Struct ``rate``, NULL on rows the test does not fit."""
    stats.register(ab.sparkSession)
    result = stats.ab_rate_test(
        _bigint("test_a"), _bigint("conversion_a"), _bigint("test_b"),
        _bigint("conversion_b"), _double("confidence_level"), F.col("hypothesis"),
    )
    return ab.withColumn("rate", F.when(valid_for_rates(), result))


def _welch(n_a: str, n_b: str) -> Column:
    return stats.ab_count_welch(
        _bigint(n_a), F.col("mean_value_a"), F.col("var_value_a"),
        _bigint(n_b), F.col("mean_value_b"), F.col("var_value_b"),
        _double("confidence_level"), F.col("hypothesis"),
    )


def test_values(moments: DataFrame) -> DataFrame:
    """Welch test on the rows of ``value_moments``."""
    stats.register(moments.sparkSession)
    return moments.select("id", _welch("n_a_value", "n_b_value").alias("welch"))


def attach_stats(ab: DataFrame) -> DataFrame:
    """The columns of whichever test fits. Both tests are columns of the same row, so
    no join is needed."""
    tested = test_rates(test_proportions(ab))
    return tested.select(
        *ab.columns,
        *[
            F.coalesce(F.col(f"proportion.{name}"), F.col(f"rate.{name}")).alias(out)
            for name, out in _RATE_FIELDS.items()
        ],
    )


def attach_value_test(conv: DataFrame, values: DataFrame) -> DataFrame:
    """Value-test columns of another frame by id; without a text the row reads 'Not
    tested'."""
    flat = values.select(
        "id", *[F.col(f"welch.{name}").alias(out) for name, out in _WELCH_FIELDS.items()]
    )
    return conv.join(flat, "id", "left").withColumn(
        "value_details", F.coalesce("value_details", F.lit(NOT_TESTED))
    )


def with_value_test(ab: DataFrame) -> DataFrame:
    """J5 where moments and row come from the same frame: the test is a column, so the
    events behind the frame are not read a second time for a join with itself."""
    stats.register(ab.sparkSession)
    welch = F.when(has_value_test(), _welch("conversion_a", "conversion_b"))
    tested = with_moments(ab).withColumn("welch", welch)
    columns = {out: F.col(f"welch.{name}") for name, out in _WELCH_FIELDS.items()}
    columns["value_details"] = F.coalesce(columns["value_details"], F.lit(NOT_TESTED))
    return tested.select(*ab.columns, *[c.alias(out) for out, c in columns.items()])


def build_report(ab: DataFrame, run_date: dt.date) -> DataFrame:
    """The 30 report columns for every pivoted experiment."""
    full = attach_stats(with_value_test(ab)).withColumn(
        "date_last_analyzed", F.lit(run_date)
    )
    return full.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in REPORT.fields]
    )


def run_report(
    registry: DataFrame,
    filters: DataFrame | None,
    events: Mapping[str, DataFrame],
    run_date: dt.date,
    strict_reference: bool = False,
) -> DataFrame:
    """Registry and event tables to report rows. ``skipped_in_report`` names the rows that
    cannot run."""
    results = analyze_all(registry, filters, events, strict_reference)
    return build_report(pivot_ab(results_to_registry(results, registry)), run_date)
