"""Exposure and conversion rows of one registry row (P, F and A6/A7 items)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abspark.functions.scalars import all_of
from abspark.sources.layouts import EventLayout
from abspark.spec import CONVERSION_SIDE, EXPOSURE_SIDE, ExperimentSpec


def filter_predicates(layout: EventLayout, spec: ExperimentSpec, side: str) -> list[Column]:
    """Predicates of all filter rows that restrict this side; several are ANDed. They
    keep three-valued logic: a missing property under Exclude is not silently true."""
    found = [layout.filter_predicate(f) for f in spec.side_filters(side)]
    return [p for p in found if p is not None]


def select_active(registry: DataFrame, tool: str | None = None) -> DataFrame:
    """rows to analyse, of one analytics tool or of all."""
    active = registry.where(F.col("analyze_test"))
    return active if tool is None else active.where(F.col("analytics_tool") == tool)


def date_window(events: DataFrame, layout: EventLayout, spec: ExperimentSpec) -> DataFrame:
    """events of the days the row is about."""
    return events.where(layout.in_window(spec.date_start, spec.date_end))


def exposure_predicate(layout: EventLayout, spec: ExperimentSpec) -> Column:
    return all_of(
        [
            layout.in_window(spec.date_start, spec.date_end),
            layout.exposure_guard(spec),
            layout.identity_predicate(spec),
            *filter_predicates(layout, spec, EXPOSURE_SIDE),
        ]
    )


def conversion_predicate(layout: EventLayout, spec: ExperimentSpec) -> Column:
    return all_of(
        [
            layout.in_window(spec.date_start, spec.date_end),
            layout.event_is(spec.conversion_event),
            layout.identity_predicate(spec),
            *filter_predicates(layout, spec, CONVERSION_SIDE),
        ]
    )


def label_exposures(
    events: DataFrame, layout: EventLayout, spec: ExperimentSpec
) -> DataFrame:
    """Exposures with their variant text; events without a usable text drop out."""
    return (
        events.where(exposure_predicate(layout, spec))
        .select(
            layout.grouping_key(spec).alias("key"),
            layout.event_time().alias("exposure_time"),
            layout.exposure_text(spec).alias("variant"),
        )
        .where(F.col("variant").isNotNull())
    )


def conversions_all(
    events: DataFrame, layout: EventLayout, spec: ExperimentSpec
) -> DataFrame:
    """Every conversion event with its value."""
    return events.where(conversion_predicate(layout, spec)).select(
        layout.grouping_key(spec).alias("key"),
        layout.event_time().alias("conv_time"),
        layout.value(spec).alias("conv_value"),
        F.pow(layout.value(spec), F.lit(2)).alias("conv_sq_value"),
        F.lit(1).cast("bigint").alias("conv_count"),
    )


def conversions_once(
    events: DataFrame, layout: EventLayout, spec: ExperimentSpec
) -> DataFrame:
    """One row per key: first conversion of the window, summed value and its square."""
    total = F.sum("conv_value")
    return (
        conversions_all(events, layout, spec)
        .groupBy("key")
        .agg(
            F.min("conv_time").alias("conv_time"),
            total.alias("conv_value"),
            F.pow(total, F.lit(2)).alias("conv_sq_value"),
            F.lit(1).cast("bigint").alias("conv_count"),
        )
    )


def conversions(events: DataFrame, layout: EventLayout, spec: ExperimentSpec) -> DataFrame:
    build = conversions_all if spec.count_all else conversions_once
    return build(events, layout, spec)


def matches_variant(text: Column, pattern: str) -> Column:
    """F8: partial match of the variant text."""
    return text.rlike(pattern)
