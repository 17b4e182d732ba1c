"""Lookup lists and report views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abspark.functions.scalars import format_bytes, full_trim

# Columns of the downloaded report, in order.
RESULT_COLUMNS = [
    "id", "experiment_name", "date_last_analyzed", "date_start", "date_end", "hypothesis",
    "confidence_level", "analyze_test", "user_overlap", "conversion_event",
    "conv_significance", "conv_details", "value_significance", "value_details", "scope",
    "identity_source", "test_a", "conversion_a", "test_b", "conversion_b", "conv_rate_a",
    "conv_rate_b", "conv_z_score", "conv_p_value", "mean_value_a", "mean_value_b",
    "t_value", "value_p_value",
]


def union_distinct(*lists: DataFrame) -> DataFrame:
    """Set union."""
    return reduce(DataFrame.unionByName, lists).distinct()


def merge_lookup_lists(first: DataFrame, second: DataFrame) -> DataFrame:
    """Trimmed, distinct, without blanks, sorted by the last column first (scope, then
    name). Works for one and for two columns."""
    columns = first.columns
    trimmed = [full_trim(F.col(c).cast("string")).alias(c) for c in columns]
    both = first.select(*trimmed).unionByName(second.select(*trimmed))
    filled = reduce(lambda a, b: a & b, [F.col(c) != "" for c in columns])
    return both.where(filled).distinct().orderBy(*reversed(columns))


def with_default_entry(rows: DataFrame, **default: str) -> DataFrame:
    """The list plus a configured entry, unless it is blank or listed already."""
    values = {name: text.strip() for name, text in default.items()}
    if not all(values.values()):
        return rows
    entry = rows.sparkSession.range(1).select(
        *[F.lit(values[c]).alias(c) for c in rows.columns]
    )
    same = reduce(
        lambda a, b: a & b,
        [full_trim(F.col(c)) == text for c, text in values.items()],
    )
    listed = rows.where(same).select(F.lit(1)).limit(1)
    missing = entry.where(~listed.exists())
    return rows.unionByName(missing)


def lookup_order(rows: DataFrame, *columns: str) -> DataFrame:
    """O3: scope first, then name."""
    return rows.orderBy(*columns)


def lookup_table(rows: DataFrame, order: list[str]) -> DataFrame:
    """A whole lookup list in order. A spreadsheet stops after some rows; here none
    are lost, and the sort is a range exchange, not one task."""
    return rows.orderBy(*order)


def results_order() -> list[Column]:
    """O1: active first, latest analysis, highest number, latest end. An id that is not a
    number sorts last instead of failing."""
    return [
        F.desc("analyze_test"),
        F.desc("date_last_analyzed"),
        F.col("id").try_cast("bigint").desc(),
        F.desc("date_end"),
    ]


def download_results(report: DataFrame) -> DataFrame:
    """S14."""
    return report.select(*RESULT_COLUMNS).orderBy(*results_order())


def query_info_order() -> list[Column]:
    """O2."""
    return [F.desc("execution_time"), F.desc("id")]


def download_query_info(table: DataFrame) -> DataFrame:
    """Cost log with readable bytes, newest first."""
    return table.select(
        "id", "execution_time", "job_ids", "total_bytes_billed",
        format_bytes(F.col("total_bytes_billed")).alias("bytes_text"),
        "estimated_cost_usd",
    ).orderBy(*query_info_order())


def unescape_newlines(text: Column) -> Column:
    """A written backslash-n becomes a line break."""
    return F.replace(text, F.lit("\\n"), F.lit("\n"))


def shown_value_parameter(value_test: Column, parameter: Column) -> Column:
    return F.when(value_test, parameter).otherwise(F.lit(""))


def comparison_mark(date_comparison: Column) -> Column:
    return F.when(date_comparison, F.lit("✔")).otherwise(F.lit(""))


def date_period(start: Column, end: Column) -> Column:
    return F.concat(start.cast("string"), F.lit(" - "), end.cast("string"))


def numbered_name(ident: Column, name: Column) -> Column:
    return F.concat(ident, F.lit(". "), name)


def registry_view(experiments: DataFrame) -> DataFrame:
    """Registry as the dashboard shows it."""
    return experiments.withColumns(
        {
            "description_shown": unescape_newlines(F.col("description")),
            "value_parameter_shown": shown_value_parameter(
                F.col("event_value_test"), F.col("experiment_event_value_parameter")
            ),
        }
    )


def report_view(report: DataFrame) -> DataFrame:
    """Report as the dashboard shows it."""
    return report.withColumns(
        {
            "date_comparison_shown": comparison_mark(F.col("date_comparison")),
            "date_period": date_period(F.col("date_start"), F.col("date_end")),
            "id_experiment_name": numbered_name(F.col("id"), F.col("experiment_name")),
        }
    )


def report_search(report: DataFrame, text: str) -> DataFrame:
    """experiment name contains the text, whatever the case."""
    return report.where(F.contains(F.lower("experiment_name"), F.lower(F.lit(text))))
