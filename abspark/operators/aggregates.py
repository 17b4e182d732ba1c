"""Aggregations over units, results and logs (G items)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abspark.functions.scalars import safe_divide


def sufficient_stats(units: DataFrame, joined: DataFrame) -> DataFrame:
    """G1: users, conversions, value sum and sum of squares as one row. Sums over nothing
    stay NULL; the user count is never NULL."""
    measures = ["conv_count", "conv_value", "conv_sq_value"]
    stacked = units.select(F.lit(1).alias("unit")).unionByName(
        joined.select(*measures), allowMissingColumns=True
    )
    return stacked.agg(
        F.count("unit").alias("user_count"),
        F.sum("conv_count").alias("conversion_count"),
        F.sum("conv_value").alias("total_conversion_value"),
        F.sum("conv_sq_value").alias("total_conversion_sq_value"),
    )


def unit_stats(units: DataFrame, conversions: DataFrame, strict: bool) -> DataFrame:
    """G1 over one use of the units: conversions are joined to the left of every unit and
    summed per key (the join's own partitioning), so units that convert nothing count."""
    late = F.col("conv_time") > F.col("exposure_time")
    if not strict:
        late = late | (F.col("conv_time") == F.col("exposure_time"))
    right = conversions.withColumnRenamed("key", "conv_key")
    met = units.join(right, (F.col("key") == F.col("conv_key")) & late, "left")
    measures = ["conv_count", "conv_value", "conv_sq_value"]
    per_unit = met.groupBy("key").agg(*[F.sum(m).alias(m) for m in measures])
    return per_unit.agg(
        F.count(F.lit(1)).alias("user_count"),
        F.sum("conv_count").alias("conversion_count"),
        F.sum("conv_value").alias("total_conversion_value"),
        F.sum("conv_sq_value").alias("total_conversion_sq_value"),
    )


def distinct_unit_count(units: DataFrame) -> DataFrame:
    """Number of distinct non-NULL keys."""
    return units.agg(F.count_distinct("key").alias("user_count"))


def _of_variant(variant: str, column: str) -> Column:
    return F.sum(F.when(F.col("variant") == variant, F.col(column)).otherwise(0))


def counting_mode(count_all: Column, scope: Column) -> Column:
    """What one conversion is."""
    return (
        F.when(count_all, F.lit("Once per Event"))
        .when(scope == "User", F.lit("Once per User"))
        .otherwise(F.lit("Once per Session"))
    )


def merge_conversion_event_names(a: Column, b: Column) -> Column:
    """One name, or both when the variants differ."""
    return (
        F.when(a.isNull(), b)
        .when(b.isNull() | (a == b), a)
        .otherwise(F.concat(a, F.lit(" / "), b))
    )


def results_to_registry(results: DataFrame, registry: DataFrame) -> DataFrame:
    """Results joined to their active registry rows. Both sides hold one short row per
    variant; Spark broadcasts the registry when its statistics say it is small."""
    wanted = registry.where(F.col("analyze_test")).select(
        "id", "variant", "experiment_name", "identity_source",
        F.col("confidence").cast("double").alias("confidence_level"),
        "hypothesis", "event_value_test", "analyze_test",
        F.col("user_overlap").alias("registry_overlap"),
        "date_comparison", "conversion_count_all",
    )
    return results.join(wanted, ["id", "variant"])


# Columns two rows of one experiment must agree on to be pivoted into one row.
PIVOT_KEYS = [
    "id", "experiment_name", "scope", "confidence_level", "hypothesis",
    "event_value_test", "analyze_test", "registry_overlap", "date_comparison",
    "identity_source", "conversions_counting_mode",
]


def pivot_ab(joined: DataFrame) -> DataFrame:
    """One row per experiment with ``_a`` and ``_b`` columns."""
    sums = {
        "test": "user_count",
        "conversion": "conversion_count",
        "total_conversion_value": "total_conversion_value",
        "total_conversion_sq_value": "total_conversion_sq_value",
    }
    name_a, name_b = F.col("conv_event_a"), F.col("conv_event_b")
    return (
        joined.withColumn(
            "conversions_counting_mode",
            counting_mode(F.col("conversion_count_all"), F.col("scope")),
        )
        .groupBy(*PIVOT_KEYS)
        .agg(
            F.min("date_start").alias("date_start"),
            F.max("date_end").alias("date_end"),
            *[
                _of_variant(v, column).alias(f"{name}_{v.lower()}")
                for name, column in sums.items()
                for v in ("A", "B")
            ],
            *[
                F.max(F.when(F.col("variant") == v, F.col("conversion_event"))).alias(
                    f"conv_event_{v.lower()}"
                )
                for v in ("A", "B")
            ],
        )
        .withColumn("conversion_event", merge_conversion_event_names(name_a, name_b))
        .withColumnRenamed("registry_overlap", "user_overlap")
        .drop("conv_event_a", "conv_event_b")
    )


def has_value_test() -> Column:
    """Value test on, and conversions on both sides."""
    return (
        F.col("event_value_test") & (F.col("conversion_a") > 0) & (F.col("conversion_b") > 0)
    )


def with_moments(ab: DataFrame) -> DataFrame:
    """G4 as columns beside the pivoted row: mean and sample variance of the value over
    conversions. A variant without conversions has neither."""

    def mean(v: str) -> Column:
        return safe_divide(F.col(f"total_conversion_value_{v}"), F.col(f"conversion_{v}"))

    def variance(v: str) -> Column:
        n = F.col(f"conversion_{v}")
        total = F.col(f"total_conversion_value_{v}").cast("double")
        squares = F.col(f"total_conversion_sq_value_{v}").cast("double")
        return safe_divide(squares - safe_divide(total * total, n), n - 1)

    return ab.withColumns(
        {
            **{f"mean_value_{v}": mean(v) for v in "ab"},
            **{f"var_value_{v}": variance(v) for v in "ab"},
        }
    )


def value_moments(ab: DataFrame) -> DataFrame:
    """The moments of the experiments a value test fits."""
    return with_moments(ab).where(has_value_test()).select(
        "id", "hypothesis", "confidence_level",
        F.col("conversion_a").alias("n_a_value"), F.col("conversion_b").alias("n_b_value"),
        "mean_value_a", "mean_value_b", "var_value_a", "var_value_b",
    )


# Fixed value: bytes per TiB.
BYTES_PER_TIB = 1_099_511_627_776


def one_price(registry: DataFrame, tool: str | None = None) -> DataFrame:
    """The price of a run, any positive one of the logged active rows (the highest, so
    that the choice is stable)."""
    logged = registry.where(
        F.col("analyze_test")
        & F.col("query_information_logging")
        & (F.col("query_price_per_tib") > 0)
    )
    if tool is not None:
        logged = logged.where(F.col("analytics_tool") == tool)
    return logged.agg(F.max("query_price_per_tib").alias("query_price_per_tib"))


# Jobs named in one row of the cost log; keeps a row far below a megabyte.
JOBS_PER_PIECE = 5_000


def cost_pieces(job_log: DataFrame, jobs_per_piece: int = JOBS_PER_PIECE) -> DataFrame:
    """id, piece (from 1), job_ids, bytes_billed: the jobs of an id in order of their names,
    so many to a row, so that an id with very many jobs fills rows and not one row."""
    order = Window.partitionBy("id").orderBy("job_id")
    place = F.row_number().over(order) - 1
    jobs = job_log.where(F.col("id").isNotNull()).select("id", "job_id", "bytes_billed")
    piece = (F.floor(place / jobs_per_piece) + 1).cast("int")
    return jobs.withColumn("piece", piece).groupBy("id", "piece").agg(
        F.array_join(F.sort_array(F.collect_list("job_id")), ", ").alias("job_ids"),
        F.sum("bytes_billed").alias("bytes_billed"),
    )


def query_cost_rollup(job_log: DataFrame, price: DataFrame) -> DataFrame:
    """Per experiment the jobs, billed bytes and cost. ``price`` is the one-row frame
    of ``one_price``. Job names are put in order, so the text is stable; it is made of the
    pieces an id has."""
    texts = F.transform(
        F.array_sort(F.collect_list(F.struct("piece", "job_ids"))), lambda p: p["job_ids"]
    )
    named = F.filter(texts, lambda t: t != "")
    per_id = cost_pieces(job_log).groupBy("id").agg(
        F.array_join(named, ", ").alias("job_ids"), F.sum("bytes_billed").alias("total_bytes_billed")
    )
    cost = F.col("total_bytes_billed") / F.lit(BYTES_PER_TIB) * price.scalar()
    return per_id.select(
        "id", "job_ids", "total_bytes_billed",
        cost.cast("decimal(38,9)").alias("estimated_cost_usd"),
    )


def plan_summary(blocks: DataFrame) -> DataFrame:
    """How many experiments a run analyses, updates or only syncs, and the date span of
    those it analyses. ``blocks`` has one row per experiment."""
    choice = F.lower(F.trim(F.coalesce(F.col("analyze_choice"), F.lit(""))))
    yes, update = choice == "yes", choice == "update"
    other_start = F.when(F.col("date_comparison"), F.col("date_start_b"))
    other_end = F.when(F.col("date_comparison"), F.col("date_end_b"))
    starts = [F.col("date_start_a"), other_start]
    ends = [F.col("date_end_a"), other_end]
    return blocks.agg(
        F.count_if(yes).alias("analyze_count"),
        F.count_if(update).alias("update_count"),
        F.count_if(~yes & ~update).alias("status_only_count"),
        F.min(F.when(yes, F.least(*starts, *ends))).alias("date_min"),
        F.max(F.when(yes, F.greatest(*starts, *ends))).alias("date_max"),
    )


def export_summary(stage: DataFrame) -> DataFrame:
    """G7, after staging: experiments per export mode, each id counted once."""
    ident = F.trim(F.col("id"))

    def ids(mode: str) -> Column:
        return F.count_distinct(F.when(F.col("export_mode") == mode, ident))

    return stage.where(F.coalesce(ident, F.lit("")) != "").agg(
        ids("ANALYZE").alias("analyzed"),
        ids("UPDATE").alias("updated"),
        ids("STATUS_ONLY").alias("synced"),
    )


def cost_rows(
    job_log: DataFrame, price: DataFrame, merge_jobs: DataFrame, run_time: Column
) -> DataFrame:
    """G5 as rows of the cost table: the jobs of the run's merge (job_id, bytes_billed) are
    billed to one of its experiments, the smallest id, and every row carries the time of the
    run."""
    billed_to = job_log.agg(F.min("id")).scalar()
    merges = merge_jobs.select(billed_to.alias("id"), "job_id", "bytes_billed")
    jobs = job_log.select("id", "job_id", "bytes_billed").unionByName(merges)
    return query_cost_rollup(jobs, price).select(
        "id", run_time.alias("execution_time"), "job_ids", "total_bytes_billed",
        "estimated_cost_usd",
    )


def distinct_list(rows: DataFrame, *columns: str) -> DataFrame:
    """The distinct combinations of some columns."""
    return rows.select(*columns).distinct()
