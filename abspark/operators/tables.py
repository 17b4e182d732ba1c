"""Table maintenance (S6-S13): every change is a new DataFrame over the old one.

Plain files cannot be changed in place, so an upsert is the old rows joined with the staged
ones, written as a new snapshot (``merge_into_snapshots`` also publishes it, so that readers
and other writers notice). Where the table format knows MERGE, ``merge_report`` uses it
instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from abspark.functions.scalars import to_double
from abspark.operators.registry import normalize_id
from abspark.schemas import EXPERIMENTS, EXPERIMENTS_STAGE, REPORT
from abspark.sources.snapshots import Version, current_version, publish, read_version


# A cell without a value and a blank one stay apart: only the former is written like this.
BLANKS = {"nullValue": "\\N", "emptyValue": ""}
# A cell may hold line breaks, so a task reads a staged file as a whole: files are kept small.
ROWS_PER_FILE = 50_000


def load_registry(spark: SparkSession, path: str, schema=EXPERIMENTS_STAGE) -> DataFrame:
    """Staged CSV rows with a declared schema; nothing is inferred."""
    return spark.read.schema(schema).csv(path, multiLine=True, escape='"', **BLANKS)


def write_stage(stage: DataFrame, path: str) -> None:
    """Staged rows as CSV, blanks kept as they are, ROWS_PER_FILE in a file at most."""
    stage.write.option("maxRecordsPerFile", ROWS_PER_FILE).csv(
        path, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        nullValue=BLANKS["nullValue"], emptyValue='""',
    )


def unique_rows(source: DataFrame, *keys: str) -> DataFrame:
    """The source, failing on two rows for one key, as a merge would. The rows are counted
    in a window on the key that the join after it needs sorted in any case."""
    text = F.concat_ws(" ", F.lit("more than one row for"), *[F.col(k).cast("string") for k in keys])
    count = F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(*keys))
    checked = F.when(count > 1, F.raise_error(text).cast("boolean")).otherwise(F.lit(True))
    return source.withColumn("one_row", checked).where("one_row").drop("one_row")


def upsert_report(target: DataFrame, source: DataFrame, key: str = "id") -> DataFrame:
    """Source rows replace target rows of the same key; new keys are added. Each side
    is read once: the source may be a whole analysis that is still to run."""
    fresh = unique_rows(source, key).select(key, F.struct(*source.columns).alias("new"))
    old = target.select(key, F.struct(*target.columns).alias("old"))
    both = old.join(fresh, key, "full_outer")
    is_new = F.col("new").isNotNull()
    return both.select(
        *[
            F.when(is_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
            for c in target.columns
        ]
    )


def merge_report(source: DataFrame, table: str) -> None:
    """S7 on a table format with MERGE."""
    same = F.expr(f"{table}.id = source.id")
    (
        source.alias("source")
        .mergeInto(table, same)
        .whenMatched()
        .updateAll()
        .whenNotMatched()
        .insertAll()
        .merge()
    )


def merge_into_snapshots(source: DataFrame, root: str) -> Version:
    """S7 on plain files: the current version with the source rows merged in becomes the
    next one. Fails with ConflictError, and changes nothing, if another writer was faster."""
    spark = source.sparkSession
    base = current_version(spark, root)
    merged = upsert_report(read_version(spark, root, REPORT, base), source)
    return publish(merged, root, base, partition_by=("date_last_analyzed",))


def write_report(report: DataFrame, path: str) -> None:
    """A new snapshot, one folder per analysis date."""
    report.write.mode("errorifexists").partitionBy("date_last_analyzed").parquet(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(path).select(*REPORT.fieldNames())


# Columns each export mode may change on a row that exists already.
UPDATE_COLUMNS = ["experiment_name", "variant_name", "description", "analytics_tool"]


def _mode(column: str = "export_mode") -> Column:
    return F.upper(F.trim(F.col(column)))


def valid_stage(stage: DataFrame) -> DataFrame:
    return stage.where(
        F.col("id").isNotNull() & (F.col("id") != "") & F.col("variant").isin("A", "B")
    )


def upsert_registry(target: DataFrame, stage: DataFrame) -> DataFrame:
    """Merge by export mode. ANALYZE takes all staged columns and adds new rows,
    UPDATE takes the descriptive ones, STATUS_ONLY none; the last two end the analysis.
    Two staged rows for one (id, variant) make it fail."""
    staged = unique_rows(valid_stage(stage), "id", "variant").select(
        "id", "variant", _mode().alias("mode"),
        F.struct(*EXPERIMENTS.fieldNames()).alias("new"),
    )
    old = target.select(
        "id", "variant", F.struct(*EXPERIMENTS.fieldNames()).alias("old")
    )
    mode, exists = F.col("mode"), F.col("old").isNotNull()
    analyze = F.coalesce(mode == "ANALYZE", F.lit(False))
    update = F.coalesce(mode == "UPDATE", F.lit(False))
    stops = F.coalesce(mode.isin("UPDATE", "STATUS_ONLY"), F.lit(False))

    def column(name: str) -> Column:
        result = F.when(analyze, F.col(f"new.{name}"))
        if name in UPDATE_COLUMNS:
            result = result.when(update, F.col(f"new.{name}"))
        if name == "analyze_test":
            result = result.when(stops, F.lit(False))
        return result.otherwise(F.col(f"old.{name}")).alias(name)

    return (
        old.join(staged, ["id", "variant"], "full_outer")
        .where(exists | analyze)
        .select(*[column(name) for name in EXPERIMENTS.fieldNames()])
    )


def replace_children(target: DataFrame, stage: DataFrame) -> DataFrame:
    """Staged ids lose their old rows and get the staged ones."""
    return target.join(stage.select("id"), "id", "left_anti").unionByName(
        stage.select(*target.columns)
    )


def replace_filters(target: DataFrame, ids: DataFrame, stage: DataFrame) -> DataFrame:
    """Every id marked for analysis loses its old filters, so that filters removed
    from the registry disappear; then the staged ones come in."""
    return target.join(ids.select("id"), "id", "left_anti").unionByName(
        stage.select(*target.columns)
    )


def sync_report_names(report: DataFrame, stage: DataFrame) -> DataFrame:
    """Experiment names of variant-A rows in UPDATE mode go to the report."""
    names = (
        stage.where((_mode() == "UPDATE") & (F.col("variant") == "A"))
        .groupBy("id")
        .agg(F.max("experiment_name").alias("new_name"), F.lit(True).alias("renamed"))
    )
    name = F.when(F.col("renamed"), F.col("new_name")).otherwise(F.col("experiment_name"))
    return (
        report.join(names, "id", "left")
        .withColumn("experiment_name", name)
        .select(*report.columns)
    )


def is_number(text: Column) -> Column:
    """A finite number; words that a cast would take for one ('nan', '12d') are none."""
    value = to_double(text)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def ids_with(df: DataFrame, ids: DataFrame | Iterable[str]) -> DataFrame:
    """Numeric ids, zero-padded, as a one-column frame."""
    if not isinstance(ids, DataFrame):
        ids = df.sparkSession.createDataFrame([(i,) for i in ids], "id STRING")
    return (
        ids.where(is_number(F.trim("id")))
        .select(normalize_id(F.col("id")).alias("id"))
        .where(F.col("id") != "")
    )


def delete_experiments(
    tables: Mapping[str, DataFrame], ids: DataFrame | Iterable[str]
) -> dict[str, DataFrame]:
    """The tables without the rows of these ids. Only numeric ids can be deleted."""
    return {
        name: df.join(ids_with(df, ids), "id", "left_anti") for name, df in tables.items()
    }


def delete_query_info(table: DataFrame, job_ids: DataFrame | Iterable[str]) -> DataFrame:
    """The cost log without the rows of exactly these job texts."""
    if isinstance(job_ids, DataFrame):
        return table.join(job_ids.select("job_ids"), "job_ids", "left_anti").select(
            *table.columns
        )
    named = F.col("job_ids").isin(list(job_ids))
    return table.where(F.coalesce(~named, F.lit(True)))


def rows_with_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is listed; a key that is listed twice does not repeat them."""
    return rows.join(ids.select(key), key, "left_semi").select(*rows.columns)


def rows_without_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not listed, NULL keys included."""
    return rows.join(ids.select(key), key, "left_anti").select(*rows.columns)
