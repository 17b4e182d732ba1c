"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words are runs of letters, digits and everything outside ASCII; the class below is the rest.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_TOKEN = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: spark.checkpoint.dir, or a local one where it is unset
    (a test on one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """Name of a folder of its own below the shared one."""
    return f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts its lineage, survives a
    lost executor and gives the optimizer the true size."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_BYTES = "4m"  # of an Arrow batch; Spark's own bound is 10,000 rows, whatever their length


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches are bounded by bytes, too: a JVM and its Python
    workers each hold a batch several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is. lower() does that on ASCII texts and
    is far cheaper than translate()."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, separator: str = NOT_WORD) -> Column:
    """Array of the words between separators; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def count_words(text: Column, separator: str = NOT_WORD) -> Column:
    return F.size(words(text, separator)).cast("long")


def row_key(text: Column) -> Column:
    """Tells rows that repeat a doc_id with another text apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def ordered_blocks(df: DataFrame, *order: Column) -> DataFrame:
    """Rows with a column block; blocks follow the order and are about equally large
    whatever key is frequent. Staged, so that a row's block never changes."""
    return staged(df.repartitionByRange(*order).withColumn("block", F.spark_partition_id()))


def running_sum(df: DataFrame, by: list[str], order: list[Column], value: Column) -> DataFrame:
    """Add column upto: the sum of value over the rows of the same `by` up to this one.
    Sums within blocks of the total order plus the sums of earlier blocks, so no task holds
    all rows of a hot key; only one row per key and block meets in a window."""
    keys = [F.col(c).asc_nulls_last() for c in by]
    blocks = ordered_blocks(df.withColumn("value", value), *keys, *order)
    totals = blocks.groupBy(*by, "block").agg(F.sum("value").alias("total"))
    earlier = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    totals = totals.select(F.col("block").alias("of_block"), "before", *[F.col(c).alias(f"of_{c}") for c in by])
    match = F.col("block") == F.col("of_block")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    within = Window.partitionBy(*by, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = blocks.withColumn("here", F.sum("value").over(within)).join(totals, match)
    return summed.select(*df.columns, (F.col("here") + F.col("before")).alias("upto"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


BROADCAST_BYTES = 64 << 20  # texts of a frame up to this size may be broadcast


def bounded(df: DataFrame, most: int, text: str | None = None) -> DataFrame:
    """A frame marked for broadcast if it has at most that many rows (counted) and its text
    column, if one is named, at most BROADCAST_BYTES (summed); else as it is, for a join that
    shuffles both sides."""
    size = F.lit(0) if text is None else F.octet_length(F.col(text))
    rows, held = df.limit(most + 1).agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if rows <= most and (held or 0) <= BROADCAST_BYTES else df
