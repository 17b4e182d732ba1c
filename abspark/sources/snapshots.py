"""Tables kept as snapshots of plain files, changed by one writer at a time.

A table is a folder of data folders and numbered manifests, each naming the data folders of
one version. A writer reads a version, writes its data to a new folder and then creates the
manifest of the next number, which fails if another writer has created it meanwhile: what
that writer read is out of date, so it must start again from the newer version. Readers follow
the last manifest, so they see a version whole or not at all; data a failed writer left
behind is named by no manifest.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFEST = "manifest-"


class ConflictError(RuntimeError):
    """Another writer has published the next version first."""


@dataclass(frozen=True)
class Version:
    """A published state of a table: 0 is the table before its first."""

    number: int
    folders: tuple[str, ...]


def _files(spark: SparkSession, root: str):
    """File system and path of a folder, on whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def current_version(spark: SparkSession, root: str) -> Version:
    files, path = _files(spark, root)
    if not files.exists(path):
        return Version(0, ())
    names = [s.getPath().getName() for s in files.listStatus(path)]
    numbers = [int(n.removeprefix(MANIFEST)) for n in names if n.startswith(MANIFEST)]
    if not numbers:
        return Version(0, ())
    number = max(numbers)
    lines = spark.read.text(f"{root}/{MANIFEST}{number:010d}").collect()
    return Version(number, tuple(r.value for r in lines if r.value))


def read_version(spark: SparkSession, root: str, schema: StructType, version: Version | None = None) -> DataFrame:
    """Rows of a version (the current one), none before the first."""
    version = current_version(spark, root) if version is None else version
    if not version.folders:
        return spark.createDataFrame([], schema)
    parts = [spark.read.schema(schema).parquet(f"{root}/{name}") for name in version.folders]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.select(*schema.fieldNames())


def publish(
    rows: DataFrame, root: str, base: Version, append: bool = False, partition_by: tuple[str, ...] = ()
) -> Version:
    """Write rows and make them the version after the one they were made from: the whole
    table, or (append) a further part of it. ConflictError if there is such a version by now."""
    spark = rows.sparkSession
    name = f"data-{uuid.uuid4().hex}"
    rows.write.partitionBy(*partition_by).parquet(f"{root}/{name}")
    folders = (*base.folders, name) if append else (name,)
    number = base.number + 1
    files, path = _files(spark, f"{root}/{MANIFEST}{number:010d}")
    try:
        out = files.create(path, False)
    except Py4JJavaError as error:
        if files.exists(path):
            raise ConflictError(f"version {number} of {root} was published by another writer") from error
        raise
    out.write(bytearray("".join(f"{f}\n" for f in folders).encode()))
    out.close()
    return Version(number, folders)
