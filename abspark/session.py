"""Session settings the library counts on."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Day windows and timestamps are read in UTC; ANSI mode makes bad arithmetic fail
# loudly, so every lenient cast or division in the library is a try_ form.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A key that a JSON bag holds twice must not make the whole bag unreadable.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; extra settings as keyword dictionary."""
    builder = SparkSession.builder.appName("abspark")
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def stage_folder(spark: SparkSession, parent: str | None = None) -> str:
    """A new folder for staged rows, below the given one or below spark.checkpoint.dir.
    Executors and driver must both see it, so there is no local default."""
    parent = parent or spark.conf.get("spark.checkpoint.dir", None)
    if not parent:
        raise ValueError("name a shared folder: an argument or spark.checkpoint.dir")
    return f"{parent.rstrip('/')}/stage-{uuid.uuid4()}"
