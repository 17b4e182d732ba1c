"""The given tables in the shapes the library works on.

``events`` becomes an event table in each of the four layouts. It has no variant label, no
account id and no session, so those are derived from the user id and the number in
``props`` by rules that SQL can state as well (``BASE_SQL``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abspark.session import prepare
from abspark.spec import TOOL_FLAT, TOOL_NESTED, TOOL_ONE_BAG, TOOL_TWO_BAG

# The derived columns in SQL; every oracle over events starts from this.
BASE_SQL = r"""
base AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS day, event_type, value, k, user_id AS uid_num,
    CAST(user_id AS VARCHAR) AS device,
    CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 7 = 1 THEN ''
         ELSE 'u' || CAST(user_id % 60 AS VARCHAR) END AS account,
    CASE WHEN user_id % 10 < 4 THEN 'control' WHEN user_id % 10 < 8 THEN 'treatment'
         WHEN k % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant,
    'p' || CAST(k % 5 AS VARCHAR) AS plan,
    CASE WHEN k % 11 = 0 THEN NULL
         ELSE CAST(strftime(ts, '%Y%m%d') AS BIGINT) END AS session_id,
    CASE WHEN user_id % 4 = 0 THEN NULL
         WHEN user_id % 4 = 1 THEN 'gold' ELSE 'basic' END AS tier,
    CASE k % 3 WHEN 0 THEN 'phone' WHEN 1 THEN 'desktop' ELSE NULL END AS device_kind
  FROM (SELECT *, CAST(regexp_extract(props, '-?[0-9]+') AS INTEGER) AS k FROM events)
)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with the derived columns of BASE_SQL."""
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    events = table(spark, sf_dir, "events").withColumn("k", k)
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.to_date("ts").alias("day"),
        "event_type",
        "value",
        "k",
        user.alias("uid_num"),
        user.cast("string").alias("device"),
        F.when(user % 3 == 0, F.lit(None))
        .when(user % 7 == 1, F.lit(""))
        .otherwise(F.concat(F.lit("u"), (user % 60).cast("string")))
        .alias("account"),
        F.when(user % 10 < 4, "control")
        .when(user % 10 < 8, "treatment")
        .when(F.col("k") % 2 == 0, "control")
        .otherwise("treatment")
        .alias("variant"),
        F.concat(F.lit("p"), (F.col("k") % 5).cast("string")).alias("plan"),
        F.when(F.col("k") % 11 != 0, F.date_format("ts", "yyyyMMdd").cast("bigint")).alias(
            "session_id"
        ),
        F.when(user % 4 == 1, "gold").when(user % 4 > 1, "basic").alias("tier"),
        F.when(F.col("k") % 3 == 0, "phone")
        .when(F.col("k") % 3 == 1, "desktop")
        .alias("device_kind"),
    )


def _param(key: str, **values: Column) -> Column:
    types = {
        "string_value": "string",
        "int_value": "bigint",
        "float_value": "double",
        "double_value": "double",
    }
    parts = [
        values.get(name, F.lit(None)).cast(dtype).alias(name)
        for name, dtype in types.items()
    ]
    return F.struct(F.lit(key).alias("key"), F.struct(*parts).alias("value"))


def nested(b: DataFrame) -> DataFrame:
    """Day-sharded layout with repeated key/value parameters."""
    no_params = F.array().cast(
        "array<struct<key string, value struct<string_value string, int_value bigint, "
        "float_value double, double_value double>>>"
    )
    tier = F.when(
        F.col("tier").isNotNull(), F.array(_param("tier", string_value=F.col("tier")))
    ).otherwise(no_params)
    flag = F.when(
        F.col("uid_num") % 2 == 0,
        F.array(_param("firebase_exp_7", string_value=F.col("variant"))),
    ).otherwise(no_params)
    item = F.struct(
        F.concat(F.lit("i"), F.col("k").cast("string")).alias("item_id"),
        F.when(F.col("k") % 4 != 0, F.col("plan")).alias("item_category"),
        F.lit("brand").alias("item_brand"),
    )
    return b.select(
        F.date_format("day", "yyyyMMdd").alias("table_suffix"),
        F.unix_micros("ts").alias("event_timestamp"),
        F.col("event_type").alias("event_name"),
        F.col("device").alias("user_pseudo_id"),
        F.col("account").alias("user_id"),
        F.array(
            _param("exp_variant_string", string_value=F.col("variant")),
            _param("value", double_value=F.col("value")),
            _param("k", int_value=F.col("k")),
            _param("ga_session_id", int_value=F.col("session_id")),
        ).alias("event_params"),
        F.concat(tier, flag, F.array(_param("score", int_value=F.col("k")))).alias(
            "user_properties"
        ),
        F.when(F.col("k") % 6 == 0, F.array().cast("array<struct<item_id string, "
               "item_category string, item_brand string>>"))
        .when(F.col("k") % 6 != 1, F.array(item)).alias("items"),
        F.struct((F.col("value") * 2).alias("purchase_revenue")).alias("ecommerce"),
        F.struct(F.col("device_kind").alias("category")).alias("device"),
        F.struct(F.col("plan").alias("country")).alias("geo"),
    )


def flat(b: DataFrame) -> DataFrame:
    """Flattened layout: DATE column, parameters as a struct."""
    return b.select(
        F.col("day").alias("event_date"),
        F.struct(F.unix_micros("ts").alias("event_timestamp")).alias("time"),
        F.col("event_type").alias("event_name"),
        F.col("device").alias("user_pseudo_id"),
        F.col("account").alias("user_id"),
        F.struct(
            F.col("session_id").alias("ga_session_id"),
            F.col("variant").alias("exp_variant_string"),
            F.col("value"),
            F.col("k"),
            F.col("tier"),
        ).alias("event_params"),
        F.when(
            F.col("k") % 6 != 1,
            F.array(
                F.struct(
                    F.concat(F.lit("i"), F.col("k").cast("string")).alias("item_id"),
                    F.when(F.col("k") % 4 != 0, F.col("plan")).alias("item_category"),
                )
            ),
        ).alias("items"),
        F.struct((F.col("value") * 2).alias("purchase_revenue")).alias("ecommerce"),
        F.struct(F.col("device_kind").alias("category")).alias("device"),
    )


def two_bag(b: DataFrame) -> DataFrame:
    """JSON layout with an event bag and a user bag."""
    return b.select(
        F.col("ts").alias("event_time"),
        "event_type",
        F.col("device").alias("device_id"),
        F.col("account").alias("user_id"),
        "session_id",
        F.to_json(
            F.struct(
                "k", "value", "variant", F.struct("plan", "value").alias("info")
            )
        ).alias("event_properties"),
        F.to_json(F.struct("tier", F.col("variant").alias("group"))).alias(
            "user_properties"
        ),
        F.col("device_kind").alias("platform"),
        F.col("plan").alias("country"),
    )


def one_bag(b: DataFrame) -> DataFrame:
    """JSON layout with one property bag."""
    return b.select(
        F.col("ts").alias("time"),
        F.col("event_type").alias("event_name"),
        F.col("device").alias("distinct_id"),
        F.col("account").alias("user_id"),
        F.to_json(
            F.struct(
                "k", "value", "variant", "tier",
                F.col("session_id").cast("string").alias("session_id"),
                F.when(F.col("uid_num") % 3 == 0, F.concat(F.lit("m"), "device")).alias(
                    "$user_id"
                ),
                F.struct("plan").alias("info"),
            )
        ).alias("properties"),
        F.col("device_kind").alias("platform"),
    )


LAYOUT_VIEWS = {
    TOOL_NESTED: nested,
    TOOL_FLAT: flat,
    TOOL_TWO_BAG: two_bag,
    TOOL_ONE_BAG: one_bag,
}


def layout_view(spark: SparkSession, sf_dir: str, tool: str) -> DataFrame:
    return LAYOUT_VIEWS[tool](base(spark, sf_dir))
