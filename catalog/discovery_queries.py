"""Metadata discovery and scalar helpers over events, parts, orders and documents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from abspark.functions import scalars
from abspark.operators import discovery as dis
from abspark.sources.layouts import layout_for
from abspark.spec import TOOL_FLAT, TOOL_NESTED, TOOL_ONE_BAG, TOOL_TWO_BAG
from catalog.events_queries import SHORT, union, view
from catalog.registry import query
from abspark.operators.aggregates import distinct_list
from catalog.views import BASE_SQL, base, table

TODAY = dt.date(2024, 1, 25)
DAYS = dis.days_from_text("9 Last Days")
START, END = dis.lookback_window(DAYS, TODAY)
EXCLUDED = dis.parse_exclusion_list("\"error, 'signup' , nothing\"")
W = f"WITH {BASE_SQL}, win AS (SELECT * FROM base WHERE day BETWEEN DATE '{START}' AND DATE '{END}')"
SINCE = f"""WITH {BASE_SQL}, win AS (SELECT * FROM base
    WHERE day >= DATE '{TODAY - dt.timedelta(days=DAYS)}')"""


def events_of(spark, sf_dir, tool):
    """Event table of a layout and its lookback window."""
    events, layout = view(spark, sf_dir, tool)
    if tool == TOOL_ONE_BAG:
        return events, dis.since("time", TODAY, DAYS), layout
    if tool == TOOL_TWO_BAG:
        window = dis.window_on(dis.detect_time_column(events), START, END)
        return events, window, layout
    return events, layout.in_window(START, END), layout


def window_sql(tool: str) -> str:
    return SINCE if tool == TOOL_ONE_BAG else W


# ---------------------------------------------------------------- D1, D14
@query(
    "lookback_window",
    """SELECT p_partkey, CAST(today - n AS DATE) AS date_start,
    CAST(today - 1 AS DATE) AS date_end FROM (SELECT p_partkey,
    CAST(greatest(p_size - 3, 1) AS INTEGER) AS n,
    DATE '2024-01-01' + CAST(p_partkey % 50 AS INTEGER) AS today FROM part)""",
)
def _(spark, sf_dir):
    today = F.expr("DATE '2024-01-01' + CAST(p_partkey % 50 AS INTEGER)")
    window = dis.lookback_columns(F.col("p_size") - 3, today)
    return table(spark, sf_dir, "part").select("p_partkey", window.alias("w")).select(
        "p_partkey", "w.*"
    )


@query(
    "parse_exclusion_list",
    """SELECT p_partkey, unnest(CASE p_size % 3 WHEN 0 THEN [p_name, p_type]
    WHEN 1 THEN [p_name] ELSE [p_brand, 'x y'] END) AS name FROM part""",
)
def _(spark, sf_dir):
    text = (
        F.when(F.col("p_size") % 3 == 0, F.expr("'\"' || p_name || ', ' || p_type || '\"'"))
        .when(F.col("p_size") % 3 == 1, F.expr("' ' || p_name || ' , , '"))
        .otherwise(F.expr("p_brand || ',' || \"'x y' \""))
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.explode(dis.exclusion_column(text)).alias("name")
    )


# ---------------------------------------------------------------- D2, D3
EVENT_NAMES = "SELECT DISTINCT 'EVENT' AS scope, event_type AS name FROM win"
NOT_EXCLUDED = "event_type NOT IN ('error', 'signup')"


@query(
    "discover_events",
    "\nUNION ALL\n".join(
        f"""SELECT * FROM ({window_sql(tool)} SELECT DISTINCT '{SHORT[tool]}' AS layout,
        'EVENT' AS scope, event_type AS name FROM win WHERE {NOT_EXCLUDED})"""
        for tool in SHORT
    ),
)
def _(spark, sf_dir):
    parts = []
    for tool in SHORT:
        events, window, layout = events_of(spark, sf_dir, tool)
        found = dis.discover_events(events, layout.event_column, window, EXCLUDED)
        parts.append(found.select(F.lit(SHORT[tool]).alias("layout"), "scope", "name"))
    return union(parts)


@query(
    "discover_experiments_nested",
    f"""{W} {EVENT_NAMES} WHERE {NOT_EXCLUDED} UNION
    SELECT DISTINCT 'USER_PROPERTY', 'firebase_exp_7' FROM win WHERE uid_num % 2 = 0""",
)
def _(spark, sf_dir):
    events, window, layout = events_of(spark, sf_dir, TOOL_NESTED)
    return dis.discover_experiments(events, layout.event_column, window, EXCLUDED)


@query(
    "discover_experiments_two_bag",
    f"{W} {EVENT_NAMES} UNION SELECT 'USER_PROPERTY', 'firebase_exp_12' FROM base",
)
def _(spark, sf_dir):
    events, window, layout = events_of(spark, sf_dir, TOOL_TWO_BAG)
    # the same table with the user bag as columns
    typed = events.withColumn(
        "user_properties",
        F.from_json("user_properties", "firebase_exp_12 STRING, tier STRING"),
    )
    return dis.discover_experiments(typed, layout.event_column, window)


@query("discover_experiments_one_bag", f"{SINCE} {EVENT_NAMES}")
def _(spark, sf_dir):
    events, window, layout = events_of(spark, sf_dir, TOOL_ONE_BAG)
    return dis.discover_experiments(events, layout.event_column, window)


# ---------------------------------------------------------------- D4, D5, J6
USER_KEYS = """SELECT DISTINCT 'USER' AS scope, unnest([CASE WHEN tier IS NOT NULL THEN 'tier'
    END, CASE WHEN uid_num % 2 = 0 THEN 'firebase_exp_7' END, 'score']) AS name FROM win"""
EVENT_KEYS = """SELECT DISTINCT 'EVENT' AS scope,
    unnest(['exp_variant_string', 'value', 'k', 'ga_session_id']) AS name FROM win"""


@query(
    "discover_variant_params",
    f"""{W} SELECT * FROM ({EVENT_KEYS} UNION {USER_KEYS})
    WHERE name IS NOT NULL AND name NOT IN ('k', 'score')""",
)
def _(spark, sf_dir):
    events, window, _layout = events_of(spark, sf_dir, TOOL_NESTED)
    return dis.discover_variant_params(events, window, ["k", "score"])


@query(
    "discover_value_params",
    f"""{W} SELECT * FROM (SELECT DISTINCT 'EVENT' AS scope, unnest(['value', 'k',
      CASE WHEN session_id IS NOT NULL THEN 'ga_session_id' END]) AS name FROM win)
    WHERE name IS NOT NULL""",
)
def _(spark, sf_dir):
    events, window, _layout = events_of(spark, sf_dir, TOOL_NESTED)
    return dis.discover_value_params(events, window)


@query(
    "lateral_array_join",
    f"""WITH {BASE_SQL} SELECT key, count(*) AS n FROM (SELECT unnest(['exp_variant_string',
    'value', 'k', 'ga_session_id', CASE WHEN tier IS NOT NULL THEN 'tier' END,
    CASE WHEN uid_num % 2 = 0 THEN 'firebase_exp_7' END, 'score']) AS key FROM base)
    WHERE key IS NOT NULL GROUP BY key""",
)
def _(spark, sf_dir):
    events, _layout = view(spark, sf_dir, TOOL_NESTED)
    keys = dis.lateral_names(events, "event_params", "user_properties")
    return keys.groupBy("key").agg(F.count("*").alias("n"))


@query(
    "distinct_lists",
    f"""WITH {BASE_SQL} SELECT DISTINCT event_type, variant, tier FROM base""",
)
def _(spark, sf_dir):
    return distinct_list(base(spark, sf_dir), "event_type", "variant", "tier")


# ---------------------------------------------------------------- D6, D8, D13
def filled_counts(events, names):
    """How many rows fill each discovered column: the discovered names put to use."""
    counts = events.agg(*[F.count(name).alias(name.replace(".", "__")) for name in names])
    entries = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.col(n.replace(".", "__")).alias("n"))
            for n in names
        ]
    )
    return counts.select(F.explode(entries).alias("e")).select("e.*")


def names_in(frame):
    """Names of a schema-based list (a handful of rows)."""
    return sorted(row["name"] for row in frame.select("name").toLocalIterator())


@query(
    "discover_columns",
    f"""WITH {BASE_SQL} SELECT unnest(['device.category', 'ecommerce.purchase_revenue',
    'geo.country', 'user_id']) AS name, unnest([count(device_kind), count(value),
    count(plan), count(account)]) AS n FROM base""",
)
def _(spark, sf_dir):
    events, _layout = view(spark, sf_dir, TOOL_NESTED)
    found = dis.discover_columns(
        events, r"^(device|geo|ecommerce)\.|^user_id$", exclude=["geo.city"]
    )
    return filled_counts(events, names_in(found))


@query(
    "discover_params_flat",
    f"""WITH {BASE_SQL} SELECT unnest(['k', 'value', 'ga_session_id',
    'ecommerce.purchase_revenue']) AS name, unnest([count(k), count(value),
    count(session_id), count(value)]) AS n FROM base""",
)
def _(spark, sf_dir):
    events, _layout = view(spark, sf_dir, TOOL_FLAT)
    found = names_in(
        dis.discover_params_flat(events, r"^ecommerce\.", ["tier"], numeric_only=True)
    )
    unprefixed = events.select("*", "event_params.*")
    return filled_counts(unprefixed, found)


@query(
    "detect_time_column",
    f"""{W} SELECT 'event_time' AS time_column, event_type, count(*) AS n FROM win
    GROUP BY event_type""",
)
def _(spark, sf_dir):
    events, _layout = view(spark, sf_dir, TOOL_TWO_BAG)
    column = dis.detect_time_column(events)
    inside = events.where(dis.window_on(column, START, END))
    return inside.groupBy("event_type").agg(F.count("*").alias("n")).withColumn(
        "time_column", F.lit(column)
    )


# ---------------------------------------------------------------- D7
@query(
    "discover_filter_fields_nested",
    f"""{W} SELECT CASE scope WHEN 'EVENT' THEN 'Event' ELSE 'User' END AS scope, name FROM
    ({EVENT_KEYS} UNION {USER_KEYS}) WHERE name IS NOT NULL AND name <> 'k'
    UNION SELECT 'Column', unnest(['device.category', 'geo.country'])""",
)
def _(spark, sf_dir):
    events, window, _layout = events_of(spark, sf_dir, TOOL_NESTED)
    return dis.discover_filter_fields(events, "nested", window, ["k"], r"^(device|geo)\.")


@query(
    "discover_filter_fields_flat",
    f"""WITH {BASE_SQL} SELECT scope, name, count(*) AS rows_in_table FROM base,
    (SELECT unnest(['Event', 'Event', 'Event', 'Event', 'Column']) AS scope,
     unnest(['exp_variant_string', 'ga_session_id', 'k', 'value', 'device.category']) AS name)
    GROUP BY ALL""",
)
def _(spark, sf_dir):
    events, window, _layout = events_of(spark, sf_dir, TOOL_FLAT)
    fields = dis.discover_filter_fields(events, "flat", window, ["tier"], r"^device\.")
    return fields.withColumn("rows_in_table", events.agg(F.count("*")).scalar())


@query(
    "discover_filter_fields_two_bag",
    f"""{W} SELECT DISTINCT 'Event' AS scope, unnest(['k', 'value', 'info', 'plan']) AS name
    FROM win UNION SELECT 'Column', unnest(['platform', 'country'])""",
)
def _(spark, sf_dir):
    events, window, _layout = events_of(spark, sf_dir, TOOL_TWO_BAG)
    return dis.discover_filter_fields(
        events, "two_bag", window, ["variant"], "^(platform|country)$"
    )


ONE_BAG_KEYS = """unnest(['k', 'value', 'variant', 'info', 'plan',
    CASE WHEN tier IS NOT NULL THEN 'tier' END,
    CASE WHEN session_id IS NOT NULL THEN 'session_id' END,
    CASE WHEN uid_num % 3 = 0 THEN '$user_id' END])"""


@query(
    "discover_filter_fields_one_bag",
    f"""{SINCE} SELECT * FROM (SELECT DISTINCT 'Event' AS scope, {ONE_BAG_KEYS} AS name
    FROM win) WHERE name IS NOT NULL UNION SELECT 'Column', 'platform'""",
)
def _(spark, sf_dir):
    events, window, _layout = events_of(spark, sf_dir, TOOL_ONE_BAG)
    return dis.discover_filter_fields(events, "one_bag", window, (), "^platform$")


# ---------------------------------------------------------------- D9-D12, G6, J7
@query(
    "json_keys_two_bag",
    f"""{W} SELECT DISTINCT 'EVENT' AS scope,
    unnest(['k', 'value', 'variant', 'info', 'plan']) AS name FROM win""",
)
def _(spark, sf_dir):
    events, window, _layout = events_of(spark, sf_dir, TOOL_TWO_BAG)
    return dis.discover_json_keys(events, "event_properties", window)


@query(
    "discover_variant_params_two_bag",
    f"""{W} SELECT * FROM (SELECT DISTINCT 'EVENT' AS scope,
      unnest(['k', 'value', 'variant', 'info', 'plan']) AS name FROM win
      UNION SELECT DISTINCT 'USER', unnest(['group', CASE WHEN tier IS NOT NULL THEN 'tier' END])
      FROM win) WHERE name <> 'plan'""",
)
def _(spark, sf_dir):
    events, window, _layout = events_of(spark, sf_dir, TOOL_TWO_BAG)
    return dis.discover_variant_params_two_bag(events, window, ["plan"])


@query(
    "json_nonstring_hits",
    f"""{W} SELECT unnest(['k', 'value', 'info']) AS name,
    unnest([count(*), 2 * count(*), count(*)]) AS non_string_hits FROM win""",
)
def _(spark, sf_dir):
    events, window, _layout = events_of(spark, sf_dir, TOOL_TWO_BAG)
    return dis.json_nonstring_hits(events, "event_properties", window)


@query(
    "json_nonstring_keys",
    f"""{W} SELECT DISTINCT 'EVENT' AS scope, unnest(['k', 'info']) AS name FROM win""",
)
def _(spark, sf_dir):
    events, window, _layout = events_of(spark, sf_dir, TOOL_TWO_BAG)
    return dis.json_nonstring_keys(events, "event_properties", window, ["value"])


@query(
    "json_keys_one_bag",
    f"""{SINCE} SELECT * FROM (SELECT DISTINCT 'EVENT' AS scope, {ONE_BAG_KEYS} AS name
    FROM win) WHERE name IS NOT NULL AND name <> 'info'""",
)
def _(spark, sf_dir):
    events, window, _layout = events_of(spark, sf_dir, TOOL_ONE_BAG)
    return dis.discover_json_keys_plain(events, "properties", window, ["info"])


@query(
    "discover_variant_params_flat",
    f"""WITH {BASE_SQL} SELECT unnest(['k', 'value', 'ga_session_id', 'exp_variant_string', 'tier',
    'ecommerce.purchase_revenue']) AS name, 'EVENT' AS scope, unnest([count(k), count(value),
    count(session_id), count(variant), count(tier), count(value)]) AS n FROM base""",
)
def _(spark, sf_dir):
    events, _layout = view(spark, sf_dir, TOOL_FLAT)
    found = names_in(dis.discover_variant_params_flat(events, r"^ecommerce\.[a-z_]+$"))
    counted = filled_counts(events.select("*", "event_params.*"), found)
    return counted.withColumn("scope", F.lit("EVENT"))


@query(
    "json_numeric_keys",
    f"""{SINCE} SELECT DISTINCT 'EVENT' AS scope, unnest(['k', 'value']) AS name FROM win""",
)
def _(spark, sf_dir):
    events, window, _layout = events_of(spark, sf_dir, TOOL_ONE_BAG)
    return dis.json_numeric_keys(events, "properties", window)


@query(
    "key_event_join",
    f"""WITH {BASE_SQL} SELECT name, count(*) AS texts FROM (SELECT {ONE_BAG_KEYS} AS name
    FROM base) WHERE name IS NOT NULL GROUP BY name""",
)
def _(spark, sf_dir):
    events, _layout = view(spark, sf_dir, TOOL_ONE_BAG)
    wanted = dis.discover_json_keys_plain(events, "properties", F.lit(True))
    return dis.key_event_join(events, "properties", wanted)


# ---------------------------------------------------------------- scalar helpers
@query(
    "safe_divide",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / nullif(l_tax, 0), 4)
    AS ratio FROM lineitem""",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    ratio = scalars.safe_divide(F.col("l_extendedprice"), F.col("l_tax"))
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(ratio, 4).alias("ratio")
    )


@query(
    "strict_greatest",
    """SELECT o_orderkey, CASE WHEN x IS NOT NULL THEN greatest(x, 200000) END AS high,
    CASE WHEN x IS NOT NULL THEN least(x, 200000) END AS low FROM (SELECT o_orderkey,
    CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS x FROM orders)""",
)
def _(spark, sf_dir):
    x = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))
    bound = F.lit(200000.0)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        scalars.strict_greatest(x, bound).alias("high"),
        scalars.strict_least(x, bound).alias("low"),
    )


@query(
    "full_trim",
    """SELECT doc_id, md5(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)
    || chr(133) || chr(160) || chr(12288))) AS digest FROM documents""",
)
def _(spark, sf_dir):
    padded = F.concat(F.lit("\t \n　"), "text", F.lit("\r\n "))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(scalars.full_trim(padded)).alias("digest")
    )


@query(
    "json_scalar",
    r"""SELECT doc_id, text, CAST(NULL AS VARCHAR) AS object_node, CASE WHEN n_chars % 2 = 0
    THEN CAST(n_chars AS VARCHAR) END AS number_node, '[' || source || ']' AS bracket_text,
    source AS dotted FROM documents""",
)
def _(spark, sf_dir):
    bag = F.to_json(
        F.struct(
            "text",
            F.struct(F.col("source").alias("b"), "lang").alias("a"),
            F.when(F.col("n_chars") % 2 == 0, F.col("n_chars")).alias("n"),
            F.concat(F.lit("["), "source", F.lit("]")).alias("bracket"),
        )
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", bag.alias("bag"))
    at = {"text": "text", "object_node": "a", "number_node": "n", "bracket_text": "bracket",
          "dotted": "a.b"}
    return docs.select(
        "doc_id",
        *[scalars.json_scalar(F.col("bag"), path).alias(name) for name, path in at.items()],
    )


@query(
    "to_double",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_totalprice WHEN 1 THEN NULL
    WHEN 2 THEN NULL WHEN 3 THEN -o_totalprice ELSE o_orderkey * 1000.0 END AS number
    FROM orders""",
)
def _(spark, sf_dir):
    price = F.col("o_totalprice").cast("string")
    text = (
        F.when(F.col("o_orderkey") % 5 == 0, price)
        .when(F.col("o_orderkey") % 5 == 1, F.concat(price, F.lit("d")))
        .when(F.col("o_orderkey") % 5 == 2, F.col("o_orderpriority"))
        .when(F.col("o_orderkey") % 5 == 3, F.concat(F.lit(" -"), price))
        .otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit("e3")))
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", scalars.to_double(text).alias("number")
    )


@query(
    "float_text",
    r"""SELECT o_orderkey, regexp_replace(CAST(o_totalprice AS VARCHAR), '\.0$', '') AS price,
    CAST(o_orderkey * 1000000 AS VARCHAR) AS large FROM orders""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        scalars.float_text(F.col("o_totalprice")).alias("price"),
        scalars.float_text(F.col("o_orderkey") * 1e6).alias("large"),
    )


@query(
    "json_text",
    """SELECT event_id, replace(props, ' ', '') AS compact FROM events""",
)
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    compact = scalars.json_text(F.col("props"), events.schema["props"].dataType)
    return events.select("event_id", compact.alias("compact"))


@query(
    "blank_to_null",
    f"WITH {BASE_SQL} SELECT event_id, nullif(account, '') AS account FROM base",
)
def _(spark, sf_dir):
    return base(spark, sf_dir).select(
        "event_id", scalars.blank_to_null(F.col("account")).alias("account")
    )
