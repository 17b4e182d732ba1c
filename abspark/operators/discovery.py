"""What an event table holds: event names, parameters, filter fields.

Each list is a projection that blows rows up to names, followed by one distinct: partial
aggregation shrinks it to a handful of names per map task before anything is shuffled, so
table size and skewed names do not matter. Schema-based lists never read the data.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, NumericType, StructType

from abspark.functions.scalars import full_trim, json_text
from abspark.operators.lookups import union_distinct
from abspark.sources.layouts import PROPERTY_EXPERIMENT

# Time columns a two-bag table may have, best first.
TIME_COLUMNS = [
    "event_time", "client_event_time", "server_upload_time", "ingest_time",
    "event_datetime", "event_date",
]
# Key and value patterns over JSON text.
KEY_WITH_ESCAPES = r'"((?:[^"\\]|\\.)+)"\s*:'
KEY_PLAIN = r'"([^"]+)":'
PAIR_PLAIN = r'("[^"]+":[^,}]+)'
PAIR_KEY = r'^"([^"]+)":'
PAIR_VALUE = r":(.*)$"
NUMBER_VALUE = r"^\s*-?(?:\d+\.?\d*|\d*\.\d+)(?:[eE][+-]?\d+)?\s*$"
BOOLEAN_VALUE = r"^\s*(?:true|false)\s*$"
OPENING_VALUE = r"^\s*[{\[]"
# The value is only looked at, so that a key right inside it is found as well.
PAIR_WITH_ESCAPES = r'"((?:[^"\\]|\\.)+)"\s*:(?=\s*([^,}\]]+))'


# ---------------------------------------------------------------- settings
def days_from_text(text: str | None, default: int = 2) -> int:
    """First whole number of a text like '3 Last Days', at least 1."""
    found = re.search(r"\d+", text or "")
    return max(1, int(found.group()) if found else default)


def lookback_window(days: int, today: dt.date) -> tuple[dt.date, dt.date]:
    """The last complete days, today excluded."""
    end = today - dt.timedelta(days=1)
    return end - dt.timedelta(days=max(1, days) - 1), end


def lookback_columns(days: Column, today: Column) -> Column:
    """D1 over columns."""
    return F.struct(
        F.date_sub(today, F.greatest(days, F.lit(1))).alias("date_start"),
        F.date_sub(today, 1).alias("date_end"),
    )


def parse_exclusion_list(text: str | None) -> list[str]:
    """Comma list without quotes and blanks."""

    def bare(part: str) -> str:
        part = part.strip()
        if len(part) > 1 and part[0] == part[-1] and part[0] in "\"'":
            part = part[1:-1].strip()
        return part

    return [name for name in map(bare, bare(text or "").split(",")) if name]


def exclusion_column(text: Column) -> Column:
    """D14 over a column."""

    def bare(part: Column) -> Column:
        return full_trim(F.regexp_replace(full_trim(part), r"^(['\"])(.*)\1$", "$2"))

    names = F.transform(F.split(bare(text), ","), bare)
    return F.filter(names, lambda name: name != "")


def _without(name: Column, exclude: Sequence[str]) -> Column:
    return ~name.isin(list(exclude)) if exclude else F.lit(True)


def _names(events: DataFrame, name: Column, scope: str, exclude: Sequence[str]) -> DataFrame:
    return (
        events.select(F.lit(scope).alias("scope"), name.alias("name"))
        .where(F.col("name").isNotNull() & _without(F.col("name"), exclude))
        .distinct()
    )


# ---------------------------------------------------------------- events
def discover_events(
    events: DataFrame, event_column: str, window: Column, exclude: Sequence[str] = ()
) -> DataFrame:
    """Event names of the window."""
    return _names(events.where(window), F.col(event_column), "EVENT", exclude)


def discover_experiments(
    events: DataFrame, event_column: str, window: Column, exclude: Sequence[str] = ()
) -> DataFrame:
    """D3: event names, and user properties that stand for an experiment. Properties come
    from the data where they are key/value pairs, from the schema where they are columns."""
    found = discover_events(events, event_column, window, exclude)
    dtype = (
        events.schema["user_properties"].dataType
        if "user_properties" in events.columns
        else None
    )
    if isinstance(dtype, ArrayType):
        keys = events.where(window).select(F.explode("user_properties.key").alias("name"))
        keys = keys.where(F.col("name").rlike(PROPERTY_EXPERIMENT))
        return union_distinct(found, _names(keys, F.col("name"), "USER_PROPERTY", ()))
    if isinstance(dtype, StructType):
        named = [n for n in dtype.fieldNames() if re.search(PROPERTY_EXPERIMENT, n)]
        if named:
            return union_distinct(found, _literal_names(events, "USER_PROPERTY", named))
    return found


def _literal_names(events: DataFrame, scope: str, names: Sequence[str]) -> DataFrame:
    """Names known from the schema, as rows."""
    one = events.sparkSession.range(1)
    listed = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    return one.select(F.lit(scope).alias("scope"), F.explode(listed).alias("name"))


# ---------------------------------------------------------------- nested parameters
def _keys(events: DataFrame, column: str, scope: str, exclude: Sequence[str]) -> DataFrame:
    keys = events.select(F.explode(f"{column}.key").alias("name"))
    return _names(keys, F.col("name"), scope, exclude)


def discover_variant_params(
    events: DataFrame, window: Column, exclude: Sequence[str] = ()
) -> DataFrame:
    """Keys of event parameters and user properties. One scan: both arrays are tagged
    and exploded together."""
    both = F.concat(
        F.transform("event_params.key", lambda k: F.struct(F.lit("EVENT").alias("scope"),
                                                           k.alias("name"))),
        F.transform("user_properties.key", lambda k: F.struct(F.lit("USER").alias("scope"),
                                                              k.alias("name"))),
    )
    return (
        events.where(window)
        .select(F.explode(both).alias("entry"))
        .select("entry.*")
        .where(F.col("name").isNotNull() & _without(F.col("name"), exclude))
        .distinct()
    )


def discover_value_params(
    events: DataFrame, window: Column, exclude: Sequence[str] = ()
) -> DataFrame:
    """Event parameters that ever carry a number."""
    numeric = F.filter(
        "event_params",
        lambda p: F.coalesce(
            p["value"]["int_value"].cast("double"),
            p["value"]["float_value"].cast("double"),
            p["value"]["double_value"].cast("double"),
        ).isNotNull(),
    )
    keys = events.where(window).select(F.explode(numeric).alias("p")).select("p.key")
    return _names(keys, F.col("key"), "EVENT", exclude)


# ---------------------------------------------------------------- schema
def field_paths(schema: StructType) -> list[tuple[str, DataType]]:
    """Every field path of a schema with its type; arrays are stepped into."""
    found: list[tuple[str, DataType]] = []

    def walk(dtype: DataType, prefix: str) -> None:
        if isinstance(dtype, ArrayType):
            dtype = dtype.elementType
        if isinstance(dtype, StructType):
            for f in dtype.fields:
                path = f"{prefix}.{f.name}" if prefix else f.name
                found.append((path, f.dataType))
                walk(f.dataType, path)

    walk(schema, "")
    return found


def discover_columns(
    events: DataFrame,
    column_regex: str | None,
    exclude: Sequence[str] = (),
    numeric_only: bool = False,
    scope: str = "COLUMN",
) -> DataFrame:
    """Field paths the pattern finds; none without a pattern."""
    paths = [
        path
        for path, dtype in field_paths(events.schema)
        if (column_regex or "").strip()
        and re.search(column_regex, path)
        and path not in exclude
        and (not numeric_only or isinstance(dtype, NumericType))
    ]
    return _literal_names(events, scope, sorted(paths))


def discover_params_flat(
    events: DataFrame,
    column_regex: str | None = None,
    exclude: Sequence[str] = (),
    numeric_only: bool = False,
) -> DataFrame:
    """Parameters of the flattened layout, prefix stripped, and columns the pattern
    finds."""
    prefix = "event_params."
    names = set()
    for path, dtype in field_paths(events.schema):
        own = path.startswith(prefix)
        by_pattern = bool(column_regex) and re.search(column_regex, path)
        if path == "event_params" or not (own or by_pattern):
            continue
        if numeric_only and not isinstance(dtype, NumericType):
            continue
        name = path.removeprefix(prefix)
        if name not in exclude:
            names.add((("Event" if own else "Column"), name))
    scopes = [
        _literal_names(events, scope, sorted(n for s, n in names if s == scope))
        for scope in ("Event", "Column")
    ]
    return union_distinct(*scopes)


def lateral_names(events: DataFrame, *arrays: str) -> DataFrame:
    """One row per element of the named key/value arrays, with its key."""
    keys = F.concat(*[F.coalesce(F.col(f"{a}.key"), F.array()) for a in arrays])
    return events.select(F.explode(keys).alias("key"))


def detect_time_column(events: DataFrame) -> str | None:
    """The best time column the table has."""
    return next((c for c in TIME_COLUMNS if c in events.columns), None)


def window_on(column: str | None, start: dt.date, end: dt.date) -> Column:
    """Days start..end of a detected time column, as a prunable range."""
    if column is None:
        return F.lit(True)
    after = end + dt.timedelta(days=1)
    return (F.col(column) >= F.lit(start.isoformat())) & (
        F.col(column) < F.lit(after.isoformat())
    )


def since(column: str, today: dt.date, days: int) -> Column:
    """One-bag lookback: from n days before today on, today included."""
    return F.col(column) >= F.lit((today - dt.timedelta(days=days)).isoformat())


# ---------------------------------------------------------------- JSON bags
def _bag_text(events: DataFrame, bag: str) -> Column:
    return json_text(F.col(bag), events.schema[bag].dataType)


def discover_json_keys(
    events: DataFrame,
    bag: str,
    window: Column,
    exclude: Sequence[str] = (),
    pattern: str = KEY_WITH_ESCAPES,
    scope: str = "EVENT",
    trim: bool = True,
) -> DataFrame:
    """Quoted tokens before a colon, at any depth. A struct column names its keys
    in the schema, so the data is not read. Blank keys are left out; the two-bag layout
    also trims, the one-bag layout keeps a key as it is written."""
    dtype = events.schema[bag].dataType
    if isinstance(dtype, StructType):
        names = [n for n in dtype.fieldNames() if n not in exclude]
        return _literal_names(events, scope, sorted(names))
    keys = events.where(window).select(
        F.explode(F.regexp_extract_all(_bag_text(events, bag), F.lit(pattern), 1)).alias("k")
    )
    name = F.trim(F.col("k")) if trim else F.col("k")
    return _names(keys.where(F.trim("k") != ""), name, scope, exclude)


def discover_json_keys_plain(
    events: DataFrame, bag: str, window: Column, exclude: Sequence[str] = ()
) -> DataFrame:
    """The simpler pattern of the one-bag layout."""
    return discover_json_keys(events, bag, window, exclude, KEY_PLAIN, trim=False)


def discover_variant_params_two_bag(
    events: DataFrame, window: Column, exclude: Sequence[str] = ()
) -> DataFrame:
    """Variant parameters of the two-bag layout, EVENT and USER names."""
    return union_distinct(
        discover_json_keys(events, "event_properties", window, exclude, scope="EVENT"),
        discover_json_keys(events, "user_properties", window, exclude, scope="USER"),
    )


def discover_variant_params_flat(
    events: DataFrame,
    column_regex: str | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Variant parameters of the flattened layout; every name has the scope EVENT."""
    found = discover_params_flat(events, column_regex, exclude)
    return found.select(F.lit("EVENT").alias("scope"), "name").distinct()


def json_nonstring_hits(
    events: DataFrame, bag: str, window: Column, exclude: Sequence[str] = ()
) -> DataFrame:
    """Per key, how often its value is a number, boolean, object or array; keys without
    such a value are left out. All pairs are taken from the text in one pass, instead of
    trying every key on every text."""
    text = _bag_text(events, bag)
    # The bag is parsed once, into a column; explode_outer keeps the optimizer from
    # computing the pairs a second time in a filter on their number.
    pairs = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(PAIR_WITH_ESCAPES), 1).alias("key"),
        F.regexp_extract_all("text", F.lit(PAIR_WITH_ESCAPES), 2).alias("val"),
    )
    val = F.trim("pair.val")
    typed = val.rlike(NUMBER_VALUE) | val.rlike(BOOLEAN_VALUE) | val.rlike(OPENING_VALUE)
    return (
        events.where(window)
        .select(text.alias("text"))
        .select(F.explode_outer(pairs).alias("pair"))
        .where(F.col("pair").isNotNull())
        .select(F.col("pair.key").alias("name"), typed.alias("typed"))
        .where(_without(F.col("name"), exclude))
        .groupBy("name")
        .agg(F.count_if("typed").alias("non_string_hits"))
        .where(F.col("non_string_hits") > 0)
    )


def json_nonstring_keys(
    events: DataFrame, bag: str, window: Column, exclude: Sequence[str] = ()
) -> DataFrame:
    """Keys that ever carry something other than a string."""
    hits = json_nonstring_hits(events, bag, window, exclude)
    return hits.select(F.lit("EVENT").alias("scope"), "name")


def json_numeric_keys(
    events: DataFrame, bag: str, window: Column, exclude: Sequence[str] = ()
) -> DataFrame:
    """Keys whose value, up to the next comma or brace, is a bare number."""
    text = _bag_text(events, bag)
    pairs = events.where(window).select(
        F.explode(F.regexp_extract_all(text, F.lit(PAIR_PLAIN), 1)).alias("pair")
    )
    value = F.regexp_extract("pair", PAIR_VALUE, 1)
    keys = pairs.where(value.rlike(NUMBER_VALUE)).select(
        F.regexp_extract("pair", PAIR_KEY, 1).alias("k")
    )
    return _names(keys, F.col("k"), "EVENT", exclude)


def key_event_join(events: DataFrame, bag: str, keys: DataFrame) -> DataFrame:
    """How many texts carry each candidate key. Pairs every key with every text in
    meaning; here each text names its own keys once, which then meet the candidates in an
    equi-join."""
    text = _bag_text(events, bag)
    own = F.array_distinct(F.regexp_extract_all(text, F.lit(KEY_WITH_ESCAPES), 1))
    per_key = (
        events.select(F.explode(own).alias("name")).groupBy("name").agg(
            F.count("*").alias("texts")
        )
    )
    return keys.select("name").distinct().join(per_key, "name")


# ---------------------------------------------------------------- filter fields
def discover_filter_fields(
    events: DataFrame,
    layout: str,
    window: Column,
    exclude: Sequence[str] = (),
    column_regex: str | None = None,
) -> DataFrame:
    """Event, User and Column names a filter may use, for each layout
    ('nested', 'flat', 'two_bag', 'one_bag')."""
    if layout == "flat":
        return discover_params_flat(events, column_regex, exclude)
    if layout == "nested":
        params = discover_variant_params(events, window, exclude).withColumn(
            "scope", F.initcap("scope")
        )
        columns = discover_columns(events, column_regex, scope="Column")
        return union_distinct(params, columns)
    if layout == "two_bag":
        names = discover_json_keys(events, "event_properties", window, exclude, scope="Event")
        columns = discover_columns(events, column_regex or ".", scope="Column")
        dtype = events.schema["user_properties"].dataType
        users = dtype.fieldNames() if isinstance(dtype, StructType) else []
        user_names = _literal_names(
            events, "User", sorted(n for n in users if n not in exclude)
        )
        return union_distinct(names, user_names, columns)
    names = discover_json_keys(events, "properties", window, exclude, KEY_PLAIN, "Event", False)
    return union_distinct(names, discover_columns(events, column_regex, scope="Column"))
