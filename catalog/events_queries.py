"""Scans, projections, filters, attribution and the analysis over the event views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abspark.operators import attribution as att
from abspark.operators import exposures as exp
from abspark.operators.aggregates import distinct_unit_count, sufficient_stats, unit_stats
from abspark.plans.analyze import analyze_one, analyze_specs
from abspark.plans.state import advance, analyze_day_by_day
from abspark.sources import events as scans
from abspark.sources.layouts import layout_for
from abspark.spec import (
    BOTH,
    EXCLUDE,
    FIRST,
    LAST,
    TOOL_FLAT,
    TOOL_NESTED,
    TOOL_ONE_BAG,
    TOOL_TWO_BAG,
    USER_ID_ONLY,
    USER_ID_OR_DEVICE_ID,
    FilterSpec,
)
from catalog import views
from catalog.experiments import (
    END,
    START,
    conversions_sql,
    exposures_sql,
    identity_sql,
    key_sql,
    parts_sql,
    results_sql,
    spec,
    spread,
    stats_sql,
    units_sql,
)
from catalog.registry import query, scratch_folder
from catalog.views import BASE_SQL

SHORT = {
    TOOL_NESTED: "nested",
    TOOL_FLAT: "flat",
    TOOL_TWO_BAG: "two_bag",
    TOOL_ONE_BAG: "one_bag",
}
BASE = f"WITH {BASE_SQL}"
DAYS = f"day BETWEEN DATE '{START}' AND DATE '{END}'"


def micros(time: str | Column) -> Column:
    return F.unix_micros(time)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def count_cases(events, layout, cases) -> DataFrame:
    """Rows per event name that meet each case's predicate, all cases in one scan. A case
    is (struct that labels it, predicate)."""
    tagged = F.explode(F.array(*[F.when(p, label) for label, p in cases]))
    rows = events.select(
        F.col(layout.event_column).alias("event_name"),
        (micros(layout.event_time()) % 1000003).alias("mark"),
        tagged.alias("case"),
    )
    return (
        rows.where("case IS NOT NULL")
        .groupBy("event_name", "case")
        .agg(F.count("*").alias("n"), F.sum("mark").alias("mark"))
        .select("event_name", "case.*", "n", "mark")
    )


def view(spark, sf_dir, tool):
    events = views.layout_view(spark, sf_dir, tool)
    return events, layout_for(tool, events.schema)


# ---------------------------------------------------------------- S1-S5
@query(
    "scan_sharded_events",
    f"""{BASE} SELECT strftime(day, '%Y%m%d') AS table_suffix, event_type AS event_name,
    device AS user_pseudo_id, epoch_us(ts) AS event_timestamp FROM base WHERE {DAYS}""",
)
def _(spark, sf_dir):
    events, _layout = view(spark, sf_dir, TOOL_NESTED)
    return scans.scan_sharded_events(events, START, END).select(
        "table_suffix", "event_name", "user_pseudo_id", "event_timestamp"
    )


@query(
    "choose_fresh_shards",
    f"""{BASE}, shards AS (
      SELECT DISTINCT 'events_' || strftime(day, '%Y%m%d') AS table_name FROM base
      UNION SELECT DISTINCT 'events_fresh_' || strftime(day, '%Y%m%d') FROM base
        WHERE day >= DATE '2024-01-20')
    SELECT table_name, replace(table_name, 'events_fresh_', '') AS table_suffix
    FROM shards WHERE table_name LIKE 'events_fresh_%'""",
)
def _(spark, sf_dir):
    days = views.base(spark, sf_dir).select(
        F.date_format("day", "yyyyMMdd").alias("suffix"), "day"
    ).distinct()
    daily = days.select(F.concat(F.lit("events_"), "suffix").alias("table_name"))
    fresh = days.where(F.col("day") >= "2024-01-20").select(
        F.concat(F.lit("events_fresh_"), "suffix").alias("table_name")
    )
    return scans.chosen_shards(daily.unionByName(fresh))


@query(
    "scan_chosen_shards",
    f"""{BASE} SELECT strftime(day, '%Y%m%d') AS table_suffix,
    CASE WHEN day < DATE '2024-01-10' OR day = DATE '2024-01-15' THEN 'daily' ELSE 'fresh' END AS family,
    event_type AS event_name, device AS user_pseudo_id, epoch_us(ts) AS event_timestamp
    FROM base WHERE {DAYS}""",
)
def _(spark, sf_dir):
    """The daily family ends on the 9th and has one later day, the fresh one begins on the 5th."""
    events, _layout = view(spark, sf_dir, TOOL_NESTED)
    rows = events.select("table_suffix", "event_name", "user_pseudo_id", "event_timestamp")
    root = scratch_folder(spark)
    daily = rows.where("table_suffix < '20240110' OR table_suffix = '20240115'")
    fresh = rows.where("table_suffix >= '20240105'")
    for family, prefix, part in (("daily", scans.DAILY_PREFIX, daily), ("fresh", scans.FRESH_PREFIX, fresh)):
        part.withColumn("family", F.lit(family)).write.partitionBy("table_suffix").parquet(f"{root}/{prefix}")
    return scans.scan_chosen_shards(spark, root, START, END)


@query(
    "scan_flat_events",
    f"""{BASE} SELECT day AS event_date, event_type AS event_name,
    device AS user_pseudo_id, epoch_us(ts) AS micros FROM base WHERE {DAYS}""",
)
def _(spark, sf_dir):
    events, _layout = view(spark, sf_dir, TOOL_FLAT)
    return scans.scan_flat_events(events, START, END).select(
        "event_date", "event_name", "user_pseudo_id",
        F.col("time.event_timestamp").alias("micros"),
    )


@query(
    "scan_json2_events",
    f"""{BASE} SELECT event_type, device AS device_id, session_id, epoch_us(ts) AS micros
    FROM base WHERE {DAYS}""",
)
def _(spark, sf_dir):
    events, _layout = view(spark, sf_dir, TOOL_TWO_BAG)
    return scans.scan_json2_events(events, START, END).select(
        "event_type", "device_id", "session_id", micros("event_time").alias("micros")
    )


@query(
    "scan_json1_events",
    f"""{BASE} SELECT event_type AS event_name, device AS distinct_id,
    account AS user_id, epoch_us(ts) AS micros FROM base WHERE {DAYS}""",
)
def _(spark, sf_dir):
    events, _layout = view(spark, sf_dir, TOOL_ONE_BAG)
    return scans.scan_json1_events(events, START, END).select(
        "event_name", "distinct_id", "user_id", micros("time").alias("micros")
    )


# ---------------------------------------------------------------- P1-P4
IDENTITIES = ["DEVICE_ID", USER_ID_ONLY, USER_ID_OR_DEVICE_ID]
USER_SPECS = {
    tool: [spec(tool, identity_source=i) for i in IDENTITIES] for tool in SHORT
}


@query(
    "grouping_key_user",
    "\nUNION ALL\n".join(
        f"SELECT * FROM ({BASE} SELECT '{SHORT[tool]}' AS layout, epoch_us(ts) AS micros, "
        + ", ".join(
            f"{key_sql(tool, s)} AS key_{i}" for i, s in enumerate(USER_SPECS[tool])
        )
        + " FROM base)"
        for tool in SHORT
    ),
)
def _(spark, sf_dir):
    parts = []
    for tool, specs in USER_SPECS.items():
        events, layout = view(spark, sf_dir, tool)
        parts.append(
            events.select(
                F.lit(SHORT[tool]).alias("layout"),
                micros(layout.event_time()).alias("micros"),
                *[layout.grouping_key(s).alias(f"key_{i}") for i, s in enumerate(specs)],
            )
        )
    return union(parts)


@query(
    "grouping_key_session",
    "\nUNION ALL\n".join(
        f"""SELECT * FROM ({BASE} SELECT '{SHORT[tool]}' AS layout,
        epoch_us(ts) AS micros, {
            "device || coalesce(CAST(session_id AS VARCHAR), '')"
            if tool == TOOL_ONE_BAG
            else "device || CAST(session_id AS VARCHAR)"
        } AS key FROM base)"""
        for tool in SHORT
    ),
)
def _(spark, sf_dir):
    parts = []
    for tool in SHORT:
        events, layout = view(spark, sf_dir, tool)
        parts.append(
            events.select(
                F.lit(SHORT[tool]).alias("layout"),
                micros(layout.event_time()).alias("micros"),
                layout.grouping_key(spec(tool, scope="Session")).alias("key"),
            )
        )
    return union(parts)


@query(
    "one_bag_user_id_fallback",
    f"""{BASE} SELECT epoch_us(ts) AS micros,
    coalesce(account, CASE WHEN uid_num % 3 = 0 THEN 'm' || device END) AS any_user
    FROM base""",
)
def _(spark, sf_dir):
    events, layout = view(spark, sf_dir, TOOL_ONE_BAG)
    return events.select(micros("time").alias("micros"), layout.any_user().alias("any_user"))


IDENTITY_CASES = [
    (tool, scope, identity)
    for tool in SHORT
    for scope, identity in [("User", i) for i in IDENTITIES] + [("Session", "DEVICE_ID")]
]


@query(
    "identity_predicate",
    "\nUNION ALL\n".join(
        f"""SELECT * FROM ({BASE} SELECT '{SHORT[tool]}' AS layout, '{scope}' AS scope,
        '{identity}' AS identity_source, event_type AS event_name, count(*) AS n FROM base
        WHERE {identity_sql(tool, spec(tool, scope=scope, identity_source=identity))}
        GROUP BY event_type)"""
        for tool, scope, identity in IDENTITY_CASES
    ),
)
def _(spark, sf_dir):
    parts = []
    for tool in SHORT:
        events, layout = view(spark, sf_dir, tool)
        cases = [
            (
                F.struct(F.lit(scope).alias("scope"), F.lit(identity).alias("identity_source")),
                exp.all_of(
                    [
                        layout.identity_predicate(
                            spec(tool, scope=scope, identity_source=identity)
                        )
                    ]
                ),
            )
            for t, scope, identity in IDENTITY_CASES
            if t == tool
        ]
        counted = count_cases(events, layout, cases).drop("mark")
        parts.append(counted.withColumn("layout", F.lit(SHORT[tool])))
    return union(parts)


# ---------------------------------------------------------------- P5-P11
DOUBLE_TEXT = r"regexp_replace(CAST({} AS VARCHAR), '\.0$', '')"


def column_query(name: str, tool: str, columns: dict[str, tuple], build) -> None:
    """Register a row-level query: per column a parameter name and its SQL."""
    sql = (
        f"{BASE} SELECT epoch_us(ts) AS micros, "
        + ", ".join(f"{text} AS {out}" for out, (_p, text) in columns.items())
        + " FROM base"
    )

    @query(name, sql)
    def _(spark, sf_dir):
        events, layout = view(spark, sf_dir, tool)
        return events.select(
            micros(layout.event_time()).alias("micros"),
            *[build(layout, p).alias(out) for out, (p, _t) in columns.items()],
        )


def variant_of(layout, parameter):
    return layout.raw_variant(spec(layout.tool, experiment_variant_parameter=parameter))


def value_of(layout, parameter):
    return layout.value(spec(layout.tool, experiment_event_value_parameter=parameter))


column_query(
    "extract_variant_nested",
    TOOL_NESTED,
    {
        "event_text": ("exp_variant_string", "variant"),
        "event_int": ("k", "CAST(NULL AS VARCHAR)"),
        "user_text": ("tier", "tier"),
        "user_int": ("score", "CAST(k AS VARCHAR)"),
        "unknown": ("nothing", "CAST(NULL AS VARCHAR)"),
    },
    variant_of,
)
column_query(
    "extract_variant_flat",
    TOOL_FLAT,
    {
        "bare": ("exp_variant_string", "variant"),
        "bare_int": ("k", "CAST(k AS VARCHAR)"),
        "dotted": ("device.category", "device_kind"),
        "dotted_double": ("ecommerce.purchase_revenue", DOUBLE_TEXT.format("value * 2")),
    },
    variant_of,
)
column_query(
    "extract_variant_two_bag",
    TOOL_TWO_BAG,
    {
        "event_bag": ("variant", "variant"),
        "user_bag": ("group", "variant"),
        "either": ("tier", "tier"),
        "nested_path": ("info . plan", "plan"),
        "object_node": ("info", "CAST(NULL AS VARCHAR)"),
        "number_node": ("k", "CAST(k AS VARCHAR)"),
        "no_key": ("", "CAST(NULL AS VARCHAR)"),
    },
    variant_of,
)
column_query(
    "extract_variant_one_bag",
    TOOL_ONE_BAG,
    {
        "bag": ("variant", "variant"),
        "nested_path": ("info.plan", "plan"),
        "object_node": ("info", "CAST(NULL AS VARCHAR)"),
        "number_node": ("k", "CAST(k AS VARCHAR)"),
        "missing_for_some": ("tier", "tier"),
    },
    variant_of,
)
column_query(
    "extract_value_nested",
    TOOL_NESTED,
    {
        "double_param": ("value", "value"),
        "int_param": ("k", "CAST(k AS DOUBLE)"),
        "ecommerce": ("ecommerce.purchase_revenue", "value * 2"),
        "text_param": ("exp_variant_string", "CAST(NULL AS DOUBLE)"),
        "none": ("", "CAST(NULL AS DOUBLE)"),
    },
    value_of,
)
column_query(
    "extract_value_flat",
    TOOL_FLAT,
    {
        "bare": ("value", "value"),
        "bare_int": ("k", "CAST(k AS DOUBLE)"),
        "ecommerce": ("ecommerce.purchase_revenue", "value * 2"),
        "text_param": ("tier", "TRY_CAST(tier AS DOUBLE)"),
        "none": (" ", "CAST(NULL AS DOUBLE)"),
    },
    value_of,
)
column_query(
    "extract_value_json",
    TOOL_TWO_BAG,
    {
        "number": ("value", "value"),
        "nested_path": ("info.value", "value"),
        "int_number": ("k", "CAST(k AS DOUBLE)"),
        "bad_text": ("variant", "TRY_CAST(variant AS DOUBLE)"),
    },
    value_of,
)

PADDED = r"""CASE WHEN k % 3 = 0 THEN '  ' WHEN k % 3 = 1 THEN NULL
    ELSE chr(9) || variant || ' ' || chr(10) END"""


@query(
    "label_exposures",
    f"""{BASE} SELECT device AS key, epoch_us(ts) AS micros, variant FROM base
    WHERE event_type = 'view' AND {DAYS} AND k % 3 = 2""",
)
def _(spark, sf_dir):
    events, layout = view(spark, sf_dir, TOOL_FLAT)
    k = F.col("event_params.k")
    padded = F.when(k % 3 == 0, F.lit("  ")).when(
        k % 3 == 2, F.concat(F.lit("\t"), "event_params.exp_variant_string", F.lit(" \n"))
    )
    padded_events = events.withColumn(
        "event_params", F.col("event_params").withField("exp_variant_string", padded)
    )
    labelled = exp.label_exposures(padded_events, layout, spec(TOOL_FLAT))
    return labelled.select("key", micros("exposure_time").alias("micros"), "variant")


# ---------------------------------------------------------------- F1, F2, F8, F10
@query(
    "exposure_guard",
    "\nUNION ALL\n".join(
        f"""SELECT * FROM ({BASE} SELECT '{SHORT[tool]}' AS layout,
        epoch_us(ts) AS micros FROM base WHERE event_type = 'view')"""
        for tool in SHORT
    ),
)
def _(spark, sf_dir):
    parts = []
    for tool in SHORT:
        events, layout = view(spark, sf_dir, tool)
        parts.append(
            events.where(layout.exposure_guard(spec(tool))).select(
                F.lit(SHORT[tool]).alias("layout"),
                micros(layout.event_time()).alias("micros"),
            )
        )
    return union(parts)


@query(
    "user_property_exposure",
    f"""{BASE} SELECT device AS key, epoch_us(ts) AS micros, variant FROM base
    WHERE uid_num % 2 = 0 AND {DAYS}""",
)
def _(spark, sf_dir):
    events, layout = view(spark, sf_dir, TOOL_NESTED)
    by_property = spec(TOOL_NESTED, experiment_event_name="firebase_exp_7")
    return exp.label_exposures(events, layout, by_property).select(
        "key", micros("exposure_time").alias("micros"), "variant"
    )


@query(
    "match_variant",
    f"""{BASE} SELECT variant, regexp_matches(variant, 'tr.*t$|^x') AS partial,
    regexp_matches(variant, '^control$') AS anchored, regexp_matches(variant, '[m-p]l')
    AS class_match, count(*) AS n FROM base GROUP BY ALL""",
)
def _(spark, sf_dir):
    text = F.col("variant")
    return (
        views.base(spark, sf_dir)
        .groupBy(
            text,
            exp.matches_variant(text, "tr.*t$|^x").alias("partial"),
            exp.matches_variant(text, "^control$").alias("anchored"),
            exp.matches_variant(text, "[m-p]l").alias("class_match"),
        )
        .agg(F.count("*").alias("n"))
    )


@query(
    "date_window",
    "\nUNION ALL\n".join(
        f"""SELECT * FROM ({BASE} SELECT '{SHORT[tool]}' AS layout,
        event_type AS event_name, count(*) AS n, min(epoch_us(ts)) AS first_micros,
        max(epoch_us(ts)) AS last_micros FROM base WHERE {DAYS} GROUP BY event_type)"""
        for tool in SHORT
    ),
)
def _(spark, sf_dir):
    parts = []
    for tool in SHORT:
        events, layout = view(spark, sf_dir, tool)
        time = micros(layout.event_time())
        parts.append(
            exp.date_window(events, layout, spec(tool))
            .groupBy(F.col(layout.event_column).alias("event_name"))
            .agg(
                F.count("*").alias("n"),
                F.min(time).alias("first_micros"),
                F.max(time).alias("last_micros"),
            )
            .withColumn("layout", F.lit(SHORT[tool]))
        )
    return union(parts)


# ---------------------------------------------------------------- F3-F7
def filtered_query(name: str, cases: list[tuple]) -> None:
    """Register a query that counts the rows each filter keeps. A case is (layout, filter
    scope, field, pattern, SQL of include, SQL of exclude)."""
    numbered = list(enumerate(cases))
    sql = "\nUNION ALL\n".join(
        f"""SELECT * FROM ({BASE} SELECT {i} AS case_no, '{kind}' AS filter_type,
        event_type AS event_name, count(*) AS n, sum(epoch_us(ts) % 1000003)::BIGINT AS mark
        FROM base WHERE {condition} GROUP BY event_type)"""
        for i, (_tool, _scope, _field, _pattern, include, exclude) in numbered
        for kind, condition in (("Include", include), ("Exclude", exclude))
    )

    @query(name, sql)
    def _(spark, sf_dir):
        parts = []
        for tool in dict.fromkeys(case[0] for case in cases):
            events, layout = view(spark, sf_dir, tool)
            labelled_cases = []
            for i, (t, scope, field, pattern, _include, _exclude) in numbered:
                for kind in ("Include", "Exclude") if t == tool else ():
                    f = FilterSpec(kind, "Both", scope, field, pattern)
                    predicates = exp.filter_predicates(
                        layout, spec(tool, filters=(f,)), "exposure"
                    )
                    label = F.struct(
                        F.lit(i).alias("case_no"), F.lit(kind).alias("filter_type")
                    )
                    labelled_cases.append((label, exp.all_of(predicates)))
            parts.append(count_cases(events, layout, labelled_cases))
        return union(parts)


K_TEXT = "CAST(k AS VARCHAR)"
VALUE_TEXT = DOUBLE_TEXT.format("value")


def kept(text: str, pattern: str) -> tuple[str, str]:
    """Conditions where a missing value is dropped on both sides."""
    match = f"regexp_matches({text}, '{pattern}')"
    return match, f"NOT {match}"


def filled(text: str, pattern: str) -> tuple[str, str]:
    """Conditions where a missing value reads as blank text."""
    return kept(f"coalesce({text}, '')", pattern)


filtered_query(
    "event_param_filter",
    [
        (TOOL_NESTED, "Event", "k", "^1", *kept(K_TEXT, "^1")),
        (TOOL_NESTED, "Event", "value", r"\.5$|^7", *kept(VALUE_TEXT, r"\.5$|^7")),
        (TOOL_NESTED, "Event", "ga_session_id", "15$",
         *kept("CAST(session_id AS VARCHAR)", "15$")),
        (TOOL_FLAT, "Event", "tier", "^gold$", *kept("tier", "^gold$")),
        (TOOL_FLAT, "Event", "k", "^1", *kept(K_TEXT, "^1")),
        (TOOL_TWO_BAG, "Event", "info.plan", "p[12]", *filled("plan", "p[12]")),
        (TOOL_ONE_BAG, "Event", "tier", "^gold$", *filled("tier", "^gold$")),
        (TOOL_ONE_BAG, "Event", " info . plan ", "p[12]", *filled("plan", "p[12]")),
    ],
)
filtered_query(
    "user_property_filter",
    [
        (TOOL_NESTED, "User", "tier", "^gold$", *kept("tier", "^gold$")),
        (TOOL_NESTED, "User", "score", "^1", *kept(K_TEXT, "^1")),
        (TOOL_FLAT, "User", "tier", "^gold$", "TRUE", "TRUE"),
        (TOOL_TWO_BAG, "User", "tier", "^gold$", *filled("tier", "^gold$")),
        (TOOL_ONE_BAG, "User", "tier", "^gold$", *filled("tier", "^gold$")),
    ],
)
filtered_query(
    "column_filter",
    [
        (TOOL_NESTED, "Column", "device . category", "desk", *filled("device_kind", "desk")),
        (TOOL_NESTED, "COLUMN", "geo country", "p1", *filled("plan", "p1")),
        (TOOL_NESTED, "Column", "ecommerce.purchase_revenue", "^1",
         *filled(DOUBLE_TEXT.format("value * 2"), "^1")),
        (TOOL_FLAT, "Column", "device.category", "desk", *kept("device_kind", "desk")),
        (TOOL_TWO_BAG, "Column", "platform", "desk", *filled("device_kind", "desk")),
        (TOOL_TWO_BAG, "Column", "info.plan", "p1", *filled("plan", "p1")),
        (TOOL_ONE_BAG, "Column", "platform", "^$", *filled("device_kind", "^$")),
    ],
)
ITEM_NESTED = "k % 6 > 1 AND regexp_matches(CASE WHEN k % 4 <> 0 THEN plan ELSE '' END, '{}')"
ITEM_FLAT = "k % 6 <> 1 AND k % 4 <> 0 AND regexp_matches(plan, '{}')"
filtered_query(
    "items_filter",
    [
        (tool, "Column", "items.item_category", pattern,
         sql.format(pattern), f"NOT ({sql.format(pattern)})")
        for tool, sql in ((TOOL_NESTED, ITEM_NESTED), (TOOL_FLAT, ITEM_FLAT))
        for pattern in ("^p1$", "^$|p2")
    ],
)

TARGETS = ["Experiment Event", "Conversion Event", "Both"]
TARGET_FILTER = "regexp_matches(CAST(k AS VARCHAR), '^[1-6]') AND NOT regexp_matches(plan, 'p3')"


def target_specs():
    out = []
    for i, target in enumerate(TARGETS):
        filters = (
            FilterSpec("Include", target, "Event", "k", "^[1-6]"),
            FilterSpec("Exclude", target, "Event", "info.plan", "p3"),
        )
        for variant in "AB":
            out.append(
                spec(TOOL_ONE_BAG, variant, id=f"{i:02d}", filters=filters,
                     conversion_count_all=True)
            )
    return out


ROUNDED = {"total_conversion_value": 4, "total_conversion_sq_value": 2}


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in ROUNDED.items() if c in df.columns})


@query(
    "filter_target",
    "\nUNION ALL\n".join(
        results_sql(
            TOOL_ONE_BAG,
            [s],
            exposure_extra=TARGET_FILTER if "Conversion" not in TARGETS[i // 2] else "TRUE",
            conversion_extra=TARGET_FILTER if "Experiment" not in TARGETS[i // 2] else "TRUE",
        )
        for i, s in enumerate(target_specs())
    ),
)
def _(spark, sf_dir):
    events, layout = view(spark, sf_dir, TOOL_ONE_BAG)
    return rounded(analyze_specs(events, layout, target_specs()))


# ---------------------------------------------------------------- A, W, J, G
def labelled(spark, sf_dir, tool=TOOL_NESTED, **changes):
    events, layout = view(spark, sf_dir, tool)
    return exp.label_exposures(events, layout, spec(tool, **changes))


EXPOSURES = f"{BASE}, exposures AS ({exposures_sql(TOOL_NESTED, spec(TOOL_NESTED))})"
SESSION_EXPOSURES = (
    f"{BASE}, exposures AS "
    f"({exposures_sql(TOOL_NESTED, spec(TOOL_NESTED, scope='Session'))})"
)

for policy, operator in (
    (FIRST, "overlap_first_exposure"),
    (LAST, "overlap_last_exposure"),
    (EXCLUDE, "overlap_exclude"),
    (BOTH, "overlap_credit_both"),
):
    sides = "\nUNION ALL\n".join(
        f"""SELECT '{v}' AS side, key, epoch_us(exposure_time) AS micros FROM (
        {units_sql(TOOL_TWO_BAG, spec(TOOL_NESTED, v, user_overlap=policy))})"""
        for v in "AB"
    )

    @query(operator, f"{SESSION_EXPOSURES} {sides}")
    def _(spark, sf_dir, policy=policy):
        exposures = labelled(spark, sf_dir, scope="Session")
        return union(
            [
                att.OVERLAP[policy](exposures, spec(TOOL_NESTED, v).exp_variant_string)
                .select(F.lit(v).alias("side"), "key",
                        micros("exposure_time").alias("micros"))
                for v in "AB"
            ]
        )


for name, direction in (("first_exposure_rank", ""), ("last_exposure_rank", "DESC")):

    @query(
        name,
        f"""{EXPOSURES} SELECT key, epoch_us(exposure_time) AS micros, variant,
        row_number() OVER (PARTITION BY key ORDER BY exposure_time {direction}, variant)
        AS rn FROM exposures""",
    )
    def _(spark, sf_dir, name=name):
        ranked = getattr(att, name)(labelled(spark, sf_dir))
        return ranked.select("key", micros("exposure_time").alias("micros"), "variant", "rn")


for name, count_all in (("conversions_once", False), ("conversions_all", True)):

    @query(
        name,
        f"""{BASE} SELECT key, epoch_us(conv_time) AS micros,
        round(conv_value, 4) AS conv_value, round(conv_sq_value, 2) AS conv_sq_value,
        conv_count FROM ({conversions_sql(TOOL_TWO_BAG, spec(
            TOOL_TWO_BAG, conversion_count_all=count_all))})""",
    )
    def _(spark, sf_dir, name=name):
        events, layout = view(spark, sf_dir, TOOL_TWO_BAG)
        rows = getattr(exp, name)(events, layout, spec(TOOL_TWO_BAG))
        return rows.select(
            "key", micros("conv_time").alias("micros"),
            F.round("conv_value", 4).alias("conv_value"),
            F.round("conv_sq_value", 2).alias("conv_sq_value"), "conv_count",
        )


for name, tool in (("post_exposure_join", TOOL_FLAT), ("post_exposure_join_strict", TOOL_ONE_BAG)):
    join_specs = [spec(tool, v, conversion_count_all=True) for v in "AB"]

    @query(
        name,
        " UNION ALL ".join(
            f"""SELECT '{s.variant}' AS side, * FROM ({parts_sql(tool, s)}
            SELECT key, epoch_us(exposure_time) AS exposure_micros,
            epoch_us(conv_time) AS conv_micros, round(conv_value, 4) AS conv_value
            FROM met WHERE conv_time IS NOT NULL)"""
            for s in join_specs
        ),
    )
    def _(spark, sf_dir, tool=tool, join_specs=join_specs):
        events, layout = view(spark, sf_dir, tool)
        sides = []
        for s in join_specs:
            units = att.overlap_first_exposure(
                exp.label_exposures(events, layout, s), s.exp_variant_string
            )
            joined = att.post_exposure_join(
                units, exp.conversions(events, layout, s), layout.strict_after
            )
            sides.append(joined.select(
                F.lit(s.variant).alias("side"), "key",
                micros("exposure_time").alias("exposure_micros"),
                micros("conv_time").alias("conv_micros"),
                F.round("conv_value", 4).alias("conv_value"),
            ))
        return union(sides)


@query(
    "exclude_join",
    EXPOSURES + " " + " UNION ALL ".join(
        f"""SELECT '{v}' AS side, key, epoch_us(exposure_time) AS micros FROM (
        {units_sql(TOOL_NESTED, spec(TOOL_NESTED, v, user_overlap=EXCLUDE))})"""
        for v in "AB"
    ),
)
def _(spark, sf_dir):
    exposures = labelled(spark, sf_dir)
    sides = [
        att.exclude_join(exposures, spec(TOOL_NESTED, v).exp_variant_string).select(
            F.lit(v).alias("side"), "key", micros("exposure_time").alias("micros")
        )
        for v in "AB"
    ]
    return union(sides)


@query(
    "sufficient_stats",
    " UNION ALL ".join(
        f"SELECT '{v}' AS side, * FROM ({stats_sql(TOOL_FLAT, spec(TOOL_FLAT, v, conversion_count_all=True))})"
        for v in "AB"
    ),
)
def _(spark, sf_dir):
    events, layout = view(spark, sf_dir, TOOL_FLAT)
    sides = []
    for v in "AB":
        s = spec(TOOL_FLAT, v, conversion_count_all=True)
        units = att.overlap_first_exposure(
            exp.label_exposures(events, layout, s), s.exp_variant_string
        )
        found = rounded(unit_stats(units, exp.conversions(events, layout, s), False))
        sides.append(found.select(F.lit(v).alias("side"), "*"))
    return union(sides)


@query(
    "distinct_unit_count",
    f"{SESSION_EXPOSURES} SELECT count(DISTINCT key) AS user_count FROM exposures",
)
def _(spark, sf_dir):
    return distinct_unit_count(labelled(spark, sf_dir, scope="Session"))


# ---------------------------------------------------------------- R1
for tool, short in SHORT.items():

    @query(f"analyze_{short}", results_sql(tool, spread(tool)))
    def _(spark, sf_dir, tool=tool):
        events, layout = view(spark, sf_dir, tool)
        return rounded(analyze_specs(events, layout, spread(tool)))


ONE_ROWS = [spec(TOOL_TWO_BAG, v, user_overlap=LAST, conversion_count_all=True) for v in "AB"]


@query(
    "analyze_one_row",
    " UNION ALL ".join(
        f"SELECT '{s.variant}' AS side, * FROM ({stats_sql(TOOL_TWO_BAG, s)})" for s in ONE_ROWS
    ),
)
def _(spark, sf_dir):
    events, layout = view(spark, sf_dir, TOOL_TWO_BAG)
    return union([
        rounded(analyze_one(events, layout, s)).select(F.lit(s.variant).alias("side"), "*")
        for s in ONE_ROWS
    ])


for tool in (TOOL_NESTED, TOOL_ONE_BAG):

    @query(f"analyze_day_by_day_{SHORT[tool]}", results_sql(tool, spread(tool)))
    def _(spark, sf_dir, tool=tool):
        """Three runs: some days for half of the rows, more days for all, then the rest."""
        events, layout = view(spark, sf_dir, tool)
        specs, root = spread(tool), scratch_folder(spark)
        middle = START + (END - START) // 2
        advance(root, events, layout, specs[: len(specs) // 2], START + (middle - START) // 2)
        advance(root, events, layout, specs, middle)
        return rounded(analyze_day_by_day(root, events, layout, specs, END))
