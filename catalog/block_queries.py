"""Registry preparation over blocks derived from ``customer``: one block per customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from abspark.operators import aggregates as agg
from abspark.operators import registry as reg
from abspark.schemas import EXPERIMENTS_STAGE
from catalog.registry import query
from catalog.views import table

C = "c_custkey"
TEXT = f"CAST({C} AS VARCHAR(20))"
DAY = "DATE '2024-01-01' + CAST({} AS INTEGER)"

# Block cells in SQL that both engines read.
BLOCK = {
    "id": f"CASE WHEN {C} % 50 = 7 THEN NULL WHEN {C} % 50 = 8 THEN c_name ELSE {TEXT} END",
    "experiment_name": f"CASE WHEN {C} % 40 = 1 THEN '' ELSE c_name END",
    "analyze_choice": f"""CASE {C} % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Update' WHEN 2 THEN 'No'
        WHEN 3 THEN ' Yes ' WHEN 4 THEN 'Yes' END""",
    "event_value_test": f"CASE {C} % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'yes' END",
    "hypothesis": "'Two-sided'",
    "confidence": f"CASE {C} % 4 WHEN 0 THEN '0.95' WHEN 1 THEN '80%' WHEN 2 THEN '90' "
    "ELSE '0.905' END",
    "description": "c_mktsegment",
    "scope": f"CASE {C} % 3 WHEN 0 THEN 'User' WHEN 1 THEN 'Session' ELSE '' END",
    "identity_source": f"CASE {C} % 5 WHEN 0 THEN 'USER_ID_ONLY' WHEN 1 THEN '' "
    "WHEN 2 THEN 'user_id_or_device_id' ELSE 'DEVICE_ID' END",
    "user_overlap": "'Exclude'",
    "variant_settings": f"CASE {C} % 3 WHEN 0 THEN 'Same' WHEN 1 THEN 'Different' END",
    "conversion_count_all": f"{C} % 2 = 0",
    "date_comparison": f"{C} % 4 = 0",
    "date_start_a": DAY.format(f"{C} % 20"),
    "date_end_a": f"CASE WHEN {C} % 30 = 11 THEN NULL ELSE "
    + DAY.format(f"{C} % 20 + {C} % 9") + " END",
    "date_start_b": f"CASE WHEN {C} % 30 = 12 THEN NULL ELSE "
    + DAY.format(f"60 + {C} % 20") + " END",
    "date_end_b": DAY.format(f"60 + {C} % 20 + {C} % 7"),
    "variant_name_a": "'first'",
    "variant_name_b": f"CASE WHEN {C} % 45 = 2 THEN '' ELSE 'second' END",
    "conversion_event_a": "'purchase'",
    "conversion_event_b": f"CASE WHEN {C} % 35 = 4 THEN NULL ELSE 'signup' END",
    "exp_variant_string_a": "'^control$'",
    "exp_variant_string_b": "'^treatment$'",
    "experiment_event_name_a": "'view'",
    "experiment_event_name_b": f"CASE WHEN {C} % 2 = 0 THEN 'click' ELSE '' END",
    "experiment_variant_parameter_a": "'variant'",
    "experiment_variant_parameter_b": "'other'",
    "experiment_event_value_parameter": "'value'",
    "analytics_tool": "'Mixpanel'",
    "filtering": f"CASE {C} % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'YES' ELSE 'Yes' END",
    "advanced": f"{C} % 5 < 2",
    "filter_type_a": f"CASE WHEN {C} % 2 = 0 THEN 'Exclude' END",
    "filter_type_b": f"CASE WHEN {C} % 7 = 0 THEN 'Include' END",
    "filter_on_value_a": f"""CASE {C} % 4 WHEN 0 THEN 'experiment' WHEN 1 THEN ' Conversion Event'
        WHEN 2 THEN '' ELSE 'both' END""",
    "filter_on_value_b": f"CASE WHEN {C} % 7 = 0 THEN 'the CONVERSION' END",
    "filter_scope_a": f"CASE {C} % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'Column' END",
    "filter_scope_b": f"CASE WHEN {C} % 7 = 0 THEN 'other' ELSE '' END",
    "filter_field_a": f"CASE WHEN {C} % 11 = 0 THEN ' ' ELSE ' plan ' END",
    "filter_field_b": f"CASE WHEN {C} % 7 < 3 THEN 'tier' ELSE ' ' END",
    "filter_value_a": f"CASE WHEN {C} % 11 = 0 THEN NULL ELSE c_mktsegment END",
    "filter_value_b": f"CASE WHEN {C} % 7 < 2 THEN 'gold' END",
    "images_a": f"""CASE WHEN {C} % 4 = 0 THEN 'https://drive.google.com/file/d/' || c_name
        || '/view?usp=sharing' || chr(13) || chr(10) || ' http://x/' || {TEXT} || ' '
        || chr(10) || ' ' END""",
    "images_b": f"""CASE WHEN {C} % 3 = 0 THEN 'https://drive.google.com/file/d/' || c_name
        || chr(10) || 'http://y/' || {TEXT} END""",
    "links": f"CASE WHEN {C} % 2 = 0 THEN 'http://a/' || {TEXT} || chr(10) || chr(10) "
    "|| '  http://b  ' END",
}
BLOCKS_SQL = (
    "blocks AS (SELECT c_custkey, "
    + ", ".join(f"{text} AS {name}" for name, text in BLOCK.items())
    + " FROM customer)"
)
ID_SQL = r"""CASE WHEN regexp_matches(trim(coalesce({0}, '')), '^[0-9]+$')
    THEN CASE WHEN length(CAST(CAST(trim({0}) AS BIGINT) AS VARCHAR)) < 2
      THEN '0' || CAST(CAST(trim({0}) AS BIGINT) AS VARCHAR)
      ELSE CAST(CAST(trim({0}) AS BIGINT) AS VARCHAR) END
    ELSE trim(coalesce({0}, '')) END"""
MODE_SQL = """CASE trim(coalesce(analyze_choice, '')) WHEN 'Yes' THEN 'ANALYZE'
    WHEN 'Update' THEN 'UPDATE' ELSE 'STATUS_ONLY' END"""
CONFIDENCE_SQL = """CASE WHEN confidence NOT LIKE '%\\%%' ESCAPE '\\'
    AND CAST(replace(confidence, '%', '') AS DOUBLE) <= 1
    THEN floor(CAST(confidence AS DOUBLE) * 100 + 0.5)
    ELSE CAST(replace(confidence, '%', '') AS DOUBLE) END""".replace("\\\\", "\\")
DIFFERENT = "coalesce(variant_settings, '') = 'Different'"


def blocks(spark, sf_dir):
    cells = [f"{text} AS {name}" for name, text in BLOCK.items()]
    customers = table(spark, sf_dir, "customer")
    return customers.selectExpr(
        C, *[c.replace("VARCHAR(20)", "STRING") for c in cells]
    )


W = f"WITH {BLOCKS_SQL}"


@query("normalize_id", f"{W} SELECT {C}, {ID_SQL.format('id')} AS padded FROM blocks")
def _(spark, sf_dir):
    return blocks(spark, sf_dir).select(C, reg.normalize_id(F.col("id")).alias("padded"))


@query("export_mode", f"{W} SELECT {C}, {MODE_SQL} AS mode FROM blocks")
def _(spark, sf_dir):
    return blocks(spark, sf_dir).select(C, reg.export_mode(F.col("analyze_choice")).alias("mode"))


@query(
    "normalize_confidence_input",
    f"{W} SELECT {C}, {CONFIDENCE_SQL} AS percent FROM blocks",
)
def _(spark, sf_dir):
    percent = reg.normalize_confidence_input(F.col("confidence"))
    return blocks(spark, sf_dir).select(C, percent.alias("percent"))


@query(
    "previous_period",
    f"""{W} SELECT {C}, CASE WHEN date_start_a <= date_end_a THEN
    CAST(date_start_a - CAST(date_end_a - date_start_a AS INTEGER) - 1 AS DATE) END AS date_start,
    CASE WHEN date_start_a <= date_end_a THEN CAST(date_start_a - 1 AS DATE) END AS date_end
    FROM blocks""",
)
def _(spark, sf_dir):
    period = reg.previous_period(F.col("date_start_a"), F.col("date_end_a"))
    return blocks(spark, sf_dir).select(C, period.alias("p")).select(C, "p.*")


@query(
    "default_window",
    f"""{W} SELECT {C}, CAST(date_start_a - 15 AS DATE) AS date_start,
    CAST(date_start_a - 1 AS DATE) AS date_end FROM blocks""",
)
def _(spark, sf_dir):
    window = reg.default_window(F.col("date_start_a"))
    return blocks(spark, sf_dir).select(C, window.alias("w")).select(C, "w.*")


@query(
    "enforce_scope",
    f"""{W} SELECT {C}, CASE WHEN upper(identity_source) NOT IN ('', 'DEVICE_ID') THEN 'User'
    WHEN scope = '' THEN 'User' ELSE scope END AS scope FROM blocks""",
)
def _(spark, sf_dir):
    scope = reg.enforce_scope(F.col("scope"), F.col("identity_source"))
    return blocks(spark, sf_dir).select(C, scope.alias("scope"))


TARGET_SQL = """CASE WHEN lower({0}) LIKE '%experiment%' THEN 'Experiment Event'
    WHEN lower({0}) LIKE '%conversion%' THEN 'Conversion Event' ELSE 'Both' END"""


@query(
    "normalize_filter_target",
    f"""{W} SELECT {C}, {TARGET_SQL.format('filter_on_value_a')} AS side_a,
    {TARGET_SQL.format('filter_on_value_b')} AS side_b FROM blocks""",
)
def _(spark, sf_dir):
    return blocks(spark, sf_dir).select(
        C,
        *[
            reg.normalize_filter_target(F.col(f"filter_on_value_{v}")).alias(f"side_{v}")
            for v in "ab"
        ],
    )


@query(
    "rewrite_drive_url",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://drive.google.com/uc?id=' ||
    CAST(page_id AS VARCHAR) || 'x' WHEN 1 THEN url
    ELSE 'https://drive.google.com/file/d/' || CAST(page_id AS VARCHAR) END AS url FROM pages""",
)
def _(spark, sf_dir):
    ident = F.col("page_id").cast("string")
    start = F.lit("https://drive.google.com/file/d/")
    url = (
        F.when(F.col("page_id") % 3 == 0, F.concat(start, ident, F.lit("x/view?usp=sharing")))
        .when(F.col("page_id") % 3 == 1, F.col("url"))
        .otherwise(F.concat(start, ident))
    )
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", reg.rewrite_drive_url(url).alias("url"))


OWN_B = "CASE WHEN date_comparison THEN {0}_b ELSE {0}_a END"


@query(
    "compare_dates",
    f"""{W} SELECT {C}, date_start_a, date_end_a, {OWN_B.format('date_start')} AS date_start_b,
    {OWN_B.format('date_end')} AS date_end_b FROM blocks""",
)
def _(spark, sf_dir):
    return reg.compare_dates(blocks(spark, sf_dir)).select(
        C, "date_start_a", "date_end_a", "date_start_b", "date_end_b"
    )


COMPLETE = f"""(CASE WHEN {MODE_SQL} = 'STATUS_ONLY' THEN {ID_SQL.format('id')} <> ''
  ELSE {ID_SQL.format('id')} <> '' AND experiment_name <> '' AND scope <> ''
    AND identity_source <> '' AND date_end_a IS NOT NULL
    AND NOT (date_comparison AND date_start_b IS NULL) AND variant_name_b <> ''
    AND NOT ({DIFFERENT} AND (coalesce(experiment_event_name_b, '') = ''
      OR coalesce(conversion_event_b, '') = '')) END)"""


def problem(condition: str, name: str) -> str:
    return f"CASE WHEN {condition} THEN '{name}' END"


MISSING_SQL = "concat_ws(',', " + ", ".join(
    [
        problem(f"{ID_SQL.format('id')} = ''", "id"),
        problem("experiment_name = ''", "experiment_name"),
        problem("scope = ''", "scope"),
        problem("identity_source = ''", "identity_source"),
        problem("date_end_a IS NULL", "date_end_a"),
        problem("date_comparison AND date_start_b IS NULL", "date_start_b"),
        problem("variant_name_b = ''", "variant_name"),
        problem(f"{DIFFERENT} AND experiment_event_name_b = ''", "experiment_event_name_b"),
        problem(f"{DIFFERENT} AND conversion_event_b IS NULL", "conversion_event_b"),
    ]
) + ")"


@query(
    "validate_blocks",
    f"""{W} SELECT {C}, {COMPLETE} AS complete, CASE WHEN {MODE_SQL} = 'STATUS_ONLY'
    THEN concat_ws(',', {problem(f"{ID_SQL.format('id')} = ''", 'id')})
    ELSE {MISSING_SQL} END AS missing FROM blocks""",
)
def _(spark, sf_dir):
    complete, skipped = reg.validate_blocks(blocks(spark, sf_dir))
    good = complete.select(C, F.lit(True).alias("complete"), F.lit("").alias("missing"))
    bad = skipped.select(
        C, F.lit(False).alias("complete"), F.array_join("missing", ",").alias("missing")
    )
    return good.unionByName(bad)


def expanded_sql() -> str:
    """Staged registry rows of the complete blocks."""
    rows = []
    for v, own in (("A", "a"), ("B", "b")):
        same = {
            "date_start": OWN_B.format("date_start") if v == "B" else "date_start_a",
            "date_end": OWN_B.format("date_end") if v == "B" else "date_end_a",
            "variant_name": f"variant_name_{own}",
            "exp_variant_string": f"exp_variant_string_{own}",
            "event_value_test": "lower(event_value_test) = 'yes'",
            "confidence": f"CAST({CONFIDENCE_SQL} AS BIGINT)",
            "analytics_tool": "upper(analytics_tool)",
            "query_information_logging": "CAST(NULL AS BOOLEAN)",
            "query_price_per_tib": "CAST(NULL AS DOUBLE)",
        }
        for name in (
            "conversion_event", "experiment_event_name", "experiment_variant_parameter"
        ):
            own_text = f"CASE WHEN {DIFFERENT} THEN {name}_b ELSE {name}_a END"
            same[name] = own_text if v == "B" else f"{name}_a"
        cells = []
        for f in EXPERIMENTS_STAGE.fields:
            n = f.name
            if n == "id":
                cells.append(f"{ID_SQL.format('id')} AS id")
            elif n == "variant":
                cells.append(f"'{v}' AS variant")
            elif n == "export_mode":
                cells.append(f"{MODE_SQL} AS export_mode")
            elif n == "analyze_test":
                cells.append(
                    "lower(trim(coalesce(analyze_choice, ''))) = 'yes' AS analyze_test"
                )
            else:
                text = same.get(n, n)
                cells.append(f"CASE WHEN {MODE_SQL} <> 'STATUS_ONLY' THEN {text} END AS {n}")
        rows.append(f"SELECT {', '.join(cells)} FROM blocks WHERE {COMPLETE}")
    return f"{W} " + " UNION ALL ".join(rows)


@query("expand_blocks", expanded_sql())
def _(spark, sf_dir):
    complete, _skipped = reg.validate_blocks(blocks(spark, sf_dir))
    return reg.expand_blocks(complete)


@query(
    "active_ids",
    f"""{W} SELECT DISTINCT {ID_SQL.format('id')} AS id FROM blocks
    WHERE trim(analyze_choice) = 'Yes' AND {ID_SQL.format('id')} <> ''""",
)
def _(spark, sf_dir):
    return reg.active_ids(blocks(spark, sf_dir))


# The advanced filter list: two rows per customer below the middle, found by id or name.
ADVANCED = {
    "id": f"CASE WHEN {C} % 2 = 0 THEN {TEXT} ELSE c_name END",
    "variant": f"CASE {C} % 3 WHEN 0 THEN 'a' WHEN 1 THEN ' B ' ELSE 'C' END",
    "enabled": f"CASE WHEN {C} % 9 = 0 THEN NULL ELSE {C} % 4 <> 1 END",
    "filter_type": f"CASE WHEN {C} % 2 = 0 THEN ' Exclude ' ELSE '' END",
    "filter_on_value": f"CASE WHEN {C} % 3 = 0 THEN 'Experiment' END",
    "filter_scope": f"CASE WHEN {C} % 5 = 0 THEN 'Column' ELSE ' ' END",
    "filter_field": "' field '",
    "filter_value": "c_mktsegment",
    "notes": "'note '",
    "source": "'advanced'",
}
ADVANCED_SQL = (
    "advanced AS (SELECT "
    + ", ".join(f"{t} AS {n}" for n, t in ADVANCED.items())
    + " FROM customer WHERE c_acctbal > 0)"
)


def advanced(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return customers.selectExpr(
        *[f"{t} AS {n}".replace("VARCHAR(20)", "STRING") for n, t in ADVANCED.items()]
    )


def simple_sql(v: str, scope_label: bool) -> str:
    """Cells of the simple filter of a block."""

    def cell(name: str, default: str) -> str:
        read = "{}" if default else "trim({})"
        a = f"coalesce(nullif({read.format(name + '_a')}, ''), '{default}')"
        if v == "A":
            return a
        b = f"coalesce(nullif({read.format(name + '_b')}, ''), {a})"
        return f"CASE WHEN {DIFFERENT} THEN {b} ELSE {a} END"

    scope = cell("filter_scope", "Event")
    if scope_label:
        scope = f"""CASE lower({scope}) WHEN 'user' THEN 'User' WHEN 'column' THEN 'Column'
            ELSE 'Event' END"""
    return f"""'{v}' AS variant, TRUE AS enabled, {cell('filter_type', 'Include')} AS filter_type,
      {TARGET_SQL.format('(' + cell('filter_on_value', 'Both') + ')')} AS filter_on_value,
      {scope} AS filter_scope, {cell('filter_field', '')} AS filter_field,
      {cell('filter_value', '')} AS filter_value"""


FILTERING = "lower(coalesce(filtering, '')) = 'yes'"


@query(
    "merge_filters",
    f"""{W}, {ADVANCED_SQL}, active AS (SELECT *, {ID_SQL.format('id')} AS ident,
      trim(experiment_name) AS name FROM blocks WHERE trim(analyze_choice) = 'Yes' AND {FILTERING}),
    keys AS (SELECT unnest([ident, name]) AS id FROM active
      WHERE advanced AND (ident <> '' OR name <> '')),
    listed AS (SELECT {ID_SQL.format('id')} AS id, upper(trim(variant)) AS variant, enabled,
      coalesce(nullif(trim(filter_type), ''), 'Include') AS filter_type,
      {TARGET_SQL.format("coalesce(filter_on_value, '')")} AS filter_on_value,
      coalesce(nullif(trim(filter_scope), ''), 'Event') AS filter_scope,
      trim(filter_field) AS filter_field, filter_value, trim(notes) AS notes,
      'advanced' AS source FROM advanced
      WHERE enabled AND upper(trim(variant)) IN ('A', 'B'))
    SELECT listed.* FROM listed JOIN keys ON keys.id = listed.id AND keys.id <> ''
    UNION ALL SELECT * FROM ({' UNION ALL '.join(f'''
      SELECT coalesce(nullif(ident, ''), name) AS id, {simple_sql(v, False)},
        'from Experiments (simple)' AS notes, 'simple' AS source FROM active
      WHERE NOT advanced AND (ident <> '' OR name <> '')''' for v in 'AB')})
    WHERE filter_field <> '' OR filter_value <> ''""",
)
def _(spark, sf_dir):
    return reg.merge_filters(blocks(spark, sf_dir), advanced(spark, sf_dir))


@query(
    "seed_advanced_filters",
    f"""{W}, {ADVANCED_SQL}, wanted AS (SELECT *,
      coalesce(nullif(trim(coalesce(id, '')), ''), trim(experiment_name)) AS ident
      FROM blocks WHERE {FILTERING} AND advanced),
    seeds AS ({' UNION ALL '.join(f'''
      SELECT ident AS id, {simple_sql(v, True)}, 'Seeded from simple filter ('
        || coalesce(nullif(trim(experiment_name), ''), ident) || ')' AS notes,
        'advanced' AS source FROM wanted WHERE ident <> \'\'''' for v in 'AB')})
    SELECT * FROM advanced UNION ALL SELECT seeds.* FROM seeds
    WHERE (filter_field <> '' OR filter_value <> '') AND NOT EXISTS (SELECT 1 FROM advanced a
      WHERE trim(a.id) = seeds.id AND trim(a.variant) = seeds.variant)""",
)
def _(spark, sf_dir):
    return reg.seed_advanced_filters(blocks(spark, sf_dir), advanced(spark, sf_dir))


MEDIA = "trim(analyze_choice) IN ('Yes', 'Update') AND coalesce(id, '') <> ''"


@query(
    "explode_images",
    f"""{W}, lines AS (SELECT {ID_SQL.format('id')} AS id, v.variant, trim(unnest(string_split(
      replace(v.cell, chr(13), ''), chr(10)))) AS u FROM (SELECT *, unnest([
        {{'variant': 'A', 'cell': images_a}}, {{'variant': 'B', 'cell': images_b}}]) AS v
      FROM blocks WHERE {MEDIA}))
    SELECT id, variant, regexp_replace(u, '^https://drive.google.com/file/d/(.+?)/view.*$',
      'https://drive.google.com/uc?id=\\1') AS image_url FROM lines WHERE u <> ''""",
)
def _(spark, sf_dir):
    return reg.explode_images(blocks(spark, sf_dir))


@query(
    "explode_links",
    f"""{W}, lines AS (SELECT {ID_SQL.format('id')} AS id,
      trim(unnest(string_split(links, chr(10)))) AS link FROM blocks WHERE {MEDIA})
    SELECT * FROM lines WHERE link <> ''""",
)
def _(spark, sf_dir):
    return reg.explode_links(blocks(spark, sf_dir))


YES, UPDATE = "lower(trim(analyze_choice)) = 'yes'", "lower(trim(analyze_choice)) = 'update'"


@query(
    "plan_summary",
    f"""{W} SELECT count(*) FILTER ({YES}) AS analyze_count,
    count(*) FILTER ({UPDATE}) AS update_count,
    count(*) FILTER (coalesce(lower(trim(analyze_choice)), '') NOT IN ('yes', 'update'))
      AS status_only_count,
    min(CASE WHEN {YES} THEN least(date_start_a, date_end_a,
      CASE WHEN date_comparison THEN least(date_start_b, date_end_b) END) END) AS date_min,
    max(CASE WHEN {YES} THEN greatest(date_start_a, date_end_a,
      CASE WHEN date_comparison THEN greatest(date_start_b, date_end_b) END) END) AS date_max
    FROM blocks""",
)
def _(spark, sf_dir):
    return agg.plan_summary(blocks(spark, sf_dir))
