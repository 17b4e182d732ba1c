"""The report pipeline over results derived from ``lineitem``, and over the events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from abspark.operators import aggregates as agg
from abspark.operators import lookups, tables
from abspark.operators.exposures import select_active
from abspark.plans import report as rep
from abspark.schemas import EXPERIMENTS, FILTERS, REPORT
from abspark.sources.snapshots import read_version
from abspark.spec import TOOL_ONE_BAG, FilterSpec
from catalog.experiments import results_sql, spec, spread
from catalog.registry import placed, query, scratch_folder
from catalog.stats_queries import (
    HYPOTHESIS,
    LEVEL,
    lift_sql,
    phi_sql,
    side_p_sql,
)
from catalog.views import layout_view, table

RUN_DATE = dt.date(2024, 2, 1)

# ---------------------------------------------------------------- derived results
# Every part is an experiment; open lines are variant A, finished ones B.
RESULTS_SQL = """
res AS (SELECT CAST(l_partkey AS VARCHAR) AS id,
    CASE l_linestatus WHEN 'O' THEN 'A' ELSE 'B' END AS variant,
    CASE WHEN l_partkey % 5 = 0 AND l_linestatus = 'F' THEN 'signup' ELSE 'purchase' END
      AS conversion_event,
    CASE WHEN l_partkey % 2 = 0 THEN 'User' ELSE 'Session' END AS scope,
    CAST(min(l_shipdate) AS DATE) AS date_start, CAST(max(l_shipdate) AS DATE) AS date_end,
    count(*) AS user_count,
    nullif(count(*) FILTER (l_returnflag = 'R'), 0) AS conversion_count,
    sum(l_quantity) FILTER (l_returnflag = 'R') AS total_conversion_value,
    sum(l_quantity * l_quantity) FILTER (l_returnflag = 'R') AS total_conversion_sq_value
  FROM lineitem GROUP BY l_partkey, l_linestatus)
"""
REGISTRY_SQL = f"""
reg AS (SELECT CAST(id AS VARCHAR) AS id, variant, name AS experiment_name,
    'DEVICE_ID' AS identity_source,
    CAST(CASE id % 3 WHEN 0 THEN 50 WHEN 1 THEN 80 ELSE 95 END AS DOUBLE) AS confidence_level,
    {HYPOTHESIS} AS hypothesis, id % 2 = 0 AS event_value_test, id % 10 <> 9 AS analyze_test,
    'First Exposure' AS user_overlap, id % 7 = 0 AS date_comparison,
    id % 3 = 0 AS conversion_count_all
  FROM (SELECT p_partkey AS id, p_name AS name, unnest(['A', 'B']) AS variant FROM part))
"""


def pivot_sql(results: str, registry: str) -> str:
    """Results and registry to one row per experiment."""
    sums = ", ".join(
        f"sum(CASE WHEN variant = '{v}' THEN {column} ELSE 0 END)::{kind} AS {name}_{v.lower()}"
        for name, column, kind in (
            ("test", "user_count", "BIGINT"),
            ("conversion", "conversion_count", "BIGINT"),
            ("total_conversion_value", "total_conversion_value", "DOUBLE"),
            ("total_conversion_sq_value", "total_conversion_sq_value", "DOUBLE"),
        )
        for v in "AB"
    )
    return f"""{results}, {registry},
joined AS (SELECT res.*, reg.* EXCLUDE (id, variant) FROM res
  JOIN reg ON res.id = reg.id AND res.variant = reg.variant WHERE reg.analyze_test),
ab AS (SELECT * EXCLUDE (name_a, name_b), CASE WHEN name_a IS NULL THEN name_b
    WHEN name_b IS NULL OR name_a = name_b THEN name_a
    ELSE name_a || ' / ' || name_b END AS conversion_event
  FROM (SELECT id, experiment_name, scope, confidence_level, hypothesis, event_value_test,
    analyze_test, user_overlap, date_comparison, identity_source,
    CASE WHEN conversion_count_all THEN 'Once per Event' WHEN scope = 'User'
      THEN 'Once per User' ELSE 'Once per Session' END AS conversions_counting_mode,
    min(date_start) AS date_start, max(date_end) AS date_end, {sums},
    max(CASE WHEN variant = 'A' THEN conversion_event END) AS name_a,
    max(CASE WHEN variant = 'B' THEN conversion_event END) AS name_b
  FROM joined GROUP BY ALL))
"""


RATE_MODE = "conversions_counting_mode = 'Once per Event'"
OK_PROPORTION = f"""(NOT {RATE_MODE} AND test_a > 0 AND test_b > 0
    AND conversion_a BETWEEN 0 AND test_a AND conversion_b BETWEEN 0 AND test_b)"""
OK_RATE = f"({RATE_MODE} AND test_a > 0 AND test_b > 0)"


def verdict(p: str, rate_a: str, rate_b: str, words: tuple, digits: int) -> str:
    """Text of a significant result; ``words`` are the texts around the lift."""
    ahead_a, ahead_b, tail_a, tail_b = words
    return f"""WHEN {p} < alpha AND {rate_b} > {rate_a} THEN '{ahead_b}'
        || {lift_sql(rate_b, rate_a, digits)} || '{tail_b}'
      WHEN {p} < alpha AND {rate_a} > {rate_b} THEN '{ahead_a}'
        || {lift_sql(rate_a, rate_b, digits)} || '{tail_a}'"""


def tests_sql(results: str, registry: str) -> str:
    """Adds proportion (p_*), rate (r_*) and value (v_*) test columns."""
    two_sided = f"2 * (1 - ({phi_sql('abs(z)')}))"
    one_sided = f"1 - ({phi_sql('z')})"
    level = LEVEL.replace("confidence", "confidence_level")
    return f"""WITH {pivot_sql(results, registry)},
p1 AS (SELECT id, hypothesis, confidence_level, conversion_a / test_a AS ra,
    conversion_b / test_b AS rb, (conversion_a + conversion_b) / (test_a + test_b) AS pool,
    test_a AS na, test_b AS nb FROM ab WHERE {OK_PROPORTION}),
p2 AS (SELECT *, 1 - confidence_level / 100 AS alpha, CASE WHEN pool > 0 AND pool < 1 THEN
    (rb - ra) / sqrt(pool * (1 - pool) * (1.0 / na + 1.0 / nb)) END AS z FROM p1),
p3 AS (SELECT *, CASE WHEN hypothesis = 'One-sided' THEN {one_sided} ELSE {two_sided} END AS p
  FROM p2),
proportions AS (SELECT id, ra AS rate_a, rb AS rate_b, z AS z_val, p AS p_val,
    CASE WHEN p < alpha THEN 'SIGNIFICANT' ELSE 'NOT_SIGNIFICANT' END AS significance,
    CASE {verdict('p', 'ra', 'rb', ('Variant A is better than Variant B by ',
         'Variant B is better than Variant A by ', '%.', '%.'), 2)}
      ELSE 'No significant difference.' END AS details FROM p3),
r1 AS (SELECT id, hypothesis, 1 - {level} AS alpha, conversion_a::DOUBLE AS xa,
    conversion_b::DOUBLE AS xb, test_a AS na, test_b AS nb, conversion_a / test_a AS ra,
    conversion_b / test_b AS rb FROM ab WHERE {OK_RATE}),
r2 AS (SELECT *, CASE WHEN xa > 0 AND xb > 0 THEN ln(rb / ra) / sqrt(1 / xa + 1 / xb)
    WHEN ra / na + rb / nb > 0 THEN (rb - ra) / sqrt(ra / na + rb / nb) END AS z FROM r1),
r3 AS (SELECT *, {side_p_sql('z')} AS p FROM r2),
rates AS (SELECT id, ra AS rate_a, rb AS rate_b, z AS z_val, p AS p_val,
    CASE WHEN z IS NULL THEN 'NOT_EVALUATED' WHEN p < alpha THEN 'SIGNIFICANT'
      ELSE 'NOT_SIGNIFICANT' END AS significance,
    CASE WHEN z IS NULL THEN 'Insufficient information to evaluate.'
      {verdict('p', 'ra', 'rb', ('Variant A has ', 'Variant B has ',
       '% higher Event Rate per unit than B.', '% higher Event Rate per unit than A.'), 1)}
      WHEN p < alpha THEN 'No difference.'
      ELSE 'No significant difference.' END AS details FROM r3),
moments AS (SELECT id, hypothesis, confidence_level, conversion_a AS n_a_value,
    conversion_b AS n_b_value, total_conversion_value_a / conversion_a AS mean_value_a,
    total_conversion_value_b / conversion_b AS mean_value_b,
    (total_conversion_sq_value_a - total_conversion_value_a * total_conversion_value_a
      / conversion_a) / nullif(conversion_a - 1, 0) AS var_value_a,
    (total_conversion_sq_value_b - total_conversion_value_b * total_conversion_value_b
      / conversion_b) / nullif(conversion_b - 1, 0) AS var_value_b
  FROM ab WHERE event_value_test AND conversion_a > 0 AND conversion_b > 0),
v1 AS (SELECT *, 1 - {level} AS alpha, mean_value_a AS ma, mean_value_b AS mb,
    CASE WHEN var_value_a IS NOT NULL THEN greatest(var_value_a, 0) / n_a_value END AS ea,
    CASE WHEN var_value_b IS NOT NULL THEN greatest(var_value_b, 0) / n_b_value END AS eb
  FROM moments),
v2 AS (SELECT *, CASE WHEN ea + eb > 0 THEN (mb - ma) / sqrt(ea + eb) END AS t FROM v1),
v3 AS (SELECT *, {side_p_sql('t')} AS p FROM v2),
values_ AS (SELECT id, ma AS metric_a, mb AS metric_b, t AS stat, p AS p_value,
    CASE WHEN t IS NULL THEN 'NOT_EVALUATED' WHEN p < alpha THEN 'SIGNIFICANT'
      ELSE 'NOT_SIGNIFICANT' END AS significance,
    CASE WHEN t IS NULL THEN 'Insufficient information.'
      {verdict('p', 'ma', 'mb', ('Variant A is ', 'Variant B is ',
       '% better than Variant B.', '% better than Variant A.'), 1)}
      WHEN p < alpha THEN 'No difference.'
      ELSE 'No significant difference.' END AS details FROM v3),
report AS (SELECT ab.id, date_start, date_end, experiment_name, conversion_event, scope,
    identity_source, ab.hypothesis, ab.confidence_level, analyze_test, user_overlap, test_a,
    conversion_a, test_b, conversion_b,
    round(coalesce(p.rate_a, r.rate_a), 6) AS conv_rate_a,
    round(coalesce(p.rate_b, r.rate_b), 6) AS conv_rate_b,
    round(coalesce(p.z_val, r.z_val), 6) AS conv_z_score,
    round(coalesce(p.p_val, r.p_val), 6) AS conv_p_value,
    coalesce(p.significance, r.significance) AS conv_significance,
    coalesce(p.details, r.details) AS conv_details, conversions_counting_mode,
    round(v.metric_a, 6) AS mean_value_a, round(v.metric_b, 6) AS mean_value_b,
    round(v.stat, 6) AS t_value, round(v.p_value, 6) AS value_p_value,
    v.significance AS value_significance, coalesce(v.details, 'Not tested') AS value_details,
    DATE '{RUN_DATE}' AS date_last_analyzed, date_comparison
  FROM ab LEFT JOIN proportions p ON p.id = ab.id LEFT JOIN rates r ON r.id = ab.id
  LEFT JOIN values_ v ON v.id = ab.id)
"""


TESTS = tests_sql(RESULTS_SQL, REGISTRY_SQL)
PIVOT = f"WITH {pivot_sql(RESULTS_SQL, REGISTRY_SQL)}"


def derived_results(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    q, part = F.col("l_quantity"), F.col("l_partkey")
    returned = F.col("l_returnflag") == "R"
    finished = F.col("l_linestatus") == "F"
    return (
        lines.groupBy(part, "l_linestatus")
        .agg(
            F.min("l_shipdate").cast("date").alias("date_start"),
            F.max("l_shipdate").cast("date").alias("date_end"),
            F.count("*").alias("user_count"),
            F.nullif(F.count_if(returned), F.lit(0)).alias("conversion_count"),
            F.sum(F.when(returned, q)).alias("total_conversion_value"),
            F.sum(F.when(returned, q * q)).alias("total_conversion_sq_value"),
        )
        .select(
            part.cast("string").alias("id"),
            F.when(finished, "B").otherwise("A").alias("variant"),
            F.when((part % 5 == 0) & finished, "signup").otherwise("purchase").alias(
                "conversion_event"
            ),
            F.when(part % 2 == 0, "User").otherwise("Session").alias("scope"),
            "date_start", "date_end", "user_count", "conversion_count",
            "total_conversion_value", "total_conversion_sq_value",
        )
    )


def derived_registry(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "string(p_partkey) AS id",
        "explode(array('A', 'B')) AS variant",
        "p_name AS experiment_name",
        "'DEVICE_ID' AS identity_source",
        "bigint(CASE p_partkey % 3 WHEN 0 THEN 50 WHEN 1 THEN 80 ELSE 95 END) AS confidence",
        f"{HYPOTHESIS.replace('CASE id', 'CASE p_partkey')} AS hypothesis",
        "p_partkey % 2 = 0 AS event_value_test",
        "p_partkey % 10 <> 9 AS analyze_test",
        "'First Exposure' AS user_overlap",
        "p_partkey % 7 = 0 AS date_comparison",
        "p_partkey % 3 = 0 AS conversion_count_all",
        "CASE p_partkey % 4 WHEN 0 THEN 'MIXPANEL' ELSE 'AMPLITUDE' END AS analytics_tool",
    )


def joined(spark, sf_dir):
    return agg.results_to_registry(
        derived_results(spark, sf_dir), derived_registry(spark, sf_dir)
    )


def ab(spark, sf_dir):
    return agg.pivot_ab(joined(spark, sf_dir))


def round_doubles(df, digits=6):
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


@query(
    "select_active",
    f"""WITH {REGISTRY_SQL} SELECT id, variant FROM reg
    WHERE analyze_test AND CAST(id AS BIGINT) % 4 = 0""",
)
def _(spark, sf_dir):
    return select_active(derived_registry(spark, sf_dir), TOOL_ONE_BAG).select("id", "variant")


@query(
    "results_to_registry",
    f"{PIVOT} SELECT * RENAME (user_overlap AS registry_overlap) FROM joined",
)
def _(spark, sf_dir):
    return joined(spark, sf_dir)


@query("pivot_ab", f"{PIVOT} SELECT * FROM ab")
def _(spark, sf_dir):
    return ab(spark, sf_dir)


@query("merge_conversion_event_names", f"{PIVOT} SELECT id, conversion_event FROM ab")
def _(spark, sf_dir):
    rows = joined(spark, sf_dir)

    def name(v):
        return F.max(F.when(F.col("variant") == v, F.col("conversion_event")))

    names = rows.groupBy("id").agg(name("A").alias("a"), name("B").alias("b"))
    merged = agg.merge_conversion_event_names(F.col("a"), F.col("b"))
    return names.select("id", merged.alias("conversion_event"))


@query(
    "counting_mode",
    f"{PIVOT} SELECT conversions_counting_mode, scope, count(*) AS n FROM ab GROUP BY ALL",
)
def _(spark, sf_dir):
    mode = agg.counting_mode(F.col("conversion_count_all"), F.col("scope"))
    rows = joined(spark, sf_dir).select("id", "scope", mode.alias("conversions_counting_mode"))
    per_id = rows.groupBy("id", "scope", "conversions_counting_mode").agg(F.count("*"))
    return per_id.groupBy("conversions_counting_mode", "scope").agg(F.count("*").alias("n"))


@query(
    "value_moments",
    f"""{TESTS} SELECT id, hypothesis, confidence_level, n_a_value, n_b_value,
    round(mean_value_a, 6) AS mean_value_a, round(mean_value_b, 6) AS mean_value_b,
    round(var_value_a, 6) AS var_value_a, round(var_value_b, 6) AS var_value_b
    FROM moments""",
)
def _(spark, sf_dir):
    return round_doubles(agg.value_moments(ab(spark, sf_dir)))


@query("valid_for_proportions", f"{PIVOT} SELECT id, {OK_PROPORTION} AS ok FROM ab")
def _(spark, sf_dir):
    return ab(spark, sf_dir).select("id", rep.valid_for_proportions().alias("ok"))


@query("valid_for_rates", f"{PIVOT} SELECT id, {OK_RATE} AS ok FROM ab")
def _(spark, sf_dir):
    return ab(spark, sf_dir).select("id", rep.valid_for_rates().alias("ok"))


TEST_COLUMNS = """id, round(rate_a, 6) AS rate_a, round(rate_b, 6) AS rate_b,
    round(z_val, 6) AS z_val, round(p_val, 6) AS p_val, significance, details"""


@query("test_proportions", f"{TESTS} SELECT {TEST_COLUMNS} FROM proportions")
def _(spark, sf_dir):
    tested = rep.test_proportions(ab(spark, sf_dir)).where("proportion IS NOT NULL")
    return round_doubles(tested.select("id", "proportion.*"))


@query("test_rates", f"{TESTS} SELECT {TEST_COLUMNS} FROM rates")
def _(spark, sf_dir):
    tested = rep.test_rates(ab(spark, sf_dir)).where("rate IS NOT NULL")
    return round_doubles(tested.select("id", "rate.*"))


@query(
    "test_values",
    f"""{TESTS} SELECT id, round(metric_a, 6) AS metric_a, round(metric_b, 6) AS metric_b,
    round(stat, 6) AS stat, round(p_value, 6) AS p_value, significance, details
    FROM values_""",
)
def _(spark, sf_dir):
    tested = rep.test_values(agg.value_moments(ab(spark, sf_dir)))
    return round_doubles(tested.select("id", "welch.*").drop("df"))


CONV_COLUMNS = [
    "id", "conv_rate_a", "conv_rate_b", "conv_z_score", "conv_p_value",
    "conv_significance", "conv_details",
]


@query("attach_stats", f"{TESTS} SELECT {', '.join(CONV_COLUMNS)} FROM report")
def _(spark, sf_dir):
    return round_doubles(rep.attach_stats(ab(spark, sf_dir)).select(*CONV_COLUMNS))


VALUE_COLUMNS = [
    "id", "mean_value_a", "mean_value_b", "t_value", "value_p_value",
    "value_significance", "value_details",
]


@query("attach_value_test", f"{TESTS} SELECT {', '.join(VALUE_COLUMNS)} FROM report")
def _(spark, sf_dir):
    return round_doubles(rep.with_value_test(ab(spark, sf_dir)).select(*VALUE_COLUMNS))


def derived_report(spark, sf_dir):
    return rep.build_report(ab(spark, sf_dir), RUN_DATE)


@query("build_report", f"{TESTS} SELECT * FROM report")
def _(spark, sf_dir):
    return round_doubles(derived_report(spark, sf_dir))


@query("merge_into_snapshots", f"{TESTS} SELECT * FROM report")
def _(spark, sf_dir):
    """An older report without some experiments and with other names, then the whole one
    merged in; read back through the manifest."""
    folder = scratch_folder(spark)
    report = derived_report(spark, sf_dir)
    older = report.where("CAST(id AS BIGINT) % 3 <> 0").withColumn("experiment_name", F.lit("old"))
    tables.merge_into_snapshots(older, folder)
    tables.merge_into_snapshots(report, folder)
    return round_doubles(read_version(spark, folder, REPORT))


# ---------------------------------------------------------------- from the events
def event_specs():
    """Registry rows of the flagship report: every policy and mode, with filters on one."""
    rows = spread(TOOL_ONE_BAG)
    filtered = FilterSpec("Exclude", "Conversion Event", "Event", "info.plan", "p3")
    for v in "AB":
        rows.append(spec(TOOL_ONE_BAG, v, id="20", filters=(filtered,)))
    return rows


def registry_frames(spark, specs, tool):
    """The registry and filter tables these specs come from."""
    rows = []
    for s in specs:
        values = {name: getattr(s, name, None) for name in EXPERIMENTS.fieldNames()}
        values.update(
            experiment_name=f"Experiment {s.id}",
            date_comparison=False,
            analyze_test=True,
            event_value_test=True,
            hypothesis="Two-sided" if int(s.id) % 2 else "One-sided",
            confidence=80,
            analytics_tool=tool,
        )
        rows.append(tuple(values[name] for name in EXPERIMENTS.fieldNames()))
    filters = [
        (s.id, s.variant, True, f.filter_type, f.filter_on_value, f.filter_scope,
         f.filter_field, f.filter_value, None, "advanced")
        for s in specs
        for f in s.filters
    ]
    return spark.createDataFrame(rows, EXPERIMENTS), spark.createDataFrame(filters, FILTERS)


def event_report_sql(tool, specs):
    plain = [s for s in specs if not s.filters]
    special = [s for s in specs if s.filters]
    results = results_sql(tool, plain)
    for s in special:
        results += "\nUNION ALL\n" + results_sql(
            tool, [s], conversion_extra="NOT regexp_matches(plan, 'p3')"
        )
    registry = f"""reg AS (SELECT id, variant, 'Experiment ' || id AS experiment_name,
      identity AS identity_source, 80.0::DOUBLE AS confidence_level,
      CASE WHEN CAST(id AS INT) % 2 = 1 THEN 'Two-sided' ELSE 'One-sided' END AS hypothesis,
      TRUE AS event_value_test, TRUE AS analyze_test, overlap AS user_overlap,
      FALSE AS date_comparison, count_all AS conversion_count_all
      FROM (VALUES {', '.join(
          f"('{s.id}', '{s.variant}', '{s.identity_source}', '{s.user_overlap}', {s.count_all})"
          for s in specs)}) AS t(id, variant, identity, overlap, count_all))"""
    res = f"res AS (SELECT * EXCLUDE (user_overlap) FROM ({results}))"
    return tests_sql(res, registry)


EVENT_SPECS = event_specs()


# The sums of values depend on the order of addition in their last digits, so the value
# columns are compared at four decimals.
@query(
    "run_report",
    event_report_sql(TOOL_ONE_BAG, EVENT_SPECS)
    + """SELECT * REPLACE (round(mean_value_a, 4) AS mean_value_a,
      round(mean_value_b, 4) AS mean_value_b, round(t_value, 4) AS t_value,
      round(value_p_value, 4) AS value_p_value) FROM report""",
)
def _(spark, sf_dir):
    registry, filters = registry_frames(spark, EVENT_SPECS, TOOL_ONE_BAG)
    events = {TOOL_ONE_BAG: layout_view(spark, sf_dir, TOOL_ONE_BAG)}
    report = round_doubles(rep.run_report(registry, filters, events, RUN_DATE))
    four = ["mean_value_a", "mean_value_b", "t_value", "value_p_value"]
    return report.withColumns({c: F.round(c, 4) for c in four})


# ---------------------------------------------------------------- views, orders
@query(
    "report_view",
    f"""{TESTS} SELECT id, CASE WHEN date_comparison THEN '✔' ELSE '' END
      AS date_comparison_shown, CAST(date_start AS VARCHAR) || ' - '
      || CAST(date_end AS VARCHAR) AS date_period, id || '. ' || experiment_name
      AS id_experiment_name FROM report""",
)
def _(spark, sf_dir):
    return lookups.report_view(derived_report(spark, sf_dir)).select(
        "id", "date_comparison_shown", "date_period", "id_experiment_name"
    )


@query(
    "registry_view",
    r"""SELECT p_partkey, 'first' || chr(10) || p_name AS description_shown,
    CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS value_parameter_shown FROM part""",
)
def _(spark, sf_dir):
    registry = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.lit("first\\n"), "p_name").alias("description"),
        (F.col("p_size") % 2 == 0).alias("event_value_test"),
        F.col("p_type").alias("experiment_event_value_parameter"),
    )
    return lookups.registry_view(registry).select(
        "p_partkey", "description_shown", "value_parameter_shown"
    )


@query(
    "report_search",
    f"{TESTS} SELECT id, experiment_name FROM report WHERE experiment_name ILIKE '%ED WID%'",
)
def _(spark, sf_dir):
    found = lookups.report_search(derived_report(spark, sf_dir), "ED Wid")
    return found.select("id", "experiment_name")


@query(
    "download_results",
    f"""{TESTS} SELECT id, experiment_name, date_last_analyzed, date_start, date_end, hypothesis,
    confidence_level, analyze_test, user_overlap, conversion_event, conv_significance,
    conv_details, value_significance, value_details, scope, identity_source, test_a,
    conversion_a, test_b, conversion_b, conv_rate_a, conv_rate_b, conv_z_score, conv_p_value,
    mean_value_a, mean_value_b, t_value, value_p_value, row_number() OVER (ORDER BY analyze_test DESC
    NULLS LAST, date_last_analyzed DESC, CAST(id AS BIGINT) DESC, date_end DESC) AS place FROM report""",
)
def _(spark, sf_dir):
    return round_doubles(placed(lookups.download_results(derived_report(spark, sf_dir))))
