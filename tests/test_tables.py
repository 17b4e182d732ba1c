"""Registry, report and lookup tables on small literal frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from abspark.functions import scalars
from abspark.operators import discovery, lookups, tables
from abspark.operators import registry as reg
from abspark.plans.analyze import analyze, skipped_rows
from abspark.plans.report import build_report, run_report
from abspark.schemas import EXPERIMENTS, EXPERIMENTS_STAGE, FILTERS, REPORT
from abspark.spec import TOOL_NESTED, TOOL_ONE_BAG, TOOL_TWO_BAG


def one(spark, column, *values, schema):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema)
            .select(column).collect()]


def test_ids_are_padded_but_never_cut(spark):
    got = one(spark, reg.normalize_id(F.col("v")), "1", " 7 ", "007", "12", "123", "0", "x1",
              "", None, schema="v STRING")
    assert got == ["01", "07", "07", "12", "123", "00", "x1", "", ""]


def test_confidence_cell(spark):
    got = one(spark, reg.normalize_confidence_input(F.col("v")), "0.95", "95%", "95", "x",
              schema="v STRING")
    assert got == [95.0, 95.0, 95.0, None]


def test_text_helpers(spark):
    def text(x, schema="v DOUBLE"):
        return one(spark, scalars.float_text(F.col("v")), x, schema=schema)[0]

    assert [text(x) for x in (25.0, 0.5, 1e7, 12345678.25, 1.5e-4, -3.0)] == [
        "25", "0.5", "10000000", "12345678.25", "0.00015", "-3"
    ]
    assert [text(float(x)) for x in ("inf", "-inf", "nan")] == ["inf", "-inf", "nan"]
    sizes = one(spark, scalars.format_bytes(F.col("v")), None, 0, 1, 1023, 1024, 1536,
                1024**3, 5 * 1024**4 + 1, schema="v BIGINT")
    assert sizes == ["0 B", "0 B", "1 B", "1023 B", "1 KB", "1.5 KB", "1 GB", "5 TB"]
    trimmed = one(spark, scalars.full_trim(F.col("v")), "\t a b \n", " x　",
                  schema="v STRING")
    assert trimmed == ["a b", "x"]
    numbers = one(spark, scalars.to_double(F.col("v")), "1.0d", "1.5", " 2 ", "1e3", ".5", "x",
                  "inf", schema="v STRING")
    assert numbers == [None, 1.5, 2.0, 1000.0, 0.5, None, float("inf")]


def test_json_scalars(spark):
    bag = '{"a":{"b":"x","c.d":1},"s":"{no}","l":[1],"n":null,"f":1.0}'
    df = spark.createDataFrame([(bag,)], "bag STRING")
    row = df.select(
        *[scalars.json_scalar(F.col("bag"), p).alias(p.replace(".", "_"))
          for p in ("a", "a.b", "s", "l", "n", "f", "c.d")]
    ).first()
    assert tuple(row) == (None, "x", "{no}", None, None, "1.0", None)


def test_previous_period_and_default_window(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 1), dt.date(2024, 3, 7))], "a DATE, b DATE")
    before = df.select(reg.previous_period(F.col("a"), F.col("b")).alias("p")).first().p
    assert tuple(before) == (dt.date(2024, 2, 23), dt.date(2024, 2, 29))
    window = df.select(reg.default_window(dt.date(2024, 3, 20)).alias("w")).first().w
    assert tuple(window) == (dt.date(2024, 3, 5), dt.date(2024, 3, 19))


def test_lookback():
    today = dt.date(2024, 1, 10)
    assert discovery.lookback_window(3, today) == (dt.date(2024, 1, 7), dt.date(2024, 1, 9))
    assert discovery.lookback_window(0, today) == (dt.date(2024, 1, 9), dt.date(2024, 1, 9))
    assert discovery.days_from_text("3 Last Days") == 3
    assert discovery.days_from_text("none") == 2
    assert discovery.days_from_text("0 days") == 1


def test_exclusion_list():
    assert discovery.parse_exclusion_list("\"a, 'b' ,, c\"") == ["a", "b", "c"]
    assert discovery.parse_exclusion_list(None) == []


def test_json_keys_in_odd_texts(spark):
    texts = ['{"a\\"b": "x:y", "n": {"m": [1, 2]}, "t": true, "z": null}', "not json", None]
    df = spark.createDataFrame([(t,) for t in texts], "bag STRING")
    keys = {r.name for r in discovery.discover_json_keys(df, "bag", F.lit(True)).collect()}
    assert keys == {'a\\"b', "n", "m", "t", "z"}
    hits = {r.name: r.non_string_hits
            for r in discovery.json_nonstring_hits(df, "bag", F.lit(True)).collect()}
    assert hits == {"n": 1, "m": 1, "t": 1}


# ---------------------------------------------------------------- table maintenance
def stage_row(ident, variant, mode, name, **cells):
    values = {
        "id": ident, "variant": variant, "export_mode": mode, "experiment_name": name,
        "analyze_test": mode == "ANALYZE", "scope": "User", **cells,
    }
    return tuple(values.get(c) for c in EXPERIMENTS_STAGE.fieldNames())


def test_upsert_registry(spark):
    old = [stage_row(i, "A", None, "old", analyze_test=True, scope="Session")
           for i in ("01", "02", "03", "04")]
    target = spark.createDataFrame(old, EXPERIMENTS_STAGE).select(*EXPERIMENTS.fieldNames())
    stage = spark.createDataFrame(
        [
            stage_row("01", "A", "ANALYZE", "new"), stage_row("02", "A", "update ", "new"),
            stage_row("03", "A", "STATUS_ONLY", "new"), stage_row("05", "A", "ANALYZE", "new"),
            stage_row("06", "A", "UPDATE", "new"), stage_row("", "A", "ANALYZE", "new"),
            stage_row("07", "C", "ANALYZE", "new"),
        ],
        EXPERIMENTS_STAGE,
    )
    got = {
        r.id: (r.experiment_name, r.analyze_test, r.scope)
        for r in tables.upsert_registry(target, stage).collect()
    }
    assert got == {
        "01": ("new", True, "User"), "02": ("new", False, "Session"),
        "03": ("old", False, "Session"), "04": ("old", True, "Session"),
        "05": ("new", True, "User"),
    }


def test_upsert_report_rejects_duplicates(spark):
    target = spark.createDataFrame([("1", 1)], "id STRING, x INT")
    source = spark.createDataFrame([("2", 1), ("2", 2)], "id STRING, x INT")
    with pytest.raises(Exception, match="more than one row for 2"):
        tables.upsert_report(target, source).collect()


def test_removed_filters_disappear(spark):
    target = spark.createDataFrame([("1", "f"), ("2", "g")], "id STRING, filter_field STRING")
    ids = spark.createDataFrame([("1",)], "id STRING")
    empty = target.limit(0)
    left = tables.replace_filters(target, ids, empty).collect()
    assert [tuple(r) for r in left] == [("2", "g")]


def test_delete_takes_numeric_ids_only(spark):
    target = spark.createDataFrame([("01",), ("name",)], "id STRING")
    left = tables.delete_experiments({"t": target}, ["1", "name"])["t"].collect()
    assert [r.id for r in left] == ["name"]


def test_stage_files_keep_texts(spark, tmp_path):
    row = stage_row("01", "A", " update", 'a "quoted", name\nwith a line')
    path = str(tmp_path / "stage")
    tables.write_stage(spark.createDataFrame([row], EXPERIMENTS_STAGE), path)
    assert [tuple(r) for r in tables.load_registry(spark, path).collect()] == [row]


def test_stage_files_are_bounded(spark, tmp_path):
    """A task reads a whole file, so a large partition is written as several."""
    path, n = tmp_path / "stage", 2 * tables.ROWS_PER_FILE + 1
    cells = {"id": "CAST(id AS STRING)", "description": "'two\\nlines'"}
    rows = spark.range(0, n, numPartitions=1).selectExpr(
        *[
            f"{cells.get(f.name, 'NULL')} :: {f.dataType.simpleString()} AS {f.name}"
            for f in EXPERIMENTS_STAGE.fields
        ]
    )
    tables.write_stage(rows, str(path))
    assert len(list(path.glob("part-*.csv"))) == 3
    back = tables.load_registry(spark, str(path))
    assert back.select("id").distinct().count() == back.where("description = 'two\\nlines'").count() == n


def test_report_snapshot(spark, tmp_path):
    values = {"id": "01", "test_a": 3, "date_last_analyzed": dt.date(2024, 1, 1)}
    report = spark.createDataFrame([tuple(values.get(c) for c in REPORT.fieldNames())], REPORT)
    path = str(tmp_path / "report")
    tables.write_report(report, path)
    back = tables.read_report(spark, path)
    assert back.schema.simpleString() == REPORT.simpleString()
    assert back.collect() == report.collect()


def test_orders(spark):
    rows = [("9", True, 1), ("10", True, 1), ("x", True, 1), ("11", False, 9)]
    df = spark.createDataFrame(
        [(i, a, dt.date(2024, 1, d), dt.date(2024, 1, d)) for i, a, d in rows],
        "id STRING, analyze_test BOOLEAN, date_last_analyzed DATE, date_end DATE",
    )
    assert [r.id for r in df.orderBy(*lookups.results_order()).collect()] == [
        "10", "9", "x", "11"
    ]
    info = spark.createDataFrame([("1", 1), ("2", 1), ("1", 2)], "id STRING, execution_time INT")
    ordered = info.orderBy(*lookups.query_info_order()).collect()
    assert [(r.id, r.execution_time) for r in ordered] == [("1", 2), ("2", 1), ("1", 1)]


def test_lookup_lists(spark):
    df = spark.createDataFrame([("b", "USER"), (" a ", "USER"), ("z", "EVENT"), ("", "EVENT")],
                               "name STRING, scope STRING")
    merged = lookups.merge_lookup_lists(df, df)
    assert [tuple(r) for r in merged.collect()] == [("z", "EVENT"), ("a", "USER"), ("b", "USER")]
    listed = lookups.lookup_table(merged, ["name"])
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "TakeOrderedAndProject" not in plan
    assert [r.name for r in listed.collect()] == ["a", "b", "z"]


# ---------------------------------------------------------------- report rows
def registry_row(ident, variant, **cells):
    values = dict(
        id=ident, variant=variant, date_start=dt.date(2024, 1, 1),
        date_end=dt.date(2024, 1, 1), experiment_name="e", conversion_event="buy",
        conversion_count_all=False, exp_variant_string=f"^{variant}$", analyze_test=True,
        event_value_test=True, hypothesis="Two-sided", confidence=95, scope="User",
        identity_source="DEVICE_ID", experiment_event_name="see",
        experiment_variant_parameter="variant", experiment_event_value_parameter="value",
        user_overlap="First Exposure", analytics_tool=TOOL_ONE_BAG, date_comparison=False,
    )
    values.update(cells)
    return tuple(values.get(c) for c in EXPERIMENTS.fieldNames())


@pytest.fixture(scope="module")
def events(spark):
    day = dt.datetime(2024, 1, 1)
    rows = []
    for v in "AB":
        for i in range(40):
            rows.append((day, "see", f"{v}{i}", None, f'{{"variant":"{v}"}}'))
            if i < (4 if v == "A" else 24):
                rows.append((day + dt.timedelta(hours=1), "buy", f"{v}{i}", None,
                             '{"value":%d}' % (i + 1)))
    return spark.createDataFrame(
        rows, "time TIMESTAMP, event_name STRING, distinct_id STRING, user_id STRING, "
        "properties STRING")


def report_of(spark, events, rows, filters=None):
    registry = spark.createDataFrame(rows, EXPERIMENTS)
    return run_report(registry, filters, {TOOL_ONE_BAG: events}, dt.date(2024, 2, 1))


def test_report_row(spark, events):
    row = report_of(spark, events, [registry_row("1", "A"), registry_row("1", "B")]).first()
    assert (row.test_a, row.conversion_a, row.test_b, row.conversion_b) == (40, 4, 40, 24)
    assert row.conv_significance == "SIGNIFICANT"
    assert row.conv_details == "Variant B is better than Variant A by 500%."
    assert row.mean_value_a == 2.5 and row.mean_value_b == 12.5
    assert row.value_significance == "SIGNIFICANT"
    assert row.value_details == "Variant B is 400% better than Variant A."
    assert row.conversions_counting_mode == "Once per User"
    assert row.date_last_analyzed == dt.date(2024, 2, 1)


def test_report_of_one_sided_experiment(spark, events):
    """Nobody in one arm: the row stays, without test results."""
    row = report_of(
        spark, events,
        [registry_row("1", "A"), registry_row("1", "B", exp_variant_string="^nobody$")],
    ).first()
    assert (row.test_b, row.conversion_b) == (0, 0)
    assert row.conv_significance is None and row.conv_p_value is None
    assert row.value_details == "Not tested"


def test_significant_value_without_text_reads_not_tested(spark):
    ab = spark.createDataFrame(
        [("1", 100, 50, 100, 50, 0.0, 100.0, 10.0, 210.0, 95.0, "Two-sided", True,
          "Once per User")],
        "id STRING, test_a BIGINT, conversion_a BIGINT, test_b BIGINT, conversion_b BIGINT, "
        "total_conversion_value_a DOUBLE, total_conversion_value_b DOUBLE, "
        "total_conversion_sq_value_a DOUBLE, total_conversion_sq_value_b DOUBLE, "
        "confidence_level DOUBLE, hypothesis STRING, event_value_test BOOLEAN, "
        "conversions_counting_mode STRING",
    )
    for name in ("date_start", "date_end", "experiment_name", "conversion_event", "scope",
                 "identity_source", "analyze_test", "user_overlap", "date_comparison"):
        ab = ab.withColumn(name, F.lit(None).cast(REPORT[name].dataType))
    row = build_report(ab, dt.date(2024, 2, 1)).first()
    assert row.value_significance == "SIGNIFICANT"
    assert row.value_details == "Not tested"  # the loser's mean is 0, so there is no lift


def test_disabled_filters_and_other_tools(spark, events):
    rows = [registry_row("1", "A"), registry_row("2", "A", analytics_tool=TOOL_TWO_BAG)]
    registry = spark.createDataFrame(rows, EXPERIMENTS)
    filters = spark.createDataFrame(
        [("1", "A", False, "Include", "Both", "Event", "x", "y", None, "advanced")], FILTERS)
    got = analyze(registry, filters, events, TOOL_ONE_BAG).collect()
    assert [(r.id, r.user_count) for r in got] == [("1", 40)]


def test_strict_reference_takes_every_tool(spark):
    value = ("struct<string_value:string,int_value:bigint,float_value:double,"
             "double_value:double>")
    params = f"array<struct<key:string,value:{value}>>"
    nested = spark.createDataFrame(
        [], f"table_suffix string, event_timestamp bigint, event_name string, user_pseudo_id "
        f"string, user_id string, event_params {params}, user_properties {params}")
    registry = spark.createDataFrame(
        [registry_row("1", "A"), registry_row("2", "A", analytics_tool=TOOL_NESTED)],
        EXPERIMENTS)
    own = analyze(registry, None, nested, TOOL_NESTED).collect()
    every = analyze(registry, None, nested, TOOL_NESTED, strict_reference=True).collect()
    assert [r.id for r in own] == ["2"] and [r.id for r in every] == ["1", "2"]


def test_skipped_rows_are_reported(spark, events):
    registry = spark.createDataFrame(
        [registry_row("1", "A", user_overlap="?"), registry_row("1", "B")], EXPERIMENTS)
    assert [(i, v) for i, v, _why in skipped_rows(registry, None, events, TOOL_ONE_BAG)] == [
        ("1", "A")
    ]
