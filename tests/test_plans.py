"""What the plans look like, and that they hold under skew and many experiments."""

import datetime as dt
import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from abspark.plans import analyze as plan
from abspark.sources.events import read_shards, scan_sharded_events
from abspark.sources.layouts import layout_for
from abspark.spec import EXCLUDE, FIRST, POLICIES, TOOL_NESTED, TOOL_ONE_BAG
from catalog.experiments import spec, spread
from catalog.views import layout_view


def final_plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def event_scans(text):
    return sum("FileScan" in line and "events.parquet" in line for line in text.splitlines())


@pytest.fixture(scope="module")
def one_bag(spark, folder):
    events = layout_view(spark, folder, TOOL_ONE_BAG)
    return events, layout_for(TOOL_ONE_BAG, events.schema)


def pair(**changes):
    return [spec(TOOL_ONE_BAG, v, **changes) for v in "AB"]


@pytest.mark.parametrize("experiments", [1, 10])
def test_once_mode_reads_the_events_once_without_a_join(one_bag, experiments):
    events, layout = one_bag
    specs = [
        s
        for i in range(experiments)
        for s in pair(id=str(i), user_overlap=POLICIES[i % 4])
    ]
    text = final_plan(plan.analyze_specs(events, layout, specs))
    assert event_scans(text) == 1
    assert "Join" not in text
    assert "Python" not in text


def test_filters_reach_the_files(one_bag):
    events, layout = one_bag
    printed = io.StringIO()
    with redirect_stdout(printed):
        plan.analyze_specs(events, layout, pair()).explain("formatted")
    pushed = re.search(r"PushedFilters: \[(.*)\]", printed.getvalue()).group(1)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed
    assert "In(event_type" in pushed


def test_count_all_mode_reads_the_events_once(one_bag):
    events, layout = one_bag
    both = [*pair(conversion_count_all=True), *pair(id="2"), *pair(id="3", conversion_count_all=True, user_overlap=EXCLUDE)]
    for specs in (pair(conversion_count_all=True), both):
        text = final_plan(plan.analyze_specs(events, layout, specs))
        assert event_scans(text) == 1
        assert "ReusedExchange" in text


def test_first_aggregate_is_a_hash_aggregate(one_bag):
    events, layout = one_bag
    text = final_plan(plan.analyze_specs(events, layout, pair()))
    per_variant = [l for l in text.splitlines() if re.search(r"keys=\[tag#\d+, key#\d+, variant", l)]
    assert per_variant and all("HashAggregate" in l for l in per_variant)


def test_generated_code_stays_compilable(spark, one_bag):
    """The JVM does not compile methods beyond 8000 bytes."""
    events, layout = one_bag
    specs = [
        s
        for i in range(10)
        for s in pair(id=str(i), user_overlap=POLICIES[i % 4],
                      scope="Session" if i % 3 else "User")
    ]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        printed = io.StringIO()
        with redirect_stdout(printed):
            plan.analyze_specs(events, layout, specs).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", printed.getvalue())]
    assert sizes and max(sizes) < 8000


def many_different(count, count_all):
    """Experiments that agree in nothing: windows, filters and value parameters differ."""
    from abspark.spec import FilterSpec

    day = dt.date(2024, 1, 1)
    return [
        spec(
            TOOL_ONE_BAG, variant, id=str(i), conversion_count_all=count_all and i % 2 == 0,
            date_start=day + dt.timedelta(days=i % 20), date_end=day + dt.timedelta(days=i % 20 + i % 7),
            filters=(FilterSpec("Include", "Both", "Event", "k", f"^{i}"),),
        )
        for i in range(count)
        for variant in "AB"
    ]


@pytest.mark.parametrize("count_all", [False, True])
def test_scans_do_not_grow_with_the_registry(one_bag, count_all):
    events, layout = one_bag
    results = plan.analyze_specs(events, layout, many_different(100, count_all))
    assert event_scans(final_plan(results)) == 1


def test_one_odd_row_does_not_stop_the_others(one_bag):
    from abspark.spec import FilterSpec

    events, layout = one_bag
    good = [spec(TOOL_ONE_BAG, v) for v in "AB"]
    odd = [
        spec(TOOL_ONE_BAG, "A", id="odd", filters=(FilterSpec("Include", "Both", "Event", "a'\"b", "x"),)),
        spec(TOOL_ONE_BAG, "A", id="gone", filters=(FilterSpec("Include", "Both", "Column", "not.there", "x"),)),
    ]
    assert all(plan.skip_reasons(layout, s) for s in odd)
    results = plan.analyze_specs(events, layout, good + odd).collect()
    assert sorted(r["variant"] for r in results) == ["A", "B"]


def test_gaps_between_windows_are_not_read(spark, one_bag):
    events, layout = one_bag
    apart = [
        spec(TOOL_ONE_BAG, "A", id=str(m), date_start=dt.date(2024, m, 1), date_end=dt.date(2024, m, 2))
        for m in (1, 12)
    ]
    assert plan._merged_windows(apart) == [(s.date_start, s.date_end) for s in apart]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan.analyze_specs(events, layout, apart)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = text[text.index("PushedFilters") :].split("]")[0]
    assert "Or(" in pushed and "2024-01-03" in pushed and "2024-12-01" in pushed


def test_one_key_with_most_rows(spark):
    """A key that holds most events: the numbers are right, in both modes."""
    day = dt.date(2024, 1, 5)
    start = dt.datetime(2024, 1, 5)
    n = 20000
    events = spark.range(n).select(
        (F.lit(start) + F.make_dt_interval(secs=F.col("id"))).cast("timestamp").alias("time"),
        F.when(F.col("id") % 2 == 0, "view").otherwise("purchase").alias("event_name"),
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.col("id").cast("string")).alias(
            "distinct_id"
        ),
        F.lit(None).cast("string").alias("user_id"),
        F.lit('{"variant":"control","value":1}').alias("properties"),
    )
    layout = layout_for(TOOL_ONE_BAG, events.schema)
    base = spec(TOOL_ONE_BAG, date_start=day, date_end=day)
    from dataclasses import replace

    got = plan.analyze_specs(
        events, layout, [base, replace(base, conversion_count_all=True)]
    ).collect()
    numbers = sorted((r.user_count, r.conversion_count, r.total_conversion_value) for r in got)
    units = 1 + n // 10  # hot, and one unit per other view (ids ending in 8)
    assert numbers == [(units, 1, n * 0.4), (units, n * 4 // 10, n * 0.4)]


def test_hot_key_is_split_in_the_join(spark):
    """Conversions of one key that fills a partition are spread over several tasks."""
    start = dt.datetime(2024, 1, 5)
    events = spark.range(0, 200000, 1, 16).select(
        (F.lit(start) + F.make_dt_interval(secs=F.col("id") % 80000)).cast("timestamp").alias(
            "time"
        ),
        F.when(F.col("id") % 50 == 0, "view").otherwise("purchase").alias("event_name"),
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.col("id").cast("string")).alias(
            "distinct_id"
        ),
        F.lit(None).cast("string").alias("user_id"),
        F.lit('{"variant":"control","value":1}').alias("properties"),
    )
    layout = layout_for(TOOL_ONE_BAG, events.schema)
    day = dt.date(2024, 1, 5)
    s = spec(TOOL_ONE_BAG, date_start=day, date_end=day, conversion_count_all=True)
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        text = final_plan(plan.analyze_specs(events, layout, [s]))
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert "SortMergeJoin(skew=true)" in text


def test_exposed_units_properties(one_bag):
    """Excluded units are among the first-exposure ones, and all are exposed."""
    from abspark.operators.attribution import OVERLAP
    from abspark.operators.exposures import label_exposures
    from abspark.spec import BOTH, LAST

    events, layout = one_bag
    exposures = label_exposures(events, layout, spec(TOOL_ONE_BAG))
    keys = {
        policy: {r.key for r in OVERLAP[policy](exposures, "^control$").collect()}
        for policy in POLICIES
    }
    exposed = {r.key for r in exposures.select("key").distinct().collect()}
    assert keys[FIRST] | keys[LAST] <= exposed
    assert keys[EXCLUDE] <= keys[FIRST] <= keys[BOTH]


def test_window_form_equals_aggregate_form(one_bag):
    from abspark.operators import attribution as att
    from abspark.operators.exposures import label_exposures

    events, layout = one_bag
    exposures = label_exposures(events, layout, spec(TOOL_ONE_BAG))
    for rank, overlap in (
        (att.first_exposure_rank, att.overlap_first_exposure),
        (att.last_exposure_rank, att.overlap_last_exposure),
    ):
        ranked = rank(exposures).where("rn = 1 AND variant RLIKE '^control$'")
        left = set(ranked.select("key", "exposure_time").collect())
        assert left == set(overlap(exposures, "^control$").collect())
    assert set(att.exclude_join(exposures, "^control$").collect()) == set(
        att.overlap_exclude(exposures, "^control$").collect()
    )


def test_shard_folders_are_pruned(spark, folder, tmp_path):
    events = layout_view(spark, folder, TOOL_NESTED)
    path = str(tmp_path / "shards")
    events.write.partitionBy("table_suffix").parquet(path)
    shards = read_shards(spark, path)
    window = (dt.date(2024, 1, 3), dt.date(2024, 1, 5))
    scanned = scan_sharded_events(shards, *window)
    assert sorted(r[0] for r in scanned.select("table_suffix").distinct().collect()) == [
        "20240103", "20240104", "20240105"
    ]
    assert scanned.count() == scan_sharded_events(events, *window).count()
    text = final_plan(scanned.select("event_name"))
    assert re.search(r"PartitionFilters: \[.*20240103", text)
    layout = layout_for(TOOL_NESTED, shards.schema)
    specs = [spec(TOOL_NESTED, v) for v in "AB"]
    from_files = plan.analyze_specs(shards, layout, specs).collect()
    assert [r.user_count for r in from_files] == [
        r.user_count for r in plan.analyze_specs(events, layout, specs).collect()
    ]


def plan_text(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plan_does_not_grow_with_the_registry(one_bag):
    """Rules are data: ten times the experiments give the same plan, but for constants."""
    from abspark.spec import FilterSpec

    events, layout = one_bag
    day = dt.date(2024, 1, 1)

    def shape(count):
        specs = [
            spec(TOOL_ONE_BAG, v, id=str(i), user_overlap=POLICIES[i % 4], date_start=day,
                 date_end=day + dt.timedelta(days=i % 9), exp_variant_string=f"{v}{i}",
                 experiment_event_value_parameter="value" if i % 2 else "k",
                 filters=(FilterSpec("Include", "Both", "Event", "k", f"^{i}"),))
            for i in range(count)
            for v in "AB"
        ]
        text = plan_text(plan.analyze_specs(events, layout, specs))
        words = re.sub(r"\{.*?\}|\[.*?\]", "", re.sub(r"#\d+L?", "", text))
        return len(words.splitlines()), text.count("CASE WHEN")

    assert shape(8) == shape(80)


@pytest.mark.parametrize("tool", ["AMPLITUDE", "MIXPANEL"])
def test_a_bag_is_parsed_once_for_all_paths(spark, folder, tool):
    from abspark.spec import FilterSpec

    events = layout_view(spark, folder, tool)
    layout = layout_for(tool, events.schema)

    def parses(paths):
        specs = [
            spec(tool, v, id=p, experiment_variant_parameter=p, experiment_event_value_parameter=p + "v",
                 filters=(FilterSpec("Include", "Both", "Event", p + "f", "x"), FilterSpec("Exclude", "Both", "User", p + "g", "x")))
            for p in paths
            for v in "AB"
        ]
        return plan_text(plan.analyze_specs(events, layout, specs)).count("parseJson")

    few, many = parses("a"), parses("abcdefgh")
    assert 1 <= few == many <= 2


def test_rules_of_properties_and_names_together(spark, folder):
    """Exposures of any event beside those of named ones, under every filter kind."""
    from abspark.spec import FilterSpec

    events = layout_view(spark, folder, TOOL_NESTED)
    layout = layout_for(TOOL_NESTED, events.schema)
    filters = [
        (), (FilterSpec("Include", "Both", "Event", "k", "1"),), (FilterSpec("Exclude", "Both", "Column", "items.item_id", "1"),),
        (FilterSpec("Exclude", "Both", "Event", "k", "1"), FilterSpec("Include", "Both", "Column", "items.item_id", "[0-9]")),
    ]
    specs = [
        spec(TOOL_NESTED, v, id=f"{i}{name}", filters=own, user_overlap=POLICIES[i], experiment_event_name=name or spec(TOOL_NESTED).experiment_event_name)
        for i, own in enumerate(filters) for v in "AB" for name in ("", "firebase_exp_1")
    ]
    together = {(r.id, r.variant): (r.user_count, r.conversion_count) for r in plan.analyze_specs(events, layout, specs).collect()}
    for s in specs:
        alone = plan.analyze_one(events, layout, s).first()
        assert together[(s.id, s.variant)] == (alone.user_count, alone.conversion_count)
    assert any(users for users, _ in together.values())
