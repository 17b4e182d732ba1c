"""Snapshots, runs that add days, chosen shards, and ranks and cost rows of hot keys."""

import datetime as dt
import os
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from abspark.operators import aggregates, attribution
from abspark.plans import state
from abspark.plans.analyze import analyze_specs
from abspark.schemas import REPORT
from abspark.sources import events as scans
from abspark.sources.layouts import layout_for
from abspark.sources.snapshots import ConflictError, Version, current_version, publish, read_version
from abspark.spec import TOOL_NESTED, TOOL_ONE_BAG
from catalog.experiments import END, START, spec, spread
from catalog.views import layout_view


def report_rows(spark, *rows):
    values = [tuple(r.get(f.name) for f in REPORT.fields) for r in rows]
    return spark.createDataFrame(values, REPORT)


def test_second_writer_fails(spark, tmp_path):
    root = str(tmp_path / "report")
    assert current_version(spark, root) == Version(0, ())
    assert read_version(spark, root, REPORT).count() == 0
    day = dt.date(2024, 2, 1)
    one = report_rows(spark, {"id": "1", "experiment_name": "a", "date_last_analyzed": day})
    two = report_rows(spark, {"id": "2", "experiment_name": "b", "date_last_analyzed": day})
    base = publish(one, root, current_version(spark, root), partition_by=("date_last_analyzed",))
    assert base.number == 1
    seen_by_reader = read_version(spark, root, REPORT, base)
    first = publish(two, root, base, append=True, partition_by=("date_last_analyzed",))
    with pytest.raises(ConflictError):
        publish(one, root, base, append=True, partition_by=("date_last_analyzed",))
    assert current_version(spark, root) == first and first.number == 2
    assert sorted(r.id for r in read_version(spark, root, REPORT).collect()) == ["1", "2"]
    assert [r.id for r in seen_by_reader.collect()] == ["1"]
    # The loser starts again from what is current.
    again = publish(one, root, current_version(spark, root))
    assert [r.id for r in read_version(spark, root, REPORT, again).collect()] == ["1"]


def test_merge_into_snapshots(spark, tmp_path):
    from abspark.operators.tables import merge_into_snapshots

    root = str(tmp_path / "report")
    day = dt.date(2024, 2, 1)
    row = lambda i, n: {"id": i, "experiment_name": n, "date_last_analyzed": day}
    merge_into_snapshots(report_rows(spark, row("1", "a"), row("2", "b")), root)
    merge_into_snapshots(report_rows(spark, row("2", "c"), row("3", "d")), root)
    rows = read_version(spark, root, REPORT).collect()
    assert sorted((r.id, r.experiment_name) for r in rows) == [("1", "a"), ("2", "c"), ("3", "d")]


def results(df):
    df = df.withColumns({c: F.round(c, 4) for c in ("total_conversion_value", "total_conversion_sq_value")})
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("tool", [TOOL_ONE_BAG, TOOL_NESTED])
def test_state_and_one_day_equal_the_window(spark, folder, tool, tmp_path):
    """Runs that add days, a new experiment and a longer window give what one run over all
    events gives; a run reads no day it has seen, and a repeated one reads nothing."""
    files = str(tmp_path / "events")
    view = layout_view(spark, folder, tool)
    layout = layout_for(tool, view.schema)
    day = F.expr(layout.day_of_row.replace("row_time", "time"))
    view.withColumn("part", day.cast("string")).write.partitionBy("part").parquet(files)
    layout = layout_for(tool, view.schema)

    def days(first, last):
        """Events of some days only, as files."""
        names = [f"{files}/part={first + dt.timedelta(days=i)}" for i in range((last - first).days + 1)]
        return spark.read.schema(view.schema).parquet(*[n for n in names if os.path.isdir(n)])

    root, specs = str(tmp_path / "state"), spread(tool)
    last = START + (END - START) // 2
    one = state.advance(root, days(START, last), layout, specs[:10], last)
    assert one.number == 1
    assert state.advance(root, days(START, last), layout, specs[:10], last) == one
    # One more day, from that day's events alone.
    next_day = last + dt.timedelta(days=1)
    got = state.analyze_day_by_day(root, days(next_day, next_day), layout, specs[:10], next_day)
    upto = [replace(s, date_end=next_day) for s in specs[:10]]
    named = lambda rows: [r[:4] + r[6:] for r in rows]  # noqa: E731  (without the window's end)
    expected = results(analyze_specs(days(START, next_day), layout, upto))
    assert [r[-4:] for r in results(got)] == [r[-4:] for r in expected]
    # New experiments and a longer window: what is missing is read, and only that.
    more = [replace(s, date_end=END + dt.timedelta(days=2)) for s in specs]
    got = state.analyze_day_by_day(root, days(START, END + dt.timedelta(days=2)), layout, more, END + dt.timedelta(days=2))
    assert results(got) == results(analyze_specs(days(START, END + dt.timedelta(days=2)), layout, more))
    assert named(results(got))


def test_state_of_nothing(spark, folder, tmp_path):
    view = layout_view(spark, folder, TOOL_ONE_BAG)
    layout = layout_for(TOOL_ONE_BAG, view.schema)
    root = str(tmp_path / "state")
    assert state.analyze_day_by_day(root, view, layout, [], END).count() == 0
    early = [spec(TOOL_ONE_BAG, v, date_start=dt.date(2030, 1, 1), date_end=dt.date(2030, 1, 2)) for v in "AB"]
    rows = state.analyze_day_by_day(root, view, layout, early, END).collect()
    assert [(r.user_count, r.conversion_count) for r in rows] == [(0, None), (0, None)]
    assert current_version(spark, root).number == 0


def test_days_not_wanted_are_not_read(spark, tmp_path):
    rows = lambda *days: spark.createDataFrame([(d, f"{d}-{i}") for d in days for i in range(2)], "table_suffix string, e string")
    root = str(tmp_path)
    rows("20240101", "20240102", "20240104").write.partitionBy("table_suffix").parquet(f"{root}/{scans.DAILY_PREFIX}")
    rows("20240102", "20240103", "20240105", "20240106").write.partitionBy("table_suffix").parquet(f"{root}/{scans.FRESH_PREFIX}")
    got = scans.scan_chosen_shards(spark, root, dt.date(2024, 1, 2), dt.date(2024, 1, 5))
    assert sorted({r.table_suffix for r in got.collect()}) == ["20240102", "20240103", "20240104", "20240105"]
    assert got.count() == 8
    # Files opened: two days of either family.
    opened = {re.search(r"(events_\w*)/table_suffix=(\d+)", f).groups() for f in got.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert opened == {(scans.DAILY_PREFIX, "20240102"), (scans.DAILY_PREFIX, "20240104"),
                      (scans.FRESH_PREFIX, "20240103"), (scans.FRESH_PREFIX, "20240105")}
    text = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*table_suffix", text)) == 2


@pytest.mark.parametrize("rank, latest", [(attribution.first_exposure_rank, False), (attribution.last_exposure_rank, True)])
def test_ranks_of_a_hot_key(spark, rank, latest):
    """NULL holds a third of the rows, over ten days: ranks as counted by hand, and no task of
    the numbering has more than twice the rows of the median one."""
    start = dt.datetime(2024, 1, 1)
    n = 30_000
    rows = spark.range(0, n, 1, 4).select(
        F.when(F.col("id") % 3 > 0, (F.col("id") % 5_000).cast("string")).alias("key"),
        (F.lit(start) + F.make_dt_interval(secs=(F.col("id") * 7919) % 864_000)).cast("timestamp").alias("exposure_time"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("variant"),
    )
    rows = rows.unionByName(rows.where("key IS NULL").limit(50))
    ranked = rank(rows)
    expected = {}
    for r in rows.collect():
        expected.setdefault(r.key, []).append((r.exposure_time, r.variant))
    sign = -1 if latest else 1
    for own in expected.values():
        own.sort(key=lambda x: (sign * x[0].timestamp(), x[1]))
    got = {}
    for r in sorted(ranked.collect(), key=lambda r: r.rn):
        got.setdefault(r.key, []).append((r.exposure_time, r.variant))
        assert r.rn == len(got[r.key])
    assert got == expected
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = rank(rows).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 2 and sizes.max() <= 2 * sizes.median()


def test_cost_rows_of_very_many_jobs(spark):
    n = 100_000
    jobs = spark.range(n).select(F.lit("7").alias("id"), F.format_string("job_%09d", "id").alias("job_id"), F.lit(3).alias("bytes_billed"))
    pieces = aggregates.cost_pieces(jobs).orderBy("piece").collect()
    assert [r.piece for r in pieces] == list(range(1, n // aggregates.JOBS_PER_PIECE + 1))
    assert max(len(r.job_ids) for r in pieces) < 1_000_000 and sum(r.bytes_billed for r in pieces) == 3 * n
    price = spark.createDataFrame([(5.0,)], "p double")
    whole = aggregates.query_cost_rollup(jobs, price).first()
    assert whole.job_ids == ", ".join(f"job_{i:09d}" for i in range(n))
    assert whole.total_bytes_billed == 3 * n
