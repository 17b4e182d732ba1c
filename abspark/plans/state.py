"""R1 run by run: what the analysis needs of each day is kept, so a run reads new days only.

Per day and per thing experiments ask for (an exposure or conversion rule without its
window), the state holds what the analysis reduces the events of the day to: first and last
time and value sum of each key and variant text and, for experiments that count every
conversion, the conversions of a key summed by time. Both can be merged over days, so any
window is a sum of its days: windows may be extended, and experiments added, at any time. A day
is read again only for rules that have not seen it, which a row per (day, rule) tells.

The state is a table of snapshots: a run appends a part and publishes it, so one that fails
leaves no trace, and of two runs at once the slower one fails (``ConflictError``).
"""

from __future__ import annotations

import datetime as dt
import hashlib
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructType, TimestampType

from abspark.plans.analyze import (
    _conversion_signature,
    _demand,
    _exposure_signature,
    _json_literal,
    _merged_spans,
    _parts,
    _spans,
    _sum_up,
    _Tag,
    _tag_rows,
    skip_reasons,
)
from abspark.schemas import RESULTS
from abspark.sources.layouts import EventLayout
from abspark.sources.snapshots import Version, current_version, publish, read_version
from abspark.spec import CONVERSION_SIDE, EXPOSURE_SIDE, ExperimentSpec

# kind: 'seen' (the rule has read the day), 'span' or 'each' (conversions one by one).
STATE = (
    StructType()
    .add("rule", StringType()).add("kind", StringType()).add("key", StringType()).add("variant", StringType())
    .add("first_time", TimestampType()).add("last_time", TimestampType())
    .add("times", LongType()).add("value", DoubleType()).add("sq_value", DoubleType())
    .add("day", DateType())
)
ANY_DAY = dt.date(1970, 1, 1)


def rule_names(layout: EventLayout, spec: ExperimentSpec) -> dict[str, str]:
    """Names of what a registry row asks for, by side. They hold over runs and windows."""
    always = replace(spec, date_start=ANY_DAY, date_end=ANY_DAY)
    kind = "each" if spec.count_all else "span"
    asked = {
        EXPOSURE_SIDE: ("span", _exposure_signature(layout, always)),
        CONVERSION_SIDE: (kind, _conversion_signature(always)),
    }
    return {
        side: f"{kind}-" + hashlib.sha256(repr((layout.tool, side, signature)).encode()).hexdigest()[:32]
        for side, (kind, signature) in asked.items()
    }


def _days(first: dt.date, last: dt.date) -> list[dt.date]:
    return [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]


def _missing(
    seen: dict[str, set[dt.date]], layout: EventLayout, specs: list[ExperimentSpec], upto: dt.date
) -> list[tuple[str, ExperimentSpec, str]]:
    """(rule, registry row with a window of days to read, side)."""
    todo = {}
    for s in specs:
        for side, name in rule_names(layout, s).items():
            want = set(_days(s.date_start, min(s.date_end, upto))) - seen.get(name, set())
            _, _, days = todo.setdefault(name, (s, side, set()))
            days.update(want)
    ranges = []
    for name, (s, side, days) in todo.items():
        run: list[dt.date] = []
        for day in [*sorted(days), None]:
            if run and (day is None or day != run[-1] + dt.timedelta(days=1)):
                ranges.append((name, replace(s, date_start=run[0], date_end=run[-1]), side))
                run = []
            if day is not None:
                run.append(day)
    return ranges


def advance(
    root: str, events: DataFrame, layout: EventLayout, specs: list[ExperimentSpec], upto: dt.date
) -> Version:
    """Read the days up to ``upto`` (the last complete one) that rules have not seen, and
    publish what they hold. Days and rules of the state reach the driver: configuration times
    days, no events."""
    spark = events.sparkSession
    base = current_version(spark, root)
    state = read_version(spark, root, STATE, base)
    seen: dict[str, set[dt.date]] = {}
    for r in state.where("kind = 'seen'").select("rule", "day").distinct().collect():
        seen.setdefault(r["rule"], set()).add(r["day"])
    specs = [s for s in specs if not skip_reasons(layout, s)]
    ranges = _missing(seen, layout, specs, upto)
    if not ranges:
        return base
    names = [name for name, _, _ in ranges]
    marks = [
        {"rule": name, "day": day}
        for name, s, _ in ranges
        for day in _days(s.date_start, s.date_end)
    ]
    listed = _json_literal(marks, "array<struct<rule: string, day: date>>")
    rows = spark.range(1).select(F.inline(listed)).withColumn("kind", F.lit("seen"))
    for kind in ("span", "each"):
        tags = [_Tag(n, s, side) for n, (name, s, side) in enumerate(ranges) if name.startswith(kind)]
        if not tags:
            continue
        tagged = _tag_rows(events, layout, tags, by_day=True)
        if kind == "span":
            held = _spans(tagged, "day").withColumn("times", F.lit(None).cast("long"))
        else:
            held = tagged.groupBy("tag", "key", F.col("time").alias("first_time"), "day").agg(
                F.count("*").alias("times"), F.sum("value").alias("value"),
                F.sum(F.col("value") * F.col("value")).alias("sq_value"),
            )
        name = F.element_at(_json_literal(names, "array<string>"), F.col("tag") + 1)
        held = held.withColumn("rule", name).withColumn("kind", F.lit(kind)).drop("tag")
        rows = rows.unionByName(held, allowMissingColumns=True)
    parts = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in STATE.fields]
    return publish(rows.select(*parts), root, base, append=True, partition_by=("day",))


def analyze_state(
    state: DataFrame, layout: EventLayout, specs: list[ExperimentSpec]
) -> DataFrame:
    """Results of the registry rows from the state alone; the same as over the events of the
    days it has seen. Days outside all windows are not read."""
    specs = [s for s in specs if not skip_reasons(layout, s)]
    if not specs:
        return state.sparkSession.createDataFrame([], RESULTS)
    demand = _demand(layout, specs)
    spans = _of_tags(state.where("kind = 'span'"), layout, demand.tags)
    each = None
    if demand.conversion_tags:
        kept = _of_tags(state.where("kind = 'each'"), layout, demand.conversion_tags)
        each = kept.select("tag", F.col("key").alias("conv_key"), F.col("first_time").alias("time"), "times", "value", "sq_value")
    return _sum_up(_parts(_merged_spans(spans), each, layout, specs, demand), specs)


def _of_tags(state: DataFrame, layout: EventLayout, tags: list[_Tag]) -> DataFrame:
    """State rows of the days of each tag, with its number. A rule can serve several tags,
    whose windows differ."""
    table: dict[str, list[dict]] = {}
    for tag in tags:
        name = rule_names(layout, tag.spec)[tag.side]
        table.setdefault(name, []).append(
            {"tag": tag.number, "first_day": tag.spec.date_start, "last_day": tag.spec.date_end}
        )
    kind = "map<string, array<struct<tag: int, first_day: date, last_day: date>>>"
    first = min(t.spec.date_start for t in tags)
    last = max(t.spec.date_end for t in tags)
    return (
        state.where(F.col("day").between(F.lit(first), F.lit(last)))
        .withColumn("of", F.explode(F.element_at(_json_literal(table, kind), F.col("rule"))))
        .where("day BETWEEN of.first_day AND of.last_day")
        .select("of.tag", "key", "variant", "first_time", "last_time", "times", "value", "sq_value")
    )


def analyze_day_by_day(
    root: str, events: DataFrame, layout: EventLayout, specs: list[ExperimentSpec], upto: dt.date
) -> DataFrame:
    """A run: take up the days that are new, then report from the state."""
    version = advance(root, events, layout, specs, upto)
    return analyze_state(read_version(events.sparkSession, root, STATE, version), layout, specs)
