"""All experiments of a registry in one plan.

Shape of the plan, for a table of any size:

* One scan tags rows. A registry row asks for exposures and conversions; rows that ask for
  the same thing share a tag (A and B of an experiment usually differ in the variant
  pattern alone). What a tag asks for is data: a rule in a constant map from event names to
  rules, and one expression evaluates any rule. So the plan grows with the different keys,
  parameters and filter fields that are read, not with the number of experiments, and each
  event looks only at the rules of its own name.
* Tagged rows shrink to (tag, key, variant text) with first and last time and the value
  sum: a hash aggregate over fixed-width buffers with map-side combine, so that a key that
  holds a third of all rows leaves every map task as one row per text. A second, much
  smaller aggregate gives one row per (tag, key), from which every overlap policy is read.
* Once mode needs nothing more: the key's first conversion sits beside its exposure. No
  join, one scan.
* Both modes share that scan, whatever the number of experiments. It is limited to the
  union of the date windows.
* Count-all mode compares each conversion with the exposure of its key, so the units are
  joined to the conversions, summed by time, on (tag, key) with the time test as residual.
  Both come from one aggregate, whose exchange is used twice. Adaptive execution can split a
  hot key of the join over many tasks; nothing is collected per key.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from abspark.functions.scalars import all_of, normalize_path
from abspark.operators.aggregates import sufficient_stats
from abspark.operators.attribution import OVERLAP, post_exposure_join
from abspark.operators.exposures import conversions, label_exposures, select_active
from abspark.schemas import RESULTS
from abspark.sources.layouts import EventLayout, LookupStage, field_type, layout_for, some_match
from abspark.spec import (
    BOTH,
    CONVERSION_SIDE,
    EXCLUDE,
    EXPOSURE_SIDE,
    LAST,
    POLICIES,
    SCOPE_USER,
    TOOL_NESTED,
    ExperimentSpec,
    FilterSpec,
    read_specs,
)

# ---------------------------------------------------------------- which rows can run
def skip_reasons(layout: EventLayout, spec: ExperimentSpec) -> list[str]:
    """Why a registry row cannot be analysed; empty when it can."""
    needed = {
        "date_start": spec.date_start,
        "date_end": spec.date_end,
        "scope": spec.scope,
        "experiment_event_name": spec.experiment_event_name,
        "exp_variant_string": spec.exp_variant_string,
        "conversion_event": spec.conversion_event,
    }
    if layout.needs_variant_parameter and not (
        isinstance(spec.experiment_event_name, str)
        and layout.exposure_event(spec) is None
    ):
        needed["experiment_variant_parameter"] = spec.experiment_variant_parameter
    reasons = [f"missing {name}" for name, value in needed.items() if value is None]
    if spec.user_overlap not in POLICIES:
        reasons.append(f"unknown overlap policy {spec.user_overlap!r}")
    for f in spec.filters:
        sided = f.applies_to(EXPOSURE_SIDE) or f.applies_to(CONVERSION_SIDE)
        if sided and (f.filter_field is None or f.filter_value is None):
            reasons.append("filter without field or value")
        elif sided and (f.filter_scope or "").upper() == "COLUMN":
            if field_type(layout.schema, normalize_path(f.filter_field)) is None:
                reasons.append(f"no column {f.filter_field!r}")
    return reasons or _unbuildable(layout, spec)


def _unbuildable(layout: EventLayout, spec: ExperimentSpec) -> list[str]:
    """Names no expression can be made of, such as a key no JSON path can name. They keep
    their own row from running, not the report of all the others. What rows share is tried
    once for a layout."""
    tries: list[tuple[tuple, Callable]] = [
        (_text_signature(layout, spec), lambda: layout.exposure_text(spec)),
        (_value_signature(spec), lambda: layout.value(spec)),
        *[(_subject_signature(f), lambda f=f: layout.filter_subject(f)) for f in spec.filters],
    ]
    for signature, build in tries:
        if signature not in layout.unbuildable:
            try:
                build()
                layout.unbuildable[signature] = None
            except ValueError as error:
                layout.unbuildable[signature] = str(error)
        if layout.unbuildable[signature] is not None:
            return [layout.unbuildable[signature]]
    return []


def _text_signature(layout: EventLayout, spec: ExperimentSpec) -> tuple:
    by_property = layout.exposure_event(spec) is None and spec.experiment_event_name
    return ("text", by_property, spec.experiment_variant_parameter, spec.user_overlap == BOTH)


def _value_signature(spec: ExperimentSpec) -> tuple:
    return ("value", (spec.experiment_event_value_parameter or "").strip())


def _subject_signature(f: FilterSpec) -> tuple:
    return ("subject", f.filter_scope, f.filter_field)


def active_specs(
    registry: DataFrame, filters: DataFrame | None, tool: str, every_tool: bool
) -> list[ExperimentSpec]:
    return read_specs(select_active(registry, None if every_tool else tool), filters)


# ---------------------------------------------------------------- tags
def _who(spec: ExperimentSpec) -> tuple:
    return (
        spec.by_user, spec.scope == SCOPE_USER, spec.identity, spec.date_start, spec.date_end
    )


def _exposure_signature(layout: EventLayout, spec: ExperimentSpec) -> tuple:
    """Registry rows with equal signature see the same exposure rows. Credit Both looks at
    matching rows only, so there the pattern belongs to it."""
    both = spec.user_overlap == BOTH
    return (
        _who(spec),
        spec.experiment_event_name,
        spec.experiment_variant_parameter,
        spec.side_filters(EXPOSURE_SIDE),
        spec.exp_variant_string if both else None,
        both,
    )


def _conversion_signature(spec: ExperimentSpec) -> tuple:
    return (
        _who(spec),
        spec.conversion_event,
        (spec.experiment_event_value_parameter or "").strip(),
        spec.side_filters(CONVERSION_SIDE),
    )


@dataclass(frozen=True)
class _Tag:
    """One kind of row to pick from the scan: exposures or conversions as a registry row
    (and all rows of equal signature) asks for them."""

    number: int
    spec: ExperimentSpec
    side: str


def _numbers(signatures: Iterable[tuple]) -> dict[tuple, int]:
    return {s: i for i, s in enumerate(dict.fromkeys(signatures))}


class _SharedColumns:
    """Columns several tags use: keys, texts, values, conditions and filter subjects. Those
    of a kind become one array, so that a rule can name its own by a number."""

    def __init__(self, stage: LookupStage) -> None:
        self.arrays: dict[str, list[Column]] = {}
        self._stage = stage
        self._known: dict[tuple, tuple[int, list[tuple]]] = {}
        self._kinds: dict[tuple, str | None] = {}

    def kind(self, f: FilterSpec, layout: EventLayout) -> str | None:
        """Array that holds what the filter looks at; None: it has no effect."""
        signature = _subject_signature(f)
        if signature not in self._kinds:
            subject = layout.filter_subject(f)
            kind = None if subject is None else "items" if subject.of_items else "subject"
            self._kinds[signature] = kind
        return self._kinds[signature]

    def number(self, signature: tuple, build: Callable[[], Column | None]) -> int:
        """Place in the array of its kind (the signature's first part); -1 where there is
        nothing to build."""
        if signature not in self._known:
            before = len(self._stage.asked)
            column = build()
            at = -1
            if column is not None:
                own = self.arrays.setdefault(signature[0], [])
                at = len(own)
                own.append(column)
            self._known[signature] = (at, self._stage.asked[before:])
        at, lookups = self._known[signature]
        self._stage.ask_again(lookups)
        return at

    def columns(self) -> dict[str, Column]:
        return {f"{kind}_array": F.array(*own) for kind, own in self.arrays.items()}


# What the scan has to know about a tag. Numbers below 0: nothing asked for.
_RULE = """struct<tag: int, first_day: date, last_day: date, first_suffix: string,
    last_suffix: string, who: int, key: int, text: int, pattern: string, value: int,
    filters: array<struct<subject: int, items: int, exclude: boolean, pattern: string>>>"""


def _json_literal(value, ddl: str) -> Column:
    """A constant as one literal (folded at planning time)."""
    return F.from_json(F.lit(json.dumps(value, default=str)), ddl)


def _merged_windows(specs: Iterable[ExperimentSpec]) -> list[tuple[dt.date, dt.date]]:
    """The days the rows are about, as few ranges as possible; none in a gap."""
    merged: list[tuple[dt.date, dt.date]] = []
    for start, end in sorted({(s.date_start, s.date_end) for s in specs}):
        if merged and start <= merged[-1][1] + dt.timedelta(days=1):
            merged[-1] = (merged[-1][0], max(merged[-1][1], end))
        else:
            merged.append((start, end))
    return merged


def _tag_rows(
    events: DataFrame, layout: EventLayout, tags: list[_Tag], by_day: bool = False
) -> DataFrame:
    """One output row per (event, tag it satisfies), with the day that windows are tested on
    if asked for.

    Event names and the union of the day windows come first as plain filters, so they reach
    the files; experiments that any event may expose add a test of their own to the names.
    What rules read is computed once per event; then each event is paired with the rules of
    its name, within its own task, and one expression tells which of them it satisfies."""
    stage = LookupStage(layout.event_column)
    staged = layout.staged(stage)
    shared = _SharedColumns(stage)
    of_event: dict[str, list[dict]] = {}
    of_property: dict[str, list[dict]] = {}
    guards: dict[str, Column] = {}
    for tag in tags:
        event = layout.exposure_event(tag.spec) if tag.side == EXPOSURE_SIDE else tag.spec.conversion_event
        stage.on_event(event)
        rule = _rule(tag, staged, shared)
        if event is not None:
            of_event.setdefault(event, []).append(rule)
        else:
            name = tag.spec.experiment_event_name
            of_property.setdefault(name, []).append(rule)
            if name not in guards:
                guards[name] = layout.exposure_guard(tag.spec)

    windows = [layout.in_window(*w) for w in _merged_windows(tag.spec for tag in tags)]
    named = [F.col(layout.event_column).isin(*sorted(of_event))] if of_event else []
    wanted = reduce(lambda a, b: a | b, windows) & reduce(
        lambda a, b: a | b, [*named, *guards.values()]
    )
    rows = events.where(wanted).withColumn(
        "row_time", layout.event_time().cast("timestamp")
    )
    for level in stage.levels():
        rows = rows.withColumns(level)
    rules = _rules_of(F.col(layout.event_column), of_event)
    if of_property:
        rules = F.concat(rules, _rules_of_properties(of_property))
    rows = rows.withColumns(shared.columns()).withColumn("rule", F.explode(rules))
    return rows.where(_satisfied(layout, shared)).selectExpr(
        "rule.tag AS tag",
        "get(key_array, rule.key) AS key",
        _variant_text(shared),
        "row_time AS time",
        "get(value_array, rule.value) AS value" if "value" in shared.arrays else "CAST(NULL AS DOUBLE) AS value",
        *([f"{layout.day_of_row} AS day"] if by_day else []),
    )


def _rule(tag: _Tag, staged: EventLayout, shared: _SharedColumns) -> dict:
    """What a tag asks for, as numbers of shared columns and constants."""
    spec = tag.spec
    rule = {
        "tag": tag.number,
        "first_day": spec.date_start, "last_day": spec.date_end,
        "first_suffix": spec.date_start.strftime("%Y%m%d"),
        "last_suffix": spec.date_end.strftime("%Y%m%d"),
        "key": shared.number(
            ("key", spec.by_user, spec.identity), lambda: staged.grouping_key(spec).cast("string")
        ),
        "who": shared.number(
            ("who", spec.by_user, spec.scope == SCOPE_USER, spec.identity),
            lambda: staged.identity_predicate(spec),
        ),
        "text": -1, "value": -1, "filters": [],
    }
    if tag.side == EXPOSURE_SIDE:
        rule["text"] = shared.number(
            _text_signature(staged, spec), lambda: staged.exposure_text(spec)
        )
        if spec.user_overlap == BOTH:
            rule["pattern"] = spec.exp_variant_string
    else:
        rule["value"] = shared.number(_value_signature(spec), lambda: staged.value(spec))
    for f in spec.side_filters(tag.side):
        kind = shared.kind(f, staged)
        if kind is not None:
            at = shared.number((kind, *_subject_signature(f)), lambda f=f: staged.filter_subject(f).texts)
            rule["filters"].append(
                {"subject": -1, "items": -1, "exclude": f.exclude, "pattern": f.filter_value, kind: at}
            )
    return rule


def _rules_of(name: Column, rules: dict[str, list[dict]]) -> Column:
    """Rules of a name; none for other names."""
    none = F.array().cast(f"array<{_RULE}>")
    if not rules:
        return none
    table = _json_literal(rules, f"map<string, array<{_RULE}>>")
    return F.coalesce(F.element_at(table, name), none)


def _rules_of_properties(rules: dict[str, list[dict]]) -> Column:
    """Rules of all user properties the event carries."""
    keys = F.array_distinct(F.filter(
        F.transform(F.col("user_properties"), lambda p: p["key"]), lambda k: k.isin(*sorted(rules))
    ))
    none = F.array().cast(f"array<{_RULE}>")
    return F.coalesce(F.flatten(F.transform(keys, lambda k: _rules_of(k, rules))), none)


def _satisfied(layout: EventLayout, shared: _SharedColumns) -> Column:
    """Does the event satisfy the rule? Three-valued like the tests it stands for: a filter
    on a missing text is neither true nor false and lets the event drop."""
    parts = [F.expr(layout.rule_window)]
    if "who" in shared.arrays:
        parts.append(F.expr("rule.who < 0 OR get(who_array, rule.who)"))
    if "text" in shared.arrays:
        # Credit Both asks for a match here; all others for any text. Conversions must have
        # a key, as a NULL key never meets an exposure.
        parts.append(F.expr("""CASE WHEN rule.text < 0 THEN get(key_array, rule.key) IS NOT NULL
            WHEN rule.pattern IS NULL THEN get(text_array, rule.text) IS NOT NULL
            ELSE rlike(get(text_array, rule.text), rule.pattern) END"""))
    else:
        parts.append(F.expr("get(key_array, rule.key) IS NOT NULL"))
    kinds = [kind for kind in ("subject", "items") if kind in shared.arrays]
    if kinds:
        parts.append(F.forall(F.col("rule.filters"), lambda f: _kept(f, kinds)))
    return all_of(parts)


def _kept(f: Column, kinds: list[str]) -> Column:
    """One filter of a rule."""
    found = {
        "subject": lambda: F.rlike(F.get(F.col("subject_array"), f["subject"]), f["pattern"]),
        "items": lambda: some_match(F.get(F.col("items_array"), f["items"]), f["pattern"]),
    }
    match = found[kinds[-1]]()
    if len(kinds) == 2:
        match = F.when(f["subject"] >= 0, found["subject"]()).otherwise(match)
    return F.when(f["exclude"], ~match).otherwise(match)


def _variant_text(shared: _SharedColumns) -> str:
    """Text of an exposure; blank under Credit Both, which has looked at it; NULL of a
    conversion."""
    if "text" not in shared.arrays:
        return "CAST(NULL AS STRING) AS variant"
    return """CASE WHEN rule.text < 0 THEN NULL WHEN rule.pattern IS NULL
        THEN get(text_array, rule.text) ELSE '' END AS variant"""


# ---------------------------------------------------------------- per key
def _spans(tagged: DataFrame, *by: str) -> DataFrame:
    """First and last time and value sum per (tag, key, variant text). Conversions are the
    rows without variant text. Spans of parts of the rows can be merged."""
    return tagged.groupBy("tag", "key", "variant", *by).agg(
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
        F.sum("value").alias("value"),
    )


def _merged_spans(spans: DataFrame) -> DataFrame:
    return spans.groupBy("tag", "key", "variant").agg(
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
        F.sum("value").alias("value"),
    )


def _key_summary(spans: DataFrame, policies: set[str]) -> DataFrame:
    """One row per (tag, key): first and last labelled exposure, number of variant texts,
    first conversion and value sum."""
    exposed, converted = F.col("variant").isNotNull(), F.col("variant").isNull()
    age = -F.unix_micros(F.col("last_time").cast("timestamp"))
    newest = F.struct(age.alias("age"), F.col("variant"), F.col("last_time"))
    last = F.min(F.when(exposed, newest))
    return (
        spans.groupBy("tag", "key")
        .agg(
            F.min(F.when(exposed, F.struct("first_time", "variant"))).alias("first"),
            *([last.alias("last")] if LAST in policies else []),
            F.count("variant").alias("texts"),
            F.min(F.when(converted, F.col("first_time"))).alias("conv_time"),
            F.sum(F.when(converted, F.col("value"))).alias("conv_value"),
        )
        .where(F.col("texts") > 0)
    )


# What the per-key step has to know about a registry row.
_ROW_RULES = """struct<r: int, is_last: boolean, one_text: boolean, null_key: boolean,
    strict: boolean, pattern: string, conversion_tag: int>"""


def _row_rules(
    layout: EventLayout,
    specs: list[ExperimentSpec],
    conversion_of: list[int],
) -> list[dict]:
    return [
        {
            "r": r,
            "is_last": s.user_overlap == LAST,
            "one_text": s.user_overlap == EXCLUDE,
            "null_key": layout.allows_null_key(s),
            "strict": layout.strict_after and s.user_overlap != LAST,
            # Credit Both matched in the scan already
            "pattern": None if s.user_overlap == BOTH else s.exp_variant_string,
            "conversion_tag": conversion_of[r],
        }
        for r, s in enumerate(specs)
    ]


def _credited_units(
    summary: DataFrame,
    layout: EventLayout,
    specs: list[ExperimentSpec],
    tag_of: list[int],
    conversion_of: list[int],
) -> DataFrame:
    """One row per (registry row, key it credits), with the exposure time that counts."""
    rules = _row_rules(layout, specs, conversion_of)
    rows_of_tag: list[list[dict]] = [[] for _ in range(max(tag_of) + 1)]
    for rule, tag in zip(rules, tag_of, strict=True):
        rows_of_tag[tag].append(rule)
    table = _json_literal(rows_of_tag, f"array<array<{_ROW_RULES}>>")
    text, time = F.expr("first.variant"), F.expr("first.first_time")
    if any(rule["is_last"] for rule in rules):
        text = F.expr("IF(rule.is_last, last.variant, first.variant)")
        time = F.expr("IF(rule.is_last, last.last_time, first.first_time)")
    credit = F.expr("rule.pattern IS NULL OR rlike(text, rule.pattern)")
    return (
        summary.withColumn("rule", F.explode(F.element_at(table, F.col("tag") + 1)))
        .where("(key IS NOT NULL OR rule.null_key) AND (texts = 1 OR NOT rule.one_text)")
        .withColumn("text", text)
        .where(credit)
        .select(
            "rule.r", "rule.strict", "rule.conversion_tag", "key",
            time.alias("exposure_time"), "conv_time", "conv_value",
        )
    )


def _follows() -> Column:
    """Does the conversion count for this exposure?"""
    return F.expr(
        "conv_time > exposure_time OR (conv_time = exposure_time AND NOT strict)"
    )


def _first_rows(numbers: list[int]) -> dict[int, int]:
    """Place of the first registry row of each number."""
    found: dict[int, int] = {}
    for place, number in enumerate(numbers):
        found.setdefault(number, place)
    return found


# ---------------------------------------------------------------- the two modes
@dataclass(frozen=True)
class _Demand:
    """What a set of registry rows asks the events for. tag_of and conversion_of: numbers
    for each row (-1: its conversions count once and belong to its tag)."""

    tags: list[_Tag]
    conversion_tags: list[_Tag]
    tag_of: list[int]
    conversion_of: list[int]


def _demand(layout: EventLayout, specs: list[ExperimentSpec]) -> _Demand:
    signatures = [
        (_exposure_signature(layout, s), None if s.count_all else _conversion_signature(s))
        for s in specs
    ]
    numbers = _numbers(signatures)
    tag_of = [numbers[s] for s in signatures]
    first_of = _first_rows(tag_of)
    every = _numbers(_conversion_signature(s) for s in specs if s.count_all)
    conversion_of = [every[_conversion_signature(s)] if s.count_all else -1 for s in specs]
    tags = [
        _Tag(n, specs[first_of[n]], side)
        for signature, n in numbers.items()
        for side in (EXPOSURE_SIDE, CONVERSION_SIDE)
        if side == EXPOSURE_SIDE or signature[1] is not None
    ]
    first_of = _first_rows(conversion_of)
    conversion_tags = [_Tag(n, specs[first_of[n]], CONVERSION_SIDE) for n in every.values()]
    return _Demand(tags, conversion_tags, tag_of, conversion_of)


def _spans_and_conversions(
    events: DataFrame, layout: EventLayout, demand: _Demand
) -> tuple[DataFrame, DataFrame | None]:
    """Spans of all tags, and the conversions that count one by one, if there are such. One
    aggregate over one scan holds both: a conversion is a group of its time (so the
    conversions of a hot key go to many tasks), anything else one of its text."""
    if not demand.conversion_tags:
        return _spans(_tag_rows(events, layout, demand.tags)), None
    offset = 1 + max(tag.number for tag in demand.tags)
    shifted = [replace(tag, number=offset + tag.number) for tag in demand.conversion_tags]
    tagged = _tag_rows(events, layout, [*demand.tags, *shifted])
    alone = F.when(F.col("tag") >= offset, F.col("time")).alias("alone")
    held = tagged.groupBy("tag", "key", "variant", alone).agg(
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
        F.count(F.lit(1)).alias("times"),
        F.sum("value").alias("value"),
        F.sum(F.col("value") * F.col("value")).alias("sq_value"),
        F.min("tag").alias("number"),
    )
    # Both uses must be the same plan up to the exchange for it to be shared: they are told
    # apart by an aggregate, which no filter passes, and ask for all columns.
    whole = F.expr("times > 0 AND coalesce(first_time, last_time) IS NOT NULL AND (value IS NULL OR sq_value IS NULL OR NOT isnan(value) OR isnan(sq_value))")
    spans = held.where((F.col("number") < offset) & whole)
    each = held.where((F.col("number") >= offset) & whole).select(
        (F.col("number") - offset).alias("tag"), F.col("key").alias("conv_key"),
        F.col("first_time").alias("time"), "times", "value", "sq_value",
    )
    return spans.select("tag", "key", "variant", "first_time", "last_time", "value"), each


def _parts(
    spans: DataFrame,
    conversion_rows: DataFrame | None,
    layout: EventLayout,
    specs: list[ExperimentSpec],
    demand: _Demand,
) -> DataFrame:
    """Rows (r, unit, conv_count, conv_value, conv_sq_value) whose sums are the results, from
    the spans of all tags and the conversions that count one by one, if there are such."""
    summary = _key_summary(spans, {s.user_overlap for s in specs})
    units = _credited_units(summary, layout, specs, demand.tag_of, demand.conversion_of)
    counted = _follows()
    parts = units.select(
        "r",
        F.lit(1).alias("unit"),
        F.when(counted, F.lit(1)).cast("long").alias("conv_count"),
        F.when(counted, F.col("conv_value")).alias("conv_value"),
        F.when(counted, F.col("conv_value") * F.col("conv_value")).alias("conv_sq_value"),
    )
    if conversion_rows is None:
        return parts
    # Conversions have no NULL keys, so the null-safe test equals the plain one. It keeps
    # a NULL-key filter from being pushed into this use of the units only, and the tests
    # for absent sums, true of every such unit, keep both uses the same columns: both share
    # one exchange.
    same_key = F.expr("conversion_tag = tag AND key <=> conv_key")
    later = F.expr("time > exposure_time OR (time = exposure_time AND NOT strict)")
    joined = (
        units.where("conversion_tag >= 0 AND conv_time IS NULL AND conv_value IS NULL")
        .select("r", "strict", "conversion_tag", "key", "exposure_time")
        .join(conversion_rows, same_key)
        .where(later)
    )
    return parts.unionByName(
        joined.select(
            "r", F.col("times").alias("conv_count"), F.col("value").alias("conv_value"),
            F.col("sq_value").alias("conv_sq_value"),
        ),
        allowMissingColumns=True,
    )


def _sum_up(parts: DataFrame, specs: list[ExperimentSpec]) -> DataFrame:
    """Results rows. Every registry row enters the sum once with nothing, so
    that a row without a single unit reports 0 users."""
    all_rows = parts.sparkSession.range(len(specs)).selectExpr("CAST(id AS INT) AS r")
    sums = (
        parts.unionByName(all_rows, allowMissingColumns=True)
        .groupBy("r")
        .agg(
            F.count("unit").alias("user_count"),
            F.sum("conv_count").alias("conversion_count"),
            F.sum("conv_value").alias("total_conversion_value"),
            F.sum("conv_sq_value").alias("total_conversion_sq_value"),
        )
    )
    described = [f for f in RESULTS.fields if f.name not in sums.columns]
    table = _json_literal(
        [{f.name: getattr(s, f.name) for f in described} for s in specs],
        f"array<{StructType(described).simpleString()}>",
    )
    return sums.withColumn("row", F.element_at(table, F.col("r") + 1)).select(
        *[f.name if f.name in sums.columns else f"row.{f.name}" for f in RESULTS.fields]
    )


def analyze_specs(
    events: DataFrame, layout: EventLayout, specs: list[ExperimentSpec]
) -> DataFrame:
    """Results of the given registry rows; rows that cannot run are left out."""
    runnable = [s for s in specs if not skip_reasons(layout, s)]
    if not runnable:
        return events.sparkSession.createDataFrame([], RESULTS)
    demand = _demand(layout, runnable)
    spans, each = _spans_and_conversions(events, layout, demand)
    return _sum_up(_parts(spans, each, layout, runnable, demand), runnable)


def analyze(
    registry: DataFrame,
    filters: DataFrame | None,
    events: DataFrame,
    source: str,
    strict_reference: bool = False,
) -> DataFrame:
    """One results row per active (id, variant) of the source's tool.

    ``source`` is the analytics-tool label of the event table. With ``strict_reference``
    the nested layout takes active rows of every tool, as its original job does."""
    layout = layout_for(source, events.schema)
    every_tool = strict_reference and source == TOOL_NESTED
    return analyze_specs(
        events, layout, active_specs(registry, filters, source, every_tool)
    )


def specs_by_tool(
    registry: DataFrame,
    filters: DataFrame | None,
    tools: Iterable[str],
    strict_reference: bool = False,
) -> dict[str, list[ExperimentSpec]]:
    """Active registry rows of each tool; registry and filters are read once."""
    every = read_specs(select_active(registry), filters)
    return {
        tool: [
            s for s in every
            if s.analytics_tool == tool or strict_reference and tool == TOOL_NESTED
        ]
        for tool in tools
    }


def analyze_all(
    registry: DataFrame,
    filters: DataFrame | None,
    events: Mapping[str, DataFrame],
    strict_reference: bool = False,
) -> DataFrame:
    """Results over several event tables, one per analytics tool."""
    specs = specs_by_tool(registry, filters, events, strict_reference)
    return reduce(
        DataFrame.unionByName,
        [
            analyze_specs(df, layout_for(tool, df.schema), specs[tool])
            for tool, df in events.items()
        ],
    )


def skipped_rows(
    registry: DataFrame,
    filters: DataFrame | None,
    events: DataFrame,
    source: str,
) -> list[tuple[str, str, list[str]]]:
    """(id, variant, reasons) of active registry rows that ``analyze`` leaves out."""
    layout = layout_for(source, events.schema)
    return [
        (s.id, s.variant, reasons)
        for s in active_specs(registry, filters, source, False)
        if (reasons := skip_reasons(layout, s))
    ]


def skipped_in_report(
    registry: DataFrame,
    filters: DataFrame | None,
    events: Mapping[str, DataFrame],
    strict_reference: bool = False,
) -> list[tuple[str, str, str, list[str]]]:
    """(tool, id, variant, reasons) of active rows that a report over these tables leaves
    out."""
    specs = specs_by_tool(registry, filters, events, strict_reference)
    return [
        (tool, s.id, s.variant, reasons)
        for tool, df in events.items()
        for s in specs[tool]
        if (reasons := skip_reasons(layout_for(tool, df.schema), s))
    ]


# ---------------------------------------------------------------- one row, step by step
def analyze_one(
    events: DataFrame, layout: EventLayout, spec: ExperimentSpec
) -> DataFrame:
    """The same numbers for a single registry row, written as separate operators:
    exposures, overlap policy, conversions, join, sums. Readable and checked equal to the
    shared plan, but it scans the events once per side."""
    exposures = label_exposures(events, layout, spec)
    units = OVERLAP[spec.user_overlap](exposures, spec.exp_variant_string)
    if not layout.allows_null_key(spec):
        units = units.where(F.col("key").isNotNull())
    strict = layout.strict_after and spec.user_overlap != LAST
    joined = post_exposure_join(units, conversions(events, layout, spec), strict)
    return sufficient_stats(units, joined)

