"""The four event-table layouts, each giving the same expressions over its own columns.

A layout answers, for one registry row: which key groups a unit, which rows may take part,
what the variant text and the conversion value are, and what a filter row means. The
places where the layouts differ are class attributes or overridden methods, so that
everything after the scan is layout-independent.
"""

from __future__ import annotations

import copy
import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from abspark.functions.scalars import (
    blank_to_null,
    field_type,
    first_with_key,
    full_trim,
    normalize_path,
    param_text,
    scalar_only,
    text_of,
    to_double,
    variant_path,
)
from abspark.spec import (
    BOTH,
    EXCLUDE,
    LAST,
    TOOL_FLAT,
    TOOL_NESTED,
    TOOL_ONE_BAG,
    TOOL_TWO_BAG,
    USER_ID_ONLY,
    USER_ID_OR_DEVICE_ID,
    ExperimentSpec,
    FilterSpec,
)

# Fixed value: event names that stand for "any event with this user property".
PROPERTY_EXPERIMENT = r"^firebase_exp_\d+$"


class LookupStage:
    """Lookups that several expressions of a plan share. Each becomes one column, read
    only on the events it is needed on. A lookup may build on earlier ones, which then are
    on a lower level."""

    def __init__(self, event_column: str):
        self.event_column = event_column
        self._built: dict[tuple, tuple[str, int, Column]] = {}
        self._events: dict[tuple, set[str | None]] = {}
        self._current: str | None = None
        self.asked: list[tuple] = []

    def on_event(self, event: str | None) -> None:
        """Event the expressions asked for next belong to; None: any event."""
        self._current = event

    def column(self, name: tuple, build: Callable[[], Column], level: int) -> Column:
        if name not in self._built:
            expression = build()
            self._built[name] = (f"lookup_{len(self._built)}", level, expression)
        self.ask_again([name])
        return F.col(self._built[name][0])

    def ask_again(self, names: list[tuple]) -> None:
        """Note that the current event needs these lookups."""
        self.asked.extend(names)
        for name in names:
            self._events.setdefault(name, set()).add(self._current)

    def levels(self) -> list[dict[str, Column]]:
        """Columns to add, level by level."""
        found: dict[int, dict[str, Column]] = {}
        for name, (out, level, expression) in self._built.items():
            events = self._events[name]
            if level == 0 and None not in events:
                here = F.col(self.event_column).isin(*sorted(events))
                expression = F.when(here, expression)
            found.setdefault(level, {})[out] = expression
        return [found[level] for level in sorted(found)]


@dataclass(frozen=True)
class Subject:
    """Text a filter looks at, or (of_items) the texts of all items, one of which must match.
    A missing text is no match and no mismatch, an item's missing text is a mismatch."""

    texts: Column
    of_items: bool = False

    def matches(self, pattern: Column) -> Column:
        if self.of_items:
            return some_match(self.texts, pattern)
        return F.rlike(self.texts, pattern)


def some_match(texts: Column, pattern: Column) -> Column:
    return F.coalesce(
        F.exists(texts, lambda t: F.coalesce(F.rlike(t, pattern), F.lit(False))), F.lit(False)
    )


class EventLayout:
    """Expressions shared by all layouts."""

    tool: str
    event_column = "event_name"
    device_column = "user_pseudo_id"
    #: conversions must come strictly after the exposure (Last Exposure never is strict)
    strict_after = False
    #: Credit Both reads the trimmed, non-blank label instead of the raw variant text
    both_uses_label = False
    #: Last Exposure counts distinct keys, so that a NULL key does not count
    last_skips_null_key = True
    #: a registry row without variant parameter cannot run
    needs_variant_parameter = True

    def __init__(self, schema: StructType):
        self.schema = schema
        self._stage: LookupStage | None = None
        #: what could and what could not be built over this table, kept by the planner
        self.unbuildable: dict[tuple, str | None] = {}

    # -- lookups: a JSON path or an array search, needed several times per row
    def staged(self, stage: LookupStage) -> EventLayout:
        """A copy that takes its lookups from the columns of a stage."""
        twin = copy.copy(self)
        twin._stage = stage
        return twin

    def lookup(self, name: tuple, build: Callable[[], Column], level: int = 0) -> Column:
        return build() if self._stage is None else self._stage.column(name, build, level)

    def parameter(self, column: str, key: str) -> Column:
        """Value struct of the first parameter with that key."""
        return self.lookup(
            ("parameter", column, key),
            lambda: first_with_key(F.col(column), key)["value"],
        )

    # Each asks for what it builds on every time, so that the stage knows all events that
    # need it.
    def parameter_text(self, column: str, key: str) -> Column:
        value = self.parameter(column, key)
        return self.lookup(("text", column, key), lambda: param_text(value), 1)

    def parsed(self, bag: str) -> Column:
        """A JSON bag, parsed once for all paths."""
        return self.lookup(("bag", bag), lambda: F.try_parse_json(F.col(bag)))

    def number_text(self, bag: str, path: str) -> Column:
        """Text at a dotted path of a JSON bag; of a number, not always as it is written."""
        parsed = self.parsed(bag)
        return self.lookup(
            ("json", bag, path), lambda: F.try_variant_get(parsed, variant_path(path), "string"), 1
        )

    def scalar(self, bag: str, path: str) -> Column:
        """Scalar at a dotted path of a JSON bag."""
        parsed, text = self.parsed(bag), self.number_text(bag, path)
        return self.lookup(
            ("scalar", bag, path), lambda: scalar_only(text, parsed, F.col(bag), path), 2
        )

    # -- scan
    def event_time(self) -> Column:
        raise NotImplementedError

    def in_window(self, start: dt.date, end: dt.date) -> Column:
        """Rows of the days start..end, as a predicate that prunes."""
        raise NotImplementedError

    #: SQL test of a row, with columns row_time and first_day, last_day of a rule (dates)
    rule_window = "row_time >= rule.first_day AND row_time < rule.last_day + INTERVAL 1 DAY"
    #: SQL for the day that windows are tested on
    day_of_row = "to_date(row_time)"

    def event_is(self, name: str) -> Column:
        return F.col(self.event_column) == F.lit(name)

    # -- identity
    def session_key(self) -> Column:
        raise NotImplementedError

    def user_key(self, identity: str) -> Column:
        device = F.col(self.device_column)
        if identity == USER_ID_ONLY:
            return F.col("user_id")
        if identity == USER_ID_OR_DEVICE_ID:
            return F.coalesce(blank_to_null(F.col("user_id")), device)
        return device

    def grouping_key(self, spec: ExperimentSpec) -> Column:
        return self.user_key(spec.identity) if spec.by_user else self.session_key()

    def has_user(self) -> Column:
        return F.col("user_id").isNotNull() & (F.col("user_id") != "")

    def has_device(self) -> Column:
        return F.col(self.device_column).isNotNull()

    def identity_predicate(self, spec: ExperimentSpec) -> Column | None:
        """Rows that can be attributed to a unit at all; None: every row."""
        if spec.identity == USER_ID_ONLY:
            return self.has_user()
        if spec.identity == USER_ID_OR_DEVICE_ID:
            return self.has_user() | self.has_device()
        return self.has_device()

    # -- exposure
    def exposure_event(self, spec: ExperimentSpec) -> str | None:
        """Event name an exposure must have; None when any event may expose."""
        return spec.experiment_event_name

    def exposure_guard(self, spec: ExperimentSpec) -> Column:
        return self.event_is(spec.experiment_event_name)

    def raw_variant(self, spec: ExperimentSpec) -> Column:
        raise NotImplementedError

    def variant_label(self, spec: ExperimentSpec) -> Column:
        """Trimmed variant text; NULL where the event carries none."""
        return blank_to_null(full_trim(self.raw_variant(spec)))

    def exposure_text(self, spec: ExperimentSpec) -> Column:
        """Variant text the overlap policy of this row looks at."""
        if spec.user_overlap == BOTH and not self.both_uses_label:
            return self.raw_variant(spec)
        return self.variant_label(spec)

    def allows_null_key(self, spec: ExperimentSpec) -> bool:
        """Is a NULL key one unit (grouping) or none (join, distinct count)?"""
        if spec.user_overlap == EXCLUDE:
            return False
        return not (spec.user_overlap == LAST and self.last_skips_null_key)

    # -- conversion
    def value(self, spec: ExperimentSpec) -> Column:
        raise NotImplementedError

    def has_value_parameter(self, spec: ExperimentSpec) -> bool:
        return bool((spec.experiment_event_value_parameter or "").strip())

    # -- filters
    def filter_subject(self, f: FilterSpec) -> Subject | None:
        """What the filter's pattern is matched against; None: the filter has no effect."""
        raise NotImplementedError

    def filter_match(self, f: FilterSpec) -> Column | None:
        """Match of the filter's pattern, before include/exclude; None: no effect."""
        subject = self.filter_subject(f)
        return None if subject is None else subject.matches(F.lit(f.filter_value))

    def filter_predicate(self, f: FilterSpec) -> Column | None:
        match = self.filter_match(f)
        if match is None:
            return None
        return ~match if f.exclude else match

    def column_text(self, path: str) -> Column:
        return text_of(F.col(path), field_type(self.schema, path))


def _time_window(column: str, start: dt.date, end: dt.date) -> Column:
    """Half-open range on the raw timestamp, so that file statistics can prune."""
    after = end + dt.timedelta(days=1)
    return (F.col(column) >= F.lit(start.isoformat())) & (
        F.col(column) < F.lit(after.isoformat())
    )


class NestedLayout(EventLayout):
    """Day-sharded events with repeated key/value parameters."""

    tool = TOOL_NESTED
    rule_window = "table_suffix BETWEEN rule.first_suffix AND rule.last_suffix"
    day_of_row = "to_date(table_suffix, 'yyyyMMdd')"

    def event_time(self) -> Column:
        return F.timestamp_micros(F.col("event_timestamp"))

    def in_window(self, start, end) -> Column:
        return F.col("table_suffix").between(
            F.lit(start.strftime("%Y%m%d")), F.lit(end.strftime("%Y%m%d"))
        )

    def session_key(self) -> Column:
        session = self.parameter("event_params", "ga_session_id")
        return F.concat(F.col(self.device_column), session["int_value"].cast("string"))

    def by_property(self, spec: ExperimentSpec) -> bool:
        return bool(re.search(PROPERTY_EXPERIMENT, spec.experiment_event_name or ""))

    def exposure_event(self, spec) -> str | None:
        return None if self.by_property(spec) else spec.experiment_event_name

    def variant_key(self, spec: ExperimentSpec) -> str:
        if self.by_property(spec):
            return spec.experiment_event_name
        return spec.experiment_variant_parameter

    def exposure_guard(self, spec) -> Column:
        if not self.by_property(spec):
            return self.event_is(spec.experiment_event_name)
        key = F.lit(self.variant_key(spec))
        return F.exists(F.col("user_properties"), lambda p: p["key"] == key)

    def raw_variant(self, spec) -> Column:
        key = self.variant_key(spec)
        return F.coalesce(
            self.parameter("event_params", key)["string_value"],
            self.parameter_text("user_properties", key),
        )

    def value(self, spec) -> Column:
        name = spec.experiment_event_value_parameter or ""
        if not name.strip():
            return F.lit(None).cast("double")
        if name.lower().startswith("ecommerce."):
            return _lenient_double(F.col(name), field_type(self.schema, name))
        v = self.parameter("event_params", name)
        return F.coalesce(
            v["int_value"].cast("double"),
            v["float_value"].cast("double"),
            v["double_value"].cast("double"),
        )

    def filter_subject(self, f) -> Subject | None:
        if f.filter_scope == "Event":
            return Subject(self.parameter_text("event_params", f.filter_field))
        if f.filter_scope == "User":
            return Subject(self.parameter_text("user_properties", f.filter_field))
        if (f.filter_scope or "").upper() != "COLUMN":
            return None
        path = re.sub(r"\s+", ".", normalize_path(f.filter_field.strip()))
        if path.startswith("items."):
            return Subject(_item_texts(self.schema, path, missing=""), of_items=True)
        return Subject(F.coalesce(self.column_text(path), F.lit("")))


def _item_texts(schema: StructType, path: str, missing: str | None) -> Column:
    """Texts of a field of all elements of the items array; an absent array has none."""
    inner = path.split(".", 1)[1]
    dtype = field_type(schema, path)

    def text_in(item: Column) -> Column:
        text = item
        for part in inner.split("."):
            text = text[part]
        text = text_of(text, dtype)
        return text if missing is None else F.coalesce(text, F.lit(missing))

    return F.transform(F.col("items"), text_in)


def _lenient_double(value: Column, dtype) -> Column:
    if dtype is not None and dtype.typeName() == "string":
        return to_double(value)
    return value.try_cast("double")


class FlatLayout(EventLayout):
    """Flattened events: a DATE column and a plain parameter struct."""

    tool = TOOL_FLAT
    both_uses_label = True
    rule_window = "event_date BETWEEN rule.first_day AND rule.last_day"
    day_of_row = "event_date"

    def event_time(self) -> Column:
        return F.timestamp_micros(F.col("time.event_timestamp"))

    def in_window(self, start, end) -> Column:
        return F.col("event_date").between(F.lit(start), F.lit(end))

    def session_key(self) -> Column:
        return F.concat(
            F.col(self.device_column), F.col("event_params.ga_session_id").cast("string")
        )

    def identity_predicate(self, spec) -> Column | None:
        """The scan takes every row; only the user-id rule guards both sides."""
        return self.has_user() if spec.identity == USER_ID_ONLY else None

    def parameter_path(self, name: str) -> str:
        return name if "." in name else f"event_params.{name}"

    def raw_variant(self, spec) -> Column:
        return self.column_text(self.parameter_path(spec.experiment_variant_parameter))

    def value(self, spec) -> Column:
        name = spec.experiment_event_value_parameter or ""
        if not name.strip():
            return F.lit(None).cast("double")
        path = self.parameter_path(name)
        return _lenient_double(F.col(path), field_type(self.schema, path))

    def filter_subject(self, f) -> Subject | None:
        if f.filter_scope not in ("Event", "Column"):
            return None
        if f.filter_field.startswith("items."):
            return Subject(_item_texts(self.schema, f.filter_field, missing=None), of_items=True)
        return Subject(self.column_text(self.parameter_path(f.filter_field)))


class TwoBagLayout(EventLayout):
    """JSON events with an event bag and a user bag."""

    tool = TOOL_TWO_BAG
    event_column = "event_type"
    device_column = "device_id"
    strict_after = True
    last_skips_null_key = False
    needs_variant_parameter = False
    event_bag = "event_properties"
    user_bag = "user_properties"

    def event_time(self) -> Column:
        return F.col("event_time")

    def in_window(self, start, end) -> Column:
        return _time_window("event_time", start, end)

    def session_key(self) -> Column:
        return F.concat(F.col(self.device_column), F.col("session_id").cast("string"))

    def has_device(self) -> Column:
        return F.col(self.device_column).isNotNull() & (F.col(self.device_column) != "")

    def identity_predicate(self, spec) -> Column:
        base = super().identity_predicate(spec)
        if spec.scope == "User":
            return base
        return base & F.col("session_id").isNotNull()

    def bags(self) -> list[str]:
        return [self.event_bag, self.user_bag]

    def raw_variant(self, spec) -> Column:
        key = normalize_path(spec.experiment_variant_parameter or "")
        if not key.strip():
            return F.lit(None).cast("string")
        return F.coalesce(*[self.scalar(bag, key) for bag in self.bags()])

    def value(self, spec) -> Column:
        name = normalize_path((spec.experiment_event_value_parameter or "").strip())
        if not name:
            return F.lit(None).cast("double")
        return to_double(self.number_text(self.event_bag, name))

    def in_bag(self, bag: str, path: str) -> Subject:
        return Subject(F.coalesce(self.scalar(bag, path), F.lit("")))

    def filter_subject(self, f) -> Subject | None:
        path = normalize_path((f.filter_field or "").strip())
        if not path:
            return None
        if f.filter_scope == "Event":
            return self.in_bag(self.event_bag, path)
        if f.filter_scope == "User":
            return self.in_bag(self.user_bag, path)
        if (f.filter_scope or "").upper() != "COLUMN":
            return None
        if "." in path:
            return self.in_bag(self.event_bag, path)
        return Subject(F.coalesce(self.column_text(path), F.lit("")))


class OneBagLayout(TwoBagLayout):
    """JSON events with a single property bag."""

    tool = TOOL_ONE_BAG
    event_column = "event_name"
    device_column = "distinct_id"
    event_bag = "properties"
    user_bag = "properties"

    def event_time(self) -> Column:
        return F.col("time")

    def in_window(self, start, end) -> Column:
        return _time_window("time", start, end)

    def bags(self) -> list[str]:
        return [self.event_bag]

    def any_user(self) -> Column:
        """User id column, else one of two properties; blanks are kept as they are."""
        bag = self.event_bag
        return F.coalesce(
            F.col("user_id"), self.scalar(bag, "user_id"), self.scalar(bag, "$user_id")
        )

    def any_session(self) -> Column:
        bag = self.event_bag
        return F.coalesce(self.scalar(bag, "session_id"), self.scalar(bag, "$session_id"))

    def session_key(self) -> Column:
        return F.concat(
            F.col(self.device_column), F.coalesce(self.any_session(), F.lit(""))
        )

    def user_key(self, identity: str) -> Column:
        device = F.col(self.device_column)
        if identity == USER_ID_ONLY:
            return self.any_user()
        if identity == USER_ID_OR_DEVICE_ID:
            return F.coalesce(self.any_user(), device)
        return device

    def has_user(self) -> Column:
        return self.any_user().isNotNull()

    def identity_predicate(self, spec) -> Column:
        base = EventLayout.identity_predicate(self, spec)
        if spec.scope == "User":
            return base
        return base & self.any_session().isNotNull()

    def filter_subject(self, f) -> Subject | None:
        path = normalize_path((f.filter_field or "").strip())
        if not path or f.filter_scope is None:
            return None
        if f.filter_scope.upper() == "COLUMN":
            return Subject(F.coalesce(self.column_text(path), F.lit("")))
        return self.in_bag(self.event_bag, path)


LAYOUTS = {c.tool: c for c in (NestedLayout, FlatLayout, TwoBagLayout, OneBagLayout)}


def layout_for(tool: str, schema: StructType) -> EventLayout:
    return LAYOUTS[tool](schema)
