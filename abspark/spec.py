"""One registry row and one filter row as plain config objects.

Which event, parameter, pattern or column an experiment uses is data in the registry, so
registry rows are read to the driver (they are configuration: two short rows per
experiment) and turned into column expressions over the event table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labels of the registry.
TOOL_NESTED = "GOOGLE ANALYTICS"
TOOL_FLAT = "GA4 DATAFORM"
TOOL_TWO_BAG = "AMPLITUDE"
TOOL_ONE_BAG = "MIXPANEL"
SCOPE_USER = "User"
USER_ID_ONLY = "USER_ID_ONLY"
USER_ID_OR_DEVICE_ID = "USER_ID_OR_DEVICE_ID"
FIRST = "First Exposure"
LAST = "Last Exposure"
EXCLUDE = "Exclude"
BOTH = "Credit Both"
POLICIES = [FIRST, LAST, EXCLUDE, BOTH]
ON_EXPERIMENT = "Experiment Event"
ON_CONVERSION = "Conversion Event"
ON_BOTH = "Both"

EXPOSURE_SIDE = "exposure"
CONVERSION_SIDE = "conversion"


@dataclass(frozen=True)
class FilterSpec:
    filter_type: str | None
    filter_on_value: str | None
    filter_scope: str | None
    filter_field: str | None
    filter_value: str | None

    @property
    def exclude(self) -> bool:
        return (self.filter_type or "").upper() == "EXCLUDE"

    def applies_to(self, side: str) -> bool:
        """does this filter restrict the exposure or the conversion side?"""
        wanted = ON_EXPERIMENT if side == EXPOSURE_SIDE else ON_CONVERSION
        return self.filter_on_value in (wanted, ON_BOTH)


@dataclass(frozen=True)
class ExperimentSpec:
    id: str
    variant: str
    date_start: dt.date | None = None
    date_end: dt.date | None = None
    variant_name: str | None = None
    conversion_event: str | None = None
    conversion_count_all: bool | None = False
    exp_variant_string: str | None = None
    scope: str | None = SCOPE_USER
    identity_source: str | None = "DEVICE_ID"
    experiment_event_name: str | None = None
    experiment_variant_parameter: str | None = None
    experiment_event_value_parameter: str | None = None
    user_overlap: str | None = FIRST
    analytics_tool: str | None = None
    filters: tuple[FilterSpec, ...] = field(default=())

    @property
    def by_user(self) -> bool:
        return (self.scope or "").strip().upper() == "USER"

    @property
    def identity(self) -> str:
        """Identity rule; only the exact user scope has a choice."""
        return (self.identity_source or "") if self.scope == SCOPE_USER else ""

    @property
    def count_all(self) -> bool:
        return bool(self.conversion_count_all)

    def side_filters(self, side: str) -> tuple[FilterSpec, ...]:
        return tuple(f for f in self.filters if f.applies_to(side))


_REGISTRY_FIELDS = [f.name for f in fields(ExperimentSpec) if f.name != "filters"]
_FILTER_FIELDS = [f.name for f in fields(FilterSpec)]


def read_specs(registry: DataFrame, filters: DataFrame | None) -> list[ExperimentSpec]:
    """Active registry rows with their enabled filters, in (id, variant) order."""
    by_row: dict[tuple[str, str], list[FilterSpec]] = {}
    if filters is not None:
        enabled = filters.where(F.coalesce(F.col("enabled"), F.lit(True)))
        for row in _config_rows(enabled, ["id", "variant", *_FILTER_FIELDS]):
            by_row.setdefault((row["id"], row["variant"]), []).append(
                FilterSpec(*(row[name] for name in _FILTER_FIELDS))
            )
    specs = [
        ExperimentSpec(
            **{name: row[name] for name in _REGISTRY_FIELDS},
            filters=tuple(
                sorted(by_row.get((row["id"], row["variant"]), []), key=repr)
            ),
        )
        for row in _config_rows(registry, _REGISTRY_FIELDS)
    ]
    return sorted(specs, key=lambda s: (s.id or "", s.variant or "", repr(s)))


def _config_rows(df: DataFrame, columns: list[str]) -> Iterator:
    """Config rows (short, two per experiment) on the driver. What the registry comes from
    keeps its own partitions."""
    yield from df.select(*columns).collect()
