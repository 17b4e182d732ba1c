"""Registry preparation (C1-C15) as table transforms.

A *block* is one row per experiment with ``_a`` and ``_b`` fields:

    id, experiment_name, analyze_choice, event_value_test, hypothesis, confidence, description,
    scope, identity_source, user_overlap, variant_settings, conversion_count_all,
    date_comparison, date_start_a/_b, date_end_a/_b, variant_name_a/_b,
    conversion_event_a/_b, exp_variant_string_a/_b, experiment_event_name_a/_b,
    experiment_variant_parameter_a/_b, experiment_event_value_parameter,
    filtering, advanced, filter_type_a/_b, filter_on_value_a/_b, filter_scope_a/_b,
    filter_field_a/_b, filter_value_a/_b, images_a/_b, links
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abspark.functions.scalars import blank_to_null, full_trim
from abspark.schemas import EXPERIMENTS_STAGE

# Export modes and the shared-file link forms.
ANALYZE, UPDATE, STATUS_ONLY = "ANALYZE", "UPDATE", "STATUS_ONLY"
DRIVE_SHARE_LINK = r"^https://drive\.google\.com/file/d/(.+?)/view.*$"
DRIVE_DIRECT_LINK = "https://drive.google.com/uc?id="
SEED_NOTE = "Seeded from simple filter"
SIMPLE_NOTE = "from Experiments (simple)"


def _filled(c: Column) -> Column:
    """A cell with something in it."""
    return F.coalesce(c.cast("string"), F.lit("")) != ""


def normalize_id(ident: Column) -> Column:
    """C4: digits get at least two places; other ids stay as they are."""
    text = full_trim(ident.cast("string"))
    digits = F.regexp_replace(text, "^0+(?=[0-9])", "")
    padded = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    return F.when(text.rlike("^[0-9]+$"), padded).otherwise(F.coalesce(text, F.lit("")))


def export_mode(analyze: Column) -> Column:
    """C6."""
    choice = full_trim(analyze)
    return (
        F.when(choice == "Yes", ANALYZE)
        .when(choice == "Update", UPDATE)
        .otherwise(STATUS_ONLY)
    )


def normalize_confidence_input(confidence: Column) -> Column:
    """A fraction (0.95) or a percent ('95%', 95) as a percent number. The cell comes
    as text; without a percent sign, a number up to 1 is a fraction."""
    number = F.regexp_replace(confidence, "%", "").try_cast("double")
    is_fraction = ~F.contains(confidence, F.lit("%")) & (number <= 1)
    return F.when(is_fraction, F.floor(number * 100 + 0.5).cast("double")).otherwise(number)


def previous_period(start: Column, end: Column) -> Column:
    """Window of equal length that ends the day before ``start``; NULL unless the
    given window is a real one."""
    length = F.date_diff(end, start) + 1
    before_end = F.date_sub(start, 1)
    before = F.struct(
        F.date_sub(before_end, length - 1).alias("date_start"),
        before_end.alias("date_end"),
    )
    return F.when(start <= end, before)


def default_window(today: Column | dt.date) -> Column:
    """The fourteen days before yesterday, and yesterday."""
    day = today if isinstance(today, Column) else F.lit(today)
    yesterday = F.date_sub(day, 1)
    return F.struct(
        F.date_sub(yesterday, 14).alias("date_start"), yesterday.alias("date_end")
    )


def enforce_scope(scope: Column, identity: Column) -> Column:
    """Any identity but the device forces the User scope; blank means User."""
    chosen = F.upper(F.coalesce(identity, F.lit("")))
    return F.when(~chosen.isin("", "DEVICE_ID"), F.lit("User")).otherwise(
        F.coalesce(blank_to_null(scope), F.lit("User"))
    )


def normalize_filter_target(text: Column) -> Column:
    """What a filter is applied to, as the long label."""
    t = F.lower(full_trim(F.coalesce(text, F.lit(""))))
    return (
        F.when(t.contains("experiment"), "Experiment Event")
        .when(t.contains("conversion"), "Conversion Event")
        .otherwise("Both")
    )


def normalize_filter_scope(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t == "user", "User").when(t == "column", "Column").otherwise("Event")


def rewrite_drive_url(url: Column) -> Column:
    """Share link to direct link."""
    ident = F.regexp_extract(url, DRIVE_SHARE_LINK, 1)
    return F.when(ident != "", F.concat(F.lit(DRIVE_DIRECT_LINK), ident)).otherwise(url)


def _is_different() -> Column:
    return F.coalesce(F.col("variant_settings"), F.lit("")) == "Different"


def _compared() -> Column:
    return F.coalesce(F.col("date_comparison"), F.lit(False))


def compare_dates(blocks: DataFrame) -> DataFrame:
    """B has its own window only under date comparison."""
    for name in ("date_start", "date_end"):
        own = F.when(_compared(), F.col(f"{name}_b")).otherwise(F.col(f"{name}_a"))
        blocks = blocks.withColumn(f"{name}_b", own)
    return blocks


def inherit_from_a(blocks: DataFrame) -> DataFrame:
    """B takes event, parameter and conversion event from A unless set differently."""
    for name in (
        "experiment_event_name", "experiment_variant_parameter", "conversion_event"
    ):
        own = F.when(_is_different(), F.coalesce(F.col(f"{name}_b"), F.lit("")))
        blocks = blocks.withColumn(f"{name}_b", own.otherwise(F.col(f"{name}_a")))
    return blocks


def with_missing(blocks: DataFrame) -> DataFrame:
    """``missing`` lists what a block lacks. A block that is only synced needs an id
    and nothing else."""
    different, compared = _is_different(), _compared()

    def needs(name: str, only: Column | None = None) -> Column:
        lacking = ~_filled(F.col(name))
        return F.when(lacking if only is None else lacking & only, F.lit(name))

    id_missing = F.when(normalize_id(F.col("id")) == "", F.lit("id"))
    either = [
        F.when(
            ~_filled(F.col(f"{name}_a")) | ~_filled(F.col(f"{name}_b")), F.lit(name)
        )
        for name in ("variant_name", "exp_variant_string")
    ]
    full = [
        id_missing,
        *[
            needs(name)
            for name in (
                "experiment_name", "event_value_test", "hypothesis", "confidence",
                "description", "scope", "identity_source", "date_start_a", "date_end_a",
            )
        ],
        needs("date_start_b", compared),
        needs("date_end_b", compared),
        *either,
        needs("experiment_event_name_a"),
        needs("experiment_event_name_b", different),
        needs("experiment_variant_parameter_a"),
        needs("experiment_variant_parameter_b", different),
        needs("conversion_event_a"),
        needs("conversion_event_b", different),
    ]
    only_status = export_mode(F.col("analyze_choice")) == STATUS_ONLY
    return blocks.withColumn(
        "missing",
        F.when(only_status, F.array_compact(F.array(id_missing))).otherwise(
            F.array_compact(F.array(*full))
        ),
    )


def validate_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complete blocks, and skipped ones with their reasons."""
    checked = with_missing(blocks)
    complete = F.size("missing") == 0
    return checked.where(complete).drop("missing"), checked.where(~complete)


def expand_blocks(blocks: DataFrame) -> DataFrame:
    """Complete blocks to staged registry rows, A and B. Rows that are only synced
    carry id, variant, mode and a cleared ``analyze_test``."""
    ready = inherit_from_a(compare_dates(blocks))
    mode = export_mode(F.col("analyze_choice"))
    says_yes = F.lower(full_trim(F.col("analyze_choice"))) == "yes"
    shared = {
        "id": normalize_id(F.col("id")),
        "export_mode": mode,
        "analyze_test": F.coalesce(says_yes, F.lit(False)),
    }
    detail = {
        "date_comparison": _compared(),
        "event_value_test": F.lower(F.col("event_value_test")) == "yes",
        "confidence": normalize_confidence_input(F.col("confidence")).cast("bigint"),
    }
    per_variant = {
        "date_start", "date_end", "variant_name", "conversion_event",
        "exp_variant_string", "experiment_event_name", "experiment_variant_parameter",
    }
    known = set(blocks.columns)
    if "analytics_tool" in known:
        detail["analytics_tool"] = F.upper(F.col("analytics_tool"))

    def row(variant: str) -> Column:
        cells = []
        for f in EXPERIMENTS_STAGE.fields:
            if f.name == "variant":
                cell = F.lit(variant)
            elif f.name in shared:
                cell = shared[f.name]
            else:
                if f.name in detail:
                    cell = detail[f.name]
                elif f.name in per_variant:
                    cell = F.col(f"{f.name}_{variant.lower()}")
                else:
                    cell = F.col(f.name) if f.name in known else F.lit(None)
                cell = F.when(mode != STATUS_ONLY, cell)
            cells.append(cell.cast(f.dataType).alias(f.name))
        return F.struct(*cells)

    return ready.select(F.explode(F.array(row("A"), row("B"))).alias("r")).select("r.*")


def active_ids(blocks: DataFrame) -> DataFrame:
    """C14: padded ids marked Yes."""
    return (
        blocks.where(full_trim(F.col("analyze_choice")) == "Yes")
        .select(normalize_id(F.col("id")).alias("id"))
        .where(F.col("id") != "")
        .distinct()
    )


def _simple_filters(blocks: DataFrame, note: Column, source: str) -> DataFrame:
    """The simple filter of each block, per variant. B takes A's unless set differently,
    and then only what B leaves blank."""

    def cell(name: str, variant: str, default: str) -> Column:
        def read(v: str) -> Column:
            text = F.col(f"{name}_{v}")
            return blank_to_null(text if default else full_trim(text))

        a = F.coalesce(read("a"), F.lit(default))
        if variant == "A":
            return a
        own = F.coalesce(read("b"), a)
        return F.when(_is_different(), own).otherwise(a)

    def row(variant: str) -> Column:
        return F.struct(
            F.col("filter_id").alias("id"),
            F.lit(variant).alias("variant"),
            F.lit(True).alias("enabled"),
            cell("filter_type", variant, "Include").alias("filter_type"),
            normalize_filter_target(cell("filter_on_value", variant, "Both")).alias(
                "filter_on_value"
            ),
            cell("filter_scope", variant, "Event").alias("filter_scope"),
            cell("filter_field", variant, "").alias("filter_field"),
            cell("filter_value", variant, "").alias("filter_value"),
            note.alias("notes"),
            F.lit(source).alias("source"),
        )

    return (
        blocks.select(F.explode(F.array(row("A"), row("B"))).alias("f"))
        .select("f.*")
        .where((F.col("filter_field") != "") | (F.col("filter_value") != ""))
    )


def _filtering_on() -> Column:
    return F.lower(F.coalesce(F.col("filtering"), F.lit(""))) == "yes"


def merge_filters(blocks: DataFrame, advanced: DataFrame) -> DataFrame:
    """Filter rows of the experiments to analyse: enabled advanced rows (found by id
    or by name) where the block says advanced, else its simple filter."""
    name = full_trim(F.coalesce(F.col("experiment_name"), F.lit("")))
    ident = normalize_id(F.col("id"))
    active = (
        blocks.where((full_trim(F.col("analyze_choice")) == "Yes") & _filtering_on())
        .withColumn("filter_id", F.coalesce(blank_to_null(ident), name))
        .where(F.col("filter_id") != "")
    )
    uses_advanced = F.coalesce(F.col("advanced"), F.lit(False))
    keys = active.where(uses_advanced).select(
        F.explode(F.array(ident, name)).alias("id")
    ).where(F.col("id") != "")
    rows = advanced.select(
        normalize_id(F.col("id")).alias("id"),
        F.upper(full_trim(F.col("variant"))).alias("variant"),
        F.coalesce(F.col("enabled"), F.lit(False)).alias("enabled"),
        F.coalesce(blank_to_null(full_trim(F.col("filter_type"))), F.lit("Include")).alias(
            "filter_type"
        ),
        normalize_filter_target(F.col("filter_on_value")).alias("filter_on_value"),
        F.coalesce(blank_to_null(full_trim(F.col("filter_scope"))), F.lit("Event")).alias(
            "filter_scope"
        ),
        full_trim(F.coalesce(F.col("filter_field"), F.lit(""))).alias("filter_field"),
        full_trim(F.coalesce(F.col("filter_value"), F.lit(""))).alias("filter_value"),
        full_trim(F.coalesce(F.col("notes"), F.lit(""))).alias("notes"),
        F.lit("advanced").alias("source"),
    ).where(F.col("enabled") & F.col("variant").isin("A", "B"))
    simple = _simple_filters(active.where(~uses_advanced), F.lit(SIMPLE_NOTE), "simple")
    return rows.join(keys, "id").select(*rows.columns).unionByName(simple)


def seed_advanced_filters(blocks: DataFrame, advanced: DataFrame) -> DataFrame:
    """The advanced list plus a row per variant from the simple filter of blocks that
    turned advanced filtering on, unless that (id, variant) is listed already."""
    name = full_trim(F.coalesce(F.col("experiment_name"), F.lit("")))
    ident = full_trim(F.coalesce(F.col("id").cast("string"), F.lit("")))
    wanted = (
        blocks.where(_filtering_on() & F.coalesce(F.col("advanced"), F.lit(False)))
        .withColumn("filter_id", F.coalesce(blank_to_null(ident), name))
        .where(F.col("filter_id") != "")
    )
    note = F.concat(
        F.lit(f"{SEED_NOTE} ("), F.coalesce(blank_to_null(name), F.col("filter_id")),
        F.lit(")"),
    )
    seeds = _simple_filters(wanted, note, "advanced").withColumn(
        "filter_scope", normalize_filter_scope(F.col("filter_scope"))
    )
    listed = advanced.select(
        full_trim(F.col("id")).alias("id"), full_trim(F.col("variant")).alias("variant")
    )
    new = seeds.join(listed, ["id", "variant"], "left_anti")
    return advanced.unionByName(new.select(*advanced.columns))


def split_lines(cell: Column) -> Column:
    """Trimmed non-blank lines of a cell."""
    lines = F.transform(F.split(cell, "\r?\n"), full_trim)
    return F.filter(lines, lambda line: line != "")


def _with_media(blocks: DataFrame) -> DataFrame:
    mode = full_trim(F.col("analyze_choice"))
    return blocks.where(mode.isin("Yes", "Update") & _filled(F.col("id"))).withColumn(
        "id", normalize_id(F.col("id"))
    )


def explode_images(blocks: DataFrame) -> DataFrame:
    """C11: image lines per variant, share links rewritten."""
    sides = F.array(
        *[
            F.struct(F.lit(v).alias("variant"), F.col(f"images_{v.lower()}").alias("cell"))
            for v in ("A", "B")
        ]
    )
    return (
        _with_media(blocks)
        .select("id", F.explode(sides).alias("side"))
        .select("id", "side.variant", F.explode(split_lines(F.col("side.cell"))).alias("u"))
        .select("id", "variant", rewrite_drive_url(F.col("u")).alias("image_url"))
    )


def explode_links(blocks: DataFrame) -> DataFrame:
    """C11: link lines per experiment."""
    return _with_media(blocks).select(
        "id", F.explode(split_lines(F.col("links"))).alias("link")
    )
