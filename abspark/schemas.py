"""Column types of the registry, child, report and cost tables."""

from __future__ import annotations

import re

from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_TYPES: dict[str, DataType] = {
    "STRING": StringType(),
    "DATE": DateType(),
    "BOOLEAN": BooleanType(),
    "BIGINT": LongType(),
    "DOUBLE": DoubleType(),
    "TIMESTAMP": TimestampType(),
    "MONEY": DecimalType(38, 9),
}


def columns(text: str) -> StructType:
    """Schema from 'name TYPE, ...'; needs no running session."""
    pairs = re.findall(r"(\w+)\s+(\w+)", text)
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


EXPERIMENTS = columns(
    """
    id STRING, variant STRING, date_start DATE, date_end DATE, date_comparison BOOLEAN,
    experiment_name STRING, variant_name STRING, conversion_event STRING,
    conversion_count_all BOOLEAN, exp_variant_string STRING, analyze_test BOOLEAN,
    event_value_test BOOLEAN, hypothesis STRING, confidence BIGINT, description STRING,
    scope STRING, identity_source STRING, experiment_event_name STRING,
    experiment_variant_parameter STRING, experiment_event_value_parameter STRING,
    user_overlap STRING, analytics_tool STRING, query_information_logging BOOLEAN,
    query_price_per_tib DOUBLE
    """
)

# The staged form carries the export mode before the tool columns.
EXPERIMENTS_STAGE = StructType(
    EXPERIMENTS.fields[:21]
    + columns("export_mode STRING").fields
    + EXPERIMENTS.fields[21:]
)

FILTERS = columns(
    """
    id STRING, variant STRING, enabled BOOLEAN, filter_type STRING,
    filter_on_value STRING, filter_scope STRING, filter_field STRING,
    filter_value STRING, notes STRING, source STRING
    """
)

LINKS = columns("id STRING, link STRING")
IMAGES = columns("id STRING, variant STRING, image_url STRING")

RESULTS = columns(
    """
    id STRING, variant STRING, variant_name STRING, conversion_event STRING,
    scope STRING, user_overlap STRING, date_start DATE, date_end DATE,
    user_count BIGINT, conversion_count BIGINT, total_conversion_value DOUBLE,
    total_conversion_sq_value DOUBLE
    """
)

REPORT = columns(
    """
    id STRING, date_start DATE, date_end DATE, experiment_name STRING,
    conversion_event STRING, scope STRING, identity_source STRING, hypothesis STRING,
    confidence_level DOUBLE, analyze_test BOOLEAN, user_overlap STRING, test_a BIGINT,
    conversion_a BIGINT, test_b BIGINT, conversion_b BIGINT, conv_rate_a DOUBLE,
    conv_rate_b DOUBLE, conv_z_score DOUBLE, conv_p_value DOUBLE,
    conv_significance STRING, conv_details STRING, conversions_counting_mode STRING,
    mean_value_a DOUBLE, mean_value_b DOUBLE, t_value DOUBLE, value_p_value DOUBLE,
    value_significance STRING, value_details STRING, date_last_analyzed DATE,
    date_comparison BOOLEAN
    """
)

JOB_LOG = columns("id STRING, job_id STRING, bytes_billed BIGINT")

QUERY_INFORMATION = columns(
    """
    id STRING, execution_time TIMESTAMP, job_ids STRING, total_bytes_billed BIGINT,
    estimated_cost_usd MONEY
    """
)
