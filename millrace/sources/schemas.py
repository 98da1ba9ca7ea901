"""Explicit schemas, so that no source is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

TABLES: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

PAYMENTS = (
    "id string, amount bigint, status string, `metadata.country` string, `metadata.segment` string,"
    " `metadata.channel` string, `metadata.batch_date` string"
)

RAW_INTERVENTIONS = (
    "intervention_id string, plant string, line string, equipment_tag string, reported_at timestamp_ntz,"
    " technician_id string, alert_code string, raw_text string"
)

INTERVENTION_PAYLOAD = (
    "summary string, machine_type string, component string, failure_category string, root_cause_class string,"
    " root_cause_detail string, action_taken string, resolution string, severity string, downtime_minutes int,"
    " planned_work boolean, parts_replaced array<string>, recurring boolean, recommendation string,"
    " escalation_needed boolean, extraction_confidence double"
)

ORDER_LINES = "array<struct<sku:string,cases:bigint,quantity:bigint>>"

# The closed vocabularies of a structured intervention.
MACHINE_TYPES = [
    "rolling_mill", "blast_furnace", "sinter_plant", "continuous_caster", "conveyor",
    "hydraulic_power_unit", "fan_or_blower", "gearbox", "electrical_drive", "gas_cleaning", "other",
]
FAILURE_CATEGORIES = [
    "mechanical_wear", "hydraulic_leak", "electrical_fault", "instrument_or_sensor", "lubrication",
    "blockage_or_fouling", "overheating", "bearing_failure", "structural_or_foundation",
    "control_or_software", "other",
]
ROOT_CAUSE_CLASSES = [
    "wear_end_of_life", "design_or_installation", "upstream_contamination",
    "maintenance_interval_too_long", "deferred_repair", "misalignment_or_looseness",
    "loss_of_lubrication", "environmental_ingress", "human_error", "unknown",
]
SEVERITIES = ["low", "medium", "high", "critical"]
RESOLUTIONS = ["resolved", "temporary_fix", "not_resolved"]


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
