"""Validation and monthly analytics of maintenance intervention records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import differs, half_even, in_month, month_key, not_blank, percent, sentinel_to_null
from millrace.sources import schemas

LOW_CONFIDENCE = 0.6

VOCABULARIES: dict[str, Sequence[str]] = {
    "machine_type": schemas.MACHINE_TYPES,
    "failure_category": schemas.FAILURE_CATEGORIES,
    "root_cause_class": schemas.ROOT_CAUSE_CLASSES,
    "severity": schemas.SEVERITIES,
    "resolution": schemas.RESOLUTIONS,
}


def validate_payloads(
    df: DataFrame,
    payload: str,
    vocabularies: Mapping[str, Sequence[str]] = VOCABULARIES,
    schema: str = schemas.INTERVENTION_PAYLOAD,
) -> DataFrame:
    """Parse a JSON payload column and mark each record structured or failed.

    Every field is required, the vocabularies are closed, and the confidence lies in
    [0, 1]. Low confidence is kept and flagged. Failed rows keep null fields.
    """
    fields = schemas.struct(schema).fieldNames()
    parsed = df.withColumn("__r", F.from_json(payload, schema, {"mode": "PERMISSIVE"}))
    checks = [F.col("__r").isNotNull()]
    checks += [F.col(f"__r.{f}").isNotNull() for f in fields]
    checks += [F.col(f"__r.{f}").isin(*levels) for f, levels in vocabularies.items()]
    checks += [F.col("__r.extraction_confidence").between(0.0, 1.0)]
    good = checks[0]
    for check in checks[1:]:
        good = good & check
    flagged = parsed.withColumn("__ok", F.coalesce(good, F.lit(False)))
    return flagged.select(
        *[c for c in df.columns if c != payload],
        *[F.when(F.col("__ok"), F.col(f"__r.{f}")).alias(f) for f in fields],
        F.when(F.col("__ok"), "structured").otherwise("failed").alias("status"),
        (F.col("__ok") & F.coalesce(F.col("__r.extraction_confidence") < LOW_CONFIDENCE, F.lit(False))).alias(
            "low_confidence"
        ),
    )


def structuring_counts(validated: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Run counters: total, structured, skipped because stored already, failed, low confidence."""
    seen = validated.join(stored.select(key).distinct().withColumn("__seen", F.lit(True)), key, "left")
    fresh = F.col("__seen").isNull()
    return seen.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(fresh & (F.col("status") == "structured")).alias("structured"),
        F.count_if(~fresh).alias("skipped"),
        F.count_if(fresh & (F.col("status") == "failed")).alias("failed"),
        F.count_if(fresh & F.col("low_confidence")).alias("low_confidence"),
    )


def load_frame(records: DataFrame, month: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Records with the month key, decoded part lists, and -1 downtime as null."""
    rows = records.where(in_month(F.col("reported_at"), month)) if month else records
    if columns:
        rows = rows.select(*columns)
    out = rows.withColumn("month", month_key(F.col("reported_at")))
    if "parts_replaced" in out.columns:
        text = F.coalesce(F.nullif(F.col("parts_replaced"), F.lit("")), F.lit("[]"))
        out = out.withColumn("parts_replaced", F.from_json(text, "array<string>"))
    return out.withColumn("downtime_minutes", sentinel_to_null(F.col("downtime_minutes")))


def available_months(frame: DataFrame) -> DataFrame:
    return frame.select("month").where(F.col("month").isNotNull()).distinct().orderBy("month")


def top_counts(frame: DataFrame, column: str, limit: int = 5) -> DataFrame:
    """Most frequent values with their share of all rows, ties by value."""
    total = frame.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        frame.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "value")
        .limit(limit)
        .withColumn("share_pct", percent(F.col("count"), total, 1))
    )


def downtime_by(frame: DataFrame, column: str, limit: int = 5) -> DataFrame:
    """Total, mean and count of stated downtime per value, largest totals first."""
    return (
        frame.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(
            F.coalesce(F.sum("downtime_minutes"), F.lit(0)).cast("bigint").alias("total_downtime_minutes"),
            half_even(F.avg("downtime_minutes"), 1).alias("avg_downtime_minutes"),
            F.count("downtime_minutes").alias("interventions"),
        )
        .orderBy(F.desc("total_downtime_minutes"), "value")
        .limit(limit)
    )


def repeat_offenders(frame: DataFrame, min_events: int = 3) -> DataFrame:
    """Equipment and failure category pairs with at least ``min_events`` events."""
    return (
        frame.where(F.col("equipment_tag").isNotNull() & F.col("failure_category").isNotNull())
        .groupBy("equipment_tag", "failure_category")
        .agg(
            F.count("intervention_id").alias("events"),
            F.coalesce(F.sum("downtime_minutes"), F.lit(0)).cast("bigint").alias("total_downtime_minutes"),
            F.count_if(differs(F.col("resolution"), "resolved")).alias("still_open_or_temporary"),
            F.array_sort(F.collect_set("root_cause_class")).alias("root_cause_classes"),
        )
        .where(F.col("events") >= min_events)
    )


def headline(frame: DataFrame, month: str) -> DataFrame:
    """The month's key figures in one row; a month without rows gives a note instead."""
    planned = F.coalesce(F.col("planned_work"), F.lit(True))
    downtime = F.col("downtime_minutes")
    flag = lambda c: F.coalesce(F.col(c), F.lit(True))
    rows = F.count(F.lit(1))
    empty = rows == 0
    figures = {
        "interventions": rows,
        "unplanned_interventions": F.count_if(~planned),
        "planned_interventions": F.count_if(planned),
        "total_downtime_minutes": F.coalesce(F.sum(downtime), F.lit(0)).cast("bigint"),
        "unplanned_downtime_minutes": F.coalesce(F.sum(F.when(~planned, downtime)), F.lit(0)).cast("bigint"),
        "avg_downtime_minutes": half_even(F.avg(downtime), 1),
        "interventions_missing_downtime": F.count_if(downtime.isNull()),
        "recurring_share_pct": half_even(F.try_divide(F.count_if(flag("recurring")), rows) * 100, 1),
        "escalations_requested": F.count_if(flag("escalation_needed")),
        "low_confidence_extractions": F.count_if(F.col("extraction_confidence") < LOW_CONFIDENCE),
    }
    return frame.agg(
        *[(e if n == "interventions" else F.when(~empty, e)).alias(n) for n, e in figures.items()],
        F.when(empty, "No records for this month.").alias("note"),
    ).select(F.lit(month).alias("month"), *figures, "note")


def open_items(frame: DataFrame) -> DataFrame:
    return frame.where(differs(F.col("resolution"), "resolved")).select(
        "intervention_id", "equipment_tag", "resolution", "summary", "recommendation"
    )


def recommendations(frame: DataFrame) -> DataFrame:
    return frame.where(not_blank(F.col("recommendation"))).select(
        "intervention_id", "equipment_tag", "recommendation", "escalation_needed"
    )


def parts_replaced(frame: DataFrame, limit: int = 8) -> DataFrame:
    return (
        frame.select(F.explode("parts_replaced").alias("part"))
        .groupBy("part")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "part")
        .limit(limit)
    )


def _month_links(frame: DataFrame) -> DataFrame:
    """Monthly totals with the previous month that is present in the data."""
    monthly = (
        frame.where(F.col("month").isNotNull())
        .groupBy("month")
        .agg(
            F.count(F.lit(1)).alias("interventions"),
            F.coalesce(F.sum("downtime_minutes"), F.lit(0)).cast("bigint").alias("downtime_minutes"),
        )
    )
    by_month = Window.partitionBy(F.lit(0)).orderBy("month")
    return monthly.select(
        "*",
        F.lag("month").over(by_month).alias("previous_month"),
        F.lag("interventions").over(by_month).alias("previous_interventions"),
        F.lag("downtime_minutes").over(by_month).alias("previous_downtime_minutes"),
    )


def month_over_month(frame: DataFrame, month: str | None = None) -> DataFrame:
    """Counts and downtime against the previous present month; change is null when that was 0."""

    def change(name: str):
        now, before = F.col(name), F.col(f"previous_{name}")
        grown = F.try_divide(now - before, before) * 100
        return F.when(before != 0, half_even(grown, 1)).alias(f"{name}_change_pct")

    linked = _month_links(frame)
    out = linked.select(*linked.columns, change("interventions"), change("downtime_minutes"))
    return out.where(F.col("month") == month) if month else out


def category_turnover(frame: DataFrame, column: str = "failure_category") -> DataFrame:
    """Per month, values new against the previous present month and values gone since."""
    links = _month_links(frame).select("month", "previous_month").where(F.col("previous_month").isNotNull())
    seen = frame.where(F.col(column).isNotNull()).select("month", F.col(column).alias("value")).distinct()
    previous = seen.withColumnRenamed("month", "previous_month").join(links, "previous_month")
    current = seen.join(links, "month")
    pair = ["month", "value"]
    fresh = current.join(previous.select(*pair), pair, "left_anti").select(*pair, F.lit("new").alias("change"))
    gone = previous.select(*pair).join(seen, pair, "left_anti").select(*pair, F.lit("resolved").alias("change"))
    return fresh.unionByName(gone)


def inspect(records: DataFrame, ids: Sequence) -> DataFrame:
    """Raw text beside the structured record, for the given ids."""
    packed = F.to_json(
        F.struct(*[c for c in records.columns if c not in ("intervention_id", "raw_text")]),
        {"ignoreNullFields": "false"},
    )
    return records.where(F.col("intervention_id").isin(*ids)).select(
        "intervention_id", "raw_text", packed.alias("structured")
    )
