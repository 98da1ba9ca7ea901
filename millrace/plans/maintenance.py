"""Maintenance analytics, bound to orders as interventions on customers' equipment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import maintenance as m
from millrace.plans.registry import query
from millrace.sources import schemas
from millrace.sources.readers import table

MONTH = "1997-05"


def interventions(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    key = F.col("o_orderkey")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("intervention_id"),
            F.concat(F.lit("PLANT-"), "n_regionkey").alias("plant"),
            F.concat(F.lit("EQ-"), "o_custkey").alias("equipment_tag"),
            F.col("o_orderdate").alias("reported_at"),
            F.col("c_mktsegment").alias("machine_type"),
            F.col("n_name").alias("component"),
            F.col("o_orderpriority").alias("failure_category"),
            F.element_at(F.array(*map(F.lit, schemas.ROOT_CAUSE_CLASSES)), (key % 10 + 1).cast("int")).alias(
                "root_cause_class"
            ),
            F.when(F.col("o_orderstatus") == "F", "resolved")
            .when(F.col("o_orderstatus") == "P", "temporary_fix")
            .otherwise("not_resolved")
            .alias("resolution"),
            F.when(F.col("o_totalprice") > 300000, "high").otherwise("low").alias("severity"),
            F.when(key % 5 == 0, -1).otherwise(F.floor(F.col("o_totalprice") / 1000)).cast("int").alias(
                "downtime_minutes"
            ),
            (key % 3 == 0).alias("planned_work"),
            F.when(key % 4 == 0, "[]")
            .otherwise(F.concat(F.lit('["'), "n_name", F.lit('", "'), "c_mktsegment", F.lit('"]')))
            .alias("parts_replaced"),
            (F.col("c_acctbal") > 5000).alias("recurring"),
            F.when(key % 4 == 1, "  ").otherwise(F.concat(F.lit("check "), "o_orderpriority")).alias("recommendation"),
            (F.col("o_totalprice") > 250000).alias("escalation_needed"),
            (F.col("c_acctbal") / 10000).alias("extraction_confidence"),
            F.concat(F.lit("order "), key).alias("summary"),
            F.concat_ws(" ", "n_name", "o_orderpriority", "c_mktsegment").alias("raw_text"),
        )
    )


def frame(spark: SparkSession, sf: str, month: str | None = None) -> DataFrame:
    return m.load_frame(interventions(spark, sf), month)


_CAUSES = ", ".join(f"'{c}'" for c in schemas.ROOT_CAUSE_CLASSES)
IV = f"""WITH iv AS (
  SELECT o_orderkey AS intervention_id, 'PLANT-' || n_regionkey AS plant, 'EQ-' || o_custkey AS equipment_tag,
    o_orderdate AS reported_at, strftime(o_orderdate, '%Y-%m') AS month, c_mktsegment AS machine_type,
    n_name AS component, o_orderpriority AS failure_category, [{_CAUSES}][o_orderkey % 10 + 1] AS root_cause_class,
    CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'temporary_fix' ELSE 'not_resolved' END AS resolution,
    CASE WHEN o_totalprice > 300000 THEN 'high' ELSE 'low' END AS severity,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 1000) AS INTEGER) END AS downtime_minutes,
    o_orderkey % 3 = 0 AS planned_work,
    CASE WHEN o_orderkey % 4 = 0 THEN [] ELSE [n_name, c_mktsegment] END AS parts_replaced,
    c_acctbal > 5000 AS recurring,
    CASE WHEN o_orderkey % 4 = 1 THEN '  ' ELSE 'check ' || o_orderpriority END AS recommendation,
    o_totalprice > 250000 AS escalation_needed, c_acctbal / 10000 AS extraction_confidence,
    'order ' || o_orderkey AS summary, n_name || ' ' || o_orderpriority || ' ' || c_mktsegment AS raw_text
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
cur AS (SELECT * FROM iv WHERE month = '{MONTH}')
"""


def _top_sql(source: str, column: str, limit: int) -> str:
    return IV + f"""SELECT {column} AS value, count(*) AS count,
    round_even(count(*) / (SELECT count(*) FROM {source}) * 100, 1) AS share_pct
    FROM {source} GROUP BY 1 ORDER BY count DESC, value LIMIT {limit}"""


def _downtime_sql(column: str) -> str:
    return IV + f"""SELECT {column} AS value, CAST(coalesce(sum(downtime_minutes), 0) AS BIGINT) AS total_downtime_minutes,
    round_even(avg(downtime_minutes), 1) AS avg_downtime_minutes, count(downtime_minutes) AS interventions
    FROM iv GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""


for _column, _limit in [
    ("failure_category", 5), ("root_cause_class", 5), ("machine_type", 5), ("component", 8),
    ("resolution", 5), ("severity", 5),
]:
    query("A10 F4 S4", _top_sql("cur", _column, _limit), name=f"top_{_column}_of_month")(
        lambda spark, sf, c=_column, n=_limit: m.top_counts(frame(spark, sf, MONTH), c, n)
    )

for _column in ("equipment_tag", "failure_category"):
    query("A11 F3", _downtime_sql(_column), name=f"downtime_by_{_column}")(
        lambda spark, sf, c=_column: m.downtime_by(frame(spark, sf), c)
    )


@query(
    "A12 D1",
    IV + """SELECT equipment_tag, failure_category, count(*) AS events,
    CAST(coalesce(sum(downtime_minutes), 0) AS BIGINT) AS total_downtime_minutes,
    count(*) FILTER (resolution IS DISTINCT FROM 'resolved') AS still_open_or_temporary,
    array_to_string(list_sort(list_distinct(list(root_cause_class))), ',') AS root_cause_classes
    FROM iv GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def repeat_offenders(spark: SparkSession, sf: str) -> DataFrame:
    found = m.repeat_offenders(frame(spark, sf), 3)
    return found.withColumn("root_cause_classes", F.array_join("root_cause_classes", ","))


def _headline_sql(month: str) -> str:
    return IV + f"""SELECT '{month}' AS month, count(*) AS interventions,
    CASE WHEN count(*) > 0 THEN count(*) FILTER (NOT planned_work) END AS unplanned_interventions,
    CASE WHEN count(*) > 0 THEN count(*) FILTER (planned_work) END AS planned_interventions,
    CASE WHEN count(*) > 0 THEN CAST(coalesce(sum(downtime_minutes), 0) AS BIGINT) END AS total_downtime_minutes,
    CASE WHEN count(*) > 0 THEN CAST(coalesce(sum(downtime_minutes) FILTER (NOT planned_work), 0) AS BIGINT) END
      AS unplanned_downtime_minutes,
    round_even(avg(downtime_minutes), 1) AS avg_downtime_minutes,
    CASE WHEN count(*) > 0 THEN count(*) - count(downtime_minutes) END AS interventions_missing_downtime,
    round_even(count(*) FILTER (recurring) / nullif(count(*), 0) * 100, 1) AS recurring_share_pct,
    CASE WHEN count(*) > 0 THEN count(*) FILTER (escalation_needed) END AS escalations_requested,
    CASE WHEN count(*) > 0 THEN count(*) FILTER (extraction_confidence < 0.6) END AS low_confidence_extractions,
    CASE WHEN count(*) = 0 THEN 'No records for this month.' END AS note
    FROM iv WHERE month = '{month}'"""


@query("A13 F4 F5", _headline_sql(MONTH))
def maintenance_headline(spark: SparkSession, sf: str) -> DataFrame:
    return m.headline(frame(spark, sf, MONTH), MONTH)


@query("A13", _headline_sql("1980-01"))
def maintenance_headline_empty_month(spark: SparkSession, sf: str) -> DataFrame:
    return m.headline(frame(spark, sf, "1980-01"), "1980-01")


@query(
    "F5",
    IV + "SELECT intervention_id, equipment_tag, resolution, summary, recommendation FROM cur"
    " WHERE resolution IS DISTINCT FROM 'resolved'",
)
def open_interventions(spark: SparkSession, sf: str) -> DataFrame:
    return m.open_items(frame(spark, sf, MONTH))


@query(
    "F6",
    IV + "SELECT intervention_id, equipment_tag, recommendation, escalation_needed FROM iv WHERE trim(recommendation) <> ''",
)
def technician_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return m.recommendations(frame(spark, sf))


@query(
    "A14 X26 D3",
    IV + """SELECT part, count(*) AS count FROM (SELECT unnest(parts_replaced) AS part FROM iv)
    GROUP BY part ORDER BY count DESC, part LIMIT 8""",
)
def replaced_parts(spark: SparkSession, sf: str) -> DataFrame:
    return m.parts_replaced(frame(spark, sf))


_MOM = IV + """, mon AS (SELECT month, count(*) AS n, CAST(coalesce(sum(downtime_minutes), 0) AS BIGINT) AS d
    FROM iv GROUP BY month),
  linked AS (SELECT month, n AS interventions, d AS downtime_minutes, lag(month) OVER w AS previous_month,
    lag(n) OVER w AS previous_interventions, lag(d) OVER w AS previous_downtime_minutes FROM mon WINDOW w AS (ORDER BY month))
"""


@query(
    "W8 X1 X13",
    _MOM + """SELECT *, CASE WHEN previous_interventions <> 0 THEN round_even((interventions - previous_interventions)
    / previous_interventions * 100, 1) END AS interventions_change_pct,
    CASE WHEN previous_downtime_minutes <> 0 THEN round_even((downtime_minutes - previous_downtime_minutes)
    / previous_downtime_minutes * 100, 1) END AS downtime_minutes_change_pct FROM linked""",
)
def month_over_month(spark: SparkSession, sf: str) -> DataFrame:
    return m.month_over_month(frame(spark, sf))


@query(
    "U1",
    _MOM + """, seen AS (SELECT DISTINCT month, equipment_tag AS value FROM iv),
  link AS (SELECT month, previous_month FROM linked WHERE previous_month IS NOT NULL),
  now AS (SELECT l.month, value FROM seen s JOIN link l ON s.month = l.month),
  old AS (SELECT l.month, value FROM seen s JOIN link l ON s.month = l.previous_month)
  SELECT month, value, 'new' AS change FROM (SELECT * FROM now EXCEPT SELECT * FROM old)
  UNION ALL SELECT month, value, 'resolved' FROM (SELECT * FROM old EXCEPT SELECT * FROM now)""",
)
def equipment_turnover(spark: SparkSession, sf: str) -> DataFrame:
    return m.category_turnover(frame(spark, sf), "equipment_tag")


@query("A27", IV + "SELECT DISTINCT month FROM iv")
def available_months(spark: SparkSession, sf: str) -> DataFrame:
    return m.available_months(frame(spark, sf))


@query(
    "F14",
    IV + "SELECT intervention_id, raw_text, summary, component, resolution FROM iv WHERE intervention_id IN (7, 77, 777)",
)
def inspect_interventions(spark: SparkSession, sf: str) -> DataFrame:
    found = m.inspect(interventions(spark, sf), [7, 77, 777])
    out = F.from_json("structured", "summary string, component string, resolution string")
    return found.select("intervention_id", "raw_text", out.alias("r")).select("intervention_id", "raw_text", "r.*")


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Extraction payloads as JSON; some carry words outside the vocabularies or are cut off."""
    rows = interventions(spark, sf)
    key = F.col("intervention_id")
    word = lambda levels: F.element_at(F.array(*map(F.lit, levels)), (key % len(levels) + 1).cast("int"))
    body = F.to_json(
        F.struct(
            "summary",
            word(schemas.MACHINE_TYPES).alias("machine_type"),
            "component",
            F.when(key % 7 == 0, "unheard_of").otherwise(word(schemas.FAILURE_CATEGORIES)).alias("failure_category"),
            "root_cause_class",
            F.lit("").alias("root_cause_detail"),
            F.col("raw_text").alias("action_taken"),
            "resolution",
            "severity",
            "downtime_minutes",
            "planned_work",
            F.array("component").alias("parts_replaced"),
            "recurring",
            "recommendation",
            "escalation_needed",
            "extraction_confidence",
        )
    )
    return rows.select(
        key, "equipment_tag", F.when(key % 11 == 0, F.substring(body, 1, 40)).otherwise(body).alias("payload")
    )


_FAIL = """(intervention_id % 7 = 0 OR intervention_id % 11 = 0 OR extraction_confidence < 0 OR extraction_confidence > 1)"""


@query(
    "C7",
    IV + f"""SELECT intervention_id, CASE WHEN {_FAIL} THEN 'failed' ELSE 'structured' END AS status,
    CASE WHEN NOT {_FAIL} THEN resolution END AS resolution,
    NOT {_FAIL} AND extraction_confidence < 0.6 AS low_confidence FROM iv""",
)
def validated_interventions(spark: SparkSession, sf: str) -> DataFrame:
    checked = m.validate_payloads(payloads(spark, sf), "payload")
    return checked.select("intervention_id", "status", "resolution", "low_confidence")


@query(
    "A26 J9",
    IV + f""", seen AS (SELECT * , EXISTS (SELECT 1 FROM events WHERE event_id = intervention_id AND event_type = 'error')
      AS stored FROM iv)
    SELECT count(*) AS total, count(*) FILTER (NOT stored AND NOT {_FAIL}) AS structured,
    count(*) FILTER (stored) AS skipped, count(*) FILTER (NOT stored AND {_FAIL}) AS failed,
    count(*) FILTER (NOT stored AND NOT {_FAIL} AND extraction_confidence < 0.6) AS low_confidence FROM seen""",
)
def structuring_counts(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "events").where("event_type = 'error'").select(F.col("event_id").alias("intervention_id"))
    return m.structuring_counts(m.validate_payloads(payloads(spark, sf), "payload"), stored, "intervention_id")


@query(
    "X26 D3",
    """SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS events
    FROM events GROUP BY 1, 2""",
)
def event_property_counts(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("k", F.from_json("props", "k int").getField("k"))
    return events.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("events"))
