"""Supply chain, bound to order lines as shipments between nations."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import mapped
from millrace.operators import history, planning, tracking
from millrace.operators.prefix import range_edges
from millrace.plans.registry import query
from millrace.session import discard, stage, stage_at, stage_parts
from millrace.sources.readers import table

ORDER = ["dispatch_date", "order_seq", "shipment_id"]

# Transit factor of the service levels.
SERVICE_FACTORS = {"express": 0.72, "standard": 1.0, "economy": 1.35}


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    line, orders, customer, supplier, nation = (
        table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier", "nation")
    )
    origin = nation.select(F.col("n_nationkey").alias("from_key"), F.col("n_name").alias("origin_warehouse"))
    target = nation.select(
        F.col("n_nationkey").alias("to_key"),
        F.col("n_name").alias("destination_store"),
        F.concat(F.lit("REGION-"), "n_regionkey").alias("region"),
    )
    transit = F.make_dt_interval(days=F.col("l_quantity").cast("int"))
    # Orders get their store first, so that the lines, the largest table, move by order only.
    sent = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(target, F.col("c_nationkey") == F.col("to_key"))
    return (
        line.join(sent, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(origin, F.col("s_nationkey") == F.col("from_key"))
        .select(
            F.concat_ws("-", F.lit("SHP"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("shipment_id"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("order_seq"),
            F.concat(F.lit("ORD-"), "l_orderkey").alias("order_id"),
            "origin_warehouse",
            "destination_store",
            "region",
            F.concat(F.lit("CARRIER-"), F.col("l_suppkey")).alias("carrier"),
            F.when(F.col("l_returnflag") == "R", "express")
            .when(F.col("l_returnflag") == "A", "standard")
            .otherwise("economy")
            .alias("service_level"),
            F.col("l_quantity").cast("bigint").alias("units"),
            (F.col("l_extendedprice") / 1000).alias("weight_kg"),
            F.col("l_discount").alias("warehouse_load"),
            F.col("l_shipdate").alias("dispatch_ts"),
            (F.col("l_shipdate") + F.expr("INTERVAL 25 DAYS")).alias("promised_ts"),
            (F.col("l_shipdate") + transit).alias("actual_arrival_ts"),
            F.lit(25.0).alias("planned_transit_days"),
            F.col("l_quantity").alias("actual_transit_days"),
            F.when(F.col("l_linestatus") == "O", "in_transit").otherwise("delivered").alias("status"),
        )
    )


# What lanes and tracking read of a shipment.
LANE_COLUMNS = [
    "shipment_id", "origin_warehouse", "destination_store", "carrier", "units", "dispatch_ts", "promised_ts",
    "actual_arrival_ts", "actual_transit_days",
]
TRACKED_COLUMNS = [*LANE_COLUMNS, "order_id", "region", "status"]


def lane_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The joined shipments, stored once for the passes of lane statistics."""
    return stage(shipments(spark, sf).select(*LANE_COLUMNS), "lanes")


SHIP = """WITH ship AS (
  SELECT concat_ws('-', 'SHP', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS shipment_id,
    l_orderkey * 8 + l_linenumber AS order_seq, 'ORD-' || l_orderkey AS order_id, sn.n_name AS origin_warehouse,
    cn.n_name AS destination_store, 'REGION-' || cn.n_regionkey AS region, 'CARRIER-' || l_suppkey AS carrier,
    CASE l_returnflag WHEN 'R' THEN 'express' WHEN 'A' THEN 'standard' ELSE 'economy' END AS service_level,
    CAST(l_quantity AS BIGINT) AS units, l_shipdate AS dispatch_ts, l_shipdate + INTERVAL 25 DAYS AS promised_ts,
    l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS actual_arrival_ts, l_quantity AS actual_transit_days,
    CASE l_linestatus WHEN 'O' THEN 'in_transit' ELSE 'delivered' END AS status,
    sn.n_name || '->' || cn.n_name AS lane, l_quantity > 25 AS late
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
    JOIN nation cn ON c_nationkey = cn.n_nationkey)
"""

LANES = SHIP + """, lanes AS (SELECT lane, carrier, count(*) AS shipments,
    round_even(quantile_cont(actual_transit_days, 0.5), 2) AS median_transit_days,
    round_even(quantile_cont(actual_transit_days, 0.9), 2) AS p90_transit_days,
    round_even((1 - count(*) FILTER (late) / count(*)) * 100, 1) AS on_time_rate_pct,
    round_even(CAST(sum(units) AS BIGINT) / count(*), 0) AS avg_units, count(*) >= 20 AS sufficient_volume
  FROM ship WHERE dispatch_ts >= (SELECT max(dispatch_ts) FROM ship) - INTERVAL 90 DAYS GROUP BY lane, carrier)
"""


@query("A15 T2 X13 X19 X29 F18 X10", LANES + "SELECT * FROM lanes")
def lane_performance(spark: SparkSession, sf: str) -> DataFrame:
    return planning.lane_performance(lane_rows(spark, sf))


@query(
    "F10 T6",
    LANES + """, hit AS (SELECT * FROM lanes WHERE shipments >= 1 AND (lane ILIKE '%nation_1%' OR carrier ILIKE '%nation_1%'))
    SELECT lane, carrier, shipments, median_transit_days, p90_transit_days, on_time_rate_pct, avg_units,
      (SELECT count(*) FROM hit) AS matches FROM hit ORDER BY on_time_rate_pct, shipments DESC, lane, carrier LIMIT 15""",
)
def find_lanes(spark: SparkSession, sf: str) -> DataFrame:
    # Lanes by nation and carrier rarely reach the floor at test scale; the floor is lifted here.
    lanes = planning.lane_performance(lane_rows(spark, sf)).withColumn("sufficient_volume", F.lit(True))
    return planning.find_lanes(lanes, "nation_1", worst=True)


# Rows of a slice of keys whose shuffle is on disk at a time, and the most slices.
SLICE_ROWS, MOST_SLICES = 2_000_000, 8

_PRIOR = "(PARTITION BY {k} ORDER BY dispatch_ts, order_seq, shipment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _features(spark: SparkSession, sf: str, more: Mapping[str, Column] | None = None) -> tuple[DataFrame, str]:
    """History features and the folder they are read from; what a row gives by itself is added last, so that it does not move.

    Each step is stored without the keys that no later one needs, slice by slice of its keys, and the table
    before it is deleted: the disk holds one step's rows and one slice's shuffle at a time. ``more``
    names columns of the shipments to keep.
    """
    more = dict(more or {})
    rows = shipments(spark, sf).withColumn(
        "lane", planning.lane_key(F.col("origin_warehouse"), F.col("destination_store"))
    )
    transit = F.col("actual_transit_days")
    own = [
        "shipment_id", "order_seq", "carrier", "lane", "origin_warehouse", "dispatch_date", "service_level", "actual_transit_days", "was_late",
    ]
    base, spent = stage_at(
        rows.withColumn("dispatch_date", F.to_date("dispatch_ts"))
        .withColumn("was_late", (F.col("actual_arrival_ts") > F.col("promised_ts")).cast("double"))
        .select(*own, *[c.alias(n) for n, c in more.items() if n not in own]),
        "shipments", "zstd",
    )
    # One sketch of the order serves all three steps.
    edges = range_edges(base, ORDER[:2])
    first = F.lit(base.agg(F.min("dispatch_date")).first()[0])

    slices = max(1, min(MOST_SLICES, -(-base.count() // SLICE_ROWS)))

    def stored(rows: DataFrame, key: str, label: str, step: Callable[[DataFrame], DataFrame], *done: str) -> DataFrame:
        nonlocal spent
        at = F.pmod(F.xxhash64(key), F.lit(slices))
        kept, path = stage_parts((step(rows.where(at == k) if slices > 1 else rows).drop(*done) for k in range(slices)), label, "zstd")
        discard(spark, spent)
        spent = path
        return kept

    rows = stored(base, "lane", "lane_history", lambda part: history.prior_median(
        part, ["lane"], ORDER, "actual_transit_days", "lane_hist_median_transit", count="lane_hist_shipments", edges=edges
    ), "lane")
    means = {"warehouse_hist_mean_transit": transit}
    rows = stored(
        rows, "origin_warehouse", "warehouse_history",
        lambda part: history.prior_stats(part, ["origin_warehouse"], ORDER, means=means, edges=edges),
        *([] if "origin_warehouse" in more else ["origin_warehouse"]),
    )
    both = {"carrier_hist_mean_transit": transit, "carrier_hist_late_rate": F.col("was_late")}
    rows = stored(
        rows, "carrier", "carrier_history",
        lambda part: history.prior_stats(part, ["carrier"], ORDER, means=both, edges=edges), "order_seq", "was_late",
    )
    rows = history.calendar_columns(rows, "dispatch_date").withColumn("service_level_factor", mapped(F.col("service_level"), SERVICE_FACTORS, 1.0))
    return history.warmup_flag(rows, "dispatch_date", first=first), spent


@query(
    "W1 W3 W4 W5 X2 X3 X4 X18 D2",
    SHIP + f"""SELECT shipment_id, CAST(dispatch_ts AS DATE) AS dispatch_date, isodow(dispatch_ts) - 1 AS dispatch_dow,
    month(dispatch_ts) AS dispatch_month, CAST(month(dispatch_ts) IN (11, 12) AS INTEGER) AS is_peak_season,
    CAST(month(dispatch_ts) IN (1, 2) AS INTEGER) AS is_weather_season,
    CAST(isodow(dispatch_ts) >= 6 AS INTEGER) AS is_weekend_dispatch,
    CASE service_level WHEN 'express' THEN 0.72 WHEN 'standard' THEN 1.0 ELSE 1.35 END::DOUBLE AS service_level_factor,
    avg(actual_transit_days) OVER {_PRIOR.format(k='carrier')} AS carrier_hist_mean_transit,
    avg(CAST(late AS INTEGER)) OVER {_PRIOR.format(k='carrier')} AS carrier_hist_late_rate,
    avg(actual_transit_days) OVER {_PRIOR.format(k='origin_warehouse')} AS warehouse_hist_mean_transit,
    count(*) OVER {_PRIOR.format(k='lane')} AS lane_hist_shipments,
    quantile_cont(actual_transit_days, 0.5) OVER {_PRIOR.format(k='lane')} AS lane_hist_median_transit,
    CAST(dispatch_ts AS DATE) < CAST((SELECT min(dispatch_ts) FROM ship) AS DATE) + 60 AS in_warmup FROM ship""",
)
def shipment_features(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf)[0].select(
        "shipment_id", "dispatch_date", "dispatch_dow", "dispatch_month", "is_peak_season", "is_weather_season",
        "is_weekend_dispatch", "service_level_factor",
        "carrier_hist_mean_transit", "carrier_hist_late_rate", "warehouse_hist_mean_transit",
        "lane_hist_shipments", "lane_hist_median_transit", "in_warmup",
    )


@query(
    "W2 H3",
    SHIP + f"""SELECT shipment_id, quantile_cont(actual_transit_days, 0.5) OVER {_PRIOR.format(k='carrier')}
    AS prior_median FROM ship""",
)
def carrier_prior_median(spark: SparkSession, sf: str) -> DataFrame:
    rows = shipments(spark, sf).withColumn("dispatch_date", F.to_date("dispatch_ts")).select(
        "shipment_id", "order_seq", "dispatch_date", "carrier", "actual_transit_days"
    )
    ran = history.prior_median(stage(rows, "shipments"), ["carrier"], ORDER, "actual_transit_days", "prior_median")
    return ran.select("shipment_id", "prior_median")


@query(
    "F16 W5",
    SHIP + """SELECT CAST(dispatch_ts AS DATE) AS dispatch_date, count(*) AS usable FROM ship
    WHERE CAST(dispatch_ts AS DATE) >= CAST((SELECT min(dispatch_ts) FROM ship) AS DATE) + 60
      AND actual_transit_days IS NOT NULL GROUP BY 1""",
)
def usable_shipments_by_day(spark: SparkSession, sf: str) -> DataFrame:
    rows = history.warmup_flag(
        shipments(spark, sf).withColumn("dispatch_date", F.to_date("dispatch_ts")), "dispatch_date"
    )
    usable = rows.where(~F.col("in_warmup") & F.col("actual_transit_days").isNotNull())
    return usable.groupBy("dispatch_date").agg(F.count(F.lit(1)).alias("usable"))


def tracked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Live and delivered shipments, out of one stored join."""
    rows = stage(shipments(spark, sf).select(*TRACKED_COLUMNS), "tracked")
    live = rows.where("status = 'in_transit'").drop("actual_arrival_ts", "actual_transit_days").withColumn(
        "actual_arrival_ts", F.lit(None).cast("timestamp_ntz")
    )
    return live, rows.where("status = 'delivered'")


def stores(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("store_id"),
        F.concat(F.lit("Store "), "n_name").alias("store_name"),
        F.col("r_name").alias("region"),
        F.concat(F.lit("WH-"), "r_regionkey").alias("default_warehouse"),
    )


LIVE = SHIP + """, live AS (SELECT * FROM ship WHERE status = 'in_transit'), done AS (SELECT * FROM ship WHERE status = 'delivered'),
  lane_hist AS (SELECT lane, quantile_cont(actual_transit_days, 0.5) AS m, count(*) AS n FROM done GROUP BY lane),
  overall AS (SELECT quantile_cont(actual_transit_days, 0.5) AS m FROM done),
  predicted AS (SELECT live.*, CASE WHEN h.n >= 5 THEN h.m ELSE o.m END AS days
    FROM live LEFT JOIN lane_hist h USING (lane) CROSS JOIN overall o),
  timed AS (SELECT *, dispatch_ts + to_seconds(days * 86400) AS eta,
    date_diff('second', promised_ts, dispatch_ts + to_seconds(days * 86400)) / 3600 AS hours FROM predicted)
"""
_PREDICTED = """shipment_id, strftime(eta, '%Y-%m-%d %H:%M') AS predicted_arrival, round_even(days, 2) AS predicted_transit_days,
  strftime(promised_ts, '%Y-%m-%d %H:%M') AS promised_arrival, round_even(hours, 1) AS projected_delay_hours,
  hours > 0 AS projected_to_miss_promise"""
_PREDICTED_COLUMNS = [
    "shipment_id", "predicted_arrival", "predicted_transit_days", "promised_arrival", "projected_delay_hours",
    "projected_to_miss_promise",
]


@query("M26 X5 X9", LIVE + f"SELECT {_PREDICTED} FROM timed")
def predicted_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    return tracking.predict_arrivals(*tracked(spark, sf)).select(*_PREDICTED_COLUMNS)


@query(
    "J15",
    LIVE + """, carr AS (SELECT carrier, avg(actual_transit_days) AS m, avg(CAST(late AS INTEGER)) AS r FROM done GROUP BY 1),
  ware AS (SELECT origin_warehouse, avg(actual_transit_days) AS m FROM done GROUP BY 1)
  SELECT shipment_id, coalesce(h.m, o.m) AS lane_hist_median_transit, coalesce(h.n, 0) AS lane_hist_shipments,
    c.m AS carrier_hist_mean_transit, c.r AS carrier_hist_late_rate, w.m AS warehouse_hist_mean_transit
  FROM live LEFT JOIN lane_hist h USING (lane) LEFT JOIN carr c USING (carrier) LEFT JOIN ware w USING (origin_warehouse)
    CROSS JOIN overall o""",
)
def live_history_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = tracking.with_history(*tracked(spark, sf))
    return rows.select(
        "shipment_id", "lane_hist_median_transit", "lane_hist_shipments",
        "carrier_hist_mean_transit", "carrier_hist_late_rate", "warehouse_hist_mean_transit",
    )


@query(
    "F9 J8 T6 X20",
    LIVE + f""", hit AS (SELECT {_PREDICTED}, destination_store, carrier FROM timed WHERE
      (region ILIKE '%asia%' OR destination_store IN (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey
        WHERE r_name ILIKE '%asia%' OR 'Store ' || n_name ILIKE '%asia%' OR upper(n_name) = 'ASIA')) AND hours > 0)
  SELECT *, (SELECT count(*) FROM hit) AS matches FROM hit ORDER BY projected_delay_hours DESC, shipment_id LIMIT 25""",
)
def find_late_shipments(spark: SparkSession, sf: str) -> DataFrame:
    found = tracking.find_shipments(
        *tracked(spark, sf), stores(spark, sf), "asia", late_only=True
    )
    return found.select(*_PREDICTED_COLUMNS, "destination_store", "carrier", "matches")


@query(
    "F12 X20",
    LIVE + """, asked AS (SELECT DISTINCT ' ord-' || event_id AS identifier FROM events),
  known AS (SELECT 0 AS level, order_id AS needle, * EXCLUDE (order_id) FROM live
    UNION ALL BY NAME SELECT 1 AS level, order_id AS needle, * EXCLUDE (order_id) FROM done),
  best AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY needle ORDER BY level, shipment_id) = 1)
  SELECT identifier, shipment_id, CASE WHEN shipment_id IS NULL THEN 'not found' WHEN level = 1 THEN 'delivered' ELSE status END AS status,
    destination_store, carrier, CASE WHEN level = 1 THEN strftime(actual_arrival_ts, '%Y-%m-%d %H:%M') END AS delivered_at,
    strftime(promised_ts, '%Y-%m-%d %H:%M') AS promised_at, CASE WHEN level = 1 THEN actual_arrival_ts > promised_ts END AS was_late,
    CASE WHEN level = 1 THEN round_even(date_diff('second', promised_ts, actual_arrival_ts) / 3600, 1) END AS delay_hours
  FROM asked LEFT JOIN best ON upper(trim(identifier)) = needle""",
)
def track_shipments(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "events").select(F.concat(F.lit(" ord-"), "event_id").alias("identifier")).distinct()
    return tracking.track_shipments(asked, *tracked(spark, sf))


@query(
    "F11",
    """SELECT order_number, CASE WHEN o_orderkey IS NULL THEN
      'Sorry, no order found with the number ''' || order_number || ''' in the system. Please verify the order number.'
    ELSE 'Order ' || order_number || ' for ' || c_name || ' is currently in ''' || o_orderstatus || ''' status. Shipping address: '
      || c_mktsegment || '. Estimated delivery date: ' || CASE WHEN o_orderstatus = 'P' THEN 'Unknown'
      ELSE strftime(o_orderdate, '%Y-%m-%d') END || '.' END AS answer
    FROM (SELECT 'ORD-' || (event_id * 3) AS order_number, event_id * 3 AS key FROM events)
    LEFT JOIN (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey) ON key = o_orderkey""",
)
def order_status(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "events").select(F.concat(F.lit("ORD-"), F.col("event_id") * 3).alias("order_number"))
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    known = orders.select(
        F.concat(F.lit("ORD-"), "o_orderkey").alias("order_number"),
        F.col("c_name").alias("customer_name"),
        F.col("o_orderstatus").alias("status"),
        F.col("c_mktsegment").alias("shipping_address"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("estimated_delivery"),
    )
    return tracking.order_status(asked, known)


def demand(spark: SparkSession, sf: str) -> DataFrame:
    line, supplier, nation = (table(spark, sf, t) for t in ("lineitem", "supplier", "nation"))
    return (
        line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(
            F.col("n_name").alias("store_id"),
            F.col("l_returnflag").alias("category"),
            F.to_date("l_shipdate").alias("sales_date"),
        )
        .agg(F.sum("l_quantity").cast("bigint").alias("units_sold"))
    )


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    return demand(spark, sf).groupBy("store_id", "category").agg(
        (F.sum("units_sold") % 900).alias("units_on_hand"), (F.count(F.lit(1)) % 70).alias("units_in_transit")
    )


DEMAND = """WITH demand AS (SELECT n_name AS store_id, l_returnflag AS category, CAST(l_shipdate AS DATE) AS sales_date,
    CAST(sum(l_quantity) AS BIGINT) AS units_sold
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3),
recent AS (SELECT * FROM demand WHERE sales_date > (SELECT max(sales_date) FROM demand) - 56),
lvl AS (SELECT store_id, category, avg(units_sold) AS level FROM recent GROUP BY 1, 2),
shape AS (SELECT isodow(sales_date) AS dow, avg(units_sold) / (SELECT avg(units_sold) FROM recent) AS f FROM recent GROUP BY 1),
fc AS (SELECT store_id, category, (SELECT max(sales_date) FROM demand) + CAST(i AS INTEGER) AS forecast_date, level
  FROM lvl CROSS JOIN range(1, 22) r(i)),
forecast AS (SELECT store_id, category, forecast_date,
  round_even(level * f * CASE WHEN month(forecast_date) IN (11, 12) THEN 1.45 ELSE 1.0 END::DOUBLE, 2) AS forecast_units, level
  FROM fc LEFT JOIN shape ON isodow(forecast_date) = dow)
"""


@query("P7 A17 J5 J6 X8 F18", DEMAND + "SELECT * REPLACE (round(level, 6) AS level) FROM forecast")
def store_demand_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return planning.demand_forecast(demand(spark, sf)).withColumn("level", F.round("level", 6))


COVER = DEMAND + """, inv AS (SELECT store_id, category, CAST(sum(units_sold) AS BIGINT) % 900 AS units_on_hand,
    count(*) % 70 AS units_in_transit FROM demand GROUP BY 1, 2),
daily AS (SELECT store_id, category, avg(forecast_units) AS d, sum(forecast_units) AS h FROM forecast GROUP BY 1, 2),
c0 AS (SELECT inv.*, d, h, units_on_hand + units_in_transit AS av,
    CASE WHEN d > 0 THEN round_even((units_on_hand + units_in_transit) / d, 1) END AS days_of_cover
  FROM inv LEFT JOIN daily USING (store_id, category)),
cover AS (SELECT c0.store_id, 'Store ' || n_name AS store_name, r_name AS region, 'WH-' || r_regionkey AS default_warehouse, category,
    units_on_hand, units_in_transit, round(d, 6) AS forecast_daily_units, days_of_cover,
    CASE WHEN days_of_cover <= 21 THEN DATE '2001-12-01' + CAST(floor(days_of_cover) AS INTEGER) END AS projected_stockout_date,
    CASE WHEN h IS NOT NULL THEN greatest(round_even(h - av, 0), 0) END AS shortfall_units,
    CASE WHEN days_of_cover IS NULL THEN 'ok' WHEN days_of_cover <= 3 THEN 'critical' WHEN days_of_cover <= 7 THEN 'high'
      WHEN days_of_cover <= 14 THEN 'medium' ELSE 'ok' END AS risk
  FROM c0 LEFT JOIN nation ON store_id = n_name LEFT JOIN region ON n_regionkey = r_regionkey)
"""


def cover(spark: SparkSession, sf: str) -> DataFrame:
    forecast = planning.demand_forecast(demand(spark, sf))
    found = planning.store_cover(
        inventory(spark, sf), stores(spark, sf), forecast, as_of=F.lit("2001-12-01").cast("date")
    )
    return found.withColumn("forecast_daily_units", F.round("forecast_daily_units", 6))


@query("P8 A16 J3 J4 X6 X12 X15", COVER + "SELECT * FROM cover")
def store_cover(spark: SparkSession, sf: str) -> DataFrame:
    return cover(spark, sf)


@query(
    "F10 T6",
    COVER + """, hit AS (SELECT * FROM cover WHERE (store_name ILIKE '%nation_1%' OR region ILIKE '%nation_1%')
      AND risk IN ('critical', 'high'))
    SELECT *, (SELECT count(*) FROM hit) AS matches FROM hit ORDER BY days_of_cover, store_id, category LIMIT 25""",
)
def find_store_cover(spark: SparkSession, sf: str) -> DataFrame:
    return planning.find_cover(cover(spark, sf), "nation_1")


@query(
    "A18",
    LANES.replace("WITH ship", COVER.replace("WITH demand", "WITH demand", 1) + ", ship")
    + """SELECT (SELECT count(*) FROM cover) AS store_cover_rows,
    (SELECT count(*) FROM cover WHERE risk IN ('critical', 'high')) AS at_risk_store_categories,
    count(*) AS lane_performance_rows, count(*) FILTER (shipments >= 2) AS lanes_with_sufficient_volume,
    min(on_time_rate_pct) FILTER (shipments >= 2) AS worst_measurable_lane_on_time_pct,
    round_even(quantile_cont(on_time_rate_pct, 0.5) FILTER (shipments >= 2), 1) AS median_measurable_lane_on_time_pct
    FROM lanes""",
)
def planning_summary(spark: SparkSession, sf: str) -> DataFrame:
    lanes = planning.lane_performance(lane_rows(spark, sf)).withColumn(
        "sufficient_volume", F.col("shipments") >= 2
    )
    return planning.view_summary(cover(spark, sf), lanes)
