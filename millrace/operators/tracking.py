"""Shipment and order lookups for whole tables of requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import contains_fold, half_even, hours_between
from millrace.operators.planning import lane_key
from millrace.operators.prefix import grouped_quantiles
from millrace.session import stage

MIN_LANE_HISTORY = 5

# The sentences of the order lookup.
ORDER_FOUND = (
    "Order %s for %s is currently in '%s' status. Shipping address: %s. Estimated delivery date: %s."
)
ORDER_MISSING = (
    "Sorry, no order found with the number '%s' in the system. Please verify the order number."
)


def order_status(requests: DataFrame, orders: DataFrame) -> DataFrame:
    """One sentence per requested order number; orders are unique by number."""
    date = F.coalesce(F.date_format("estimated_delivery", "yyyy-MM-dd"), F.lit("Unknown"))
    found = F.format_string(
        ORDER_FOUND,
        F.col("order_number"),
        F.col("customer_name"),
        F.col("status"),
        F.col("shipping_address"),
        date,
    )
    known = orders.withColumn("__found", F.lit(True))
    return requests.join(known, "order_number", "left").select(
        "order_number",
        F.when(F.col("__found"), found)
        .otherwise(F.format_string(ORDER_MISSING, F.col("order_number")))
        .alias("answer"),
    )


def history_cells(delivered: DataFrame) -> DataFrame:
    """Counts and sums per warehouse, store, carrier and transit time, stored once.

    They add up to every coarser grain, lane, carrier, warehouse and all, so the
    deliveries are read once however many grains are asked for. The table has no more
    rows than ``delivered``, and far fewer where transit times repeat.
    """
    transit, late = F.col("actual_transit_days"), (F.col("actual_arrival_ts") > F.col("promised_ts")).cast("double")
    cells = delivered.groupBy("origin_warehouse", "destination_store", "carrier", "actual_transit_days").agg(
        F.count(F.lit(1)).alias("cell_rows"),
        F.count(transit).alias("timed"),
        F.sum(transit).alias("days"),
        F.count(late).alias("judged"),
        F.sum(late).alias("late"),
    )
    return stage(cells, "cells")


def lane_history(cells: DataFrame) -> DataFrame:
    """Shipment count and exact median transit per lane, from ``history_cells``."""
    lanes = cells.withColumn(
        "lane", lane_key(F.col("origin_warehouse"), F.col("destination_store"))
    ).where(F.col("lane").isNotNull())
    rows = F.col("cell_rows")
    return grouped_quantiles(
        lanes, ["lane"], "actual_transit_days", {"lane_median": 0.5}, {"lane_shipments": rows}, weight=rows
    ).select("lane", "lane_median", "lane_shipments")


def overall_median(cells: DataFrame) -> Column:
    """The median transit of all deliveries, as a scalar subquery."""
    found = grouped_quantiles(cells, [], "actual_transit_days", {"m": 0.5}, weight=F.col("cell_rows"))
    return found.select("m").scalar()


def group_history(cells: DataFrame, key: str, prefix: str) -> DataFrame:
    """Mean transit and late rate per carrier or warehouse over all history, from ``history_cells``."""
    return (
        cells.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.try_divide(F.sum("days"), F.sum("timed")).alias(f"{prefix}_hist_mean_transit"),
            F.try_divide(F.sum("late"), F.sum("judged")).alias(f"{prefix}_hist_late_rate"),
        )
    )


def with_history(live: DataFrame, delivered: DataFrame) -> DataFrame:
    """Live rows with lane, carrier and warehouse history; unseen lanes take the overall median."""
    cells = history_cells(delivered)
    warehouse = group_history(cells, "origin_warehouse", "warehouse").drop("warehouse_hist_late_rate")
    return (
        live.withColumn("lane", lane_key(F.col("origin_warehouse"), F.col("destination_store")))
        .join(lane_history(cells), "lane", "left")
        .join(group_history(cells, "carrier", "carrier"), "carrier", "left")
        .join(warehouse, "origin_warehouse", "left")
        .withColumn("overall_median", overall_median(cells))
        .withColumn("lane_hist_median_transit", F.coalesce("lane_median", "overall_median"))
        .withColumn("lane_hist_shipments", F.coalesce("lane_shipments", F.lit(0)))
    )


def predict_arrivals(live: DataFrame, delivered: DataFrame) -> DataFrame:
    """Predicted arrival from lane history (5 shipments or more) or the overall median."""
    cells = history_cells(delivered)
    lanes = lane_history(cells)
    days = F.when(F.col("lane_shipments") >= MIN_LANE_HISTORY, F.col("lane_median")).otherwise(
        F.col("overall_median")
    )
    rows = (
        live.withColumn("lane", lane_key(F.col("origin_warehouse"), F.col("destination_store")))
        .join(lanes, "lane", "left")
        .withColumn("overall_median", overall_median(cells))
        .withColumn("days", days)
        .withColumn(
            "predicted_ts", F.col("dispatch_ts") + F.make_dt_interval(secs=F.col("days") * 86400)
        )
    )
    delay = hours_between(F.col("predicted_ts"), F.col("promised_ts"))
    return rows.select(
        *live.columns,
        F.date_format("predicted_ts", "yyyy-MM-dd HH:mm").alias("predicted_arrival"),
        half_even(F.col("days"), 2).alias("predicted_transit_days"),
        F.date_format("promised_ts", "yyyy-MM-dd HH:mm").alias("promised_arrival"),
        half_even(delay, 1).alias("projected_delay_hours"),
        (delay > 0).alias("projected_to_miss_promise"),
    )


def track_shipments(requests: DataFrame, live: DataFrame, delivered: DataFrame) -> DataFrame:
    """Per identifier (shipment or order id): the live row, else the delivered row, else an error.

    An order with several shipments gives the one with the smallest shipment id.
    """
    columns = ["shipment_id", "order_id", "status", "destination_store", "carrier", "promised_ts", "actual_arrival_ts"]

    known = live.select(F.lit(0).alias("level"), *columns).unionByName(delivered.select(F.lit(1).alias("level"), *columns))
    entry = F.struct("level", *columns).alias("entry")
    first = F.min_by("entry", F.struct("entry.level", "entry.shipment_id")).alias("entry")
    asked = requests.select("identifier", F.upper(F.trim("identifier")).alias("needle"))
    needles = asked.select("needle").distinct()
    # An order's rows become one before they move; shipments move once, by their own id.
    by_order = known.select(F.col("order_id").alias("needle"), entry).groupBy("needle").agg(first).join(needles, "needle")
    by_shipment = known.select(F.col("shipment_id").alias("needle"), entry).join(needles, "needle", "left_semi")
    best = by_order.unionByName(by_shipment).groupBy("needle").agg(first)
    done = F.col("entry.level") == 1
    late = F.col("entry.actual_arrival_ts") > F.col("entry.promised_ts")
    hours = hours_between(F.col("entry.actual_arrival_ts"), F.col("entry.promised_ts"))
    return asked.join(best, "needle", "left").select(
        "identifier",
        F.col("entry.shipment_id").alias("shipment_id"),
        F.when(F.col("entry").isNull(), "not found")
        .when(done, "delivered")
        .otherwise(F.col("entry.status"))
        .alias("status"),
        F.col("entry.destination_store").alias("destination_store"),
        F.col("entry.carrier").alias("carrier"),
        F.when(done, F.date_format("entry.actual_arrival_ts", "yyyy-MM-dd HH:mm")).alias("delivered_at"),
        F.date_format("entry.promised_ts", "yyyy-MM-dd HH:mm").alias("promised_at"),
        F.when(done, late).alias("was_late"),
        F.when(done, half_even(hours, 1)).alias("delay_hours"),
    )


def search_shipments(live: DataFrame, stores: DataFrame, store_or_region: str = "", status: str = "") -> DataFrame:
    """Live shipments to a matching store, or whose own region matches."""
    hits = live
    if store_or_region.strip():
        text = store_or_region.strip()
        matched = stores.where(
            contains_fold(F.col("store_name"), text)
            | F.coalesce(F.upper("store_id") == text.upper(), F.lit(False))
            | contains_fold(F.col("region"), text)
        ).select(F.col("store_id").alias("destination_store"))
        own = contains_fold(F.col("region"), text)
        # The disjunction as two disjoint arms, so that neither needs a nested loop.
        hits = live.where(own).unionByName(
            live.where(~own).join(matched.distinct(), "destination_store", "left_semi").select(*live.columns)
        )
    if status.strip():
        hits = hits.where(F.col("status") == status.strip().lower())
    return hits


def find_shipments(
    live: DataFrame,
    delivered: DataFrame,
    stores: DataFrame,
    store_or_region: str = "",
    status: str = "",
    late_only: bool = False,
    limit: int = 25,
) -> DataFrame:
    """Matching live shipments by projected delay, capped, with the full match count."""
    rows = predict_arrivals(search_shipments(live, stores, store_or_region, status), delivered)
    if late_only:
        rows = rows.where("projected_to_miss_promise")
    matches = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        rows.orderBy(F.desc("projected_delay_hours"), "shipment_id").limit(limit).withColumn("matches", matches)
    )
