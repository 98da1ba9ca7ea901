"""Pricing of purchase orders, and sent orders applied to stock on order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import half_even
from millrace.sources.schemas import ORDER_LINES


def price_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Order lines (order_id, line_no, sku, cases) with prices, or with the reason they fail."""
    goods = products.select(
        "sku", "name", "unit", "units_per_case", "min_order_quantity", "case_price_eur", "preferred_supplier_id",
        F.lit(True).alias("__known"),
    )
    asked = F.coalesce(F.col("cases"), F.lit(0)).cast("bigint")
    minimum = F.coalesce(F.nullif("min_order_quantity", F.lit(0)), F.lit(1))
    error = (
        F.when(F.col("__known").isNull(), F.concat(F.lit("Unknown SKU '"), "sku", F.lit("'.")))
        .when(F.col("preferred_supplier_id").isNull(), F.concat("name", F.lit(" has no registered supplier.")))
        .when(
            asked <= 0,
            F.concat(F.lit("Quantity for "), "sku", F.lit(" must be a positive number of cases.")),
        )
    )
    price = F.coalesce(F.col("case_price_eur"), F.lit(0.0))
    per_case = F.coalesce(F.nullif("units_per_case", F.lit(0)), F.lit(1))
    return (
        lines.withColumn("sku", F.trim("sku"))
        .join(goods, "sku", "left")
        .withColumn("error", error)
        .withColumn("cases", F.when(F.col("error").isNull(), F.greatest(asked, minimum)))
        .select(
            "order_id",
            "line_no",
            "sku",
            F.col("name").alias("product"),
            "cases",
            (F.col("cases") * per_case).alias("quantity"),
            "unit",
            F.when(F.col("error").isNull(), price).alias("case_price_eur"),
            half_even(F.col("cases") * price, 2).alias("line_total_eur"),
            "preferred_supplier_id",
            "error",
        )
    )


def price_orders(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Total per order, or the first line error, or the refusal of several suppliers."""
    priced = price_lines(lines, products)
    failed = F.col("error").isNotNull()
    totals = priced.groupBy("order_id").agg(
        F.min_by(F.when(failed, F.col("error")), F.when(failed, F.col("line_no"))).alias("first_error"),
        F.min("preferred_supplier_id").alias("low"),
        F.max("preferred_supplier_id").alias("high"),
        F.count(F.lit(1)).alias("lines"),
        F.sum("line_total_eur").alias("total"),
    )
    # One supplier exactly when smallest and largest agree; no distinct set is kept.
    error = F.coalesce(
        F.col("first_error"),
        F.when(
            F.col("low") != F.col("high"),
            "Items span more than one supplier. Create one purchase order per supplier.",
        ),
    )
    fine = error.isNull()
    return totals.select(
        "order_id",
        "lines",
        F.when(fine, F.col("low")).alias("supplier_id"),
        F.when(fine, half_even(F.col("total"), 2)).alias("total_eur"),
        F.when(fine, "draft").otherwise("refused").alias("status"),
        error.alias("error"),
    )


def apply_sent_orders(stock: DataFrame, orders: DataFrame, already_sent: DataFrame) -> DataFrame:
    """Stock per sku with the quantities of newly sent orders added to what is on order.

    An order that was sent before is refused, so it cannot count twice.
    """
    fresh = orders.join(already_sent.select("po_number"), "po_number", "left_anti")
    added = (
        fresh.select(F.explode(F.from_json("lines_json", ORDER_LINES)).alias("line"))
        .groupBy(F.col("line.sku").alias("sku"))
        .agg(F.sum("line.quantity").alias("added"))
    )
    return (
        stock.join(added, "sku", "left")
        .withColumn(
            "on_order",
            F.coalesce("on_order", F.lit(0.0)) + F.coalesce(F.col("added").cast("double"), F.lit(0.0)),
        )
        .drop("added")
    )
