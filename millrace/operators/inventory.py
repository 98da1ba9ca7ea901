"""Stock projection, order alerts, par levels and stock searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import contains_fold, half_even, mapped, whole_cases
from millrace.functions.text import sorted_list
from millrace.operators.containment import contained_in

# The window of alerts and the order of severities.
ACTION_WINDOW_DAYS = 7
SEVERITY_ORDER = {"critical": 0, "high": 1, "medium": 2}

# Days of cover held per product category.
PAR_COVER_DAYS = {
    "dry_goods": 21,
    "beverage": 18,
    "bakery": 1,
    "produce": 4,
    "salad": 3,
    "protein": 5,
    "chilled": 7,
}


def stock_rows(products: DataFrame, stock: DataFrame) -> DataFrame:
    return products.join(stock, products["id"] == stock["product_id"]).drop("product_id")


def _with_walk(rows: DataFrame, forecast: DataFrame) -> DataFrame:
    """Each stock row with its site's forecast days and the stock walked through them.

    A forecast is at most sixty days, so one array per site travels to the stock rows
    and nothing is shuffled by product.
    """
    days = forecast.groupBy("site_id").agg(
        F.array_sort(
            F.collect_list(F.struct("service_date", "predicted_covers", "is_closed"))
        ).alias("days")
    )
    rate = F.col("consumption_per_100_covers")
    used = F.transform(
        "days",
        lambda d: F.when(d["is_closed"], F.lit(0.0)).otherwise(d["predicted_covers"] * rate / F.lit(100.0)),
    )
    opening = F.coalesce(F.col("quantity_on_hand"), F.lit(0.0)) + F.coalesce(F.col("on_order"), F.lit(0.0))
    walked = F.aggregate(
        "used",
        F.struct(opening.alias("left"), F.array().cast("array<double>").alias("closing")),
        lambda acc, u: F.struct(
            (acc["left"] - u).alias("left"), F.concat(acc["closing"], F.array(acc["left"] - u)).alias("closing")
        ),
        lambda acc: acc["closing"],
    )
    joined = rows.join(days, "site_id").withColumn("used", used).withColumn("closing", walked)
    steps = F.transform(
        F.arrays_zip("days", "used", "closing"),
        lambda z: F.struct(
            z["days"]["service_date"].alias("service_date"),
            z["days"]["predicted_covers"].alias("predicted_covers"),
            half_even(z["used"], 2).alias("consumption"),
            half_even(z["closing"], 2).alias("closing_stock"),
        ),
    )
    return joined.withColumn("steps", steps).drop("days", "used", "closing")


def project_stock(rows: DataFrame, forecast: DataFrame) -> DataFrame:
    """One row per product, site and forecast day: consumption and closing stock."""
    return _with_walk(rows, forecast).select("site_id", "sku", F.inline("steps"))


def _first_out(steps: Column) -> Column:
    out = F.filter(steps, lambda s: s["closing_stock"] <= 0)
    return F.get(out, F.lit(0))["service_date"]


def first_stockouts(rows: DataFrame, forecast: DataFrame) -> DataFrame:
    walked = _with_walk(rows, forecast)
    return walked.select("site_id", "sku", _first_out(F.col("steps")).alias("stockout_date"))


def severity(days_to_order: Column, cover: Column) -> Column:
    return F.when(days_to_order <= 0, "critical").when(cover <= 3, "high").otherwise("medium")


def order_alerts(
    rows: DataFrame,
    suppliers: DataFrame,
    forecast: DataFrame,
    as_of: Column,
    horizon_days: int = 14,
    include_all: bool = False,
    action_window_days: int = ACTION_WINDOW_DAYS,
) -> DataFrame:
    """What must be ordered soon: stock-out, order-by date, capped quantity, cases, cost, severity."""
    named = suppliers.select(
        F.col("id").alias("preferred_supplier_id"),
        F.col("name").alias("supplier"),
        F.col("email").alias("supplier_email"),
    )
    walked = _with_walk(rows, forecast).join(named, "preferred_supplier_id", "left")
    shown = F.transform("steps", lambda s: s["consumption"])
    total = F.aggregate(shown, F.lit(0.0), lambda a, x: a + x)
    opened = F.size(F.filter(shown, lambda x: x > 0))
    measured = (
        walked.withColumn("stockout_date", _first_out(F.col("steps")))
        .withColumn("horizon_use", total)
        .withColumn("daily", F.coalesce(F.try_divide(total, opened), F.lit(0.0)))
        .withColumn("as_of", as_of)
        .withColumn("order_by_date", F.expr("date_sub(stockout_date, lead_time_days)"))
        .withColumn("days_to_order", F.datediff("order_by_date", "as_of"))
        .withColumn(
            "cover",
            F.coalesce(F.datediff("stockout_date", "as_of"), F.lit(horizon_days)).cast("double"),
        )
    )
    if not include_all:
        measured = measured.where(
            F.col("stockout_date").isNotNull() & (F.col("days_to_order") <= action_window_days)
        )
    # The shortfall looks at stock on hand only, although the projection counts stock on order.
    deficit = F.greatest(
        F.col("par_level") - F.col("quantity_on_hand"), F.col("horizon_use") - F.col("quantity_on_hand")
    )
    most = F.col("daily") * F.greatest(F.col("shelf_life_days"), F.lit(1))
    quantity = F.greatest(F.lit(0.0), F.least(deficit, most))
    per_case = F.greatest(F.coalesce(F.nullif("units_per_case", F.lit(0)), F.lit(1)), F.lit(1))
    cases = whole_cases(quantity, F.col("units_per_case"), F.col("min_order_quantity"))
    # The sentences of alerts.
    reason = F.when(
        F.col("stockout_date").isNotNull(),
        F.format_string(
            "Projected to run out on %s at %.1f %s/day against forecast covers.",
            F.col("stockout_date").cast("string"),
            F.col("daily"),
            F.col("unit"),
        ),
    ).otherwise("Within cover for the full horizon.")
    alerts = measured.withColumn("cases", cases).select(
        "site_id",
        "sku",
        F.col("name").alias("product"),
        "category",
        "unit",
        half_even(F.col("quantity_on_hand"), 1).alias("quantity_on_hand"),
        half_even(F.col("par_level"), 1).alias("par_level"),
        half_even(F.col("daily"), 2).alias("daily_consumption_estimate"),
        "stockout_date",
        half_even(F.col("cover"), 1).alias("days_of_cover"),
        "lead_time_days",
        "order_by_date",
        half_even((F.col("cases") * per_case).cast("double"), 1).alias("suggested_order_quantity"),
        F.col("cases").alias("suggested_order_cases"),
        half_even(F.col("cases") * F.coalesce(F.col("case_price_eur"), F.lit(0.0)), 2).alias("estimated_cost_eur"),
        "supplier",
        "supplier_email",
        severity(F.col("days_to_order"), F.col("cover")).alias("severity"),
        reason.alias("reason"),
    )
    return alerts.orderBy(mapped(F.col("severity"), SEVERITY_ORDER, 9), "days_of_cover", "site_id", "sku")


def par_levels(rows: DataFrame, average_covers: DataFrame) -> DataFrame:
    """Par per stock row: daily use times cover days plus lead time, capped by shelf life."""
    days = F.least(
        mapped(F.col("category"), PAR_COVER_DAYS, 5) + F.col("lead_time_days"),
        F.greatest(F.col("shelf_life_days"), F.lit(1)),
    )
    use = F.col("consumption_per_100_covers") * F.col("avg_covers") / 100.0
    return rows.join(average_covers, "site_id").select(
        "site_id", "sku", half_even(use * days, 1).alias("par_level")
    )


def search_stock(rows: DataFrame, suppliers: DataFrame, needle: str = "") -> DataFrame:
    """Stock by product name, category or code text; a blank needle lists everything."""
    hits = rows
    if needle.strip():
        text = needle.strip()
        hits = rows.where(
            contains_fold(F.col("name"), text)
            | contains_fold(F.col("category"), text)
            | contains_fold(F.col("sku"), text)
        )
    named = suppliers.select(F.col("id").alias("preferred_supplier_id"), F.col("name").alias("supplier"))
    return hits.join(named, "preferred_supplier_id", "left").select(
        "sku",
        F.col("name").alias("product"),
        "category",
        half_even(F.col("quantity_on_hand"), 1).alias("quantity_on_hand"),
        "unit",
        half_even(F.col("par_level"), 1).alias("par_level"),
        half_even(F.coalesce(F.col("on_order"), F.lit(0.0)), 1).alias("on_order"),
        (F.col("quantity_on_hand") < F.col("par_level")).alias("below_par"),
        "supplier",
        "lead_time_days",
    )


def find_suppliers(requests: DataFrame, products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Per request: the supplier of the first matching product, else active suppliers by
    category text, else the known categories."""
    asked = requests.select("request", F.lower(F.trim("request")).alias("needle")).distinct()
    named = products.select(
        "id", "sku", "name", "preferred_supplier_id",
        F.explode(F.array(F.lower("name"), F.lower("sku"))).alias("text"),
    )
    pairs = contained_in(asked.select("needle"), named.select("text"))
    first = (
        pairs.join(named, "text")
        .groupBy("needle")
        .agg(F.min_by(F.struct("sku", "name", "preferred_supplier_id"), "id").alias("p"))
    )
    supplied = first.join(
        suppliers.select(F.col("id").alias("sid"), F.col("name").alias("supplier")),
        F.col("p.preferred_supplier_id") == F.col("sid"),
    ).select("needle", F.col("p.name").alias("product"), F.col("p.sku").alias("sku"), "supplier")
    active = suppliers.where("active").select(
        F.lower(F.coalesce("categories", F.lit(""))).alias("text"), F.col("name").alias("supplier")
    )
    by_category = (
        contained_in(asked.select("needle"), active.select("text"))
        .join(active, "text")
        .select("needle", "supplier")
        .join(supplied.select("needle"), "needle", "left_anti")
    )
    known = suppliers.select(F.explode(sorted_list(F.coalesce("categories", F.lit("")))).alias("c")).distinct()
    all_known = known.agg(F.array_join(F.array_sort(F.collect_set("c")), ",").alias("k")).scalar()
    none = F.lit(None).cast("string")
    hits = supplied.select("needle", F.lit("product").alias("matched_on"), "product", "sku", "supplier").unionByName(
        by_category.select("needle", F.lit("category").alias("matched_on"), none.alias("product"), none.alias("sku"), "supplier")
    )
    return asked.join(hits, "needle", "left").select(
        "request",
        F.coalesce("matched_on", F.lit("none")).alias("matched_on"),
        "product",
        "sku",
        "supplier",
        F.when(F.col("matched_on").isNull(), all_known).alias("known_categories"),
    )
