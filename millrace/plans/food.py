"""Food-service planning, bound to parts as products and daily order totals as covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.calendar import closure_reason, is_closed
from millrace.operators import forecast, inventory, purchasing
from millrace.plans.registry import query
from millrace.sources.readers import table

AS_OF = "2001-08-02"
SITES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
CATEGORIES = ["dry_goods", "beverage", "bakery", "produce", "salad", "protein", "chilled", "frozen"]


def covers(spark: SparkSession, sf: str) -> DataFrame:
    """Covers per region and day: one per thousand euros ordered."""
    orders, customer, nation, region = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    daily = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("site_id"), F.to_date("o_orderdate").alias("service_date"))
        .agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    )
    return daily.select(
        "site_id", "service_date", F.expr("cents div 100000").alias("covers"), is_closed(F.col("service_date")).alias("is_closed")
    )


def products(spark: SparkSession, sf: str) -> DataFrame:
    part, line = table(spark, sf, "part"), table(spark, sf, "lineitem")
    source = line.groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_suppkey").alias("preferred_supplier_id"))
    key = F.col("p_partkey")
    goods = part.select(
        key.alias("id"),
        F.concat(F.lit("PRD-"), key).alias("sku"),
        F.col("p_name").alias("name"),
        F.element_at(F.array(*map(F.lit, CATEGORIES)), (key % 8 + 1).cast("int")).alias("category"),
        F.lit("kg").alias("unit"),
        (F.col("p_size") % 12).alias("units_per_case"),
        (F.col("p_size") / 7.0).alias("consumption_per_100_covers"),
        (F.col("p_size") % 5 + 1).alias("lead_time_days"),
        (key % 4).cast("int").alias("min_order_quantity"),
        (key % 20).cast("int").alias("shelf_life_days"),
        F.col("p_retailprice").alias("case_price_eur"),
    )
    return goods.join(source, "id", "left")


def stock(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        key.alias("product_id"),
        F.element_at(F.array(*map(F.lit, SITES)), (key % 5 + 1).cast("int")).alias("site_id"),
        (key % 97 / 0.7).alias("quantity_on_hand"),
        ((key % 50) * 4.1).alias("par_level"),
        F.when(key % 3 == 0, key % 11 / 0.3).alias("on_order"),
    )


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    word = lambda n: F.element_at(F.array(*map(F.lit, CATEGORIES)), ((key + n) % 8 + 1).cast("int"))
    return table(spark, sf, "supplier").select(
        key.alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lower("s_name"), F.lit("@example.com")).alias("email"),
        F.concat_ws(",", word(0), word(3)).alias("categories"),
        (key % 10 != 0).alias("active"),
    )


def stock_rows(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.stock_rows(products(spark, sf), stock(spark, sf))


_SITES = ", ".join(f"'{s}'" for s in SITES)
_CATS = ", ".join(f"'{c}'" for c in CATEGORIES)
_REASON = """CASE WHEN isodow({d}) >= 6 THEN 'weekend'
  WHEN strftime({d}, '%m-%d') IN ('01-01', '05-01', '05-08', '07-14', '08-15', '11-01', '11-11', '12-25') THEN 'public holiday'
  WHEN strftime({d}, '%m-%d') BETWEEN '08-01' AND '08-15' THEN 'summer shutdown' END"""

FOOD = f"""WITH covers AS (SELECT *, {_REASON.format(d='service_date')} IS NOT NULL AS is_closed FROM (
    SELECT r_name AS site_id, CAST(o_orderdate AS DATE) AS service_date,
      CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) // 100000 AS covers
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)),
src AS (SELECT l_partkey, min(l_suppkey) AS sup FROM lineitem GROUP BY 1),
sup AS (SELECT s_suppkey AS id, s_name AS name, lower(s_name) || '@example.com' AS email,
    [{_CATS}][s_suppkey % 8 + 1] || ',' || [{_CATS}][(s_suppkey + 3) % 8 + 1] AS categories, s_suppkey % 10 <> 0 AS active FROM supplier),
prod AS (SELECT p_partkey AS id, 'PRD-' || p_partkey AS sku, p_name AS name, [{_CATS}][p_partkey % 8 + 1] AS category,
    'kg' AS unit, p_size % 12 AS units_per_case, p_size / 7.0::DOUBLE AS rate, p_size % 5 + 1 AS lead_time_days,
    p_partkey % 4 AS moq, p_partkey % 20 AS shelf, p_retailprice AS price, sup AS supplier_id
  FROM part LEFT JOIN src ON p_partkey = l_partkey),
st AS (SELECT prod.*, [{_SITES}][id % 5 + 1] AS site_id, id % 97 / 0.7::DOUBLE AS on_hand, id % 50 * 4.1::DOUBLE AS par_level,
    CASE WHEN id % 3 = 0 THEN id % 11 / 0.3::DOUBLE END AS on_order FROM prod),
opened AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY service_date DESC) AS r FROM covers WHERE NOT is_closed),
site AS (SELECT site_id, max(service_date) AS last_date FROM covers GROUP BY 1),
agg AS (SELECT site_id, count(*) AS n, avg(covers) FILTER (r <= 5) AS short_mean, stddev_samp(covers) FILTER (r <= 60) AS spread
  FROM opened GROUP BY 1),
days AS (SELECT site_id, last_date + CAST(i AS INTEGER) AS service_date, {_REASON.format(d='(last_date + CAST(i AS INTEGER))')} AS note
  FROM site CROSS JOIN range(1, 15) t(i)),
numbered AS (SELECT *, count(*) FILTER (note IS NULL) OVER (PARTITION BY site_id ORDER BY service_date) AS step FROM days),
fc AS (SELECT d.site_id, d.service_date, d.note, CASE WHEN n >= 5 THEN o.covers ELSE short_mean END AS centre, spread
  FROM numbered d JOIN agg USING (site_id)
  LEFT JOIN opened o ON o.site_id = d.site_id AND o.r = 5 - (d.step - 1) % 5),
forecast AS (SELECT site_id, service_date, strftime(service_date, '%A') AS weekday,
    CAST(CASE WHEN note IS NOT NULL THEN 0 ELSE greatest(round_even(centre, 0), 0) END AS BIGINT) AS predicted_covers,
    CAST(CASE WHEN note IS NOT NULL THEN 0 ELSE greatest(round_even(centre - 1.28 * spread, 0), 0) END AS BIGINT) AS lower,
    CAST(CASE WHEN note IS NOT NULL THEN 0 ELSE greatest(round_even(centre + 1.28 * spread, 0), 0) END AS BIGINT) AS upper,
    note IS NOT NULL AS is_closed, note FROM fc),
used AS (SELECT st.*, service_date, predicted_covers,
    CASE WHEN is_closed THEN 0.0 ELSE predicted_covers * rate / 100.0 END::DOUBLE AS use
  FROM st JOIN forecast USING (site_id)),
walk AS (SELECT *, round_even(use, 2) AS consumption, round_even(coalesce(on_hand, 0) + coalesce(on_order, 0)
    - sum(use) OVER (PARTITION BY site_id, sku ORDER BY service_date), 2) + 0.0::DOUBLE AS closing_stock FROM used)
"""


@query("P6 X7 X8 X9 S5", FOOD + "SELECT * FROM forecast")
def covers_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.forecast_covers(covers(spark, sf))


@query(
    "S5",
    FOOD + "SELECT service_date, covers, is_closed FROM covers WHERE site_id = 'ASIA'",
)
def site_covers(spark: SparkSession, sf: str) -> DataFrame:
    return covers(spark, sf).where("site_id = 'ASIA'").select("service_date", "covers", "is_closed")


@query(
    "X7",
    f"SELECT day, {_REASON.format(d='day')} AS reason FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)",
)
def closure_calendar(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.withColumn("reason", closure_reason(F.col("day")))


@query("W6 J1", FOOD + "SELECT site_id, sku, service_date, predicted_covers, consumption, closing_stock FROM walk")
def stock_projection(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.project_stock(stock_rows(spark, sf), forecast.forecast_covers(covers(spark, sf)))


@query(
    "W7",
    FOOD + "SELECT site_id, sku, min(service_date) FILTER (closing_stock <= 0) AS stockout_date FROM walk GROUP BY 1, 2",
)
def first_stockouts(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.first_stockouts(stock_rows(spark, sf), forecast.forecast_covers(covers(spark, sf)))


@query(
    "P9 X11 X17 J10 T1",
    FOOD + f""", m AS (SELECT site_id, sku, any_value(name) AS product, any_value(category) AS category, any_value(unit) AS unit,
    any_value(on_hand) AS on_hand, any_value(par_level) AS par, any_value(lead_time_days) AS lead, any_value(shelf) AS shelf,
    any_value(units_per_case) AS upc, any_value(moq) AS moq, any_value(price) AS price, any_value(supplier_id) AS sid,
    min(service_date) FILTER (closing_stock <= 0) AS stockout_date, sum(consumption) AS total,
    coalesce(sum(consumption) / nullif(count(*) FILTER (consumption > 0), 0), 0) AS daily FROM walk GROUP BY 1, 2),
  d AS (SELECT *, stockout_date - lead AS order_by_date, stockout_date - DATE '{AS_OF}' AS cover,
    greatest(0, least(greatest(par - on_hand, total - on_hand), daily * greatest(shelf, 1))) AS q FROM m
    WHERE stockout_date IS NOT NULL AND stockout_date - lead - DATE '{AS_OF}' <= 7),
  c AS (SELECT *, CAST(greatest(ceil(q / greatest(coalesce(nullif(upc, 0), 1), 1)), coalesce(nullif(moq, 0), 1)) AS BIGINT) AS cases FROM d)
  SELECT site_id, sku, product, category, unit, round_even(on_hand, 1) AS quantity_on_hand, round_even(par, 1) AS par_level,
    round_even(daily, 2) AS daily_consumption_estimate, stockout_date, CAST(cover AS DOUBLE) AS days_of_cover,
    lead AS lead_time_days, order_by_date, CAST(cases * greatest(coalesce(nullif(upc, 0), 1), 1) AS DOUBLE) AS suggested_order_quantity,
    cases AS suggested_order_cases, round_even(cases * price, 2) AS estimated_cost_eur, sup.name AS supplier, email AS supplier_email,
    CASE WHEN order_by_date <= DATE '{AS_OF}' THEN 'critical' WHEN cover <= 3 THEN 'high' ELSE 'medium' END AS severity
  FROM c LEFT JOIN sup ON sid = sup.id""",
)
def order_alerts(spark: SparkSession, sf: str) -> DataFrame:
    found = inventory.order_alerts(
        stock_rows(spark, sf),
        suppliers(spark, sf),
        forecast.forecast_covers(covers(spark, sf)),
        F.lit(AS_OF).cast("date"),
    )
    return found.drop("reason")


@query(
    "P13",
    FOOD + """, a AS (SELECT site_id, CAST(sum(covers) AS BIGINT) / count(*) AS avg_covers FROM covers WHERE NOT is_closed GROUP BY 1)
  SELECT site_id, sku, round_even(rate * avg_covers / 100.0 * least(CASE category WHEN 'dry_goods' THEN 21 WHEN 'beverage' THEN 18
    WHEN 'bakery' THEN 1 WHEN 'produce' THEN 4 WHEN 'salad' THEN 3 WHEN 'protein' THEN 5 WHEN 'chilled' THEN 7 ELSE 5 END
    + lead_time_days, greatest(shelf, 1)), 1) AS par_level FROM st JOIN a USING (site_id)""",
)
def par_levels(spark: SparkSession, sf: str) -> DataFrame:
    average = (
        covers(spark, sf).where(~F.col("is_closed")).groupBy("site_id").agg(F.avg("covers").alias("avg_covers"))
    )
    return inventory.par_levels(stock_rows(spark, sf), average)


@query(
    "F8 J10 X20",
    FOOD + """SELECT sku, st.name AS product, category, round_even(on_hand, 1) AS quantity_on_hand, unit,
    round_even(par_level, 1) AS par_level, round_even(coalesce(on_order, 0), 1) AS on_order, on_hand < par_level AS below_par,
    sup.name AS supplier, lead_time_days
  FROM st LEFT JOIN sup ON supplier_id = sup.id
  WHERE st.name ILIKE '%widget%' OR category ILIKE '%widget%' OR sku ILIKE '%widget%'""",
)
def inventory_search(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.search_stock(stock_rows(spark, sf), suppliers(spark, sf), " Widget ")


@query(
    "F13 X25",
    FOOD + """, asked AS (SELECT DISTINCT p_name AS request FROM part UNION SELECT DISTINCT 'Salad' FROM part
      UNION SELECT DISTINCT c_mktsegment FROM customer UNION SELECT DISTINCT 'prd-7' FROM part),
  p1 AS (SELECT request, arg_min(prod.sku, prod.id) AS sku, arg_min(prod.name, prod.id) AS product,
      arg_min(coalesce(supplier_id, -1), prod.id) AS sid
    FROM asked JOIN prod ON contains(lower(prod.name), lower(request)) OR contains(lower(prod.sku), lower(request)) GROUP BY 1),
  p2 AS (SELECT request, product, sku, sup.name AS supplier FROM p1 JOIN sup ON sid = sup.id),
  c2 AS (SELECT DISTINCT request, sup.name AS supplier FROM asked JOIN sup ON active AND contains(categories, lower(request))
    WHERE request NOT IN (SELECT request FROM p2))
  SELECT asked.request, CASE WHEN p2.sku IS NOT NULL THEN 'product' WHEN c2.supplier IS NOT NULL THEN 'category' ELSE 'none' END AS matched_on,
    p2.product, p2.sku, coalesce(p2.supplier, c2.supplier) AS supplier,
    CASE WHEN p2.sku IS NULL AND c2.supplier IS NULL THEN
      (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT unnest(string_split(categories, ',')) AS c FROM sup)) END AS known_categories
  FROM asked LEFT JOIN p2 ON asked.request = p2.request LEFT JOIN c2 ON asked.request = c2.request""",
)
def find_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    part, customer = table(spark, sf, "part"), table(spark, sf, "customer")
    asked = (
        part.select(F.col("p_name").alias("request"))
        .union(part.select(F.lit("Salad")))
        .union(customer.select("c_mktsegment"))
        .union(part.select(F.lit("prd-7")))
        .distinct()
    )
    return inventory.find_suppliers(asked, products(spark, sf), suppliers(spark, sf))


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Requested order lines; some ask for nothing and some name an unknown product."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 1000000 + F.col("l_suppkey")).alias("line_no"),
        F.when(F.col("l_partkey") % 31 == 0, F.concat(F.lit("OLD-"), "l_partkey"))
        .otherwise(F.concat(F.lit(" PRD-"), "l_partkey"))
        .alias("sku"),
        (F.col("l_quantity") - 3).cast("int").alias("cases"),
    )


LINES = FOOD + """, lines AS (SELECT l_orderkey AS order_id, (l_linenumber * 1000000 + l_partkey) * 1000000 + l_suppkey AS line_no,
    CASE WHEN l_partkey % 31 = 0 THEN 'OLD-' || l_partkey ELSE 'PRD-' || l_partkey END AS sku, CAST(l_quantity - 3 AS BIGINT) AS asked
    FROM lineitem),
  l1 AS (SELECT lines.*, prod.*EXCLUDE (sku), CASE WHEN prod.sku IS NULL THEN 'Unknown SKU ''' || lines.sku || '''.'
    WHEN supplier_id IS NULL THEN name || ' has no registered supplier.'
    WHEN asked <= 0 THEN 'Quantity for ' || lines.sku || ' must be a positive number of cases.' END AS error
    FROM lines LEFT JOIN prod ON lines.sku = prod.sku),
  priced AS (SELECT *, CASE WHEN error IS NULL THEN greatest(asked, coalesce(nullif(moq, 0), 1)) END AS cases FROM l1),
  pl AS (SELECT *, round_even(cases * price, 2) AS line_total FROM priced)
"""


@query(
    "J11 P10",
    LINES + """SELECT order_id, line_no, sku, name AS product, cases, cases * coalesce(nullif(units_per_case, 0), 1) AS quantity, unit,
    CASE WHEN error IS NULL THEN price END AS case_price_eur, line_total AS line_total_eur,
    supplier_id AS preferred_supplier_id, error FROM pl""",
)
def priced_order_lines(spark: SparkSession, sf: str) -> DataFrame:
    return purchasing.price_lines(order_lines(spark, sf), products(spark, sf))


@query(
    "P10 U5",
    LINES + """, t AS (SELECT order_id, count(*) AS lines, arg_min(error, line_no) FILTER (error IS NOT NULL) AS first_error,
      min(supplier_id) AS low, max(supplier_id) AS high, sum(line_total) AS total FROM pl GROUP BY 1),
    e AS (SELECT *, coalesce(first_error, CASE WHEN low <> high THEN
      'Items span more than one supplier. Create one purchase order per supplier.' END) AS error FROM t)
    SELECT order_id, lines, CASE WHEN error IS NULL THEN low END AS supplier_id,
      CASE WHEN error IS NULL THEN round_even(total, 2) END AS total_eur,
      CASE WHEN error IS NULL THEN 'draft' ELSE 'refused' END AS status, error FROM e""",
)
def priced_orders(spark: SparkSession, sf: str) -> DataFrame:
    return purchasing.price_orders(order_lines(spark, sf), products(spark, sf))


@query(
    "P11 X26",
    """WITH st AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 11 / 0.3::DOUBLE END AS on_order FROM part),
    added AS (SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem
      WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1)
    SELECT 'PRD-' || id AS sku, coalesce(on_order, 0) + coalesce(CAST(q AS DOUBLE), 0) AS on_order
    FROM st LEFT JOIN added ON id = l_partkey""",
)
def stock_after_sent_orders(spark: SparkSession, sf: str) -> DataFrame:
    # An order arrives as one record per line, so no order is gathered in one place.
    item = F.struct(F.concat(F.lit("PRD-"), "l_partkey").alias("sku"), F.col("l_quantity").cast("bigint").alias("quantity"))
    orders = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("po_number"), F.to_json(F.array(item)).alias("lines_json")
    )
    sent = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("po_number"))
    rows = stock(spark, sf).select(F.concat(F.lit("PRD-"), "product_id").alias("sku"), "on_order")
    return purchasing.apply_sent_orders(rows, orders, sent)
