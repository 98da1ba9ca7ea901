"""Payment analytics, bound to orders with their customers and nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import half_even
from millrace.operators import kpi, profile
from millrace.plans.registry import query
from millrace.sources.readers import sample_with_count, table

CHANNELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def payments(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("id"),
            F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount"),
            F.when(F.col("o_orderstatus") == "F", "succeeded")
            .when(F.col("o_orderstatus") == "O", "pending")
            .otherwise("failed")
            .alias("status"),
            F.col("n_name").alias("country"),
            F.col("c_mktsegment").alias("segment"),
            F.col("o_orderpriority").alias("channel"),
            F.to_date("o_orderdate").alias("batch_date"),
        )
    )


PAY = """WITH pay AS (
  SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS amount,
         CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
         n_name AS country, c_mktsegment AS segment, o_orderpriority AS channel,
         CAST(o_orderdate AS DATE) AS batch_date
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


def _by_sql(dimension: str) -> str:
    return PAY + f"""SELECT {dimension}, CAST(sum(amount) AS BIGINT) / 100 AS total_revenue,
  count(amount) AS transaction_count, round(CAST(sum(amount) AS BIGINT) / 100 / count(amount), 6) AS avg_transaction
  FROM pay GROUP BY {dimension}"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("A1 D4 F1", _by_sql("country"))
def revenue_by_country(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(kpi.run_analysis(payments(spark, sf), "revenue_by_country"), "avg_transaction")


@query("A1 D4 F1", _by_sql("segment"))
def revenue_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(kpi.run_analysis(payments(spark, sf), "revenue_by_segment"), "avg_transaction")


@query("A1 D4 F1", _by_sql("channel"))
def revenue_by_channel(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(kpi.run_analysis(payments(spark, sf), "revenue_by_channel"), "avg_transaction")


@query(
    "A2 D4",
    PAY + """SELECT batch_date, CAST(sum(amount) AS BIGINT) AS sum, count(amount) AS count,
    round(CAST(sum(amount) AS BIGINT) / count(amount), 6) AS mean FROM pay GROUP BY batch_date""",
)
def custom_analysis(spark: SparkSession, sf: str) -> DataFrame:
    found = kpi.run_analysis(payments(spark, sf), "custom", group_by="batch_date", metric="amount")
    return _rounded(found, "mean")


@query(
    "A3",
    PAY + """SELECT status, CAST(sum(amount) AS BIGINT) / 100 AS total_amount, count(amount) AS count,
    count(id) AS transactions FROM pay GROUP BY status""",
)
def status_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return kpi.run_analysis(payments(spark, sf), "status_distribution")


_CELL = "CAST(coalesce(sum(amount) FILTER (channel = '{c}'), 0) AS BIGINT) / 100 AS \"{c}\""


@query(
    "A4",
    PAY + "SELECT segment, " + ", ".join(_CELL.format(c=c) for c in CHANNELS) + " FROM pay GROUP BY segment",
)
def segment_channel_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return kpi.run_analysis(payments(spark, sf), "segment_channel_matrix", channels=CHANNELS)


@query(
    "A5",
    PAY + """SELECT round_even(CAST(sum(amount) AS BIGINT) / 100, 2) AS total_revenue_eur,
    count(*) AS total_transactions,
    count(*) FILTER (status = 'succeeded') AS successful_transactions,
    round_even(count(*) FILTER (status = 'succeeded') / count(*) * 100, 2) AS success_rate,
    round_even(CAST(sum(amount) AS BIGINT) / 100 / count(*), 2) AS average_transaction_value,
    (SELECT country FROM pay GROUP BY country ORDER BY sum(amount) DESC, country LIMIT 1) AS top_country,
    (SELECT channel FROM pay GROUP BY channel ORDER BY sum(amount) DESC, channel LIMIT 1) AS top_channel
    FROM pay""",
)
def payment_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return kpi.kpi_row(payments(spark, sf))


@query(
    "A6",
    PAY + """SELECT position, "column", data_type, missing, (SELECT count(*) FROM pay) AS rows FROM (
    SELECT 0 AS position, 'id' AS "column", 'bigint' AS data_type, count(*) - count(id) AS missing FROM pay
    UNION ALL SELECT 1, 'amount', 'bigint', count(*) - count(amount) FROM pay
    UNION ALL SELECT 2, 'status', 'string', count(*) - count(status) FROM pay
    UNION ALL SELECT 3, 'country', 'string', count(*) - count(country) FROM pay
    UNION ALL SELECT 4, 'segment', 'string', count(*) - count(segment) FROM pay
    UNION ALL SELECT 5, 'channel', 'string', count(*) - count(channel) FROM pay
    UNION ALL SELECT 6, 'batch_date', 'date', count(*) - count(batch_date) FROM pay)""",
)
def payment_table_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.table_profile(payments(spark, sf))


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "A7",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean,
        round(quantile_cont({c}, 0.5), 6) AS median, round(stddev_samp({c}), 6) AS std FROM lineitem"""
        for c in _NUMERIC
    ),
)
def numeric_profile(spark: SparkSession, sf: str) -> DataFrame:
    found = profile.numeric_profile(table(spark, sf, "lineitem"), _NUMERIC)
    return _rounded(found, "mean", "median", "std")


_CATEGORICAL = ["status", "country", "segment", "channel"]


@query(
    "A8",
    PAY + ", cells AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS count FROM pay GROUP BY {c}" for c in _CATEGORICAL
    )
    + """) SELECT * FROM (SELECT "column", value, count,
      row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS place,
      count(*) OVER (PARTITION BY "column") AS unique_count FROM cells) WHERE place <= 10""",
)
def categorical_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.categorical_profile(payments(spark, sf), _CATEGORICAL)


_DIMENSIONS = ["segment", "country", "channel", "status"]
_ROLL = """SELECT '{d}' AS dimension, {v} AS value, round_even(CAST(sum(amount) AS BIGINT) / 100, 2) AS total_revenue,
  round_even(CAST(sum(amount) AS BIGINT) / 100 / count(amount), 2) AS avg_transaction,
  count(amount) AS transaction_count, min(batch_date) AS first_date, max(batch_date) AS last_date FROM pay {g}"""


@query(
    "A9",
    PAY
    + " UNION ALL ".join(
        [_ROLL.format(d=d, v=d, g=f"GROUP BY {d}") for d in _DIMENSIONS]
        + [_ROLL.format(d="total", v="'all'", g="")]
    ),
)
def payment_report(spark: SparkSession, sf: str) -> DataFrame:
    return kpi.report_rollup(payments(spark, sf), _DIMENSIONS)


_BOUNDS = """, b AS (SELECT avg(amount / 100) AS m, stddev_samp(amount / 100) AS s FROM pay)"""


@query(
    "F2",
    PAY + _BOUNDS + """ SELECT id, amount / 100 AS amount_eur, country, segment, status FROM pay, b
    WHERE amount / 100 > m + 1.5 * s OR amount / 100 < m - 1.5 * s""",
)
def payment_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    rows = kpi.to_euros(payments(spark, sf))
    return kpi.outliers(rows, "amount_eur", 1.5).select("id", "amount_eur", "country", "segment", "status")


@query(
    "F2",
    PAY + _BOUNDS + """ SELECT round_even(m, 2) AS mean_amount, round_even(s, 2) AS std_amount,
    round_even(m + 2.0 * s, 2) AS upper_bound, round_even(m - 2.0 * s, 2) AS lower_bound FROM b""",
)
def payment_anomaly_bounds(spark: SparkSession, sf: str) -> DataFrame:
    bounds = kpi.outlier_bounds(kpi.to_euros(payments(spark, sf)), "amount_eur")
    return bounds.select(*[half_even(F.col(c), 2).alias(c) for c in bounds.columns])


@query("S1 T9")
def payment_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sample_with_count(payments(spark, sf), 5)
