"""Credit risk, bound to orders as loan applications and exposures of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import score_points
from millrace.operators import risk, scoring, stability
from millrace.plans.registry import query
from millrace.session import stage
from millrace.sources.readers import table

DIMENSIONS = ["sector", "region", "client_segment"]
NUMERIC = ["age", "annual_income", "loan_amount", "term_months"]
CATEGORICAL = ["segment", "sector", "region"]
SHOCK = "1-URGENT"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )


def portfolio(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).select(
        F.concat(F.lit("EXP-"), "o_orderkey").alias("exposure_id"),
        F.col("o_orderkey").alias("application_id"),
        F.col("c_mktsegment").alias("client_segment"),
        F.col("o_orderpriority").alias("sector"),
        F.col("n_name").alias("region"),
        F.col("o_totalprice").alias("exposure_at_default"),
        ((F.col("o_custkey") % 60 + 20) / 83.0).alias("loss_given_default"),
        (F.col("o_orderkey") % 120).alias("days_past_due"),
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Only settled and open orders carry a score; the rest drop out of the book."""
    p = (F.col("o_orderkey") % 400 + 1) / 1007.0
    return table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("application_id"), p.alias("probability_of_default"), score_points(p).alias("score_points")
    )


def book(spark: SparkSession, sf: str) -> DataFrame:
    return risk.expected_loss(portfolio(spark, sf), scored(spark, sf))


BOOK = """WITH book AS (SELECT 'EXP-' || o_orderkey AS exposure_id, o_orderkey AS application_id, c_mktsegment AS client_segment,
    o_orderpriority AS sector, n_name AS region, o_totalprice AS ead, (o_custkey % 60 + 20) / 83.0::DOUBLE AS lgd,
    o_orderkey % 120 AS dpd, (o_orderkey % 400 + 1) / 1007.0::DOUBLE AS p,
    round_even((o_orderkey % 400 + 1) / 1007.0::DOUBLE * ((o_custkey % 60 + 20) / 83.0::DOUBLE) * o_totalprice, 2) AS el
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'P')
"""


@query(
    "M20 J2 X14",
    BOOK + """SELECT exposure_id, application_id, p AS probability_of_default, el AS expected_loss,
    round_even(el / ead * 100, 3) AS loss_rate_pct, dpd >= 90 OR p >= 0.35 AS watchlist,
    CAST(round_even(600 - 20 / ln(2) * ln(50) + 20 / ln(2) * ln((1 - p) / p), 0) AS BIGINT) AS score_points FROM book""",
)
def expected_losses(spark: SparkSession, sf: str) -> DataFrame:
    return book(spark, sf).select(
        "exposure_id", "application_id", "probability_of_default", "expected_loss", "loss_rate_pct", "watchlist", "score_points"
    )


CONC = BOOK.rstrip() + """, g AS (
  SELECT 'sector' AS dimension, sector AS level, sum(ead) AS e, sum(el) AS l, count(*) AS n FROM book GROUP BY 2
  UNION ALL SELECT 'region', region, sum(ead), sum(el), count(*) FROM book GROUP BY 2
  UNION ALL SELECT 'client_segment', client_segment, sum(ead), sum(el), count(*) FROM book GROUP BY 2),
s AS (SELECT *, round_even(e / sum(e) OVER w * 100, 2) AS es, round_even(l / sum(l) OVER w * 100, 2) AS ls FROM g WINDOW w AS (PARTITION BY dimension))
"""


@query(
    "A19 W12 H8",
    CONC + """SELECT dimension, level, round_even(e, 2) AS exposure, round_even(l, 2) AS expected_loss, n AS exposures,
    es AS exposure_share_pct, ls AS loss_share_pct, round_even(ls / es, 2) AS risk_intensity FROM s""",
)
def concentration(spark: SparkSession, sf: str) -> DataFrame:
    found = risk.concentration(book(spark, sf), DIMENSIONS)
    return found.withColumns({c: F.bround(c, 2) for c in ("exposure", "expected_loss")})


@query(
    "A20 X16",
    CONC + """, h AS (SELECT dimension, sum((e / t) ** 2) AS x FROM (SELECT *, sum(e) OVER (PARTITION BY dimension) AS t FROM g) GROUP BY 1)
    SELECT dimension, round_even(x, 4) AS hhi, CASE WHEN x < 0.15 THEN 'diversified' WHEN x < 0.25 THEN 'moderately concentrated'
      ELSE 'concentrated' END AS assessment, round_even(1 / x, 1) AS effective_number_of_groups FROM h""",
)
def herfindahl(spark: SparkSession, sf: str) -> DataFrame:
    return risk.herfindahl(risk.concentration(book(spark, sf), DIMENSIONS), ["dimension"], "exposure")


@query(
    "A21",
    BOOK + """SELECT count(*) AS exposures, round_even(sum(ead), 2) AS total_exposure_eur, round_even(sum(el), 2) AS total_expected_loss_eur,
    round_even(sum(el) / sum(ead) * 100, 3) AS portfolio_loss_rate_pct, round_even(sum(p * ead) / sum(ead) * 100, 3) AS exposure_weighted_pd_pct,
    round_even(sum(lgd * ead) / sum(ead) * 100, 2) AS exposure_weighted_lgd_pct, count(*) FILTER (dpd >= 90 OR p >= 0.35) AS watchlist_exposures,
    round_even(sum(ead) FILTER (dpd >= 90 OR p >= 0.35), 2) AS watchlist_exposure_eur FROM book""",
)
def portfolio_totals(spark: SparkSession, sf: str) -> DataFrame:
    return risk.portfolio_totals(book(spark, sf))


@query(
    "T3",
    BOOK + """SELECT exposure_id, sector, client_segment, round_even(ead, 4) AS exposure_at_default, round_even(p, 4) AS probability_of_default,
    round_even(lgd, 4) AS loss_given_default, round_even(el, 4) AS expected_loss FROM book ORDER BY el DESC, exposure_id LIMIT 10""",
)
def largest_losses(spark: SparkSession, sf: str) -> DataFrame:
    return risk.largest_losses(book(spark, sf))


_STRESS = "SELECT '{n}' AS scenario, sum({e}) AS loss FROM book"


@query(
    "M22 J7 X12",
    BOOK.rstrip() + ", sc AS ("
    + " UNION ALL ".join(
        _STRESS.format(n=n, e=f"least(greatest(p * {f}, 0), 1) * lgd * ead") for n, f in risk.SCENARIOS.items()
    )
    + " UNION ALL "
    + _STRESS.format(
        n=f"sector_shock_{SHOCK}",
        e=f"CASE WHEN sector = '{SHOCK}' THEN p * 3 * least(lgd * 1.25, 0.95) ELSE p * lgd END * ead",
    )
    + """) SELECT scenario, round_even(loss, 2) AS expected_loss, round_even((loss / (SELECT sum(el) FROM book) - 1) * 100, 2) + 0.0::DOUBLE AS change_vs_base_pct,
    round_even(loss / (SELECT sum(ead) FROM book) * 100, 3) AS loss_rate_pct FROM sc""",
)
def stress_test(spark: SparkSession, sf: str) -> DataFrame:
    return risk.stress_test(book(spark, sf), shock_sector=SHOCK)


def market(spark: SparkSession, sf: str) -> DataFrame:
    daily = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("observation_date")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents")
    )
    return risk.daily_returns(daily.select("observation_date", (F.col("cents") / 100).alias("portfolio_value")))


@query(
    "M21",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / 100 AS v
      FROM orders GROUP BY 1),
    r AS (SELECT day, v, v / lag(v) OVER (ORDER BY day) - 1 AS r FROM d QUALIFY lag(v) OVER (ORDER BY day) IS NOT NULL),
    q AS (SELECT quantile_cont(r, 0.01) AS q FROM r),
    s AS (SELECT count(*) AS n, arg_max(v, day) AS v, avg(r) AS m, stddev_samp(r) AS s,
      avg(r) FILTER (r <= (SELECT q FROM q)) AS t, kurtosis_pop(r) AS k,
      (SELECT avg(((r - mm) / sd) ** 3) FROM r, (SELECT avg(r) AS mm, stddev_pop(r) AS sd FROM r)) AS sk FROM r)
    SELECT 99.0::DOUBLE AS confidence_pct, 1 AS horizon_days, round_even(v, 2) AS portfolio_value, round_even(-q * v, 2) AS historical_var,
      round_even(-(m - 2.3263478740408408 * s) * v, 2) AS parametric_var_normal, round_even(-t * v, 2) AS expected_shortfall,
      round_even((-q / -(m - 2.3263478740408408 * s) - 1) * 100, 2) AS parametric_understatement_pct, n AS observations,
      round_even(s * sqrt(252) * 100, 2) AS annualised_volatility_pct, round_even(k, 3) AS excess_kurtosis,
      exp(-(n / 6 * (sk * sk + k * k / 4)) / 2) < 0.01 AS normality_rejected FROM s, q""",
)
def value_at_risk(spark: SparkSession, sf: str) -> DataFrame:
    return risk.value_at_risk(market(spark, sf))


def applicants(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    p = (key * 7919 % 1000 + 1) / 1003.0
    return _orders(spark, sf).select(
        key.alias("application_id"),
        F.to_date("o_orderdate").alias("application_date"),
        (F.col("o_custkey") % 50 + 18).cast("double").alias("age"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("annual_income"),
        F.col("o_totalprice").alias("loan_amount"),
        (key % 3 * 12).cast("double").alias("term_months"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("sector"),
        F.col("n_name").alias("region"),
        (F.col("o_orderstatus") == "F").cast("int").alias("defaulted"),
        p.alias("probability"),
        score_points(p).alias("points"),
    )


APP = """WITH app AS (SELECT o_orderkey AS application_id, CAST(o_orderdate AS DATE) AS application_date, CAST(o_custkey % 50 + 18 AS DOUBLE) AS age,
    CASE WHEN c_acctbal > 0 THEN c_acctbal END AS annual_income, o_totalprice AS loan_amount, CAST(o_orderkey % 3 * 12 AS DOUBLE) AS term_months,
    c_mktsegment AS segment, o_orderpriority AS sector, n_name AS region, CAST(o_orderstatus = 'F' AS INTEGER) AS defaulted,
    (o_orderkey * 7919 % 1000 + 1) / 1003.0::DOUBLE AS probability
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
split AS (SELECT *, row_number() OVER (ORDER BY application_date, application_id) - 1 < floor(count(*) OVER () * 0.75) AS is_train,
    CAST(round_even(600 - 20 / ln(2) * ln(50) + 20 / ln(2) * ln((1 - probability) / probability), 0) AS BIGINT) AS points FROM app),
tr AS (SELECT * FROM split WHERE is_train), te AS (SELECT * FROM split WHERE NOT is_train)
"""


def split(spark: SparkSession, sf: str) -> DataFrame:
    # Fits and drift reports read both halves many times over.
    return stage(scoring.time_split(applicants(spark, sf), "application_date", "application_id"), "split")


@query("M1", APP + "SELECT application_id, is_train FROM split")
def time_split(spark: SparkSession, sf: str) -> DataFrame:
    return split(spark, sf).select("application_id", "is_train")


def _edge_sql(feature: str, source: str, bins: int) -> str:
    places = ", ".join(str(i / bins) for i in range(bins + 1))
    return f"(SELECT list_sort(list_distinct(quantile_cont({feature}, [{places}]))) FROM {source})"


EDGES = APP.rstrip() + ", e6 AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, x[2:len(x) - 1] AS edges FROM (SELECT {_edge_sql(f, 'tr', 6)} AS x)" for f in NUMERIC
) + ")\n"


@query("M2 X15", EDGES + "SELECT feature, i AS edge_no, round(edges[i], 6) AS edge FROM (SELECT *, unnest(range(1, len(edges) + 1)) AS i FROM e6)")
def quantile_bins(spark: SparkSession, sf: str) -> DataFrame:
    found = scoring.quantile_edges(split(spark, sf).where("is_train"), NUMERIC, 6)
    return found.select("feature", F.posexplode("edges").alias("p", "e")).select(
        "feature", (F.col("p") + 1).cast("bigint").alias("edge_no"), F.round("e", 6).alias("edge")
    )


def _level_sql(source: str) -> str:
    numeric = [
        f"SELECT '{f}' AS feature, coalesce(CASE WHEN {f} IS NOT NULL THEN CAST(len(list_filter(edges, lambda x: x < {f})) AS VARCHAR) END, 'nan')"
        f" AS level, defaulted, application_id FROM {source}, e6 WHERE feature = '{f}'"
        for f in NUMERIC
    ]
    categorical = [
        f"SELECT '{f}', coalesce({f}, 'nan'), defaulted, application_id FROM {source}" for f in CATEGORICAL
    ]
    return " UNION ALL ".join(numeric + categorical)


WOE = EDGES.rstrip() + f""", lv AS ({_level_sql('tr')}),
wc AS (SELECT feature, level, sum(defaulted)::DOUBLE AS bad, count(*)::DOUBLE AS n FROM lv GROUP BY 1, 2),
wt AS (SELECT *, greatest(sum(bad) OVER w, 1) AS b, sum(n) OVER w AS nn, count(*) OVER w AS l FROM wc WINDOW w AS (PARTITION BY feature)),
wr AS (SELECT feature, level, bad, n - bad AS good, (bad + 0.5) / (b + 0.5 * l) AS br, (n - bad + 0.5) / (greatest(nn - b, 1) + 0.5 * l) AS gr FROM wt),
woe AS (SELECT feature, level, CAST(bad AS BIGINT) AS bad, CAST(good AS BIGINT) AS good, ln(gr / br) AS woe, (gr - br) * ln(gr / br) AS iv FROM wr)
"""


def fitted(spark: SparkSession, sf: str) -> tuple[scoring.WoeBinning, DataFrame]:
    rows = split(spark, sf)
    return scoring.WoeBinning(NUMERIC, CATEGORICAL).fit(rows.where("is_train"), "defaulted"), rows


@query("M3", WOE + "SELECT feature, level, bad, good, round(woe, 6) + 0.0::DOUBLE AS woe, round(iv, 6) AS iv FROM woe")
def woe_table(spark: SparkSession, sf: str) -> DataFrame:
    binning, _ = fitted(spark, sf)
    return binning.weights.withColumns({c: F.round(c, 6) for c in ("woe", "iv")})


@query(
    "M5 T7 X15",
    WOE + """SELECT feature, v AS information_value, CASE WHEN v <= 0.02 THEN 'useless' WHEN v <= 0.1 THEN 'weak' WHEN v <= 0.3 THEN 'medium'
    WHEN v <= 0.5 THEN 'strong' ELSE 'suspicious' END AS strength FROM (SELECT feature, round_even(sum(iv), 4) AS v FROM woe GROUP BY 1)""",
)
def information_values(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.iv_table(fitted(spark, sf)[0].weights)


@query(
    "M4 J17",
    WOE + f""", lt AS ({_level_sql('te')}),
  j AS (SELECT application_id, lt.feature, coalesce(woe, 0) AS woe FROM lt LEFT JOIN woe ON lt.feature = woe.feature AND lt.level = woe.level)
  SELECT application_id, """
    + ", ".join(f"round(max(woe) FILTER (feature = '{f}'), 6) + 0.0::DOUBLE AS woe_{f}" for f in [*NUMERIC, *CATEGORICAL])
    + " FROM j GROUP BY 1",
)
def woe_features(spark: SparkSession, sf: str) -> DataFrame:
    binning, rows = fitted(spark, sf)
    out = binning.transform(rows.where("NOT is_train"))
    return out.select("application_id", *[F.round(f"woe_{f}", 6).alias(f"woe_{f}") for f in [*NUMERIC, *CATEGORICAL]])


@query(
    "M12 W9 H10",
    APP.rstrip() + """, g AS (SELECT probability AS p, sum(defaulted) AS b, sum(1 - defaulted) AS g FROM te GROUP BY 1),
  c AS (SELECT *, sum(b) OVER w AS cb, sum(g) OVER w AS cg, sum(b) OVER () AS tb, sum(g) OVER () AS tg FROM g WINDOW w AS (ORDER BY p)),
  m AS (SELECT sum(b * (cg - g + g / 2)) / (max(tb) * max(tg)) AS auc, max(abs(cg / tg - cb / tb)) AS ks FROM c)
  SELECT round_even(auc, 4) AS auc, round_even(2 * auc - 1, 4) AS gini, round_even(ks, 4) AS ks,
    (SELECT round_even(avg((probability - defaulted) ** 2), 5) FROM te) AS brier,
    (SELECT round_even(avg(defaulted) * 100, 2) FROM te) AS default_rate_pct FROM m""",
)
def score_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.evaluate(split(spark, sf).where("NOT is_train"), "defaulted", "probability")


@query(
    "W9",
    APP.rstrip() + """, g AS (SELECT probability AS score, sum(defaulted) AS b, sum(1 - defaulted) AS g FROM te GROUP BY 1)
  SELECT score, round(sum(b) OVER w / sum(b) OVER (), 9) AS cum_bad, round(sum(g) OVER w / sum(g) OVER (), 9) AS cum_good
  FROM g WINDOW w AS (ORDER BY score)""",
)
def ks_curve(spark: SparkSession, sf: str) -> DataFrame:
    curve = scoring.ks_curve(split(spark, sf).where("NOT is_train"), "defaulted", "probability")
    return curve.select("score", F.round("cum_bad", 9).alias("cum_bad"), F.round("cum_good", 9).alias("cum_good"))


@query(
    "M13",
    APP.rstrip() + f""", e AS (SELECT x[2:len(x) - 1] AS edges FROM (SELECT {_edge_sql('probability', 'te', 10)} AS x)),
  d AS (SELECT CAST(len(list_filter(edges, lambda x: x < probability)) AS INTEGER) AS decile, probability, defaulted FROM te, e)
  SELECT decile, count(*) AS applicants, round_even(avg(probability) * 100, 2) AS predicted_rate, round_even(avg(defaulted) * 100, 2) AS observed_rate,
    round_even((avg(defaulted) - avg(probability)) * 100, 2) + 0.0::DOUBLE AS difference_pp FROM d GROUP BY 1""",
)
def calibration_table(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.calibration(split(spark, sf).where("NOT is_train"), "defaulted", "probability")


@query(
    "M14",
    APP + """SELECT segment, CAST(trunc(quantile_cont(points, 0.05)) AS BIGINT) AS p05, CAST(trunc(quantile_cont(points, 0.5)) AS BIGINT) AS p50,
    CAST(trunc(quantile_cont(points, 0.95)) AS BIGINT) AS p95 FROM split GROUP BY 1""",
)
def score_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_distribution(applicants(spark, sf), "points", ["segment"])


_PSI_NUM = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST(len(list_filter(edges, lambda x: x <= {f})) AS INTEGER) AS level, is_train FROM split, "
    f"(SELECT x[2:len(x) - 1] AS edges FROM (SELECT {_edge_sql(f, 'tr', 10)} AS x)) WHERE {f} IS NOT NULL"
    for f in NUMERIC
)
_PARTS = """, c AS (SELECT feature, level, count(*) FILTER (is_train) AS r, count(*) FILTER (NOT is_train) AS k FROM b GROUP BY 1, 2),
s AS (SELECT *, r / greatest(sum(r) OVER w, 1) + 1e-6 AS e, k / greatest(sum(k) OVER w, 1) + 1e-6 AS a FROM c WINDOW w AS (PARTITION BY feature)),
p AS (SELECT *, (a - e) * ln(a / e) AS part FROM s)
"""
_BAND = """CASE WHEN x < 0.10 THEN 'stable' WHEN x < 0.25 THEN 'investigate' ELSE 'unstable' END AS assessment"""


@query(
    "M23 H5",
    APP.rstrip() + f", b AS ({_PSI_NUM})" + _PARTS
    + "SELECT feature, level, r AS reference, k AS current, round(part, 6) AS contribution FROM p",
)
def psi_bins(spark: SparkSession, sf: str) -> DataFrame:
    rows = split(spark, sf)
    found = stability.psi_bins(rows.where("is_train"), rows.where("NOT is_train"), NUMERIC)
    return found.select("feature", "level", "reference", "current", F.round("part", 6).alias("contribution"))


_PSI_CAT = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS level, is_train FROM split" for f in CATEGORICAL)


@query(
    "M24 J16 U6",
    APP.rstrip() + f", b AS ({_PSI_CAT})" + _PARTS
    + "SELECT feature, level, r AS reference, k AS current, round(part, 6) AS contribution FROM p",
)
def psi_levels(spark: SparkSession, sf: str) -> DataFrame:
    rows = split(spark, sf)
    found = stability.psi_levels(rows.where("is_train"), rows.where("NOT is_train"), CATEGORICAL)
    return found.select("feature", "level", "reference", "current", F.round("part", 6).alias("contribution"))


@query(
    "M25 T7",
    APP.rstrip()
    + f", b AS (SELECT feature, CAST(level AS VARCHAR) AS level, is_train FROM ({_PSI_NUM}) UNION ALL {_PSI_CAT})"
    + _PARTS
    + f"SELECT feature, round_even(x, 5) AS psi, {_BAND} FROM (SELECT feature, sum(part) AS x FROM p GROUP BY 1)",
)
def feature_drift(spark: SparkSession, sf: str) -> DataFrame:
    rows = split(spark, sf)
    return stability.feature_drift(rows.where("is_train"), rows.where("NOT is_train"), NUMERIC, CATEGORICAL)


@query(
    "M25",
    APP.rstrip()
    + f""", b AS (SELECT 'points' AS feature, len(list_filter(edges, lambda x: x <= points)) AS level, is_train FROM split,
      (SELECT x[2:len(x) - 1] AS edges FROM (SELECT {_edge_sql('points', 'tr', 10)} AS x)))"""
    + _PARTS.rstrip()
    + f""", m AS (SELECT (SELECT median(points) FROM tr) AS rm, (SELECT median(points) FROM te) AS cm, (SELECT sum(part) FROM p) AS x)
  SELECT round_even(x, 5) AS score_psi, {_BAND.replace('assessment', 'score_assessment')}, CAST(trunc(rm) AS BIGINT) AS reference_median_points,
    CAST(trunc(cm) AS BIGINT) AS current_median_points, CAST(trunc(cm - rm) AS BIGINT) AS shift_points,
    (SELECT round_even(avg(defaulted) * 100, 2) FROM tr) AS reference_default_pct,
    (SELECT round_even(avg(defaulted) * 100, 2) FROM te) AS current_default_pct FROM m""",
)
def stability_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = split(spark, sf)
    return stability.stability_summary(rows.where("is_train"), rows.where("NOT is_train"), "points", "defaulted")
