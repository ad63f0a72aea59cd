"""Trees, forests and boosting whose answers SQL can state: few rounds on whole tables.

Features are small integers, so every value has a bin of its own and SQL can try all splits.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabscout.operators.learners import SUITE_MAKERS, make_learner
from tabscout.operators.preprocess import FEATURES, LABEL
from tabscout.plans import train as R
from tabscout.plans.score import score

from .fixtures import table
from .profile_queries import rounded

_ORDERS = """SELECT o_orderkey AS id, CAST(month(o_orderdate) AS INTEGER) AS f1,
  CAST(o_custkey % 23 AS INTEGER) AS f2, CAST(floor(o_totalprice / 20000) AS INTEGER) AS f3,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM {orders}"""
_CUSTOMERS = """SELECT c_custkey AS id, CAST(c_nationkey AS INTEGER) AS f1,
  CAST(c_custkey % 19 AS INTEGER) AS f2, CAST(length(c_mktsegment) AS INTEGER) AS f3,
  CAST(round(c_acctbal * 100) AS BIGINT) AS y FROM {customer}"""


def _rows(spark, d, sql, name):
    given = spark.sql(sql.format(**{name: "{source}"}), source=table(spark, d, name))
    assembler = VectorAssembler(inputCols=["f1", "f2", "f3"], outputCol=FEATURES)
    return assembler.transform(given.withColumn(LABEL, F.col("y").cast("double")))


def _fitted(sql, name, make, probability):
    """Rows with what a learner fitted on all of them answers."""
    def run(spark, d):
        rows = _rows(spark, d, sql, name)
        scored = make().fit(rows).transform(rows)
        out = [F.col("id"), F.round("prediction", 1).alias("prediction")]
        if probability:
            out.append(F.round(vector_to_array("probability")[1], 6).alias("probability"))
        return scored.select(*out)
    return run


def _grown(source, depth, weight, least_h=0.0, least_gain="1e-6"):
    """CTEs of a tree grown on ``base`` (id, f1, f2, f3, g, h): ``level{depth}`` gives each row its leaf.

    ``weight`` is what a side of a split is worth, in terms of {g}, {h} and {n}.
    """
    side = lambda g, h, n: weight.format(g=g, h=h, n=n)
    text = f"base AS ({source}), level0 AS (SELECT *, 1 AS node FROM base)"
    for k in range(depth):
        text += f""",
  cells{k} AS (SELECT node, f, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM (
    SELECT node, g, h, unnest([1, 2, 3]) AS f, unnest([f1, f2, f3]) AS v FROM level{k}) GROUP BY 1, 2, 3),
  sides{k} AS (SELECT node, f, v, sum(g) OVER up AS gl, sum(h) OVER up AS hl, sum(n) OVER up AS nl,
      sum(g) OVER al AS g, sum(h) OVER al AS h, sum(n) OVER al AS n FROM cells{k}
    WINDOW up AS (PARTITION BY node, f ORDER BY v), al AS (PARTITION BY node, f)),
  gains{k} AS (SELECT node, f, v, {side('gl', 'hl', 'nl')} + {side('(g - gl)', '(h - hl)', '(n - nl)')}
      - {side('g', 'h', 'n')} AS gain FROM sides{k}
    WHERE nl < n AND hl >= {least_h} AND h - hl >= {least_h}),
  best{k} AS (SELECT node, f AS bf, v AS bv FROM gains{k} WHERE gain > {least_gain}
    QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) = 1),
  level{k + 1} AS (SELECT id, f1, f2, f3, y, g, h, CASE WHEN bf IS NULL THEN l.node
      WHEN CASE bf WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END <= bv THEN l.node * 2
      ELSE l.node * 2 + 1 END AS node
    FROM level{k} l LEFT JOIN best{k} b ON l.node = b.node)"""
    return text


_BY_HESSIAN = "(CASE WHEN {n} = 0 THEN 0 ELSE {g} * {g} / ({h} + 1.0::DOUBLE) END)"
_BY_ROWS = "(CASE WHEN {n} = 0 THEN 0 ELSE {g} * {g} / CAST({n} AS DOUBLE) END)"


def _classes(source, depth, leaf, weight, start="0.0::DOUBLE", least_h=0.0, least_gain="1e-6"):
    return f"""WITH {_grown(source, depth, weight, least_h, least_gain)},
  leaves AS (SELECT node, {leaf} AS value FROM level{depth} GROUP BY node),
  told AS (SELECT id, 1 / (1 + exp(-({start} + value))) AS p FROM level{depth} JOIN leaves USING (node))
  SELECT id, CASE WHEN p > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction,
    round(p, 6) AS probability FROM told"""


_Y = _ORDERS.format(orders="orders")
_HALF = f"SELECT *, 0.5::DOUBLE - y AS g, 0.25::DOUBLE AS h FROM ({_Y})"
_PRIOR = f"""SELECT t.*, p - y AS g, p * (1 - p) AS h FROM ({_Y}) t, (
  SELECT avg(y) AS p FROM ({_Y}))"""
_SHARES = f"SELECT *, CAST(y AS DOUBLE) AS g, 1.0::DOUBLE AS h FROM ({_Y})"
_CENTS = _CUSTOMERS.format(customer="customer")
_RESIDUALS = f"""SELECT t.*, m - y AS g, 1.0::DOUBLE AS h FROM ({_CENTS}) t, (
  SELECT avg(y) AS m FROM ({_CENTS}))"""

F15_SQL = _classes(_HALF, 3, "-sum(g) / (sum(h) + 1) * 0.1", _BY_HESSIAN, least_h=1)
F04_SQL = _classes(_PRIOR, 2, "-sum(g) / sum(h) * 0.1", _BY_ROWS,
                   f"(SELECT ln(avg(y) / (1 - avg(y))) FROM ({_Y}))")
# For two classes the Gini gain is twice the variance's.
F03_SQL = f"""WITH {_grown(_SHARES, 3, _BY_ROWS, least_gain="-1")},
  leaves AS (SELECT node, avg(y) AS p FROM level3 GROUP BY node)
  SELECT id, CASE WHEN p > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction,
    round(p, 6) AS probability FROM level3 JOIN leaves USING (node)"""
F09_SQL = f"""WITH {_grown(_RESIDUALS, 2, _BY_ROWS)},
  leaves AS (SELECT node, (SELECT avg(y) FROM ({_CENTS})) - avg(g) * 0.1 AS value
    FROM level2 GROUP BY node)
  SELECT id, round(value, 1) AS prediction FROM level2 JOIN leaves USING (node)"""
F08_SQL = f"""WITH {_grown(_RESIDUALS, 3, _BY_ROWS)},
  leaves AS (SELECT node, avg(y) AS value FROM level3 GROUP BY node)
  SELECT id, round(value, 1) AS prediction FROM level3 JOIN leaves USING (node)"""


def f02_unlimited(spark, d):
    """The suite's tree on one feature of 199 values: a leaf for each value or pure stretch."""
    orders = table(spark, d, "orders").withColumns({
        "x": (F.col("o_orderkey") % 199).cast("double"),
        LABEL: F.when(F.col("o_orderstatus") == "F", 0.0).when(
            F.col("o_orderstatus") == "O", 1.0).otherwise(2.0)})
    rows = VectorAssembler(inputCols=["x"], outputCol=FEATURES).transform(orders)
    _, make = SUITE_MAKERS["DecisionTree"]
    return make().fit(rows).transform(rows).select("o_orderkey", "prediction")


F02_SQL = """WITH t AS (SELECT o_orderkey, o_orderkey % 199 AS x, CASE o_orderstatus WHEN 'F' THEN 0
    WHEN 'O' THEN 1 ELSE 2 END AS y FROM orders),
  best AS (SELECT x, y FROM t GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY x ORDER BY count(*) DESC, y) = 1)
  SELECT o_orderkey, CAST(best.y AS DOUBLE) AS prediction FROM t JOIN best USING (x)"""


def i02_probability(spark, d):
    """Scoring with the probability kept: a forest of one tree with a leaf for each level."""
    df = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority")
    trained = R.train_final(df, "o_orderstatus", "id", "orders", "random forest", {
        "numTrees": 1, "bootstrap": False, "nodeFeatures": "all"})
    return rounded(score(df, trained.model, trained.meta))


I02_SQL = """WITH levels AS (
    SELECT o_orderpriority, o_orderstatus, count(*) AS n,
      count(*) / CAST(sum(count(*)) OVER (PARTITION BY o_orderpriority) AS DOUBLE) AS share
    FROM orders GROUP BY 1, 2),
  best AS (SELECT * FROM levels QUALIFY row_number() OVER (
    PARTITION BY o_orderpriority ORDER BY n DESC, o_orderstatus) = 1)
  SELECT o.o_orderpriority, b.o_orderstatus AS prediction, round(share, 6) AS prediction_probability
  FROM orders o JOIN best b ON o.o_orderpriority = b.o_orderpriority"""


def f01_two_values(spark, d):
    """Logistic regression on one feature of two values: its penalised optimum is known."""
    rows = table(spark, d, "orders").select(
        F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0).alias("x"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias(LABEL))
    rows = VectorAssembler(inputCols=["x"], outputCol=FEATURES).transform(rows)
    scored = make_learner("logistic regression", "classification").fit(rows).transform(rows)
    share = F.round(vector_to_array("probability")[1], 3).alias("probability")
    return scored.groupBy("x", "prediction", share).agg(F.count(F.lit(1)).alias("n"))


# Newton's steps for the constant b and the penalised weight w.
F01_SQL = """WITH RECURSIVE cells AS (
    SELECT CAST(sum(CASE WHEN x THEN 0 ELSE 1 END) AS DOUBLE) AS n0, CAST(sum(CASE WHEN x THEN 1 ELSE 0 END) AS DOUBLE) AS n1,
      CAST(sum(CASE WHEN y AND NOT x THEN 1 ELSE 0 END) AS DOUBLE) AS y0,
      CAST(sum(CASE WHEN y AND x THEN 1 ELSE 0 END) AS DOUBLE) AS y1
    FROM (SELECT o_orderpriority = '1-URGENT' AS x, o_orderstatus = 'F' AS y FROM orders)),
  steps AS (
    SELECT 0 AS k, 0.0::DOUBLE AS b, 0.0::DOUBLE AS w
    UNION ALL
    SELECT k + 1, b - (hww * gb - hbw * gw) / (hbb * hww - hbw * hbw),
      w - (hbb * gw - hbw * gb) / (hbb * hww - hbw * hbw)
    FROM (SELECT k, b, w, n0 * p0 - y0 + n1 * p1 - y1 AS gb, n1 * p1 - y1 + w AS gw,
        n0 * p0 * (1 - p0) + n1 * p1 * (1 - p1) AS hbb, n1 * p1 * (1 - p1) AS hbw,
        n1 * p1 * (1 - p1) + 1 AS hww
      FROM (SELECT k, b, w, 1 / (1 + exp(-b)) AS p0, 1 / (1 + exp(-b - w)) AS p1 FROM steps), cells)
    WHERE k < 30),
  ends AS (SELECT b, w FROM steps WHERE k = 30),
  told AS (SELECT 0.0::DOUBLE AS x, 1 / (1 + exp(-b)) AS p FROM ends
    UNION ALL SELECT 1.0::DOUBLE, 1 / (1 + exp(-b - w)) FROM ends)
  SELECT x, CASE WHEN p > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction,
    round(p, 3) AS probability, count(*) AS n
  FROM told JOIN (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
    AS x FROM orders) USING (x) GROUP BY 1, 2, 3"""


def _suite(name, **params):
    return lambda: SUITE_MAKERS[name][1](**params)


QUERIES = {
    "f01_two_values": (f01_two_values, F01_SQL),
    "f02_unlimited_tree": (f02_unlimited, F02_SQL),
    "f03_forest_of_one": (_fitted(_ORDERS, "orders", lambda: make_learner(
        "random forest", "classification", {
            "numTrees": 1, "maxDepth": 3, "bootstrap": False, "nodeFeatures": "all"}), True), F03_SQL),
    "f04_first_round": (_fitted(_ORDERS, "orders", lambda: make_learner(
        "gradient boosting", "classification", {"trees": 1, "depth": 2}), True), F04_SQL),
    "f08_forest_of_one": (_fitted(_CUSTOMERS, "customer", lambda: make_learner(
        "random forest", "regression", {"numTrees": 1, "maxDepth": 3, "bootstrap": False}), False),
        F08_SQL),
    "f09_first_round": (_fitted(_CUSTOMERS, "customer", lambda: make_learner(
        "gradient boosting", "regression", {"trees": 1, "depth": 2}), False), F09_SQL),
    "f10_first_round": (_fitted(_CUSTOMERS, "customer", lambda: make_learner(
        "decision tree", "regression", {"trees": 1, "depth": 2}), False), F09_SQL),
    "f15_first_round": (_fitted(_ORDERS, "orders", _suite(
        "XGBoost", trees=1, depth=3, rowShare=1.0, columnShare=1.0), True), F15_SQL),
    "i02_probability": (i02_probability, I02_SQL),
}
