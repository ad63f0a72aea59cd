"""Sources, sinks, checks and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscout.operators import validate as V
from tabscout.operators.profile import DatasetSpec
from tabscout.session import scratch_path
from tabscout.sources import catalog as C, logstore, tables as T

from .fixtures import table, with_tables

TABLES = {
    "region": "r_name", "nation": "n_regionkey", "customer": "c_mktsegment",
    "supplier": "s_nationkey", "part": "p_brand", "orders": "o_orderstatus",
    "lineitem": "l_returnflag", "events": "event_type", "documents": "lang",
    "embeddings": "label", "pages": "url", "benchmark": "text", "labels": "quality",
    "conversations": "role",
}
WIDTHS = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6,
    "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2,
    "labels": 3, "conversations": 4,
}


def a01_read_csv(spark, d):
    path = scratch_path(spark, "csv")
    T.write_table(table(spark, d, "customer"), path, "csv")
    return T.read_table(spark, path, "csv")


def a02_infer_types(spark, d):
    orders = table(spark, d, "orders")
    return T.infer_types(orders.select(*[F.col(c).cast("string").alias(c) for c in orders.columns]))


def a03_read_parquet(spark, d):
    counts = None
    for name in TABLES:
        one = T.read_table(spark, f"{d}/{name}.parquet", "parquet").agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    return counts


def a04_round_trip(spark, d):
    path = scratch_path(spark, "parquet")
    T.write_table(table(spark, d, "part"), path, "parquet")
    return T.read_table(spark, path, "parquet")


def a05_build_catalog(spark, d):
    specs = [
        DatasetSpec(n, t, f"{d}/{n}.parquet", task_id=i, dataset_id=i)
        for i, (n, t) in enumerate(TABLES.items())
    ]
    specs.append(DatasetSpec("broken", "no_such_column", f"{d}/orders.parquet"))
    return C.build_catalog(spark, specs)[0]


def a07_checkpoint_read(spark, d):
    path = scratch_path(spark, "log")
    logstore.append_results(table(spark, d, "bench_log"), path)
    return logstore.checkpoint_read(spark, path).select("seq", "dataset_id", "model", "accuracy")


def b03_drop_null_target(spark, d):
    return V.drop_null_target(table(spark, d, "dirty"), "target").select("row_id", "target")


def b04_clean_target(spark, d):
    return V.clean_target(table(spark, d, "dirty"), "target").select("row_id", "target")


def b05_filter_catalog(spark, d):
    return V.filter_catalog(table(spark, d, "catalog"), exclude=["ds_3", "ds_7"])


def b06_drop_missing(spark, d):
    return V.drop_missing(table(spark, d, "bench_log"), ["dataset_name", "model"]).select(
        "seq", "dataset_name", "model")


def b07_project(spark, d):
    log = table(spark, d, "bench_log")
    strict = V.project(log, ["seq", "dataset_id", "model", "status"])
    return V.project_available(strict, ["model", "not_there", "seq"])


def b09_viability(spark, d):
    return V.viability(table(spark, d, "catalog"))


def b10_reconcile(spark, d):
    meta = {"target_column": "o_orderstatus", "feature_columns": ["o_totalprice", "o_custkey"]}
    return V.reconcile_features(table(spark, d, "orders"), meta)


def b11_drop_ignored(spark, d):
    meta = {"row_id_attribute": "l_orderkey", "ignore_attribute": "l_tax, l_shipdate , nothing"}
    return V.drop_ignored(table(spark, d, "lineitem"), meta, "l_returnflag")[0]


def b12_slice(spark, d):
    return V.slice_equal(table(spark, d, "bench_log"), dataset_id=5, model="KNN").select(
        "seq", "dataset_id", "model")


LATEST = """
SELECT seq, dataset_id, model, accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_id, model ORDER BY seq DESC) AS rn
  FROM (SELECT seq, dataset_id, accuracy,
               CASE trim(model) WHEN 'logistic_regression' THEN 'LogisticRegression'
                 WHEN 'LogisticRegression' THEN 'LogisticRegression'
                 WHEN 'decision_tree' THEN 'DecisionTree' WHEN 'DecisionTree' THEN 'DecisionTree'
                 WHEN 'random_forest' THEN 'RandomForest' WHEN 'RandomForest' THEN 'RandomForest'
                 WHEN 'knn' THEN 'KNN' WHEN 'KNN' THEN 'KNN' WHEN 'svm' THEN 'SVM'
                 WHEN 'SVM' THEN 'SVM' WHEN 'xgboost' THEN 'XGBoost'
                 WHEN 'XGBoost' THEN 'XGBoost' END AS model FROM bench_log) t
  WHERE model IS NOT NULL) u WHERE rn = 1
"""

QUERIES = {
    "a01_read_csv": (a01_read_csv, """
        SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal,
               c_mktsegment FROM customer"""),
    "a02_infer_types": (a02_infer_types, """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
               CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders"""),
    "a03_read_parquet": (a03_read_parquet, " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES)),
    "a04_round_trip": (a04_round_trip, "SELECT * FROM part"),
    "a05_build_catalog": (a05_build_catalog, " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS task_id, CAST({i} AS BIGINT) AS dataset_id, "
        f"'{n}' AS dataset_name, '{t}' AS target_column, count(*) AS n_samples, "
        f"CAST({WIDTHS[n]} AS BIGINT) AS n_features, count(DISTINCT {t}) AS n_classes FROM {n}"
        for i, (n, t) in enumerate(TABLES.items()))),
    "a07_checkpoint_read": (a07_checkpoint_read, with_tables("bench_log", sql=LATEST)),
    "b03_drop_null_target": (b03_drop_null_target, with_tables(
        "dirty", sql="SELECT row_id, target FROM dirty WHERE target IS NOT NULL")),
    "b04_clean_target": (b04_clean_target, with_tables("dirty", sql="""
        SELECT row_id, target FROM dirty
        WHERE target IS NOT NULL AND target NOT IN ('nan', 'None', '')""")),
    "b05_filter_catalog": (b05_filter_catalog, with_tables("catalog", sql="""
        SELECT * FROM catalog WHERE n_samples >= 500 AND n_features >= 2 AND n_classes >= 2
        AND dataset_name NOT IN ('ds_3', 'ds_7')""")),
    "b06_drop_missing": (b06_drop_missing, with_tables("bench_log", sql="""
        SELECT seq, dataset_name, model FROM bench_log
        WHERE dataset_name IS NOT NULL AND model IS NOT NULL""")),
    "b07_project": (b07_project, with_tables(
        "bench_log", sql="SELECT model, seq FROM bench_log")),
    "b09_viability": (b09_viability, with_tables("catalog", sql="""
        SELECT *, CASE WHEN n_samples < 10 THEN 'too_few_rows' WHEN n_features <= 0
          THEN 'no_features' WHEN n_classes < 2 THEN 'one_class' ELSE 'ok' END AS viability
        FROM catalog""")),
    "b10_reconcile_features": (b10_reconcile, "SELECT o_totalprice, o_custkey FROM orders"),
    "b11_drop_ignored": (b11_drop_ignored, """
        SELECT l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
               l_returnflag, l_linestatus FROM lineitem"""),
    "b12_equality_slice": (b12_slice, with_tables("bench_log", sql="""
        SELECT seq, dataset_id, model FROM bench_log WHERE dataset_id = 5 AND model = 'KNN'""")),
}
