"""Tables derived from the given ones, in SQL that Spark and DuckDB both read.

``{name}`` stands for a given table: a frame on the Spark side, a view on the other.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BENCH_LOG = """
SELECT event_id AS seq,
       user_id % 34 AS task_id,
       CASE WHEN user_id % 34 = 33 THEN NULL ELSE user_id % 34 END AS dataset_id,
       CASE WHEN event_id % 29 = 0 THEN NULL
            ELSE concat('ds_', CAST(user_id % 34 AS STRING)) END AS dataset_name,
       'target' AS target_column,
       CASE CAST(event_id % 12 AS INT)
            WHEN 0 THEN 'logistic_regression' WHEN 1 THEN 'DecisionTree'
            WHEN 2 THEN ' random_forest ' WHEN 3 THEN 'KNN'
            WHEN 4 THEN 'svm' WHEN 5 THEN 'XGBoost'
            WHEN 6 THEN 'catboost' WHEN 7 THEN 'RANDOM_FOREST'
            WHEN 8 THEN 'LogisticRegression' WHEN 9 THEN 'knn'
            WHEN 10 THEN 'xgboost' ELSE NULL END AS model,
       CAST(100 + 37 * (user_id % 34) AS BIGINT) AS n_samples,
       CAST(3 + (user_id % 34) % 11 AS BIGINT) AS n_features,
       CAST(2 + (user_id % 34) % 4 AS BIGINT) AS n_classes,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE value / CAST(500 AS DOUBLE) END AS accuracy,
       CASE WHEN event_id % 17 = 0 THEN CAST('Infinity' AS DOUBLE)
            ELSE value / CAST(510 AS DOUBLE) END AS balanced_accuracy,
       CASE WHEN event_id % 19 = 0 THEN NULL ELSE value / CAST(520 AS DOUBLE) END AS f1_score,
       value / CAST(530 AS DOUBLE) AS "precision",
       value / CAST(540 AS DOUBLE) AS recall,
       value AS training_time,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN ' Success '
            WHEN 'view' THEN NULL ELSE 'success' END AS status,
       CASE WHEN event_type = 'error' THEN ' timeout ' ELSE NULL END AS error,
       'parquet' AS data_source
FROM {events}
"""

# The same log spread over many datasets, so that most lack some learner.
SPARSE_LOG = BENCH_LOG.replace("user_id % 34", "CAST(floor(event_id / 14) AS BIGINT)")

CATALOG = """
SELECT p_partkey AS dataset_id, concat('ds_', CAST(p_partkey % 34 AS STRING)) AS dataset_name,
       CAST(floor(p_retailprice) AS BIGINT) - 450 AS n_samples,
       CAST(p_size AS BIGINT) AS n_features,
       p_partkey % 5 AS n_classes
FROM {part}
"""

# Dataset sizes and column mixes on both sides of every rule's boundary.
PROFILES = """
SELECT p_partkey AS task_id, concat('ds_', CAST(p_partkey AS STRING)) AS dataset_name,
       (CAST(floor(p_retailprice) AS BIGINT) - 895) * 60 AS n_samples,
       CAST(p_size AS BIGINT) AS n_features,
       CAST(p_partkey % (p_size + 1) AS BIGINT) AS n_numeric,
       CAST(p_size - p_partkey % (p_size + 1) AS BIGINT) AS n_categorical,
       CAST(p_partkey % 7 AS DOUBLE) AS missing_percentage,
       CASE WHEN p_partkey % 2 = 0 THEN 'regression' ELSE 'classification' END AS task_type
FROM {part}
"""

PRED_CLS = """
SELECT o_orderkey AS id, o_orderstatus AS label,
       CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 350000 THEN 'O'
            WHEN o_totalprice < 480000 THEN 'P' ELSE 'X' END AS prediction
FROM {orders}
"""

PRED_REG = """
SELECT l_orderkey AS id, l_extendedprice AS label,
       CAST(52000 + 7 * l_quantity - 1000 * l_discount AS DOUBLE) AS prediction
FROM {lineitem}
"""

DIRTY = """
SELECT o_orderkey AS row_id, o_orderkey AS paid,
       CAST(NULL AS DOUBLE) AS all_null,
       7 AS constant_col,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'k' END AS constant_with_nulls,
       CASE WHEN o_orderkey % 25 = 0 THEN 'bad' ELSE CAST(o_custkey AS STRING) END AS numeric_text_96,
       CASE WHEN o_orderkey % 10 = 0 THEN 'bad' ELSE CAST(o_custkey AS STRING) END AS numeric_text_90,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS cat_nulls,
       o_totalprice > 250000 AS flag,
       o_orderdate AS ts,
       CASE WHEN o_orderkey % 11 = 0 THEN CAST('Infinity' AS DOUBLE)
            WHEN o_orderkey % 13 = 0 THEN CAST('NaN' AS DOUBLE)
            WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS num_inf,
       CASE WHEN o_orderkey % 23 = 0 THEN 'nan' WHEN o_orderkey % 29 = 0 THEN ''
            WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderstatus END AS target
FROM {orders}
"""

# Results that arrive after the log was written.
NEW_RESULTS = """
SELECT s_suppkey + 10000000 AS seq, s_suppkey % 40 AS task_id, s_suppkey % 40 AS dataset_id,
       concat('ds_', CAST(s_suppkey % 40 AS STRING)) AS dataset_name,
       CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'knn' WHEN 1 THEN 'SVM'
            WHEN 2 THEN 'catboost' ELSE 'random_forest' END AS model,
       s_acctbal / CAST(10000 AS DOUBLE) AS accuracy,
       'success' AS status
FROM {supplier}
"""

ALL = {
    "bench_log": BENCH_LOG, "sparse_log": SPARSE_LOG, "catalog": CATALOG, "profiles": PROFILES, "pred_cls": PRED_CLS,
    "pred_reg": PRED_REG, "dirty": DIRTY, "new_results": NEW_RESULTS,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table."""
    if name not in ALL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = ALL[name]
    sources = {s: table(spark, sf_dir, s) for s in re.findall(r"\{(\w+)\}", text)}
    return spark.sql(text.replace('"precision"', "`precision`"), **sources)


def with_tables(*names: str, sql: str) -> str:
    """DuckDB text with the derived tables it needs in front."""
    parts = []
    for name in names:
        text = re.sub(r"\{(\w+)\}", r"\1", ALL[name]).strip()
        parts.append(f"{name} AS (\n{text}\n)")
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
