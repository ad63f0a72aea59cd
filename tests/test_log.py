import itertools

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabscout.functions import constants as K, names as N
from tabscout.operators import advise, benchlog as J
from workload.fixtures import table

NAMES = ["knn", "KNN", " svm ", "SVM", "catboost", None, "random_forest"]
ENTRY = st.tuples(st.integers(0, 3) | st.none(), st.sampled_from(NAMES), st.floats(0, 1))


def frame(spark, rows, start=0):
    return spark.createDataFrame(
        [(start + i, *r) for i, r in enumerate(rows)],
        "seq long, dataset_id long, model string, accuracy double")


def keyed(df):
    return {(r["dataset_id"], r["model"]): (r["seq"], r["accuracy"]) for r in df.collect()}


@settings(max_examples=8, deadline=None)
@given(st.lists(ENTRY, max_size=25))
def test_latest_is_the_last_write_and_idempotent(spark, rows):
    got = J.latest(frame(spark, rows).repartition(3))
    want = {(d, m): (i, a) for i, (d, m, a) in enumerate(rows)}
    assert keyed(got) == want
    assert keyed(J.latest(got)) == want


def upsert_by_hand(old, new):
    """Replace in place or append, clean, keep the first of repeats."""
    log = [[i, d, m, a] for i, (d, m, a) in enumerate(old)]
    for j, (d, m, a) in enumerate(new):
        name = K.STRICT_ALIASES.get((m or "").strip())
        if d is None or name not in K.OFFICIAL_LEARNERS:
            continue
        hit = next((r for r in log if r[1] == d and
                    K.STRICT_ALIASES.get((r[2] or "").strip()) == name), None)
        if hit:
            hit[3] = a
        else:
            log.append([1000 + j, d, name, a])
    result = {}
    for seq, d, m, a in log:
        name = K.STRICT_ALIASES.get((m or "").strip())
        if d is not None and name:
            result.setdefault((d, name), a)
    return result


@settings(max_examples=8, deadline=None)
@given(st.lists(ENTRY, max_size=15), st.lists(ENTRY, max_size=8))
def test_upsert(spark, old, new):
    got = J.upsert(frame(spark, old), frame(spark, new, 1000))
    assert {k: a for k, (_, a) in keyed(got).items()} == upsert_by_hand(old, new)


def test_results_do_not_depend_on_partitioning(spark, data):
    log = table(spark, data, "bench_log")
    mixed = log.repartition(11)
    for run in (J.repair, J.finalise, J.best_per_dataset, J.dataset_characteristics,
                J.best_cells_per_dataset, J.missing_cells):
        a = sorted(map(str, run(log).collect()))
        assert a == sorted(map(str, run(mixed).collect())), run.__name__


def test_hot_dataset_is_folded_before_the_shuffle(spark, data):
    """A group with most of the rows costs one row per task, not one task."""
    log = spark.range(20000).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id") % 50)
        .cast("long").alias("dataset_id"), F.lit("KNN").alias("model"), F.rand(1).alias("accuracy"))
    plan = J.latest(log)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max_by" in plan
    best = {r["dataset_id"]: r["seq"] for r in J.latest(log).collect()}
    assert best[1] == max(i for i in range(20000) if i % 10 < 9 or i % 50 == 1)


def test_completed_by_id_or_name(spark):
    metrics = {m: 0.5 for m in K.METRICS}
    rows = [dict(seq=i, dataset_id=d, dataset_name=n, model=m, status=s, **metrics)
            for i, (d, n, m, s) in enumerate([
                ("1", "a", "knn", "success"), ("x", " B ", "SVM", " Success "),
                ("2.0", None, "XGBoost", "success"), ("3", "c", "KNN", "failed"),
                ("4", "a", "xgboost", "success")])]
    rows.append(dict(rows[0], seq=9, model="SVM", f1_score=float("inf")))
    log = spark.createDataFrame(rows)
    catalog = spark.createDataFrame([(1, "A"), (2, "b"), (3, "c")], "dataset_id long, dataset_name string")
    done = {r["dataset_id"]: r["completed"] for r in J.completed(catalog, log).collect()}
    # Dataset 1 also gets what dataset 4 did under the same name.
    assert done == {1: ["KNN", "XGBoost"], 2: ["SVM", "XGBoost"], 3: []}
    plan = {r["dataset_id"]: (r["action"], r["completed"]) for r in J.resume_plan(catalog, log).collect()}
    assert plan == {1: ("resume", 2), 2: ("resume", 2), 3: ("start", 0)}


def full_log(spark, datasets, spoil=None):
    rows = [dict(seq=i, dataset_id=d, dataset_name=f"d{d}", model=m, status="success",
                 **{k: 0.5 for k in K.METRICS})
            for i, (d, m) in enumerate(itertools.product(range(datasets), K.OFFICIAL_LEARNERS))]
    if spoil:
        rows[3].update(spoil)
    return spark.createDataFrame(rows)


def test_complete_matrix(spark):
    assert J.summary(full_log(spark, 4), 4).first()["matrix_complete"]
    assert not J.summary(full_log(spark, 4), 5).first()["matrix_complete"]
    row = J.summary(full_log(spark, 4, {"status": "failed"}), 4).first()
    assert not row["matrix_complete"] and row["remaining"] == 1
    assert J.summary(full_log(spark, 4), 4, runner=True).first()["remaining"] == 0
    assert J.missing_cells(full_log(spark, 3)).count() == 0


def test_order(spark, data):
    rows = J.ordered(J.read_checkpoint(table(spark, data, "bench_log"))).collect()
    keys = [(r["dataset_id"] is None, r["dataset_id"] or 0, K.OFFICIAL_LEARNERS.index(r["model"]))
            for r in rows]
    assert keys == sorted(keys)


def test_best_cells_mix_rows(spark):
    log = spark.createDataFrame(
        [(0, "d", "a", 0.9, None), (1, "d", None, 0.95, 0.3), (2, "d", "c", None, 0.1)],
        "seq long, dataset_name string, model string, f1_score double, accuracy double")
    row = J.best_cells_per_dataset(log, ["model", "f1_score", "accuracy"]).first()
    assert (row["model"], row["f1_score"], row["accuracy"]) == ("a", 0.95, 0.3)


@pytest.mark.parametrize("n,f,num,cat,cls,reg", [
    (499, 20, 10, 5, "SVM", "Random Forest"), (499, 21, 10, 5, "SVM", "Gradient Boosting"),
    (499, 20, 5, 10, "Logistic Regression", "Gradient Boosting"),
    (499, 20, 5, 5, "Logistic Regression", "Random Forest"),
    (500, 30, 5, 10, "Random Forest", "Random Forest"),
    (500, 31, 10, 5, "Random Forest", "Gradient Boosting"),
    (4999, 31, 5, 5, "Random Forest", "Gradient Boosting"),
    (5000, 31, 5, 5, "Random Forest", "Random Forest"),
])
def test_rules(spark, n, f, num, cat, cls, reg):
    df = spark.createDataFrame([(n, f, num, cat)], "n_samples long, n_features long, "
                               "n_numeric long, n_categorical long")
    assert advise.rules_classification(df).first()["recommended_model"] == cls
    assert advise.rules_regression(df).first()["recommended_model"] == reg


def test_names(spark):
    assert N.canonical_learner(" K-Nearest Neighbors ") == "knn"
    assert N.canonical_learner("LogisticRegression") == "logistic regression"
    assert N.gate("RandomForest", "classification") == "RandomForest"
    assert N.gate("DecisionTree", "classification", strict=True) == "Random Forest"
    assert N.gate("XGBoost", "regression") == "Gradient Boosting"
    assert N.gate("SVM", "classification", strict=True) == "SVM"
    spelled = {r["spelling"]: r["learner"] for r in N.alias_table(spark).collect()}
    assert spelled == K.FACTORY_ALIASES
