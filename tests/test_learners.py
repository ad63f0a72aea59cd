import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabscout.operators import metrics as M, neighbors as NB
from tabscout.operators.learners import make_learner
from tabscout.operators.preprocess import FEATURES, LABEL
from tabscout.plans import selector as H, suite as U, train as R
from tabscout.plans.recommend import recommend
from tabscout.plans.score import score
from tabscout.operators.profile import DatasetSpec
from tabscout.session import scratch_path
from tabscout.sources.artifacts import load_model
from tabscout.sources.logstore import ResultLog
from tabscout.streaming.score_stream import read_stream, score_stream
from workload.fixtures import table

SMALL_SUITE = {
    "LogisticRegression": {"maxIter": 20}, "DecisionTree": {"maxDepth": 5},
    "RandomForest": {"numTrees": 10, "maxDepth": 5}, "SVM": {"width": 32, "maxIter": 10},
    "XGBoost": {"trees": 3, "depth": 3},
}
QUICK = {
    "logistic regression": {"maxIter": 10}, "decision tree": {"maxDepth": 3},
    "random forest": {"numTrees": 5, "maxDepth": 3}, "gradient boosting": {"trees": 2},
    "svm": {"width": 16, "maxIter": 5}, "knn": {}, "naive bayes": {},
}


def brute(train, query, k):
    result = []
    for q, x in query:
        near = sorted((float(np.sqrt(((np.array(x) - np.array(t)) ** 2).sum())), key)
                      for key, t in train)[:k]
        result += [(q, rank + 1, key, round(d, 9)) for rank, (d, key) in enumerate(near)]
    return sorted(result)


@pytest.mark.parametrize("shape", ["spread", "clustered", "copies"])
def test_neighbours_match_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(NB, "TRAIN_BLOCK", 16)
    monkeypatch.setattr(NB, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(5)
    points = rng.normal(size=(330, 3))
    if shape == "clustered":
        points += rng.integers(0, 5, (330, 1)) * 20
    if shape == "copies":
        points[::3] = points[0]
    train = [(i, [float(v) for v in points[i]]) for i in range(300)]
    query = [(i, [float(v) for v in points[i]]) for i in range(270, 330)]
    found = NB.neighbours(
        spark.createDataFrame([(*t, t[0] % 3) for t in train], "k long, v array<double>, y int"),
        spark.createDataFrame(query, "q long, v array<double>"), 5, "k", "q", "v", "y")
    got = sorted((r["query_key"], r["rank"], r["train_key"], round(r["distance"], 9))
                 for r in found.collect())
    assert got == brute(train, query, 5)


def test_too_few_neighbours(spark):
    df = spark.createDataFrame([(1, [0.0], 1)], "k long, v array<double>, y int")
    with pytest.raises(ValueError, match="5 neighbours"):
        NB.neighbours(df, df, 5, "k", "k", "v", "y")


def test_metrics_agree_with_spark(spark, data):
    pred = table(spark, data, "pred_cls").withColumns({
        "l": F.ascii("label").cast("double"), "p": F.ascii("prediction").cast("double")})
    row = M.classification_metrics(pred).first()
    for ours, theirs in (("accuracy", "accuracy"), ("f1_score", "f1"),
                         ("precision", "weightedPrecision"), ("recall", "weightedRecall")):
        want = MulticlassClassificationEvaluator(
            labelCol="l", predictionCol="p", metricName=theirs).evaluate(pred)
        assert row[ours] == pytest.approx(want, abs=1e-9)


def test_r2_of_constant_truth(spark):
    same = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "label double, prediction double")
    off = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "label double, prediction double")
    assert M.regression_metrics(same).first()["r2_score"] == 1.0
    assert M.regression_metrics(off).first()["r2_score"] == 0.0


def test_ridge_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2))
    y = x @ [2.0, -1.0] + rng.normal(size=60)
    df = VectorAssembler(inputCols=["a", "b"], outputCol=FEATURES).transform(
        spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)],
                              f"a double, b double, {LABEL} double"))
    model = make_learner("ridge", "regression", {"alpha": 5.0}).fit(df)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 5 * np.eye(2), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), want, atol=1e-8)


def test_unknown_learner():
    with pytest.raises(ValueError, match="supported"):
        make_learner("ridge", "classification")


@pytest.mark.parametrize("name", list(QUICK))
def test_classifiers_score_save_and_load(spark, data, name):
    df = table(spark, data, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority",
                                             "o_orderstatus").limit(300)
    trained = R.train_final(df, "o_orderstatus", "o_orderkey", "orders", name, QUICK[name])
    assert trained.meta["evaluation_samples"] == 60
    assert 0 <= trained.meta["accuracy"] <= 1
    scored = score(df, trained.model, trained.meta)
    features = trained.meta["feature_columns"]
    assert scored.columns == [*features, "prediction", "prediction_probability"]
    rows = scored.collect()
    assert len(rows) == 300
    assert {r["prediction"] for r in rows} <= {"F", "O", "P"}
    assert all(1 / 3 - 1e-9 <= r["prediction_probability"] <= 1 + 1e-9 for r in rows) or \
        name in ("gradient boosting", "knn")
    path = scratch_path(spark, "model")
    trained.save(path)
    model, meta = load_model(spark, path)
    again = score(df, model, meta).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


@pytest.mark.parametrize("name,params", [
    ("linear regression", {}), ("ridge", {}), ("decision tree", {"trees": 2}),
    ("random forest", {"numTrees": 3, "maxDepth": 3}), ("knn", {}),
    ("svm", {"width": 16, "maxIter": 5})])
def test_regressors(spark, data, name, params):
    df = table(spark, data, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus",
                                             "o_custkey").limit(200)
    trained = R.train_final(df, "o_totalprice", "o_orderkey", "orders", name, params)
    assert trained.meta["task_type"] == "regression"
    assert set(trained.meta) >= {"r2_score", "mae", "rmse"}
    scored = score(df, trained.model, trained.meta)
    assert scored.count() == 200 and "prediction_probability" not in scored.columns
    assert scored.filter("prediction IS NULL").count() == 0


def test_advised_training_keeps_label_type(spark):
    df = spark.range(120).select(
        F.col("id").alias("user_id"), (F.col("id") % 2 + 10).alias("y"),
        (F.col("id") % 2 * 3 + F.col("id") % 5).cast("double").alias("x"))
    trained = R.train_final(df, "y", "user_id", params={"width": 16, "maxIter": 5})
    assert trained.meta["recommended_model"] == "SVM"
    assert trained.meta["removed_identifier_columns"] == ["user_id"]
    scored = score(df, trained.model, trained.meta)
    assert scored.schema["prediction"].dataType.simpleString() == "bigint"
    assert {r[0] for r in scored.select("prediction").collect()} <= {10, 11}


def test_suite_logs_failures_and_resumes(spark, data):
    path = scratch_path(spark, "log")
    specs = [DatasetSpec("labels", "quality", f"{data}/labels.parquet", task_id=1, dataset_id=1),
             DatasetSpec("broken", "nothing", f"{data}/orders.parquet", task_id=2, dataset_id=2)]
    quick = {**SMALL_SUITE, "KNN": {"k": 5000}}
    summary, counters = U.run_benchmark(spark, specs, lambda s: "doc_id", path, quick)
    assert counters == {"run": 1, "skipped": 0, "resumed": 0, "failed": 1}
    row = summary.first()
    assert (row["rows"], row["successful"], row["complete_datasets"]) == (6, 5, 0)
    log = ResultLog(spark, path)
    failed = log.read().filter("status = 'failed'").first()
    assert failed["model"] == "KNN" and "5000 neighbours" in failed["error"]
    summary, counters = U.run_benchmark(spark, specs[:1], lambda s: "doc_id", path, SMALL_SUITE)
    assert counters == {"run": 1, "skipped": 0, "resumed": 1, "failed": 0}
    assert summary.first()["matrix_complete"]
    assert log.read().count() == 6 and log.read().filter("status = 'failed'").count() == 0
    _, counters = U.run_benchmark(spark, specs[:1], lambda s: "doc_id", path, SMALL_SUITE)
    assert counters["skipped"] == 1


def test_not_viable(spark):
    with pytest.raises(U.NotViable, match="too_few_rows"):
        U.run_suite(spark.range(5).selectExpr("id k", "id x", "id % 2 y"), "y", "k")


def test_cross_validation(spark, data):
    rows = U.cross_validate(table(spark, data, "labels"), "quality", "doc_id",
                            ["DecisionTree"], folds=3, params=SMALL_SUITE)
    assert len(rows) == 1 and 0 <= rows[0]["f1_macro_mean"] <= 1 and rows[0]["f1_macro_std"] >= 0


def test_folds_side_by_side_share_no_properties(spark, data, monkeypatch):
    import threading

    context, together = spark.sparkContext, threading.Barrier(2, timeout=60)
    seen = []

    class Watch:
        def fit(self, rows):
            own = str(threading.get_ident())
            context.setLocalProperty("ts.thread", own)
            together.wait()
            seen.append(context.getLocalProperty("ts.thread") == own)
            together.wait()
            raise InterruptedError

    monkeypatch.setattr(U, "suite", lambda shape, params: {
        n: U.Entry(False, Watch(), None) for n in U.K.OFFICIAL_LEARNERS})
    with pytest.raises(InterruptedError):
        U.cross_validate(table(spark, data, "labels"), "quality", "doc_id", ["DecisionTree"], folds=2,
                         parallelism=2)
    assert seen == [True, True]


def test_package_is_shipped_once_by_threads_side_by_side():
    import threading
    from multiprocessing.pool import ThreadPool
    from types import SimpleNamespace

    from tabscout.session import ship_package

    paths, together = [], threading.Barrier(4, timeout=60)
    context = SimpleNamespace(applicationId="ship-test", addPyFile=paths.append)

    def ship(_):
        together.wait()
        ship_package(SimpleNamespace(sparkContext=context))

    with ThreadPool(4) as pool:
        pool.map(ship, range(4), chunksize=1)
    assert len(paths) == 1


def test_selector_round_trip(spark, data):
    from tabscout.operators import benchlog as J

    log = J.attach_meta(table(spark, data, "bench_log"), table(spark, data, "profiles"))
    trained = H.train_selector(log, trees=10, max_depth=8, holdout=True)
    assert set(trained.facts) == {"holdout_accuracy", "training_accuracy", "datasets"}
    path = scratch_path(spark, "selector")
    trained.save(path)
    back = H.load_selector(spark, path)
    assert back.labels == trained.labels
    assert H.load_selector(spark, path + "x") is None
    row = H.recommend_for(spark, back, {
        "n_samples": 5000, "n_features": 20, "n_classes": 2, "numeric_features": 20,
        "categorical_features": 0, "missing_percentage": 0}).first()
    shares = [e["confidence"] for e in row["ranking"]]
    assert shares == sorted(shares, reverse=True) and abs(sum(shares) - 1) < 0.01
    assert row["predicted_model"] == row["ranking"][0]["model"]
    orders = table(spark, data, "orders")
    learned = recommend(orders, "o_orderstatus", "orders", back).first()
    assert learned["recommended_model"] in trained.labels and learned["ranking"]
    # Regression never asks the selector, and a broken one falls back to the rules.
    assert recommend(orders, "o_totalprice", None, back).first()["ranking"] is None
    broken = H.Selector(back.model, ["nothing"], [])
    broken.model = None
    assert recommend(orders, "o_orderstatus", None, broken).first()[
        "recommended_model"] == "Random Forest"
    parts = H.evaluate_selector(H.selector_table(log), back)
    assert parts["counts"].first()["correct"] + parts["counts"].first()["incorrect"] == \
        parts["evaluation"].count()


@pytest.mark.parametrize("name", ["decision tree", "knn"])
def test_stream_equals_batch(spark, data, name):
    df = table(spark, data, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    trained = R.train_final(df, "o_orderstatus", "o_orderkey", None, name, QUICK[name])
    stream = read_stream(spark, data, table(spark, data, "orders").schema, "orders.parquet")
    sink = scratch_path(spark, "sink")
    score_stream(stream, trained.model, trained.meta, sink,
                 scratch_path(spark, "state")).awaitTermination()
    got = spark.read.parquet(sink).select("o_totalprice", "prediction")
    want = score(df, trained.model, trained.meta).select("o_totalprice", "prediction")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_cancelled_learner_leaves_the_others(spark, data):
    import threading

    context, done = spark.sparkContext, threading.Event()

    def cancel():
        while not done.wait(0.5):
            context.cancelJobGroup("suite-RandomForest")

    canceller = threading.Thread(target=cancel)
    canceller.start()
    try:
        rows = U.run_suite(table(spark, data, "labels"), "quality", "doc_id",
                           ["DecisionTree", "RandomForest", "LogisticRegression"],
                           {**SMALL_SUITE, "RandomForest": {"numTrees": 400, "maxDepth": 12}})
    finally:
        done.set()
        canceller.join()
    status = {r["model"]: r["status"] for r in rows}
    assert status == {"LogisticRegression": "success", "DecisionTree": "success",
                      "RandomForest": "failed"}
    assert "cancel" in [r["error"] for r in rows if r["model"] == "RandomForest"][0].lower()
