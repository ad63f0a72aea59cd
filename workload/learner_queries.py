"""Learners, training, scoring, recommending. Fitted models have no SQL twin unless a
closed form exists. Learners run with full parameters but in ``j39_run_benchmark``."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabscout.functions import names as N
from tabscout.operators import advise
from tabscout.operators.learners import make_learner
from tabscout.operators.neighbors import average, neighbours, vote
from tabscout.operators.preprocess import FEATURES, LABEL
from tabscout.operators.split import stratified_split
from tabscout.plans import selector as H, suite as U, train as R
from tabscout.plans.recommend import recommend
from tabscout.plans.score import predicted_value, prediction_distribution, score
from tabscout.session import scratch_path
from tabscout.sources.artifacts import load_model, write_scores
from tabscout.streaming.score_stream import read_stream, score_stream
from tabscout.operators import benchlog as J

from .fixtures import table, with_tables
from .log_queries import STRICT
from .prepare_queries import split_sql
from .profile_queries import rounded

# Many-round learners run with full parameters on smaller tables, whole.
TARGETS = {
    "classification": ("orders", "o_orderstatus", "o_orderkey",
                       ["o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"]),
    "labelled": ("labels", "quality", "doc_id", ["toxic", "lang", "source", "n_chars"]),
    "balances": ("customer", "c_acctbal", "c_custkey", ["c_nationkey", "c_mktsegment"]),
    "regression": ("orders", "o_totalprice", "o_orderkey",
                   ["o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]),
}


def _source(spark, d, task):
    name, target, key, features = TARGETS[task]
    df = _labelled(spark, d) if task == "labelled" else table(spark, d, name)
    return df.select(key, target, *features), target, key


def _labelled(spark, d):
    """The labels with what is known of their documents."""
    documents = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, d, "labels").join(documents, "doc_id")


def holdout_metrics(learner, task, params=None):
    """Fit on the training part of a whole table, score the held-out part."""
    def run(spark, d):
        df, target, key = _source(spark, d, task)
        kind = "regression" if target in ("o_totalprice", "c_acctbal") else "classification"
        scores = R.holdout_scores(df, target, key, learner, kind, params)
        return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumns(
            {"learner": F.lit(learner), **{m: F.lit(v) for m, v in scores.items()}})
    return run


def _vectors(df, names, label):
    return VectorAssembler(inputCols=names, outputCol=FEATURES).transform(
        df.withColumn(LABEL, F.col(label).cast("double")))


def f05_naive_bayes(spark, d):
    lineitem = table(spark, d, "lineitem")
    labels = R.class_labels(lineitem, "l_returnflag")
    rows = R.with_label(lineitem, "l_returnflag", "classification", labels)
    rows = VectorAssembler(inputCols=["l_quantity", "l_extendedprice"],
                           outputCol=FEATURES).transform(rows)
    scored = make_learner("Gaussian NB", "classification").fit(rows).transform(rows)
    value = predicted_value({"task_type": "classification", "labels": labels}, F.col("prediction"))
    return scored.groupBy("l_returnflag", value.alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def _line(learner, params=None):
    def run(spark, d):
        rows = _vectors(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
        model = make_learner(learner, "regression", params).fit(rows)
        counted = rows.agg(F.count(F.lit(1)).alias("n"))
        return counted.select(
            "n", F.round(F.lit(float(model.coefficients[0])), 4).alias("slope"),
            F.round(F.lit(float(model.intercept)), 3).alias("intercept"))
    return run


def _embedding_parts(spark, d):
    return stratified_split(table(spark, d, "embeddings"), "label", "vec_id")


def f11_neighbours(spark, d):
    train, test = _embedding_parts(spark, d)
    found = neighbours(train, test, 5, "vec_id", "vec_id", "embedding", "label")
    return rounded(vote(found).withColumnRenamed("query_key", "vec_id"))


def f11_neighbour_rows(spark, d):
    train, test = _embedding_parts(spark, d)
    found = neighbours(train, test, 5, "vec_id", "vec_id", "embedding", "label")
    return rounded(found.withColumnRenamed("query_key", "vec_id"), 5)


def f11_approximate(spark, d):
    """Share of the true neighbours that the hash tables find, over all queries."""
    train, test = _embedding_parts(spark, d)
    args = (train, test, 5, "vec_id", "vec_id", "embedding", "label")
    near = ["query_key", "train_key"]
    true, found = neighbours(*args).select(*near), neighbours(*args, method="approximate").select(*near)
    both = true.join(found, near, "left_semi").agg(F.count(F.lit(1)).alias("met"))
    whole = found.agg(F.count(F.lit(1)).alias("n_found"))
    return whole.join(both).select(
        "n_found", (F.col("met") >= 0.9 * F.col("n_found")).alias("recall_holds"))


def f12_neighbours_mean(spark, d):
    train, test = _embedding_parts(spark, d)
    found = neighbours(train, test, 5, "vec_id", "vec_id", "embedding", "label")
    return rounded(average(found).withColumnRenamed("query_key", "vec_id"))


def f16_aliases(spark, d):
    log = table(spark, d, "bench_log")
    return log.select("seq", N.factory_name(F.col("model")).alias("learner"))


def f17_gate(spark, d):
    log = table(spark, d, "bench_log").withColumn(
        "task", F.when(F.col("n_classes") == 2, "regression").otherwise("classification"))
    known = log.filter("model IS NOT NULL")
    return known.select(
        "seq", "task", N.gated(F.col("model"), F.col("task")).alias("gated"),
        N.gated(F.col("model"), F.col("task"), strict=True).alias("gated_strictly"))


def f20_train_final(spark, d):
    df, target, key = _source(spark, d, "labelled")
    trained = R.train_final(df, target, key, "labels", "random forest")
    facts = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return facts.withColumns({
        m: F.lit(trained.meta[m]) for m in
        ("recommended_model", "training_samples", "evaluation_samples", "accuracy", "f1_score")})


def f21_run_suite(spark, d):
    rows = U.run_suite(_labelled(spark, d), "quality", "doc_id",
                       facts={"dataset_name": "labels", "dataset_id": 1})
    return U.log_frame(spark, rows).select("model", "status", "accuracy", "n_samples")


def e02_cross_validate(spark, d):
    rows = U.cross_validate(
        _labelled(spark, d), "quality", "doc_id",
        ["LogisticRegression", "DecisionTree", "KNN"], dataset="labels")
    return spark.createDataFrame(rows)


def _selector_log(spark, d):
    return J.attach_meta(table(spark, d, "bench_log"), table(spark, d, "profiles"))


def h01_rules_classification(spark, d):
    return advise.rules_classification(table(spark, d, "profiles")).select(
        "task_id", "recommended_model")


def h02_rules_regression(spark, d):
    return advise.rules_regression(table(spark, d, "profiles")).select(
        "task_id", "recommended_model")


def h03_selector_labels(spark, d):
    return rounded(H.selector_table(_selector_log(spark, d)))


def h03_train_selector(spark, d):
    log = _selector_log(spark, d)
    trained = H.train_selector(log)
    return log.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "training_accuracy", F.lit(trained.facts["training_accuracy"]))


def h04_evaluate_selector(spark, d):
    log = _selector_log(spark, d)
    trained = H.train_selector(log)
    return H.evaluate_selector(H.selector_table(log), trained)["evaluation"]


def h05_rank_learners(spark, d):
    trained = H.train_selector(_selector_log(spark, d))
    profiles = table(spark, d, "profiles").withColumnsRenamed(
        {"n_numeric": "numeric_features", "n_categorical": "categorical_features"}
    ).withColumn("n_classes", F.lit(2))
    return H.ranking_rows(H.rank_learners(profiles, trained), ["task_id"])


def h06_rank_confidences(spark, d):
    named = J.official(J.normalise_models(table(spark, d, "bench_log")))
    scores = named.filter("dataset_id IS NOT NULL").groupBy("dataset_id", "model").agg(
        F.avg("accuracy").alias("confidence"))
    return H.rank_confidences(scores, "dataset_id")


RECOMMENDED = [("orders", "o_orderstatus"), ("lineitem", "l_extendedprice"),
               ("customer", "c_mktsegment"), ("supplier", "s_acctbal"), ("labels", "quality")]


def h07_recommend(spark, d):
    result = None
    for name, target in RECOMMENDED:
        one = recommend(table(spark, d, name), target, name).drop("ranking")
        result = one if result is None else result.unionByName(one)
    return result


def h07_recommend_learned(spark, d):
    trained = H.train_selector(_selector_log(spark, d))
    return recommend(table(spark, d, "orders"), "o_orderstatus", "orders", trained).select(
        "task_type", "samples", "recommended_model", F.explode("ranking").alias("entry")
    ).select("task_type", "samples", "recommended_model", "entry.model", "entry.confidence")


def _trained(spark, d, learner="decision tree", params=None):
    df, target, key = _source(spark, d, "classification")
    return df, R.train_final(df, target, key, "orders", learner, params)


def i01_score(spark, d):
    df, trained = _trained(spark, d)
    return score(df, trained.model, trained.meta)


def i01_saved_score(spark, d):
    df, trained = _trained(spark, d)
    path = scratch_path(spark, "model")
    trained.save(path)
    model, meta = load_model(spark, path)
    scored = score(df, model, meta)
    out = scratch_path(spark, "scores")
    write_scores(scored, out)
    return spark.read.parquet(out)


def i03_distribution(spark, d):
    df, trained = _trained(spark, d)
    return prediction_distribution(score(df, trained.model, trained.meta))


def i04_score_stream(spark, d):
    df, trained = _trained(spark, d)
    schema = table(spark, d, "orders").schema
    stream = read_stream(spark, d, schema, "orders.parquet")
    sink = scratch_path(spark, "stream")
    query = score_stream(stream, trained.model, trained.meta, sink, scratch_path(spark, "state"))
    query.awaitTermination()
    return prediction_distribution(spark.read.parquet(sink))


def a06_save_load(spark, d):
    _, trained = _trained(spark, d)
    path = scratch_path(spark, "model")
    trained.save(path)
    _, meta = load_model(spark, path)
    absent = load_model(spark, path + "-absent")
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n_rows")).withColumns({
        "features": F.lit(", ".join(meta["feature_columns"])),
        "absent_is_none": F.lit(absent is None)})


def _saturated(spark, d):
    """A tree on one category, deep enough for a leaf for each level: its answers are exact."""
    df = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority")
    return df, R.train_final(df, "o_orderstatus", "id", "orders", "decision tree")


def f20_saturated(spark, d):
    df, trained = _saturated(spark, d)
    return rounded(df.agg(F.count(F.lit(1)).alias("n_rows")).withColumns({
        "recommended_model": F.lit(trained.meta["recommended_model"]),
        **{m: F.lit(trained.meta[m]).cast("bigint")
           for m in ("training_samples", "evaluation_samples")},
        "accuracy": F.lit(trained.meta["accuracy"])}))


def i01_saturated_score(spark, d):
    df, trained = _saturated(spark, d)
    # Sibling leaves of one class are merged, so shares are not those of a level.
    return score(df, trained.model, trained.meta).drop("prediction_probability")


def i01_saturated_saved(spark, d):
    df, trained = _saturated(spark, d)
    path, out = scratch_path(spark, "model"), scratch_path(spark, "scores")
    trained.save(path)
    model, meta = load_model(spark, path)
    write_scores(score(df, model, meta), out)
    return spark.read.parquet(out).drop("prediction_probability")


def i03_saturated_distribution(spark, d):
    df, trained = _saturated(spark, d)
    return prediction_distribution(score(df, trained.model, trained.meta))


def i04_saturated_stream(spark, d):
    _, trained = _saturated(spark, d)
    stream = read_stream(spark, d, table(spark, d, "orders").schema, "orders.parquet")
    sink = scratch_path(spark, "stream")
    score_stream(stream, trained.model, trained.meta, sink,
                 scratch_path(spark, "state")).awaitTermination()
    return prediction_distribution(spark.read.parquet(sink))


# Fewer rounds than the suite's own: this query is about many datasets.
_SHORT = {
    "LogisticRegression": {"maxIter": 20}, "DecisionTree": {"maxDepth": 5},
    "RandomForest": {"numTrees": 10, "maxDepth": 5}, "SVM": {"width": 32, "maxIter": 10},
    "XGBoost": {"trees": 3, "depth": 3},
}
_DATASETS = [
    ("labels", "quality", "doc_id"), ("customer", "c_mktsegment", "c_custkey"),
    ("orders", "o_orderstatus", "o_orderkey"), ("part", "p_type", "p_partkey"),
    ("events", "event_type", "event_id"), ("documents", "lang", "doc_id"),
    ("region", "r_name", "r_regionkey"), ("broken", "no_such_column", "o_orderkey"),
]


def j39_run_benchmark(spark, d):
    """Whole tables: six to run, one too small, one whose target is missing."""
    from tabscout.operators.profile import DatasetSpec

    specs = [DatasetSpec(name, target, f"{d}/{'orders' if name == 'broken' else name}.parquet",
                         task_id=i, dataset_id=i) for i, (name, target, _) in enumerate(_DATASETS, 1)]
    keys = {name: key for name, _, key in _DATASETS}
    result, counters = U.run_benchmark(
        spark, specs, lambda s: keys[s.name], scratch_path(spark, "runs"), _SHORT)
    return result.withColumns({f"datasets_{k}": F.lit(v) for k, v in counters.items()})


_FACTORY = """CASE lower(trim(model)) WHEN 'logistic' THEN 'logistic regression'
  WHEN 'decisiontree' THEN 'decision tree' WHEN 'randomforest' THEN 'random forest'
  WHEN 'gradientboosting' THEN 'gradient boosting' WHEN 'k-nearest neighbors' THEN 'knn'
  WHEN 'k nearest neighbors' THEN 'knn' WHEN 'gaussian nb' THEN 'naive bayes'
  WHEN 'support vector machine' THEN 'svm'{extra} ELSE lower(trim(model)) END"""
_CLASSIFIERS = ("('logistic regression', 'decision tree', 'random forest', 'gradient boosting', "
                "'knn', 'naive bayes', 'svm')")
_REGRESSORS = ("('linear regression', 'ridge', 'decision tree', 'random forest', "
               "'gradient boosting', 'knn', 'svm')")
_LABELLED = _FACTORY.format(extra=" WHEN 'logisticregression' THEN 'logistic regression'")


def _gate_sql(known):
    return (f"CASE WHEN task = 'regression' THEN CASE WHEN {known} IN {_REGRESSORS} THEN model "
            f"ELSE 'Gradient Boosting' END ELSE CASE WHEN {known} IN {_CLASSIFIERS} THEN model "
            f"ELSE 'Random Forest' END END")


_H1 = """CASE WHEN n_samples < 500 AND n_numeric > n_categorical THEN 'SVM'
  WHEN n_samples < 500 THEN 'Logistic Regression' ELSE 'Random Forest' END"""
_H2 = """CASE WHEN n_categorical > n_numeric THEN
    CASE WHEN n_samples >= 500 THEN 'Random Forest' ELSE 'Gradient Boosting' END
  WHEN n_samples < 500 THEN CASE WHEN n_features <= 20 THEN 'Random Forest'
    ELSE 'Gradient Boosting' END
  WHEN n_samples >= 5000 THEN 'Random Forest' ELSE 'Gradient Boosting' END"""

_NEAREST = "WITH " + split_sql("embeddings", "label", "vec_id").strip() + """,
d AS (SELECT q.vec_id, t.vec_id AS train_key, t.label AS outcome,
        list_distance(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) AS distance
      FROM split q JOIN split t ON q.is_test AND NOT t.is_test),
near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, train_key) AS rank
         FROM d QUALIFY rank <= 5)
"""
_SXX = "regr_sxx(l_extendedprice, l_quantity)"
_SXY = "regr_sxy(l_extendedprice, l_quantity)"


def _line_sql(alpha):
    return f"""SELECT n, round(s, 4) AS slope, round(my - s * mx, 3) AS intercept FROM
      (SELECT count(*) AS n, {_SXY} / ({_SXX} + {alpha}) AS s, avg(l_extendedprice) AS my,
        avg(l_quantity) AS mx FROM lineitem) t"""


# target, features, numeric, categorical, task test
_FACTS = {"orders": (5, 3, 2), "lineitem": (10, 7, 3), "customer": (4, 3, 1),
          "supplier": (3, 2, 1), "labels": (2, 2, 0)}


def _recommend_sql(name, target):
    features, numeric, categorical = _FACTS[name]
    regression = target in ("l_extendedprice", "s_acctbal")
    task = "regression" if regression else "classification"
    classes = "CAST(0 AS BIGINT)" if regression else f"count(DISTINCT {target})"
    rule = (_H2 if regression else _H1).replace("n_samples", "count(*)")
    for word, value in (("n_features", features), ("n_numeric", numeric),
                        ("n_categorical", categorical)):
        rule = rule.replace(word, str(value))
    return f"""SELECT '{task}' AS task_type, '{name}' AS dataset, count(*) AS samples,
      CAST({features} AS BIGINT) AS features, {classes} AS classes,
      CAST({numeric} AS BIGINT) AS numeric_features,
      CAST({categorical} AS BIGINT) AS categorical_features,
      CAST(0 AS DOUBLE) AS missing_percentage, {rule} AS recommended_model FROM {name}"""


_MAJORITY = """levels AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM {rows} GROUP BY 1, 2),
  best AS (SELECT o_orderpriority, o_orderstatus AS prediction,
      row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_orderstatus) AS seat FROM levels)
"""
_OF_ALL = "WITH " + _MAJORITY.format(rows="orders")
_SCORED = _OF_ALL + """SELECT o.o_orderpriority, prediction
  FROM orders o JOIN best b ON o.o_orderpriority = b.o_orderpriority AND seat = 1"""
_DISTRIBUTION = _OF_ALL + """SELECT prediction AS value, count(*) AS n
  FROM orders o JOIN best b ON o.o_orderpriority = b.o_orderpriority AND seat = 1 GROUP BY 1"""
_SATURATED = ("WITH " + split_sql("orders", "o_orderstatus", "o_orderkey").strip() + ", "
              + _MAJORITY.format(rows="split WHERE NOT is_test") + """
  SELECT (SELECT count(*) FROM orders) AS n_rows, 'decision tree' AS recommended_model,
    (SELECT count(*) FROM orders) AS training_samples, count(*) AS evaluation_samples,
    round(avg(CASE WHEN prediction = o_orderstatus THEN 1.0 ELSE 0.0 END), 6) AS accuracy
  FROM split s JOIN best b ON s.o_orderpriority = b.o_orderpriority AND seat = 1 WHERE is_test""")


QUERIES = {
    "f20_saturated_train": (f20_saturated, _SATURATED),
    "i01_saturated_score": (i01_saturated_score, _SCORED),
    "i01_saturated_saved": (i01_saturated_saved, _SCORED),
    "i03_saturated_distribution": (i03_saturated_distribution, _DISTRIBUTION),
    "i04_saturated_stream": (i04_saturated_stream, _DISTRIBUTION),
    "a06_save_load_model": (a06_save_load, None),
    "e02_cross_validate": (e02_cross_validate, None),
    "f01_logistic_regression": (
        holdout_metrics("Logistic", "classification"), None),
    "f02_decision_tree": (
        holdout_metrics("DecisionTree", "classification"), None),
    "f03_random_forest": (
        holdout_metrics("Random Forest", "labelled"), None),
    "f04_gradient_boosting": (
        holdout_metrics("GradientBoosting", "labelled"), None),
    "f05_naive_bayes": (f05_naive_bayes, """
        WITH c AS (SELECT l_returnflag AS label, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM lineitem)
              AS prior, avg(l_quantity) AS m1, var_pop(l_quantity) + e AS v1,
              avg(l_extendedprice) AS m2, var_pop(l_extendedprice) + e AS v2
            FROM lineitem, (SELECT 1e-9 * greatest(var_pop(l_quantity), var_pop(l_extendedprice))
              AS e FROM lineitem) smooth GROUP BY 1, e),
        rows AS (SELECT row_number() OVER () AS i, l_returnflag, l_quantity AS x1,
              l_extendedprice AS x2 FROM lineitem),
        s AS (SELECT i, l_returnflag, label, ln(prior) - 0.5 * (ln(v1) + ln(v2)
              + pow(x1 - m1, 2) / v1 + pow(x2 - m2, 2) / v2) AS score FROM rows CROSS JOIN c),
        best AS (SELECT i, l_returnflag, arg_max(label, score) AS predicted FROM s GROUP BY 1, 2)
        SELECT l_returnflag, predicted, count(*) AS n FROM best GROUP BY 1, 2"""),
    "f05_naive_bayes_holdout": (holdout_metrics("Naive Bayes", "classification"), None),
    "f06_linear_regression": (_line("Linear Regression"), _line_sql(0)),
    "f07_ridge": (_line("Ridge", {"alpha": 1000.0}), _line_sql(1000)),
    "f08_forest_regression": (
        holdout_metrics("Random Forest", "balances"), None),
    "f09_boosting_regression": (
        holdout_metrics("Gradient Boosting", "balances"), None),
    "f10_tree_regression": (
        holdout_metrics("Decision Tree", "balances"), None),
    "f11_neighbour_votes": (f11_neighbours, _NEAREST + """
        , v AS (SELECT vec_id, outcome, count(*) AS n FROM near GROUP BY 1, 2)
        SELECT vec_id, prediction, round(n / CAST(5 AS DOUBLE), 6) AS probability FROM
        (SELECT vec_id, outcome AS prediction, n, row_number() OVER (PARTITION BY vec_id
          ORDER BY n DESC, outcome) AS rn FROM v) t WHERE rn = 1"""),
    "f11_neighbour_rows": (f11_neighbour_rows, _NEAREST + """
        SELECT vec_id, train_key, round(distance, 5) AS distance, outcome,
          CAST(rank AS INTEGER) AS rank FROM near"""),
    "f11_approximate": (f11_approximate, _NEAREST + """
        SELECT count(*) AS n_found, true AS recall_holds FROM near"""),
    "f11_knn_holdout": (holdout_metrics("K-Nearest Neighbors", "classification"), None),
    "f12_neighbour_mean": (f12_neighbours_mean, _NEAREST + """
        SELECT vec_id, round(avg(outcome), 6) AS prediction FROM near GROUP BY vec_id"""),
    "f12_knn_regression": (holdout_metrics("knn", "regression"), None),
    "f13_kernel_classifier": (
        holdout_metrics("SVM", "labelled"), None),
    "f14_kernel_regressor": (
        holdout_metrics("Support Vector Machine", "balances"), None),
    "f16_factory_aliases": (f16_aliases, with_tables("bench_log", sql=f"""
        SELECT seq, {_FACTORY.format(extra='')} AS learner FROM bench_log""")),
    "f17_gate": (f17_gate, with_tables("bench_log", sql=f"""
        WITH t AS (SELECT *, CASE WHEN n_classes = 2 THEN 'regression' ELSE 'classification' END
          AS task FROM bench_log WHERE model IS NOT NULL)
        SELECT seq, task, {_gate_sql(_LABELLED)} AS gated,
          {_gate_sql('lower(model)')} AS gated_strictly FROM t""")),
    "f20_train_final": (f20_train_final, None),
    "f21_run_suite": (f21_run_suite, None),
    "h01_rules_classification": (h01_rules_classification, with_tables(
        "profiles", sql=f"SELECT task_id, {_H1} AS recommended_model FROM profiles")),
    "h02_rules_regression": (h02_rules_regression, with_tables(
        "profiles", sql=f"SELECT task_id, {_H2} AS recommended_model FROM profiles")),
    "h03_selector_labels": (h03_selector_labels, with_tables("bench_log", "profiles", sql="""
        SELECT dataset_name, model, round(f1_score, 6) AS f1_score, n_samples, n_features,
          n_classes, numeric_features, categorical_features, missing_percentage FROM (
        SELECT l.dataset_name, l.model, l.f1_score, l.n_samples, l.n_features, l.n_classes,
          p.n_numeric AS numeric_features, p.n_categorical AS categorical_features,
          p.missing_percentage, row_number() OVER (PARTITION BY l.dataset_name
            ORDER BY l.f1_score DESC, l.seq) AS rn
        FROM bench_log l LEFT JOIN profiles p ON p.task_id = l.task_id
        WHERE l.f1_score IS NOT NULL AND l.dataset_name IS NOT NULL AND l.model IS NOT NULL) t
        WHERE rn = 1""")),
    "h03_train_selector": (h03_train_selector, None),
    "h04_evaluate_selector": (h04_evaluate_selector, None),
    "h05_rank_learners": (h05_rank_learners, None),
    "h06_rank_confidences": (h06_rank_confidences, with_tables("bench_log", sql=f"""
        WITH s AS (SELECT dataset_id, model, avg(accuracy) AS confidence FROM
          (SELECT dataset_id, accuracy, {STRICT} AS model FROM bench_log) n
          WHERE model IS NOT NULL AND dataset_id IS NOT NULL GROUP BY 1, 2)
        SELECT dataset_id, model, round(confidence, 4) AS confidence,
          CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY s.confidence DESC NULLS LAST,
          model) AS INTEGER) AS position FROM s""")),
    "h07_recommend": (h07_recommend, " UNION ALL ".join(
        _recommend_sql(n, t) for n, t in RECOMMENDED)),
    "h07_recommend_learned": (h07_recommend_learned, None),
    "i01_score": (i01_score, None),
    "i01_saved_score": (i01_saved_score, None),
    "i03_prediction_distribution": (i03_distribution, None),
    "i04_score_stream": (i04_score_stream, None),
    "j39_run_benchmark": (j39_run_benchmark, None),
}
