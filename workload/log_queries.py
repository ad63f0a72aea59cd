"""Relational operators on the learner log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscout.operators import benchlog as J

from .fixtures import table, with_tables
from .profile_queries import rounded

METRICS = ["accuracy", "balanced_accuracy", "f1_score", "precision", "recall", "training_time"]
OFFICIAL = "('LogisticRegression', 'DecisionTree', 'RandomForest', 'KNN', 'SVM', 'XGBoost')"
Q = {m: f'"{m}"' if m == "precision" else m for m in METRICS}
STRICT = """CASE trim(model) WHEN 'logistic_regression' THEN 'LogisticRegression'
  WHEN 'LogisticRegression' THEN 'LogisticRegression' WHEN 'decision_tree' THEN 'DecisionTree'
  WHEN 'DecisionTree' THEN 'DecisionTree' WHEN 'random_forest' THEN 'RandomForest'
  WHEN 'RandomForest' THEN 'RandomForest' WHEN 'knn' THEN 'KNN' WHEN 'KNN' THEN 'KNN'
  WHEN 'svm' THEN 'SVM' WHEN 'SVM' THEN 'SVM' WHEN 'xgboost' THEN 'XGBoost'
  WHEN 'XGBoost' THEN 'XGBoost' END"""
FOLDED = """CASE lower(trim(coalesce(model, ''))) WHEN 'logistic_regression' THEN 'LogisticRegression'
  WHEN 'logisticregression' THEN 'LogisticRegression' WHEN 'decision_tree' THEN 'DecisionTree'
  WHEN 'decisiontree' THEN 'DecisionTree' WHEN 'random_forest' THEN 'RandomForest'
  WHEN 'randomforest' THEN 'RandomForest' WHEN 'knn' THEN 'KNN' WHEN 'svm' THEN 'SVM'
  WHEN 'xgboost' THEN 'XGBoost' ELSE trim(coalesce(model, '')) END"""
STATUS = "lower(trim(coalesce(status, '')))"
VALID = " AND ".join(f"({Q[m]} IS NOT NULL AND isfinite({Q[m]}))" for m in METRICS)
KNOWN = " AND ".join(f"{Q[m]} IS NOT NULL" for m in METRICS)
ORDER = ("CASE model WHEN 'LogisticRegression' THEN 1 WHEN 'DecisionTree' THEN 2 "
         "WHEN 'RandomForest' THEN 3 WHEN 'KNN' THEN 4 WHEN 'SVM' THEN 5 ELSE 6 END")

NAMED = f"named AS (SELECT * REPLACE ({STRICT} AS model) FROM bench_log)"
OFFICIAL_ROWS = f"{NAMED}, off AS (SELECT * FROM named WHERE model IN {OFFICIAL})"
# The log as the runner sees it: official, last row per pair.
LATEST = OFFICIAL_ROWS + """, last AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER
  (PARTITION BY dataset_id, model ORDER BY seq DESC) AS rn FROM off) t WHERE rn = 1)"""
# The log after finalising: folded names, status cleaned, incomplete marked.
FINAL = f"""typed AS (SELECT * REPLACE ({FOLDED} AS model, {STATUS} AS status) FROM bench_log),
one AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, model
  ORDER BY seq DESC) AS rn FROM typed WHERE model IN {OFFICIAL}) t WHERE rn = 1),
final AS (SELECT * REPLACE (
  CASE WHEN status = 'success' AND NOT ({KNOWN}) THEN 'incomplete' ELSE status END AS status,
  CASE WHEN status = 'success' AND NOT ({KNOWN}) THEN
    CASE WHEN trim(coalesce(error, '')) = '' THEN
      'Evaluation marked successful but one or more benchmark metrics are missing.'
    ELSE trim(error) END ELSE error END AS error) FROM one)"""
LEARNERS = ("learners AS (SELECT * FROM (VALUES ('LogisticRegression', 1), ('DecisionTree', 2), "
            "('RandomForest', 3), ('KNN', 4), ('SVM', 5), ('XGBoost', 6)) v(model, position))")
DONE = f"""good AS (SELECT dataset_id, lower(trim(dataset_name)) AS name, {STRICT} AS model
  FROM bench_log WHERE {STATUS} = 'success' AND {VALID}),
pairs AS (
  SELECT c.dataset_id, c.dataset_name, g.model FROM catalog c JOIN good g
    ON c.dataset_id = g.dataset_id WHERE g.model IS NOT NULL
  UNION
  SELECT c.dataset_id, c.dataset_name, g.model FROM catalog c JOIN good g
    ON lower(trim(c.dataset_name)) = g.name WHERE g.model IS NOT NULL AND g.name <> '')"""


def log(spark, d):
    return table(spark, d, "bench_log")


def sparse(spark, d):
    return table(spark, d, "sparse_log")


def sparse_runner_log(spark, d):
    return J.read_checkpoint(sparse(spark, d))


def runner_log(spark, d):
    return J.read_checkpoint(log(spark, d))


def final_log(spark, d):
    typed = J.clean_status(J.clean_types(log(spark, d)))
    single = J.latest(J.official(J.normalise_models(typed, case_sensitive=False)))
    return J.mark_incomplete(single)


def j01(spark, d):
    return J.normalise_models(log(spark, d)).select("seq", "model")


def j02(spark, d):
    return J.normalise_models(log(spark, d), case_sensitive=False).select("seq", "model")


def j03(spark, d):
    return J.official(J.normalise_models(log(spark, d))).select("seq", "model")


def j04(spark, d):
    text = log(spark, d).select(
        "seq", F.concat(F.col("accuracy").cast("string"), F.lit(" ")).alias("accuracy"),
        F.coalesce("model", F.lit("?")).alias("recall"))
    return rounded(J.clean_types(text, ["accuracy", "recall"]))


def j05(spark, d):
    return J.clean_status(log(spark, d)).select("seq", "status")


def j06(spark, d):
    return J.metrics_complete(log(spark, d)).select("seq", "metrics_complete")


def j07(spark, d):
    return J.metrics_valid(log(spark, d)).select("seq", "metrics_valid")


def j08(spark, d):
    return J.duplicate_members(log(spark, d))


def j09(spark, d):
    return J.latest(log(spark, d)).select("seq", "dataset_id", "model", "status")


def j10(spark, d):
    return J.latest(J.official(J.normalise_models(log(spark, d)))).select(
        "seq", "dataset_id", "model")


def j11(spark, d):
    return J.mark_incomplete(J.clean_status(log(spark, d))).select("seq", "status", "error")


def j12(spark, d):
    return J.unsuccessful(log(spark, d))


def j13(spark, d):
    return J.missing_cells(J.repair(sparse(spark, d)))


def j13_pairs(spark, d):
    return J.missing_pairs(J.repair(sparse(spark, d)))


def j14(spark, d):
    done = J.completed(table(spark, d, "catalog"), sparse(spark, d))
    return done.select("dataset_id", "dataset_name", F.explode("completed").alias("model"))


def j15(spark, d):
    return J.missing_learners(table(spark, d, "catalog"), sparse(spark, d))


def j16(spark, d):
    return J.resume_plan(table(spark, d, "catalog"), sparse(spark, d))


def j16_counts(spark, d):
    return J.plan_counts(j16(spark, d))


def j17(spark, d):
    return rounded(J.upsert(log(spark, d), table(spark, d, "new_results")).select(
        "seq", "dataset_id", "model", "accuracy", "status"))


def j18(spark, d):
    return J.find_result(log(spark, d), 5, " knn ").select("seq", "dataset_id", "model")


def j19(spark, d):
    return J.ordered(runner_log(spark, d)).select(
        "seq", "dataset_id", "model", J.model_position(F.col("model")).alias("position"))


def j20(spark, d):
    return J.summary(final_log(spark, d)).drop("matrix_complete", "remaining")


def j20_runner(spark, d):
    return J.summary(runner_log(spark, d), runner=True).select(
        "rows", "datasets", "learners", "successful", "unsuccessful", "complete_datasets")


def j21(spark, d):
    return J.evaluations_histogram(J.repair(sparse(spark, d)))


def j22(spark, d):
    return J.learner_counts(runner_log(spark, d))


def j23(spark, d):
    return J.status_counts(log(spark, d))


def j24(spark, d):
    return J.metric_nulls(log(spark, d))


def j25(spark, d):
    a = J.complete_datasets(final_log(spark, d)).withColumn("form", F.lit("final"))
    b = J.complete_datasets(runner_log(spark, d), runner=True).withColumn("form", F.lit("runner"))
    return a.unionByName(b)


def j26(spark, d):
    return J.incomplete_datasets(table(spark, d, "catalog"), sparse_runner_log(spark, d))


def j27(spark, d):
    return J.valid_successes(final_log(spark, d)).select("seq", "dataset_id", "model")


def j28(spark, d):
    return J.summary(final_log(spark, d), 34).select("matrix_complete", "remaining")


def j29(spark, d):
    return rounded(J.leaderboard(runner_log(spark, d)).select(
        "model", "accuracy", "f1_score", "precision", "recall", "training_time", "position"))


def j29_analysis(spark, d):
    return J.leaderboard(log(spark, d), successful_only=False).select(
        "model", "accuracy", "f1_score", "precision", "recall", "training_time")


def j30(spark, d):
    return rounded(J.best_per_dataset(log(spark, d)).select(
        "dataset_name", "seq", "model", "f1_score"))


def j31(spark, d):
    return rounded(J.best_cells_per_dataset(
        log(spark, d), ["model", "accuracy", "f1_score", "training_time"]))


def j32(spark, d):
    return J.best_distribution(J.best_per_dataset(log(spark, d)))


def j33(spark, d):
    return J.dataset_characteristics(log(spark, d)).select(
        "dataset_name", "seq", "n_samples", "n_features", "n_classes")


def j34(spark, d):
    return J.distinct_counts(log(spark, d))


def j35(spark, d):
    return J.attach_meta(log(spark, d), table(spark, d, "profiles")).select(
        "seq", "task_id", "numeric_features", "categorical_features", "missing_percentage")


def j36(spark, d):
    return rounded(J.finalise(log(spark, d)))


def j37(spark, d):
    return rounded(J.repair(log(spark, d)).select("seq", "dataset_id", "model", "accuracy"))


def j38(spark, d):
    full = J.attach_meta(log(spark, d), table(spark, d, "profiles"))
    return rounded(J.clean(full).drop("balanced_accuracy"))


MISSING = """grid AS (SELECT ids.dataset_id, l.model FROM
  (SELECT DISTINCT dataset_id FROM valid WHERE dataset_id IS NOT NULL) ids CROSS JOIN learners l),
lack AS (SELECT g.* FROM grid g WHERE NOT EXISTS (SELECT 1 FROM valid v
  WHERE v.dataset_id = g.dataset_id AND v.model = g.model))"""
VALID_ROWS = OFFICIAL_ROWS + f""", ok AS (SELECT * FROM off WHERE {VALID}),
valid AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER
  (PARTITION BY dataset_id, model ORDER BY seq DESC) AS rn FROM ok) t WHERE rn = 1)"""
BEST = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_name
  ORDER BY f1_score DESC, seq) AS rn FROM bench_log
  WHERE f1_score IS NOT NULL AND dataset_name IS NOT NULL) t WHERE rn = 1)"""
COUNTS = """SELECT count(*) AS "rows", count(DISTINCT dataset_id) AS datasets,
  count(DISTINCT model) AS learners"""
COMPLETE = """(SELECT count(*) FROM (SELECT dataset_id FROM {rows} WHERE dataset_id IS NOT NULL
  GROUP BY dataset_id HAVING count(DISTINCT model) = 6) c)"""
WON = LATEST + """, won AS (SELECT DISTINCT dataset_id, model FROM last
  WHERE lower(coalesce(status, 'nan')) = 'success')"""


def first_known(c):
    return (f"(SELECT {c} FROM bench_log b WHERE b.dataset_name = n.dataset_name AND {c} IS NOT NULL "
            f"ORDER BY f1_score IS NULL, f1_score DESC, seq LIMIT 1) AS {c}")


def on_sparse(sql, *more):
    """SQL on the sparse log, which it reads under the usual name."""
    rest = sql.strip()[5:]
    return with_tables(
        "sparse_log", *more, sql="WITH bench_log AS (SELECT * FROM sparse_log), " + rest)


def on_log(sql, *more):
    return with_tables("bench_log", *more, sql=sql)


QUERIES = {
    "j01_strict_names": (j01, on_log(f"SELECT seq, {STRICT} AS model FROM bench_log")),
    "j02_folded_names": (j02, on_log(f"SELECT seq, {FOLDED} AS model FROM bench_log")),
    "j03_official": (j03, on_log(f"WITH {OFFICIAL_ROWS} SELECT seq, model FROM off")),
    "j04_coerce_columns": (j04, on_log("""
        SELECT seq, round(accuracy, 6) AS accuracy, CAST(NULL AS DOUBLE) AS recall
        FROM bench_log""")),
    "j05_status": (j05, on_log(f"SELECT seq, {STATUS} AS status FROM bench_log")),
    "j06_metrics_complete": (j06, on_log(
        f"SELECT seq, ({KNOWN}) AS metrics_complete FROM bench_log")),
    "j07_metrics_valid": (j07, on_log(f"SELECT seq, ({VALID}) AS metrics_valid FROM bench_log")),
    "j08_duplicate_members": (j08, on_log("""
        SELECT CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_members
        FROM (SELECT count(*) AS n FROM bench_log GROUP BY dataset_id, model) g""")),
    "j09_latest": (j09, on_log("""
        SELECT seq, dataset_id, model, status FROM (SELECT *, row_number() OVER
        (PARTITION BY dataset_id, model ORDER BY seq DESC) AS rn FROM bench_log) t
        WHERE rn = 1""")),
    "j10_sorted_latest": (j10, on_log(f"WITH {LATEST} SELECT seq, dataset_id, model FROM last")),
    "j11_mark_incomplete": (j11, on_log(f"""
        SELECT seq, CASE WHEN {STATUS} = 'success' AND NOT ({KNOWN}) THEN 'incomplete'
            ELSE {STATUS} END AS status,
          CASE WHEN {STATUS} = 'success' AND NOT ({KNOWN}) THEN
            CASE WHEN trim(coalesce(error, '')) = '' THEN
            'Evaluation marked successful but one or more benchmark metrics are missing.'
            ELSE trim(error) END ELSE error END AS error FROM bench_log""")),
    "j12_unsuccessful": (j12, on_log("""
        SELECT dataset_id, dataset_name, model, status, error FROM bench_log
        WHERE status IS NULL OR status <> 'success'""")),
    "j13_missing_cells": (j13, on_sparse(f"""
        WITH {VALID_ROWS}, {LEARNERS}, {MISSING}
        SELECT l.dataset_id, coalesce((SELECT v.dataset_name FROM valid v
            WHERE v.dataset_id = l.dataset_id AND v.dataset_name IS NOT NULL
            ORDER BY v.seq LIMIT 1), 'UNKNOWN') AS dataset_name,
          string_agg(l.model, ', ' ORDER BY l.model) AS missing
        FROM lack l GROUP BY l.dataset_id""")),
    "j13_missing_pairs": (j13_pairs, on_sparse(f"""
        WITH {VALID_ROWS}, {LEARNERS}, {MISSING} SELECT dataset_id, model FROM lack""")),
    "j14_completed": (j14, on_sparse(f"WITH {DONE} SELECT * FROM pairs", "catalog")),
    "j15_missing_learners": (j15, on_sparse(f"""
        WITH {DONE}, {LEARNERS}
        SELECT c.dataset_id, c.dataset_name, l.model FROM catalog c CROSS JOIN learners l
        WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.dataset_id = c.dataset_id
          AND p.model = l.model)""", "catalog")),
    "j16_resume_plan": (j16, on_sparse(f"""
        WITH {DONE}, {LEARNERS},
        state AS (SELECT c.dataset_id, c.dataset_name, l.model, p.model IS NOT NULL AS done
          FROM catalog c CROSS JOIN learners l
          LEFT JOIN pairs p ON p.dataset_id = c.dataset_id AND p.model = l.model)
        SELECT dataset_id, dataset_name, count(*) FILTER (WHERE done) AS completed,
          CASE count(*) FILTER (WHERE done) WHEN 6 THEN 'skip' WHEN 0 THEN 'start'
            ELSE 'resume' END AS action,
          coalesce(string_agg(model, ', ' ORDER BY model) FILTER (WHERE NOT done), '') AS missing
        FROM state GROUP BY dataset_id, dataset_name""", "catalog")),
    "j16_plan_counts": (j16_counts, on_sparse(f"""
        WITH {DONE}, n AS (SELECT c.dataset_id, count(p.model) AS k FROM catalog c
          LEFT JOIN pairs p ON p.dataset_id = c.dataset_id GROUP BY c.dataset_id)
        SELECT CASE k WHEN 6 THEN 'skip' WHEN 0 THEN 'start' ELSE 'resume' END AS action,
          count(*) AS datasets FROM n GROUP BY 1""", "catalog")),
    "j17_upsert": (j17, on_log(f"""
        WITH old AS (SELECT * FROM (SELECT seq, dataset_id, {STRICT} AS model, accuracy, status
            FROM bench_log) t WHERE model IS NOT NULL AND dataset_id IS NOT NULL),
        new AS (SELECT * FROM (SELECT seq, dataset_id, {STRICT} AS model, accuracy, status
            FROM new_results) t WHERE model IS NOT NULL),
        old1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, model
            ORDER BY seq) AS rn FROM old) t WHERE rn = 1),
        new1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, model
            ORDER BY seq DESC) AS rn FROM new) t WHERE rn = 1)
        SELECT coalesce(o.seq, n.seq) AS seq, coalesce(o.dataset_id, n.dataset_id) AS dataset_id,
          coalesce(o.model, n.model) AS model,
          round(CASE WHEN n.seq IS NULL THEN o.accuracy ELSE n.accuracy END, 6) AS accuracy,
          CASE WHEN n.seq IS NULL THEN o.status ELSE n.status END AS status
        FROM old1 o FULL JOIN new1 n ON o.dataset_id = n.dataset_id AND o.model = n.model""",
        "new_results")),
    "j18_find_result": (j18, on_log(f"""
        SELECT seq, dataset_id, model FROM bench_log
        WHERE dataset_id = 5 AND {STRICT} = 'KNN'""")),
    "j19_ordered": (j19, on_log(f"""
        WITH {LATEST} SELECT seq, dataset_id, model, CAST({ORDER} AS BIGINT) AS position FROM last
        ORDER BY dataset_id NULLS LAST, {ORDER}, seq""")),
    "j20_summary": (j20, on_log(f"""
        WITH {FINAL} {COUNTS},
          CAST(0 AS BIGINT) AS duplicates, count(*) FILTER (WHERE status = 'success') AS successful,
          count(*) FILTER (WHERE status = 'success' AND {KNOWN}) AS valid_successful,
          {COMPLETE.format(rows='final')} AS complete_datasets,
          count(DISTINCT dataset_id) AS expected_datasets,
          count(DISTINCT dataset_id) * 6 AS expected_evaluations,
          count(*) FILTER (WHERE status <> 'success') AS unsuccessful,
          count(DISTINCT dataset_id) - {COMPLETE.format(rows='final')} AS incomplete_datasets
        FROM final""")),
    "j20_runner_summary": (j20_runner, on_log(f"""
        WITH {WON} {COUNTS},
          count(*) FILTER (WHERE lower(coalesce(status, 'nan')) = 'success') AS successful,
          count(*) FILTER (WHERE lower(coalesce(status, 'nan')) <> 'success') AS unsuccessful,
          {COMPLETE.format(rows='won')} AS complete_datasets FROM last""")),
    "j21_evaluations_histogram": (j21, on_sparse(f"""
        WITH {VALID_ROWS} SELECT evaluations, count(*) AS datasets FROM
        (SELECT count(*) AS evaluations FROM valid WHERE dataset_id IS NOT NULL
         GROUP BY dataset_id) g GROUP BY evaluations""")),
    "j22_learner_counts": (j22, on_log(f"""
        WITH {LATEST}, {LEARNERS}
        SELECT l.model, count(r.seq) AS "rows",
          count(r.seq) FILTER (WHERE lower(coalesce(r.status, 'nan')) = 'success') AS successful
        FROM learners l LEFT JOIN last r ON r.model = l.model GROUP BY l.model""")),
    "j23_status_counts": (j23, on_log(
        "SELECT status, count(*) AS n FROM bench_log GROUP BY status")),
    "j24_metric_nulls": (j24, on_log(" UNION ALL ".join(
        f"SELECT '{m}' AS metric, count(*) - count({Q[m]}) AS nulls FROM bench_log"
        for m in METRICS))),
    "j25_complete_datasets": (j25, on_log(f"""
        WITH {FINAL}, {WON}
        SELECT {COMPLETE.format(rows='final')} AS complete,
          (SELECT count(DISTINCT dataset_id) FROM final) - {COMPLETE.format(rows='final')}
            AS incomplete, 'final' AS form
        UNION ALL SELECT {COMPLETE.format(rows='won')},
          (SELECT count(DISTINCT dataset_id) FROM won) - {COMPLETE.format(rows='won')}, 'runner'
        """)),
    "j26_incomplete_datasets": (j26, on_sparse(f"""
        WITH {WON}, {LEARNERS},
        state AS (SELECT c.dataset_id, c.dataset_name, l.model, w.model IS NOT NULL AS done
          FROM catalog c CROSS JOIN learners l
          LEFT JOIN won w ON w.dataset_id = c.dataset_id AND w.model = l.model)
        SELECT dataset_id, dataset_name,
          concat(CAST(count(*) FILTER (WHERE done) AS VARCHAR), '/6') AS progress,
          string_agg(model, ', ' ORDER BY model) FILTER (WHERE NOT done) AS missing
        FROM state GROUP BY dataset_id, dataset_name
        HAVING count(*) FILTER (WHERE done) < 6""", "catalog")),
    "j27_valid_successes": (j27, on_log(f"""
        WITH {FINAL} SELECT seq, dataset_id, model FROM final
        WHERE status = 'success' AND {KNOWN}""")),
    "j28_matrix_complete": (j28, on_log(f"""
        WITH {FINAL} SELECT count(*) = 204 AND count(DISTINCT dataset_id) = 34
          AND count(DISTINCT model) = 6 AND {COMPLETE.format(rows='final')} = 34
          AND count(*) FILTER (WHERE status = 'success') = 204
          AND count(*) FILTER (WHERE status = 'success' AND {KNOWN}) = 204 AS matrix_complete,
          204 - count(*) FILTER (WHERE status = 'success') AS remaining FROM final""")),
    "j29_leaderboard": (j29, on_log(f"""
        WITH {LATEST}, m AS (SELECT model, avg(accuracy) AS accuracy, avg(f1_score) AS f1_score,
          avg("precision") AS "precision", avg(recall) AS recall,
          avg(training_time) AS training_time FROM last
          WHERE lower(coalesce(status, 'nan')) = 'success' GROUP BY model)
        SELECT model, round(accuracy, 6) AS accuracy, round(f1_score, 6) AS f1_score,
          round("precision", 6) AS "precision", round(recall, 6) AS recall,
          round(training_time, 6) AS training_time,
          CAST(row_number() OVER (ORDER BY accuracy DESC NULLS LAST, model) AS INTEGER) AS position
        FROM m""")),
    "j29_analysis_leaderboard": (j29_analysis, on_log("""
        SELECT model, round(avg(accuracy), 4) AS accuracy, round(avg(f1_score), 4) AS f1_score,
          round(avg("precision"), 4) AS "precision", round(avg(recall), 4) AS recall,
          round(avg(training_time), 4) AS training_time
        FROM bench_log WHERE model IS NOT NULL GROUP BY model""")),
    "j30_best_per_dataset": (j30, on_log(f"""
        WITH {BEST} SELECT dataset_name, seq, model, round(f1_score, 6) AS f1_score FROM best""")),
    "j31_best_cells": (j31, on_log(f"""
        SELECT n.dataset_name, b.model, round(b.accuracy, 6) AS accuracy,
          round(b.f1_score, 6) AS f1_score, round(b.training_time, 6) AS training_time
        FROM (SELECT DISTINCT dataset_name FROM bench_log WHERE dataset_name IS NOT NULL) n
        JOIN (SELECT n.dataset_name AS dn, {first_known('model')}, {first_known('accuracy')},
          {first_known('f1_score')}, {first_known('training_time')}
          FROM (SELECT DISTINCT dataset_name FROM bench_log WHERE dataset_name IS NOT NULL) n) b
        ON b.dn = n.dataset_name""")),
    "j32_best_distribution": (j32, on_log(f"""
        WITH {BEST} SELECT model, count(*) AS datasets FROM best
        WHERE model IS NOT NULL GROUP BY model""")),
    "j33_dataset_characteristics": (j33, on_log("""
        SELECT dataset_name, seq, n_samples, n_features, n_classes FROM (SELECT *, row_number()
          OVER (PARTITION BY dataset_name ORDER BY seq) AS rn FROM bench_log) t WHERE rn = 1""")),
    "j34_distinct_counts": (j34, on_log("""
        SELECT count(DISTINCT dataset_name) AS datasets, count(DISTINCT model) AS learners
        FROM bench_log""")),
    "j35_attach_meta": (j35, on_log("""
        SELECT l.seq, l.task_id, p.n_numeric AS numeric_features,
          p.n_categorical AS categorical_features, p.missing_percentage
        FROM bench_log l LEFT JOIN profiles p ON p.task_id = l.task_id""", "profiles")),
    "j36_finalise": (j36, on_log(f"""
        WITH {FINAL} SELECT task_id, dataset_id, dataset_name, target_column, model, n_samples,
          n_features, n_classes, round(accuracy, 6) AS accuracy,
          round(balanced_accuracy, 6) AS balanced_accuracy, round(f1_score, 6) AS f1_score,
          round("precision", 6) AS "precision", round(recall, 6) AS recall,
          round(training_time, 6) AS training_time, status, error, data_source FROM final""")),
    "j37_repair": (j37, on_log(f"""
        WITH {VALID_ROWS} SELECT seq, dataset_id, model, round(accuracy, 6) AS accuracy
        FROM valid""")),
    "j38_clean": (j38, on_log(f"""
        SELECT l.task_id, dataset_id, l.dataset_name, target_column, model, l.n_samples,
          l.n_features, n_classes, p.n_numeric AS numeric_features,
          p.n_categorical AS categorical_features, p.missing_percentage,
          round(accuracy, 6) AS accuracy, round(f1_score, 6) AS f1_score,
          round("precision", 6) AS "precision", round(recall, 6) AS recall,
          round(training_time, 6) AS training_time, status, error, data_source,
          ({KNOWN}) AS metrics_complete
        FROM bench_log l LEFT JOIN profiles p ON p.task_id = l.task_id
        WHERE l.dataset_name IS NOT NULL AND model IS NOT NULL""", "profiles")),
}
