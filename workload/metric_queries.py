"""Evaluation metrics on deterministic predictions."""

from __future__ import annotations

from tabscout.operators import metrics as M

from .fixtures import table, with_tables
from .profile_queries import rounded

PER_CLASS = """
counts AS (SELECT label, prediction, count(*) AS n FROM pred_cls GROUP BY 1, 2),
classes AS (
  SELECT class, sum(support) AS support, sum(predicted) AS predicted, sum(hits) AS hits FROM (
    SELECT label AS class, n AS support, 0 AS predicted,
           CASE WHEN label = prediction THEN n ELSE 0 END AS hits FROM counts
    UNION ALL SELECT prediction, 0, n, 0 FROM counts) s GROUP BY class),
scored AS (
  SELECT class, CAST(support AS DOUBLE) AS support, CAST(hits AS DOUBLE) AS hits,
    CASE WHEN predicted = 0 THEN 0 ELSE hits / CAST(predicted AS DOUBLE) END AS p,
    CASE WHEN support = 0 THEN 0 ELSE hits / CAST(support AS DOUBLE) END AS r,
    CASE WHEN support + predicted = 0 THEN 0
         ELSE 2 * hits / CAST(support + predicted AS DOUBLE) END AS f FROM classes)
"""


def _sql(body):
    return with_tables("pred_cls", sql="WITH " + PER_CLASS.strip() + "\n" + body)


def _metric(name):
    def run(spark, d):
        return rounded(M.classification_metrics(table(spark, d, "pred_cls")).select(name))
    return run


def _error(name):
    def run(spark, d):
        return rounded(M.regression_metrics(table(spark, d, "pred_reg")).select(name), 4)
    return run


def g06_class_report(spark, d):
    return rounded(M.class_report(table(spark, d, "pred_cls")))


def g07_confusion(spark, d):
    return M.confusion(table(spark, d, "pred_cls"))


def g07_confusion_matrix(spark, d):
    return M.confusion_matrix(table(spark, d, "pred_cls"))


def g13_correctness(spark, d):
    return M.mark_correct(table(spark, d, "pred_cls"))


def g13_correct_counts(spark, d):
    return M.correct_counts(table(spark, d, "pred_cls"))


def g13_distributions(spark, d):
    return M.label_distributions(table(spark, d, "pred_cls"))


QUERIES = {
    "g01_accuracy": (_metric("accuracy"), _sql(
        "SELECT round(sum(hits) / sum(support), 6) AS accuracy FROM scored")),
    "g02_balanced_accuracy": (_metric("balanced_accuracy"), _sql(
        "SELECT round(avg(r) FILTER (WHERE support > 0), 6) AS balanced_accuracy FROM scored")),
    "g03_weighted_f1": (_metric("f1_score"), _sql(
        "SELECT round(sum(f * support) / sum(support), 6) AS f1_score FROM scored")),
    "g04_weighted_precision": (_metric("precision"), _sql(
        'SELECT round(sum(p * support) / sum(support), 6) AS "precision" FROM scored')),
    "g05_weighted_recall": (_metric("recall"), _sql(
        "SELECT round(sum(r * support) / sum(support), 6) AS recall FROM scored")),
    "g06_class_report": (g06_class_report, _sql("""
        SELECT class, round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f1_score,
               CAST(support AS BIGINT) AS support FROM scored
        UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 6),
               CAST(sum(support) AS BIGINT) FROM scored
        UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6),
               CAST(sum(support) AS BIGINT) FROM scored
        UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6),
               round(sum(r * support) / sum(support), 6),
               round(sum(f * support) / sum(support), 6),
               CAST(sum(support) AS BIGINT) FROM scored""")),
    "g07_confusion": (g07_confusion, with_tables("pred_cls", sql="""
        SELECT label, prediction, count(*) AS n FROM pred_cls GROUP BY 1, 2""")),
    "g07_confusion_matrix": (g07_confusion_matrix, with_tables("pred_cls", sql="""
        SELECT label, count(*) FILTER (WHERE prediction = 'F') AS "F",
          count(*) FILTER (WHERE prediction = 'O') AS "O",
          count(*) FILTER (WHERE prediction = 'P') AS "P",
          count(*) FILTER (WHERE prediction = 'X') AS "X" FROM pred_cls GROUP BY label""")),
    "g08_macro_f1": (_metric("f1_macro"), _sql(
        "SELECT round(avg(f), 6) AS f1_macro FROM scored")),
    "g09_r2": (_error("r2_score"), with_tables("pred_reg", sql="""
        SELECT round(1 - sum(pow(label - prediction, 2)) / sum(pow(label - m, 2)), 4) AS r2_score
        FROM (SELECT *, avg(label) OVER () AS m FROM pred_reg) t""")),
    "g10_mae": (_error("mae"), with_tables("pred_reg", sql="""
        SELECT round(avg(abs(label - prediction)), 4) AS mae FROM pred_reg""")),
    "g11_rmse": (_error("rmse"), with_tables("pred_reg", sql="""
        SELECT round(sqrt(avg(pow(label - prediction, 2))), 4) AS rmse FROM pred_reg""")),
    "g13_correctness": (g13_correctness, with_tables("pred_cls", sql="""
        SELECT *, label = prediction AS correct FROM pred_cls""")),
    "g13_correct_counts": (g13_correct_counts, with_tables("pred_cls", sql="""
        SELECT count(*) FILTER (WHERE label = prediction) AS correct,
               count(*) FILTER (WHERE label <> prediction) AS incorrect FROM pred_cls""")),
    "g13_label_distributions": (g13_distributions, _sql("""
        SELECT class, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted
        FROM classes""")),
}
