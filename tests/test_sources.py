import datetime

import pytest
from pyspark.sql import functions as F

from tabscout.operators import validate as V
from tabscout.session import scratch_path
from tabscout.sources import logstore, tables as T


def types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema}


def test_inference(spark):
    raw = spark.createDataFrame(
        [("1", "1", "1.5", "True", "2020-01-01", "NA", "1d", "x"),
         ("2", "", "-2e3", "false", "2020-01-02", "", "2", "NULL"),
         ("3", "3", "nan", "FALSE", "2020-01-03", "null", "3", "y")],
        "whole string, gaps string, real string, flag string, day string, empty string, "
        "odd string, text string")
    df = T.infer_types(raw)
    assert types(df) == {
        "whole": "bigint", "gaps": "double", "real": "double", "flag": "boolean",
        "day": "string", "empty": "double", "odd": "string", "text": "string"}
    rows = df.orderBy("whole").collect()
    assert [r["gaps"] for r in rows] == [1.0, None, 3.0]
    assert [r["real"] for r in rows] == [1.5, -2000.0, None]
    assert [r["text"] for r in rows] == ["x", None, "y"]


def test_wide_inference_matches_narrow(spark):
    names = [f"c{i}" for i in range(70)]
    raw = spark.createDataFrame([tuple(str(i) for i in range(70)), tuple("x" * 70)], names)
    assert set(types(T.infer_types(raw)).values()) == {"string"}
    assert set(types(T.infer_types(raw.limit(1))).values()) == {"bigint"}


def test_csv_with_quotes_and_line_breaks(spark):
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame(
        [(1, 'say "hi", twice'), (2, "two\nlines"), (3, "plain")], "id long, text string")
    T.write_table(df, path, "csv")
    assert T.has_open_quotes(spark, path)
    back = T.read_table(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    T.write_table(df.filter("id <> 2"), path, "csv")
    assert not T.has_open_quotes(spark, path)


def test_checkpoint_of_nothing(spark):
    assert logstore.checkpoint_read(spark, scratch_path(spark, "none")).count() == 0
    with pytest.raises(ValueError):
        T.read_table(spark, "x", "xml")


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", float("nan")), (2, None, 1.0)], "id long, y string, x double")
    with pytest.raises(ValueError, match="missing columns"):
        V.require_columns(df, ["id", "z"])
    with pytest.raises(ValueError):
        V.require_rows(df.limit(0))
    assert V.drop_null_target(df, "x").count() == 1
    assert V.split_target(df, "y") == (["id", "x"], "y")
    with pytest.raises(ValueError, match="required features"):
        V.reconcile_features(df, {"target_column": "y", "feature_columns": ["q"]})
    assert V.reconcile_features(df, {"target_column": "y", "feature_columns": ["x", "id"]}
                                ).columns == ["x", "id"]
    assert V.reconcile_features(df, None).columns == df.columns


def test_datetime_target_is_refused(spark):
    from tabscout.operators.profile import detect_task

    df = spark.createDataFrame([(datetime.datetime(2020, 1, 1),)], "t timestamp")
    with pytest.raises(ValueError, match="unsupported"):
        detect_task(df, "t")
    assert detect_task(df.select(F.col("t").cast("string")), "t") == "classification"


@pytest.mark.parametrize("values,kind,task", [
    ([1.0, 2.0, 3.0], "double", "classification"),
    ([1.0, 2.5, None], "double", "regression"),
    ([1, 2, 3], "long", "classification"),
    ([True, False, None], "boolean", "classification"),
    (["1.5", "2.5", "3.5"], "string", "classification"),
])
def test_task(spark, values, kind, task):
    from tabscout.operators.profile import detect_task

    assert detect_task(spark.createDataFrame([(v,) for v in values], f"y {kind}"), "y") == task


def test_task_of_unusable_targets(spark):
    from tabscout.operators.profile import detect_task

    for values in ([None], [float("inf"), 1.5]):
        df = spark.createDataFrame([(v,) for v in values], "y double")
        with pytest.raises(Exception, match="target has"):
            detect_task(df, "y")


def result(spark, dataset, model, accuracy, seq=0):
    row = {"seq": seq, "dataset_id": dataset, "dataset_name": f"d{dataset}", "model": model,
           "accuracy": accuracy, "status": "success"}
    schema = logstore.empty_log(spark).schema
    return spark.createDataFrame([tuple(row.get(f.name) for f in schema)], schema)


def held(log):
    return sorted((r["dataset_id"], r["model"], r["accuracy"]) for r in log.read().collect())


def test_results_are_replaced_in_place(spark, monkeypatch):
    path = scratch_path(spark, "results")
    log = logstore.ResultLog(spark, path)
    assert log.read().count() == 0
    for run in range(4):
        log.upsert(result(spark, 1, "KNN", run / 10).unionByName(result(spark, 2, "SVM", 0.5, 1)))
    log.upsert(result(spark, 1, "SVM", 0.9))
    assert held(log) == [(1, "KNN", 0.3), (1, "SVM", 0.9), (2, "SVM", 0.5)]
    rows = log.read().collect()
    assert len({r["seq"] for r in rows}) == 3
    files = [s.getPath().getName() for s in log._files.listStatus(log._at(""))]
    # What older versions named is gone.
    assert len(files) <= 1 + 2 * log.KEPT
    log.upsert(result(spark, 3, "no such learner", 0.1))
    assert len(held(log)) == 3


def test_two_writers_lose_nothing(spark):
    from threading import Thread

    path = scratch_path(spark, "results")

    def write(first):
        for i in range(3):
            logstore.ResultLog(spark, path).upsert(result(spark, i, ("KNN", "SVM")[first], first + i / 10))

    writers = [Thread(target=write, args=(n,)) for n in (0, 1)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    log = logstore.ResultLog(spark, path)
    assert held(log) == sorted((i, m, n + i / 10) for n, m in enumerate(("KNN", "SVM")) for i in range(3))
    assert len({r["seq"] for r in log.read().collect()}) == 6


def test_a_lost_race_starts_again(spark, monkeypatch):
    path = scratch_path(spark, "results")
    log, other = logstore.ResultLog(spark, path), logstore.ResultLog(spark, path)
    true = logstore.ResultLog._commit
    calls = []

    def late(self, version, state):
        if self is log and not calls:
            calls.append(1)
            other.upsert(result(spark, 1, "SVM", 0.2))
        return true(self, version, state)

    monkeypatch.setattr(logstore.ResultLog, "_commit", late)
    log.upsert(result(spark, 1, "KNN", 0.1))
    assert held(log) == [(1, "KNN", 0.1), (1, "SVM", 0.2)]
