"""Categories and labels kept as tables: the same answers as within the model, at any number."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tabscout.operators import dictionary as D, encode as E, preprocess as P
from tabscout.operators.preprocess import FEATURES, CategoryPrep, prep_stages
from tabscout.plans import train as R
from tabscout.plans.score import score
from tabscout.session import scratch_path
from tabscout.sources.artifacts import load_model
from tabscout.streaming.score_stream import read_stream, score_stream


@pytest.fixture
def stored(monkeypatch):
    monkeypatch.setattr(P, "INLINE_CATEGORIES", 3)
    monkeypatch.setattr(R, "INLINE_CLASSES", 1)
    monkeypatch.setattr(D, "SMALL_DICTIONARY", 4)
    monkeypatch.setattr(D, "OFTEN", 0.2)


def people(spark, n=300):
    """A hot value, many rare ones, nulls and one column small enough for the model itself."""
    return spark.range(n).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(
            F.concat(F.lit("v"), F.col("id") % 40)).alias("wide"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("narrow"),
        (F.col("id") % 11).cast("double").alias("x"),
        F.concat(F.lit("class "), F.col("id") % 4).alias("y"))


def vectors(frame):
    return sorted((r["k"], r[FEATURES].size, r[FEATURES].toArray().tolist())
                  for r in frame.select("k", FEATURES).collect())


def test_stored_categories_give_the_same_vectors(spark, monkeypatch, stored):
    df = people(spark)
    new = df.unionByName(df.limit(3).withColumns({
        "wide": F.lit("never seen"), "k": F.col("k") + 1000}))
    far = Pipeline(stages=prep_stages(df.drop("k", "y"))).fit(df)
    monkeypatch.setattr(P, "INLINE_CATEGORIES", 1000)
    near = Pipeline(stages=prep_stages(df.drop("k", "y"))).fit(df)
    kinds = [type(s).__name__ for s in far.stages[1].stages]
    assert "StoredOneHot" in kinds and "OneHotEncoderModel" in kinds
    assert "StoredOneHot" not in [type(s).__name__ for s in near.stages[1].stages]
    assert vectors(far.transform(new)) == vectors(near.transform(new))
    path = scratch_path(spark, "prep")
    far.save(path)
    assert vectors(PipelineModel.load(path).transform(new)) == vectors(far.transform(new))


def test_a_column_without_values(spark, stored):
    df = spark.createDataFrame([(None, str(i)) for i in range(9)], "a string, b string")
    model = CategoryPrep(inputCols=["a", "b"], outputCols=["p", "q"]).fit(df)
    row = model.transform(df).select("p", "q").first()
    assert row["q"].size == 9 and row["p"].size == 1
    odd = spark.createDataFrame([("",), ("",), ("x",), (None,)], "a string")
    got = CategoryPrep(inputCols=["a"], outputCols=["p"]).fit(odd).transform(odd).select("p").collect()
    assert [r["p"].toArray().tolist() for r in got] == [[1, 0], [1, 0], [0, 1], [1, 0]]


@pytest.mark.parametrize("learner,params", [
    ("decision tree", {"maxDepth": 4}), ("gradient boosting", {"trees": 1, "depth": 2})])
def test_training_with_stored_categories_and_labels(spark, monkeypatch, stored, learner, params):
    df = people(spark)
    far = R.train_final(df, "y", "k", "people", learner, params)
    assert set(far.meta["labels"]) == {"path", "size"} and far.meta["labels"]["size"] == 4
    path = scratch_path(spark, "model")
    far.save(path)
    model, meta = load_model(spark, path)
    got = score(df, model, meta)
    assert got.columns[-2:] == ["prediction", "prediction_probability"]
    monkeypatch.setattr(P, "INLINE_CATEGORIES", 1000)
    monkeypatch.setattr(R, "INLINE_CLASSES", 1000)
    near = R.train_final(df, "y", "k", "people", learner, params)
    assert near.meta["accuracy"] == pytest.approx(far.meta["accuracy"])
    want = score(df, near.model, near.meta)
    pick = ["wide", "narrow", "x", "prediction"]
    assert sorted(map(str, got.select(*pick).collect())) == sorted(map(str, want.select(*pick).collect()))


def test_streams_are_coded_from_stored_tables(spark, stored):
    df = people(spark)
    trained = R.train_final(df, "y", "k", "people", "decision tree", {"maxDepth": 3})
    source = scratch_path(spark, "in")
    df.write.parquet(source)
    sink = scratch_path(spark, "out")
    score_stream(read_stream(spark, source, df.schema), trained.model, trained.meta, sink,
                 scratch_path(spark, "state")).awaitTermination()
    got = spark.read.parquet(sink).select("x", "prediction")
    want = score(df, trained.model, trained.meta).select("x", "prediction")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_half_a_million_categories(spark):
    """Past what the model holds by itself, without a patch."""
    df = spark.range(500_000).select(
        F.col("id").alias("k"), F.concat(F.lit("c"), F.col("id")).alias("c"),
        (F.col("id") % 2).cast("double").alias("x"))
    model = CategoryPrep(inputCols=["c"], outputCols=["hot"]).fit(df)
    some = df.filter("k % 50000 = 7")
    rows = model.transform(some).select("c", "hot").collect()
    ranks = {v: i for i, v in enumerate(sorted(f"c{i}" for i in range(500_000)))}
    assert len(rows) == 10
    for r in rows:
        assert (r["hot"].size, r["hot"].indices.tolist()) == (500_000, [ranks[r["c"]]])
    assert E.SMALL_DICTIONARY < 500_000
