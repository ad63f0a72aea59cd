import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabscout.operators import encode, prepare as D, split as S
from tabscout.operators.preprocess import FEATURES, CategoryPrep, NumericPrep, prep_stages


def test_large_dictionary_gives_the_same_codes(spark):
    df = spark.range(2000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("v"), (F.col("id") * 37 % 501).cast("string"))).alias("c"),
    ).withColumn("c", F.when(F.col("id") % 11 != 0, F.col("c")))
    small = encode.encode_columns(df, {"code": F.col("c")})
    large = encode.encode_columns(df, {"code": F.col("c")}, small=50)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    assert large.count() == 2000


def test_prepare_features_steps(spark):
    rows = [(i, None, 1, "5" if i else "x", "ab"[i % 2], float("inf"), i % 2 == 0,
             "nan" if i == 3 else "yn"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, empty double, same int, num string, cat string, "
                                     "inf double, flag boolean, y string")
    out = D.prepare_features(df, "y", "k")
    # "num" parses in 38 of 39 kept rows, "inf" turns out empty.
    assert out.columns == ["k", "num", "cat", "flag", "label"]
    got = {r["k"]: r for r in out.collect()}
    assert len(got) == 39 and got[0]["num"] is None and got[1]["num"] == 5.0
    assert got[1]["cat"] == 1.0 and got[2]["flag"] == 1.0
    assert got[0]["label"] == 1.0 and got[1]["label"] == 0.0


def test_identifier_rule(spark):
    df = spark.range(100).select(
        F.col("id").alias(" Customer_ID"), F.col("id").alias("paid"),
        (F.col("id") % 50).alias("half_id"), F.col("id").alias("amount"))
    out, removed = D.drop_identifiers(df)
    assert removed == [" Customer_ID", "paid"] and out.columns == ["half_id", "amount"]
    kept, removed = D.drop_identifiers(df, key="paid")
    assert "paid" in kept.columns and "paid" in removed


def test_unknown_and_missing_categories(spark):
    train = spark.createDataFrame([("a",), ("b",), ("b",), ("it's \\ odd",), (None,)], "c string")
    model = CategoryPrep(inputCols=["c"], outputCols=["hot"]).fit(train)
    new = spark.createDataFrame([("a",), ("new",), (None,), ("it's \\ odd",)], "c string")
    got = [list(r[0].toArray()) for r in model.transform(new).select("hot").collect()]
    assert got == [[1, 0, 0], [0, 0, 0], [0, 1, 0], [0, 0, 1]]


def test_columns_with_unequal_category_counts(spark):
    df = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", "p")], "x string, y string")
    model = CategoryPrep(inputCols=["x", "y"], outputCols=["h", "g"]).fit(df)
    got = [(list(r[0].toArray()), list(r[1].toArray()))
           for r in model.transform(df).select("h", "g").collect()]
    assert got == [([1, 0, 0], [1, 0]), ([0, 1, 0], [0, 1]), ([0, 0, 1], [1, 0])]


def test_constant_and_empty_numbers(spark):
    train = spark.createDataFrame([(2.0, None), (2.0, None)], "a double, b double")
    prep = NumericPrep(inputCols=["a", "b"], outputCols=["x", "y"])
    row = prep.fit(train).transform(train).first()
    assert (row["x"], row["y"]) == (0.0, 0.0)


def test_awkward_column_names(spark):
    df = spark.createDataFrame([(1.0, "p", 1), (3.0, "q", 2)], ["a.b", "c`d e", "k"])
    model = Pipeline(stages=prep_stages(df.drop("k"))).fit(df)
    assert model.transform(df).select(F.size(vector_to_array(FEATURES))).first()[0] == 3


def window_split(df, label, key):
    """The split by its definition, on the driver."""
    rows = df.select(label, key, F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit("42"))
                                       .cast("binary")).alias("h")).collect()
    classes = {}
    for r in rows:
        classes.setdefault(str(r[0]), []).append((r["h"], r[1]))
    want = -(-len(rows) // 5)
    seats = {c: len(v) * 0.2 for c, v in classes.items()}
    quota = {c: int(s) for c, s in seats.items()}
    order = sorted(seats, key=lambda c: (-round(seats[c] - int(seats[c]), 9), c))
    for c in order[:want - sum(quota.values())]:
        quota[c] += 1
    return {k for c, v in classes.items() for _, k in sorted(v)[:quota[c]]}


@pytest.mark.parametrize("shape", ["skewed", "many"])
def test_split_matches_definition(spark, shape):
    label = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("c"), (F.col("id") % (7 if shape == "skewed" else 150)).cast("string")))
    df = spark.range(1001).select(F.col("id").alias("k"), label.alias("y"))
    counts = df.groupBy("y").count().agg(F.min("count")).first()[0]
    assert counts >= 2
    train, test = S.stratified_split(df, "y", "k")
    got = {r["k"] for r in test.collect()}
    assert got == window_split(df, "y", "k") and len(got) == 201
    assert train.count() == 800
    again = {r["k"] for r in S.stratified_split(df.repartition(13), "y", "k")[1].collect()}
    assert got == again


def test_split_with_longer_prefixes(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 2).alias("y"))
    usual = {r["k"] for r in S.stratified_split(df, "y", "k")[1].collect()}
    monkeypatch.setattr(S, "_PREFIX_ROWS", 1)
    assert usual == {r["k"] for r in S.stratified_split(df, "y", "k")[1].collect()}


def test_split_falls_back_to_one_stratum(spark):
    df = spark.range(50).select(F.col("id").alias("k"), F.when(F.col("id") == 7, "rare")
                                .otherwise("common").alias("y"))
    assert S.stratified_split(df, "y", "k")[1].count() == 10
    assert S.stratified_split(df.limit(0), "y", "k")[1].count() == 0


def test_folds_are_even(spark):
    df = spark.range(503).select(F.col("id").alias("k"), (F.col("id") % 3).alias("y"))
    folds = S.stratified_folds(df, "y", "k")
    sizes = folds.groupBy("y", "fold").count().collect()
    for y in range(3):
        own = [r["count"] for r in sizes if r["y"] == y]
        assert len(own) == 5 and max(own) - min(own) <= 1
    a = sorted(map(tuple, folds.select("k", "fold").collect()))
    b = sorted(map(tuple, S.stratified_folds(df.repartition(9), "y", "k").select("k", "fold").collect()))
    assert a == b
