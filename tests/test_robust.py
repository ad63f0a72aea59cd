"""Constant columns, wide mixed tables, bad datasets and logs, and order-free neighbours."""

import datetime as dt

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabscout.operators import prepare, profile
from tabscout.operators.columnstats import WIDE_LIMIT
from tabscout.operators.correlate import mean_abs_correlation
from tabscout.operators.learners import Neighbours
from tabscout.plans import recommend
from tabscout.sources import catalog, logstore


@pytest.mark.parametrize("extra", [0, 8])
def test_correlation_skips_constant_columns(spark, extra):
    df = spark.range(50).select(
        F.col("id").cast("double").alias("x"), (-2.0 * F.col("id")).alias("y"),
        F.lit(0.1).alias("constant"), F.lit(None).cast("double").alias("empty"),
        *[F.lit(0.3).alias(f"c{i}") for i in range(extra)])
    assert mean_abs_correlation(df, df.columns).first()[0] == pytest.approx(1.0)
    assert mean_abs_correlation(df, ["x", "constant"]).first()[0] is None


def wide(spark, n):
    makers = [
        lambda i: (F.col("id") + i).cast("long"), lambda i: F.concat(F.lit("t"), F.col("id") % 5),
        lambda i: F.timestamp_seconds(F.col("id") * 1000 + i), lambda i: F.col("id") % 2 == 0,
        lambda i: F.lit(i), lambda i: F.lit(None).cast("double")]
    return spark.range(40).select("id", (F.col("id") % 3).alias("target"), *[
        makers[i % 6](i).alias(f"c{i}") for i in range(n)])


@pytest.mark.parametrize("n", [30, WIDE_LIMIT + 66])
def test_wide_mixed_tables(spark, n):
    df = wide(spark, n)
    kept, empty = prepare.drop_empty_columns(df, ["id", "target"])
    assert empty == [f"c{i}" for i in range(n) if i % 6 == 5]
    _, constant = prepare.drop_constant_columns(kept, ["id", "target"])
    assert constant == [f"c{i}" for i in range(n) if i % 6 == 4]
    ready = prepare.prepare_features(df, "target", "id", "label")
    assert len(ready.columns) == 2 + n * 4 // 6
    assert ready.count() == 40


def test_bad_dataset_stops_alone(spark, tmp_path, data):
    bad = tmp_path / "bad.parquet"
    spark.range(5).selectExpr("id", "id % 2 AS t").coalesce(1).write.parquet(str(bad))
    for part in bad.glob("part-*.parquet"):
        part.write_bytes(part.read_bytes()[:-40] + b"x" * 40)
    for crc in bad.glob(".*.crc"):
        crc.write_bytes(b"")
    failing = spark.range(5).selectExpr("id", "raise_error('no') AS t")
    specs = [profile.DatasetSpec("good", "r_name", f"{data}/region.parquet"),
             profile.DatasetSpec("bad", "t", str(bad)),
             profile.DatasetSpec("failing", "t", frame=failing)]
    for rows, skipped in (profile.profile_many(spark, specs), catalog.build_catalog(spark, specs)):
        assert [r["dataset_name"] for r in rows.collect()] == ["good"]
        assert set(skipped) == {"bad", "failing"}


def test_unreadable_log_is_reported(spark, tmp_path):
    missing = str(tmp_path / "none")
    assert logstore.read_log(spark, missing).count() == 0
    assert logstore.checkpoint_read(spark, missing).count() == 0
    broken = tmp_path / "log"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"no parquet")
    for read in (logstore.read_log, logstore.checkpoint_read):
        with pytest.raises(Exception):
            read(spark, str(broken)).collect()


def test_selector_failing_while_scoring(spark, data, monkeypatch):
    orders = spark.read.parquet(f"{data}/orders.parquet")
    monkeypatch.setattr(recommend, "rank_learners", lambda row, selector: row.withColumns({
        "predicted_model": F.raise_error(F.lit("broken")).cast("string"),
        "ranking": F.lit(None).cast(recommend.RANKING)}))
    row = recommend.recommend(orders, "o_orderstatus", selector=object()).first()
    assert row["recommended_model"] == "Random Forest" and row["ranking"] is None


def test_neighbours_do_not_depend_on_partitions(spark):
    rows = spark.range(400).select(
        array_to_vector(F.array((F.col("id") % 7).cast("double"), (F.col("id") % 3).cast("double")))
        .alias("v"), (F.xxhash64("id") % 2 == 0).cast("double").alias("y"))
    probe = spark.range(40).select("id", array_to_vector(F.array(
        (F.col("id") % 5).cast("double"), F.lit(1.0))).alias("v"))
    answers = set()
    for parts in (1, 3, 7):
        model = Neighbours(featuresCol="v", labelCol="y").fit(rows.repartition(parts))
        answers.add(tuple(r["prediction"] for r in model.transform(probe).orderBy("id").collect()))
    assert len(answers) == 1


def test_missing_values_and_dates_still_work(spark):
    df = spark.createDataFrame(
        [(1, None, dt.date(2024, 1, 1)), (2, 3.5, None)], "id int, x double, d date")
    assert prepare.drop_constant_columns(df, ["id"])[1] == ["x", "d"]
