import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabscout.operators import correlate, profile as P
from tabscout.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


def by_sorting(values):
    x = np.sort(np.asarray(values, float))
    result = []
    for p in PROBS:
        at = p * (len(x) - 1)
        low, high = x[int(np.floor(at))], x[int(np.ceil(at))]
        result.append(low if low == high else low + (high - low) * (at - np.floor(at)))
    return result


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(allow_nan=False, width=64, min_value=-1e300, max_value=1e300)
                | st.sampled_from([0.0, 1.0, float("inf"), -float("inf")]),
                min_size=3, max_size=60))
def test_narrowing_is_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_quantiles(df, {"x": F.col("x")}, PROBS, small=1)["x"]
    want = by_sorting(values)
    assert all(a == b or (np.isnan(a) and np.isnan(b)) for a, b in zip(got, want))


def test_narrowing_on_hard_shapes(spark):
    rng = np.random.default_rng(1)
    n = 5000
    pdf = pd.DataFrame({
        "spread": np.exp(rng.normal(size=n) * 20), "few": rng.choice([1.5, 2.5, 7.0], n),
        "tiny": rng.normal(size=n) * 1e-200, "hot": np.where(rng.random(n) < 0.4, 3.0, rng.random(n)),
    })
    df = spark.createDataFrame(pdf)
    got = exact_quantiles(df, {c: F.col(c) for c in pdf.columns}, PROBS, small=40)
    for c in pdf.columns:
        assert got[c] == by_sorting(pdf[c])


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert exact_quantiles(df, {"a": F.col("a")}, [0.5], small=0) == {"a": [None]}


def test_wide_correlation_with_gaps(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 12)) + 1e6
    x[:, 1] += x[:, 0] * 0.5
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 5] = 7.0
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(12)])
    df = spark.createDataFrame(pdf).repartition(5)
    r = pdf.corr().to_numpy()[np.triu_indices(12, 1)]
    got = correlate.mean_abs_correlation(df, list(pdf.columns)).first()[0]
    assert got == pytest.approx(np.nanmean(np.abs(r)), abs=1e-9)
    few = list(pdf.columns[:4])
    want = np.nanmean(np.abs(pdf[few].corr().to_numpy()[np.triu_indices(4, 1)]))
    assert correlate.mean_abs_correlation(df, few).first()[0] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("tile", [1, 5, 12])
def test_correlation_in_tiles(spark, monkeypatch, tile):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2300, 12)) * 3 - 1e5
    x[:, 7] -= x[:, 2]
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 4], x[:, 9] = -2.5, np.nan
    pdf = pd.DataFrame(x, columns=[f"c.{i}" for i in range(12)])
    monkeypatch.setattr(correlate, "TILE", tile)
    pairs = correlate.pair_correlations(
        spark.createDataFrame(pdf).repartition(3), list(pdf.columns)).collect()
    assert len(pairs) == len({(r["a"], r["b"]) for r in pairs}) == 66
    want = pdf.corr().to_numpy()
    for r in pairs:
        expected = want[r["a"], r["b"]]
        assert r["a"] < r["b"]
        if np.isnan(expected):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(expected, abs=1e-9)


def test_a_scan_for_every_tile(spark, monkeypatch):
    names = [f"c{i}" for i in range(300)]
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(60, 300)), columns=names)
    monkeypatch.setattr(correlate, "TILE", 128)
    pairs = correlate.pair_correlations(spark.createDataFrame(pdf), names)
    # Three blocks make six tiles, each with a scan of its own.
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(scans) == 6
    got = pairs.agg(F.count("r"), F.avg(F.abs("r"))).first()
    r = np.abs(pdf.corr().to_numpy()[np.triu_indices(300, 1)])
    assert got[0] == len(r) and got[1] == pytest.approx(r.mean(), abs=1e-9)


def test_tiles_of_no_rows(spark, monkeypatch):
    monkeypatch.setattr(correlate, "TILE", 4)
    empty = spark.createDataFrame([], ", ".join(f"c{i} double" for i in range(9)))
    assert correlate.mean_abs_correlation(empty, empty.columns).first()[0] is None


def test_profile_against_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=80), "b": rng.integers(0, 9, 80).astype(float),
                        "t": rng.choice(["x", "y", "z"], 80)})
    pdf.loc[:7, "a"] = np.nan
    row = P.profile(spark.createDataFrame(pdf), "t", "d", 4).first()
    numbers = pdf[["a", "b"]]
    shares = pdf.t.value_counts() / len(pdf)
    assert row["missing_percentage"] == pytest.approx(numbers.isna().mean().mean() * 100)
    assert row["mean_feature_std"] == pytest.approx(numbers.std().mean())
    assert row["mean_feature_variance"] == pytest.approx(numbers.var().mean())
    assert row["mean_abs_correlation"] == pytest.approx(abs(numbers.corr().iloc[0, 1]))
    assert row["target_entropy"] == pytest.approx(-(shares * np.log2(shares)).sum())
    assert row["imbalance_ratio"] == pytest.approx(shares.min() / shares.max())


def test_profile_without_numbers(spark):
    df = spark.createDataFrame([("a", "x"), (None, "y")], "c string, t string")
    row = P.profile(df, "t").first()
    assert (row["mean_feature_mean"], row["mean_abs_correlation"]) == (0.0, 0.0)
    assert row["missing_percentage"] == 50.0


def test_wide_null_counts(spark):
    names = [f"c{i}" for i in range(300)]
    df = spark.createDataFrame([tuple(None if i % 3 == 0 else float(i) for i in range(300))],
                               ", ".join(f"{n} double" for n in names))
    nulls = {r["column_name"]: r["nulls"] for r in P.null_counts(df).collect()}
    assert sum(nulls.values()) == 100 and len(nulls) == 300
