"""Landmarks against the exact kernel, the tube's width, held-out probabilities, storing."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from tabscout.operators import kernel as M
from tabscout.operators.preprocess import FEATURES, LABEL
from tabscout.session import scratch_path


def frame(spark, x, y):
    return spark.createDataFrame(
        [(i, Vectors.dense(list(map(float, r))), float(v)) for i, (r, v) in enumerate(zip(x, y))],
        ["id", FEATURES, LABEL])


def struct(x):
    n = len(x)
    return pa.StructArray.from_arrays([
        pa.array(np.ones(n, np.int8)), pa.array([None] * n, pa.int32()),
        pa.array([None] * n, pa.list_(pa.int32())), pa.array(x.tolist(), pa.list_(pa.float64()))],
        ["type", "size", "indices", "values"])


def exact(x, gamma):
    return np.exp(-gamma * ((x[:, None, :] - x[None, :, :]) ** 2).sum(2))


def test_error_falls_with_the_number_of_landmarks():
    x = np.random.default_rng(0).normal(size=(200, 3))
    errors = []
    for n in (5, 20, 80, 200):
        marks = M.Landmarks.of(struct(x[:n]), 0.3)
        found = marks.kernel(struct(x)) @ marks.projection()
        errors.append(np.abs(found @ found.T - exact(x, 0.3)).max())
    assert errors[0] > errors[1] > errors[2] > errors[3]
    assert errors[3] < 1e-5


def test_sparse_and_dense_rows_have_one_kernel():
    x = np.random.default_rng(1).integers(0, 3, (30, 6)).astype(float)
    marks = M.Landmarks.of(struct(x[:10]), 0.5)
    at = [np.flatnonzero(r) for r in x]
    sparse = pa.StructArray.from_arrays([
        pa.array(np.zeros(30, np.int8)), pa.array(np.full(30, 6, np.int32)),
        pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())),
        pa.array([r[a] for r, a in zip(x, at)], pa.list_(pa.float64()))],
        ["type", "size", "indices", "values"])
    assert np.allclose(marks.kernel(sparse), marks.kernel(struct(x)))
    far = np.exp(-0.5 * ((x[:, None, :] - np.unique(x[:10], axis=0)[None]) ** 2).sum(2))
    assert np.allclose(marks.kernel(sparse), far)


def test_minimiser_reaches_the_least_value():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(30, 8))
    h, b = a.T @ a + np.eye(8), rng.normal(size=8)
    found = M.minimise(lambda ps: [(0.5 * p @ h @ p - b @ p, h @ p - b) for p in ps], np.zeros(8), 100)
    assert np.allclose(found, np.linalg.solve(h, b), atol=1e-4)


def test_errors_inside_the_tube_are_free(spark):
    """A flat line with outliers: the tube holds the bulk, outliers pull linearly, not squared."""
    x = np.linspace(-2, 2, 81)[:, None]
    y = np.full(81, 3.0)
    y[::20] = 500.0
    df = frame(spark, x, y)
    model = M.KernelRegressor(width=40, epsilon=0.5, cost=1.0).fit(df)
    got = {r["id"]: r["prediction"] for r in model.transform(df).select("id", "prediction").collect()}
    assert len(got) == 81
    bulk = [got[i] for i in range(81) if i % 20]
    # Squared errors would draw the line towards the mean, 34; weights of outliers are bounded by 1.
    assert max(abs(v - 3.0) for v in bulk) < 5
    smooth = np.sin(x[:, 0])
    wide = M.KernelRegressor(width=40, epsilon=0.3, cost=50.0).fit(frame(spark, x, smooth))
    off = np.array([r["prediction"] for r in wide.transform(frame(spark, x, smooth)).orderBy("id").select(
        "prediction").collect()]) - smooth
    assert np.abs(off).max() < 0.33
    narrow = M.KernelRegressor(width=40, epsilon=0.01, cost=50.0).fit(frame(spark, x, smooth))
    off = np.array([r["prediction"] for r in narrow.transform(frame(spark, x, smooth)).orderBy(
        "id").select("prediction").collect()]) - smooth
    assert np.abs(off).max() < 0.05
    path = scratch_path(spark, "kernel")
    narrow.save(path)
    again = M.KernelRegressorModel.load(path).transform(df).select("prediction").collect()
    assert again == narrow.transform(df).select("prediction").collect()


def test_probabilities_are_calibrated_on_held_out_margins(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    model = M.KernelClassifier(width=200, maxIter=30).fit(frame(spark, x[:250], y[:250]))
    rows = model.transform(frame(spark, x[250:], y[250:])).withColumn(
        "p", vector_to_array("probability")[1]).orderBy("id").select("p", "prediction").collect()
    p = np.clip(np.array([r["p"] for r in rows]), 1e-9, 1 - 1e-9)
    truth = y[250:]
    loss = -(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean()
    assert loss < 0.69
    assert np.mean([r["prediction"] for r in rows] == truth) > 0.6


@pytest.mark.parametrize("classes", [1, 3])
def test_few_rows_and_several_classes(spark, classes):
    x = [[float(i), float(i % classes)] for i in range(12)]
    y = [i % classes for i in range(12)] if classes > 1 else [0] * 11 + [1]
    df = frame(spark, x, y)
    rows = M.KernelClassifier(width=8, maxIter=5).fit(df).transform(df).select("probability").collect()
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in rows) and len(rows) == 12


def test_machines_are_fitted_side_by_side(spark, monkeypatch):
    import threading

    rng = np.random.default_rng(5)
    x = rng.standard_normal((120, 2))
    y = (x[:, 0] > 0).astype(float)
    together = threading.Barrier(2, timeout=30)

    def watch(self, rows):
        together.wait()
        raise InterruptedError

    monkeypatch.setattr(M.LinearSVC, "_fit", watch)
    with pytest.raises(InterruptedError):
        M.KernelClassifier(width=8, maxIter=5).fit(frame(spark, x, y))
    assert M._at_once(100, 32) == M.MACHINES_AT_ONCE and M._at_once(1 << 40, 32) == 1


@pytest.mark.parametrize("classes", [2, 3])
def test_margins_are_those_of_the_machine(spark, classes):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((150, 2))
    y = np.floor((x[:, 0] > 0) + (x[:, 1] > 0) * (classes - 2.0))
    df = frame(spark, x, y)
    mapped, fitted, _ = M.KernelClassifier(width=8, maxIter=5).fit(df).stages
    held = mapped.transform(df).select("ts_kernel").coalesce(1)
    own = [r[0].toArray() for r in fitted.transform(held).select("rawPrediction").collect()]
    fast = [r[0].toArray() for r in M._margins(held, fitted).select("rawPrediction").collect()]
    np.testing.assert_allclose(fast, own, rtol=1e-9, atol=1e-12)
