"""Radial-basis kernel machines on landmarks.

Williams and Seeger, "Using the Nystroem Method to Speed Up Kernel Machines" (2001): the kernel
between all rows is approximated through its values at some landmark rows. With as many
landmarks as different rows it is exact; the error falls as landmarks are added.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, OneVsRestModel
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import (
    HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasSeed, Param, Params, TypeConverters,
)
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable, MLReadable, MLWritable
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import constants as K
from ..session import materialise, ship_package, side_by_side
from .arrays import ArrayReader, ArrayWriter
from .bins import cells, in_batches, plain
from .preprocess import FEATURES, LABEL

#: Cells of a dense piece of rows.
_PIECE_CELLS = 1 << 22
#: Machines that are fitted side by side, and the cells of projected rows they may hold together.
MACHINES_AT_ONCE, CELLS_AT_ONCE = 8, 1 << 26


class Landmarks:
    """Landmark rows over the features that any of them has, and the kernel's width."""

    def __init__(self, features: np.ndarray, rows: np.ndarray, gamma: float):
        self.features, self.rows, self.gamma = features, rows, gamma

    @classmethod
    def of(cls, vectors: pa.Array, gamma: float) -> "Landmarks":
        row, feature, value = cells(vectors)
        use = value != 0
        features, column = np.unique(feature[use], return_inverse=True)
        rows = np.zeros((len(vectors), len(features)))
        rows[row[use], column] = value[use]
        return cls(features, np.unique(rows, axis=0), gamma)

    def kernel(self, vectors: pa.Array) -> np.ndarray:
        """exp(-gamma |x - landmark|^2) of each row and landmark; vectors stay sparse until a piece
        of rows is compared."""
        row, feature, value = cells(vectors)
        n, width = len(vectors), len(self.features)
        squares = np.bincount(row, value * value, n)
        place = np.minimum(np.searchsorted(self.features, feature), max(0, width - 1))
        known = self.features[place] == feature if width else np.zeros(len(feature), bool)
        row, place, value = row[known], place[known], value[known]
        products = np.empty((n, len(self.rows)))
        step = max(1, _PIECE_CELLS // max(1, width))
        for low in range(0, n, step):
            high = min(n, low + step)
            here = slice(*np.searchsorted(row, (low, high)))
            dense = np.zeros((high - low, width))
            dense[row[here] - low, place[here]] = value[here]
            products[low:high] = dense @ self.rows.T
        apart = squares[:, None] + (self.rows * self.rows).sum(1) - 2 * products
        return np.exp(-self.gamma * np.maximum(apart, 0.0))

    def projection(self) -> np.ndarray:
        """Turns kernel values into features whose inner products are the kernel."""
        own = np.exp(-self.gamma * np.maximum(
            ((self.rows[:, None, :] - self.rows[None, :, :]) ** 2).sum(2), 0)) if (
            self.rows.size * len(self.rows) <= _PIECE_CELLS) else self._own()
        values, axes = np.linalg.eigh(own)
        kept = values > 1e-10 * values.max(initial=0)
        return axes[:, kept] / np.sqrt(values[kept])

    def _own(self) -> np.ndarray:
        squares = (self.rows * self.rows).sum(1)
        apart = squares[:, None] + squares - 2 * self.rows @ self.rows.T
        return np.exp(-self.gamma * np.maximum(apart, 0.0))


def pick_landmarks(dataset: DataFrame, features: str, n: int, gamma: float) -> Landmarks:
    """The ``n`` rows of least hash, at most one of equal rows."""
    rows = dataset.select(plain(features).alias("vector")).withColumn("hash", F.xxhash64("vector"))
    chosen = rows.dropDuplicates(["hash"]).orderBy("hash").limit(n).select("vector").toArrow()
    return Landmarks.of(chosen.column("vector").combine_chunks(), gamma)


def _gamma(dataset: DataFrame, features: str) -> tuple[float, int]:
    """1 / (width * variance of all cells), and the row count."""
    stats = dataset.agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col(features)).alias("s")
    ).select("s.mean", "s.variance", "s.count").first()
    mean, n = stats["mean"].toArray(), stats["count"]
    variance = stats["variance"].toArray() * (n - 1) / max(n, 1)
    overall = float((variance + mean * mean).mean() - mean.mean() ** 2)
    return (1.0 / (len(mean) * overall) if overall > 0 else 1.0), n


def _dense(found: np.ndarray) -> pa.StructArray:
    """The rows of a matrix as vectors."""
    n, width = found.shape
    none = pa.array([None] * n, pa.int32())
    return pa.StructArray.from_arrays([
        pa.array(np.ones(n, np.int8)), none, pa.array([None] * n, pa.list_(pa.int32())),
        pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()),
                                 pa.array(found.ravel()))],
        ["type", "size", "indices", "values"])


class LandmarkFeatures(Transformer, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """Maps a vector to features whose inner products approximate the kernel."""

    def __init__(self, landmarks: Landmarks | None = None, projection: np.ndarray | None = None):
        super().__init__()
        self.landmarks, self.projection = landmarks, projection

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        sent = dataset.sparkSession.sparkContext.broadcast((self.landmarks, self.projection))

        def project(vectors):
            landmarks, projection = sent.value
            return _dense(landmarks.kernel(vectors) @ projection)

        return dataset.withColumn(
            self.getOutputCol(), arrow_udf(project, VectorUDT())(plain(self.getInputCol())))

    def state(self):
        mine = self.landmarks
        return {"features": mine.features, "rows": mine.rows, "projection": self.projection}, {
            "gamma": mine.gamma}

    @classmethod
    def of_state(cls, arrays, facts):
        return cls(Landmarks(arrays["features"], arrays["rows"], facts["gamma"]), arrays["projection"])

    def write(self):
        return ArrayWriter(self)

    @classmethod
    def read(cls):
        return ArrayReader(cls)


class _KernelEstimator(Estimator, HasFeaturesCol, HasLabelCol, HasSeed, DefaultParamsReadable,
                       DefaultParamsWritable):
    width = Param(Params._dummy(), "width", "number of landmarks", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)

    def _features(self, dataset: DataFrame) -> tuple[LandmarkFeatures, int]:
        gamma, n = _gamma(dataset, self.getFeaturesCol())
        marks = pick_landmarks(dataset, self.getFeaturesCol(), self.getOrDefault(self.width), gamma)
        mapped = LandmarkFeatures(marks, marks.projection())
        return mapped._set(inputCol=self.getFeaturesCol(), outputCol="ts_kernel"), n


class KernelClassifier(_KernelEstimator):
    """Kernel support vector classifier, penalty 1.

    Probabilities are fitted (Platt) on margins of rows that the machine giving the margin was not trained
    on: rows are dealt to ``folds`` by their hash, and each fold is scored by a machine of the others.
    The machines of all classes and folds are fitted side by side, the fewer at once the larger the table:
    on a small one each iteration is a job far shorter than the time to start it.
    """

    probability = Param(Params._dummy(), "probability", "fit probabilities",
                        TypeConverters.toBoolean)
    folds = Param(Params._dummy(), "folds", "parts for held-out margins", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol=FEATURES, labelCol=LABEL, width=256, maxIter=100,
                 probability=True, folds=3, seed=K.SEED):
        super().__init__()
        self._setDefault(featuresCol=FEATURES, labelCol=LABEL, width=256, maxIter=100,
                         probability=True, folds=3, seed=K.SEED)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        mapped, n = self._features(dataset)
        label, folds = self.getLabelCol(), self.getOrDefault(self.folds)
        classes = dataset.select(F.max(label)).first()[0]

        def fit(parts: Sequence[tuple[DataFrame, int]]) -> list[Model]:
            """A machine of each part (rows, count)."""
            several = classes is not None and classes >= 2
            wanted = [(rows, count, c) for rows, count in parts
                      for c in (range(int(classes) + 1) if several else [None])]

            def one(item) -> Model:
                rows, count, own = item
                target = F.col(label)
                if own is not None:
                    target = F.when(target == own, 1.0).otherwise(0.0)
                return machine(count).fit(rows.select("ts_kernel", target.alias(label)))

            with ThreadPool(_at_once(n, mapped.projection.shape[1])) as pool:
                made = side_by_side(dataset.sparkSession, pool, one, wanted)
            if not several:
                return made
            each = int(classes) + 1
            return [
                OneVsRest(classifier=machine(count), featuresCol="ts_kernel", labelCol=label)._copyValues(
                    OneVsRestModel(made[i * each:(i + 1) * each]))
                for i, (_, count) in enumerate(parts)]

        def machine(count: int) -> LinearSVC:
            return LinearSVC(
                featuresCol="ts_kernel", labelCol=label, maxIter=self.getOrDefault(self.maxIter),
                regParam=1.0 / count, standardization=False)

        fold = F.pmod(F.xxhash64(plain(self.getFeaturesCol()), F.lit(self.getSeed())), F.lit(folds))
        projected = mapped.transform(
            dataset.select(self.getFeaturesCol(), label).withColumn("ts_fold", fold)).persist()
        try:
            held_out = []
            if self.getOrDefault(self.probability):
                held_out = self._held_out(projected, label, folds)
            fitted, *others = fit([(projected, n), *((rest, count) for rest, count, _ in held_out)])
            stages = [mapped, fitted]
            if self.getOrDefault(self.probability):
                platt = LogisticRegression(
                    featuresCol="rawPrediction", labelCol=label, predictionCol="ts_platt",
                    rawPredictionCol="ts_platt_raw", probabilityCol="probability")
                margins = reduce(DataFrame.union, [
                    _margins(own, model).select("rawPrediction", label)
                    for model, (_, _, own) in zip(others, held_out)
                ]) if held_out else _margins(projected, fitted)
                stages.append(platt.fit(margins))
        finally:
            projected.unpersist()
        return PipelineModel(stages=stages)

    def _held_out(self, projected: DataFrame, label: str,
                  folds: int) -> list[tuple[DataFrame, int, DataFrame]]:
        """Per fold the rows of the others, their number and its own rows.

        A table whose classes are not all in the rest of each fold is too small for that and has
        none: it takes the margins of the machine itself.
        """
        counts: dict[int, dict] = {}
        for r in projected.groupBy("ts_fold", label).count().collect():
            counts.setdefault(r["ts_fold"], {})[r[label]] = r["count"]
        everyone = {c for own in counts.values() for c in own}
        rest = {f: {c for g, own in counts.items() if g != f for c in own} for f in counts}
        if len(everyone) < 2 or any(r != everyone for r in rest.values()):
            return []
        size = {f: sum(sum(own.values()) for g, own in counts.items() if g != f) for f in counts}
        return [(projected.filter(F.col("ts_fold") != f), size[f], projected.filter(F.col("ts_fold") == f))
                for f in sorted(counts)]


def _margins(rows: DataFrame, model: Model) -> DataFrame:
    """Adds the model's ``rawPrediction`` in one step: to plan its own chain of steps, some for each
    class, takes far longer than the work."""
    several = isinstance(model, OneVsRestModel)
    machines = model.models if several else [model]
    weights = np.column_stack([m.coefficients.toArray() for m in machines])
    constants = np.array([m.intercept for m in machines])

    def margins(vectors):
        found = cells(vectors)[2].reshape(len(vectors), len(weights)) @ weights + constants
        return _dense(found if several else np.hstack((-found, found)))

    ship_package(rows.sparkSession)
    return rows.withColumn("rawPrediction", arrow_udf(margins, VectorUDT())(plain("ts_kernel")))


def _at_once(rows: int, width: int) -> int:
    """Machines fitted side by side: each holds the projected rows with labels of its own."""
    return max(1, min(MACHINES_AT_ONCE, CELLS_AT_ONCE // max(1, rows * width)))


def tube_loss(residual: np.ndarray, epsilon: float, soft: float) -> tuple[np.ndarray, np.ndarray]:
    """What lies outside a tube around the line, rounded off over ``soft``; and its slope."""
    out = np.maximum(np.abs(residual) - epsilon, 0.0)
    loss = np.where(out < soft, out * out / (2 * soft), out - soft / 2)
    return loss, np.sign(residual) * np.minimum(out / soft, 1.0)


def minimise(evaluate: Callable[[np.ndarray], list[tuple[float, np.ndarray]]], start: np.ndarray,
             iterations: int, memory: int = 10) -> np.ndarray:
    """L-BFGS whose step sizes are tried together: ``evaluate`` takes several points in one pass."""
    steps = 3.0 ** -np.arange(10)
    point = start
    value, slope = evaluate(point[None])[0]
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        direction, kept = -slope, []
        for s, y in reversed(past):
            a = s @ direction / (y @ s)
            kept.append(a)
            direction = direction - a * y
        if past:
            s, y = past[-1]
            direction = direction * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(kept)):
            direction = direction + s * (a - (y @ direction) / (y @ s))
        descent = slope @ direction
        if not descent < -1e-12 * max(1.0, abs(value)):
            break
        scale = 1.0 if past else 1.0 / max(1.0, np.linalg.norm(slope))
        tried = evaluate(point[None] + (scale * steps)[:, None] * direction[None])
        good = [i for i, (v, _) in enumerate(tried) if v <= value + 1e-4 * scale * steps[i] * descent]
        if not good:
            if not past:
                break
            past = []
            continue
        i = min(good, key=lambda i: tried[i][0])
        moved = scale * steps[i] * direction
        change = tried[i][1] - slope
        if moved @ change > 1e-12 * (change @ change):
            past = [*past, (moved, change)][-memory:]
        gained = value - tried[i][0]
        point, (value, slope) = point + moved, tried[i]
        if gained <= 1e-9 * max(1.0, abs(value)):
            break
    return point


class KernelRegressor(_KernelEstimator):
    """Kernel support vector regression: errors up to ``epsilon`` are free, larger ones count linearly,
    with penalty 1 on the squared weights.

    The corner of the loss is rounded off over a thousandth of the labels' deviation. Every iteration
    is one pass over the projected rows, in which tasks add up loss and slope for several step sizes.
    """

    epsilon = Param(Params._dummy(), "epsilon", "half width of the tube", TypeConverters.toFloat)
    cost = Param(Params._dummy(), "cost", "weight of the errors", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol=FEATURES, labelCol=LABEL, width=256, maxIter=100, epsilon=0.1,
                 cost=1.0, seed=K.SEED):
        super().__init__()
        self._setDefault(featuresCol=FEATURES, labelCol=LABEL, width=256, maxIter=100, epsilon=0.1,
                         cost=1.0, seed=K.SEED)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "KernelRegressorModel":
        mapped, n = self._features(dataset)
        label = F.col(self.getLabelCol()).cast("double")
        low, high, spread = dataset.agg(
            F.min(label), F.max(label), F.stddev_pop(label)).first()
        rows = materialise(dataset.select(
            plain(self.getFeaturesCol()).alias("vector"), label.alias("label")).filter(
            "label IS NOT NULL"))
        context = dataset.sparkSession.sparkContext
        sent = context.broadcast((mapped.landmarks, mapped.projection))
        epsilon, cost = self.getOrDefault(self.epsilon), self.getOrDefault(self.cost)
        soft = max(1e-3 * (spread or 0.0), 1e-6)
        centre = ((low or 0.0) + (high or 0.0)) / 2

        def project(batches):
            landmarks, projection = sent.value
            for batch in batches:
                if batch.num_rows:
                    found = landmarks.kernel(batch.column("vector")) @ projection
                    yield pa.RecordBatch.from_arrays([
                        pa.array([r.tobytes() for r in found], pa.binary()), batch.column("label")],
                        names=["row", "label"])

        projected = materialise(in_batches(rows, project, "row binary, label double"))
        size = mapped.projection.shape[1]

        def evaluate(points: np.ndarray, soft: float) -> list[tuple[float, np.ndarray]]:
            def work(batches):
                losses, slopes = np.zeros(len(points)), np.zeros((len(points), size + 1))
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    x = np.frombuffer(b"".join(batch.column("row").to_pylist())).reshape(-1, size)
                    y = np.array(batch.column("label")) - centre
                    for i, p in enumerate(points):
                        loss, slope = tube_loss(x @ p[:-1] + p[-1] - y, epsilon, soft)
                        losses[i] += loss.sum()
                        slopes[i, :-1] += slope @ x
                        slopes[i, -1] += slope.sum()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([losses.tobytes()]), pa.array([slopes.tobytes()])],
                    names=["losses", "slopes"])

            # One row a task, each as large as the weights.
            parts = in_batches(projected, work, "losses binary, slopes binary").collect()
            losses = sum((np.frombuffer(r["losses"]) for r in parts), np.zeros(len(points)))
            slopes = sum((np.frombuffer(r["slopes"]).reshape(len(points), -1) for r in parts),
                         np.zeros((len(points), size + 1)))
            out = []
            for p, loss, slope in zip(points, losses, slopes):
                pull = np.append(p[:-1], 0.0)
                out.append((0.5 * pull @ pull + cost * loss, pull + cost * slope))
            return out

        # From a widely rounded corner to a sharp one, each from where the last one ended.
        weights, stages = np.zeros(size + 1), 4
        for i in range(stages):
            wide = soft * 10.0 ** (stages - 1 - i)
            weights = minimise(lambda points: evaluate(points, wide), weights,
                               max(1, self.getOrDefault(self.maxIter) // stages))
        model = KernelRegressorModel(mapped.landmarks, mapped.projection @ weights[:-1],
                                     float(weights[-1] + centre))
        return model._set(featuresCol=self.getFeaturesCol())


class KernelRegressorModel(Model, HasFeaturesCol, MLWritable, MLReadable):
    """A weight per landmark and a constant; adds ``prediction``."""

    def __init__(self, landmarks: Landmarks | None = None, weights: np.ndarray | None = None,
                 constant: float = 0.0):
        super().__init__()
        self._setDefault(featuresCol=FEATURES)
        self.landmarks, self.weights, self.constant = landmarks, weights, constant

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        sent = dataset.sparkSession.sparkContext.broadcast(
            (self.landmarks, self.weights, self.constant))

        def predict(vectors):
            landmarks, weights, constant = sent.value
            return pa.array(landmarks.kernel(vectors) @ weights + constant)

        return dataset.withColumn(
            "prediction", arrow_udf(predict, "double")(plain(self.getFeaturesCol())))

    def state(self):
        mine = self.landmarks
        return {"features": mine.features, "rows": mine.rows, "weights": self.weights}, {
            "gamma": mine.gamma, "constant": self.constant}

    @classmethod
    def of_state(cls, arrays, facts):
        return cls(Landmarks(arrays["features"], arrays["rows"], facts["gamma"]), arrays["weights"],
                   facts["constant"])

    def write(self):
        return ArrayWriter(self)

    @classmethod
    def read(cls):
        return ArrayReader(cls)
