"""Trees, forests and boosting against plain Python, in every way they are grown and dealt."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from tabscout.operators import bins as B, treegrow as G, trees as T
from tabscout.operators.preprocess import FEATURES, LABEL
from tabscout.session import scratch_path


def frame(spark, x, y, sparse=False):
    def vector(row):
        if not sparse:
            return Vectors.dense(row)
        at = np.flatnonzero(row)
        return Vectors.sparse(len(row), at.tolist(), np.array(row)[at].tolist())
    return spark.createDataFrame(
        [(i, vector(list(map(float, r))), float(v)) for i, (r, v) in enumerate(zip(x, y))],
        ["id", FEATURES, LABEL])


def answers(model, df):
    scored = model.transform(df)
    out = ["id", "prediction"]
    if "probability" in scored.columns:
        scored = scored.withColumn("p", vector_to_array("probability"))
        out.append("p")
    return sorted(tuple(r) for r in scored.select(*out).collect())


def grow_plainly(x, g, h, depth, worth, fits):
    """Nodes as nested tuples; the best split by gain, then feature, then value."""
    rows = list(range(len(x)))

    def build(rows, level):
        G_, H, N = sum(g[r] for r in rows), sum(h[r] for r in rows), len(rows)
        best = None
        if level < depth and N > 1:
            for f in range(len(x[0])):
                values = sorted({x[r][f] for r in rows})
                for low, high in zip(values, values[1:]):
                    left = [r for r in rows if x[r][f] <= low]
                    gl, hl = sum(g[r] for r in left), sum(h[r] for r in left)
                    if not fits(hl, H - hl):
                        continue
                    gain = worth(gl, hl, len(left)) + worth(G_ - gl, H - hl, N - len(left)) - worth(G_, H, N)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                        best = gain, f, low + (high - low) / 2
        if best is None:
            return ("leaf", G_, H, rows)
        _, f, cut = best
        return ("split", f, cut, build([r for r in rows if x[r][f] <= cut], level + 1),
                build([r for r in rows if x[r][f] > cut], level + 1))

    return build(rows, 0)


def leaf_of(node, row):
    while node[0] == "split":
        node = node[3] if row[node[1]] <= node[2] else node[4]
    return node


def boost_plainly(x, y, classes, rounds, depth):
    """Softmax or logistic boosting with penalty 1, least hessian 1, rate 0.1."""
    margins = [[0.0] * (1 if classes == 2 else classes) for _ in x]
    for _ in range(rounds):
        if classes == 2:
            p = [[1 / (1 + math.exp(-m[0]))] for m in margins]
            wanted = [[v] for v in y]
            factor = 1.0
        else:
            p = []
            for m in margins:
                e = [math.exp(v) for v in m]
                p.append([v / sum(e) for v in e])
            wanted = [[float(v == c) for c in range(classes)] for v in y]
            factor = 2.0
        steps = []
        for c in range(len(margins[0])):
            g = [a[c] - b[c] for a, b in zip(p, wanted)]
            h = [factor * a[c] * (1 - a[c]) for a in p]
            tree = grow_plainly(x, g, h, depth, lambda a, b, n: a * a / (b + 1),
                                lambda a, b: a >= 1 and b >= 1)
            steps.append([-leaf_of(tree, r)[1] / (leaf_of(tree, r)[2] + 1) * 0.1 for r in x])
        for i, m in enumerate(margins):
            for c in range(len(m)):
                m[c] += steps[c][i]
    return T.probabilities(np.array(margins))


def table(seed, n=120, width=3, classes=2):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 9, (n, width))
    y = (x[:, 0] + 2 * (x[:, 1] > 4) + rng.integers(0, 4, n)) % classes
    return x.tolist(), y.tolist()


BOOSTER = dict(depth=3, penalty=1.0, minHessian=1.0, byHessian=True, prior=False)


@pytest.mark.parametrize("classes", [2, 3])
@pytest.mark.parametrize("small", [0, 25, 10_000])
def test_boosting_matches_plain_python(spark, monkeypatch, classes, small):
    monkeypatch.setattr(G, "SMALL_ROWS", small)
    monkeypatch.setattr(G, "CHUNK_BINS", 10)
    monkeypatch.setattr(T, "REFRESH_ROUNDS", 2)
    x, y = table(classes, classes=classes)
    df = frame(spark, x, y)
    model = T.HistogramBooster(trees=3, **BOOSTER).fit(df)
    want = boost_plainly(x, y, classes, 3, 3)
    got = answers(model, df)
    assert np.allclose([p for _, _, p in got], want, atol=1e-6)
    assert [a for _, a, _ in got] == want.argmax(1).tolist()


@pytest.mark.parametrize("make", [
    lambda: T.HistogramBooster(trees=4, rowShare=0.7, columnShare=0.7, **BOOSTER),
    lambda: T.HistogramBooster(trees=3, regression=True, depth=2),
    lambda: T.HistogramForest(trees=5, depth=0),
    lambda: T.HistogramForest(trees=4, depth=4, regression=True, nodeFeatures="all")])
def test_models_do_not_depend_on_the_partitioning(spark, monkeypatch, make):
    x, y = table(7, n=200, width=5, classes=3)
    df = frame(spark, x, y)
    found = []
    for parts, small in ((1, 10_000), (3, 30), (7, 0)):
        monkeypatch.setattr(G, "SMALL_ROWS", small)
        monkeypatch.setattr(G, "CHUNK_BINS", 4096 if parts < 7 else 12)
        found.append(answers(make().fit(df.repartition(parts)), df))
    assert found[0] == found[1] == found[2]


def test_dense_and_sparse_vectors_give_one_model(spark, monkeypatch):
    x, y = table(3, n=150, width=4, classes=2)
    monkeypatch.setattr(B, "DENSE_FEATURES", 2)
    one = T.HistogramBooster(trees=2, **BOOSTER).fit(frame(spark, x, y))
    two = T.HistogramBooster(trees=2, **BOOSTER).fit(frame(spark, x, y, sparse=True))
    assert answers(one, frame(spark, x, y)) == answers(two, frame(spark, x, y, sparse=True))


def depth_of(shape, node=0):
    depths, queue = 0, [(0, 0)]
    while queue:
        node, depth = queue.pop()
        depths = max(depths, depth)
        if shape.feature[node] >= 0:
            queue += [(shape.left[node], depth + 1), (shape.right[node], depth + 1)]
    return depths


@pytest.mark.parametrize("small", [4, 10_000])
def test_chains_deeper_than_forty_are_fitted(spark, monkeypatch, small):
    """Feature k is 1 for the rows of class k % 2 that no earlier feature tells: one level each."""
    monkeypatch.setattr(G, "SMALL_ROWS", small)
    x, y = [], []
    for k in range(46):
        x.append([float(j == k) for j in range(45)])
        y.append(k % 2)
    df = frame(spark, x, y)
    model = T.HistogramForest(trees=1, depth=0, bootstrap=False, nodeFeatures="all").fit(df)
    assert [a for _, a, _ in answers(model, df)] == y
    assert depth_of(model.trees[0][0]) >= 22
    # Distinct values with alternating classes, one feature: every value becomes a leaf.
    x, y = [[v] for v in range(200)], [v % 2 for v in range(200)]
    df = frame(spark, x, y)
    model = T.HistogramForest(trees=1, depth=0, bootstrap=False, nodeFeatures="all").fit(df)
    assert [a for _, a, _ in answers(model, df)] == y
    assert depth_of(model.trees[0][0]) > 40
    short = T.HistogramForest(trees=1, depth=3, bootstrap=False, nodeFeatures="all").fit(df)
    assert depth_of(short.trees[0][0]) == 3


def test_a_split_without_gain_is_made_when_classes_differ(spark):
    x, y = [[0, 0], [0, 1], [1, 0], [1, 1]] * 3, [0, 1, 1, 0] * 3
    model = T.HistogramForest(trees=1, depth=0, bootstrap=False, nodeFeatures="all").fit(
        frame(spark, x, y))
    assert [a for _, a, _ in answers(model, frame(spark, x, y))] == y


def test_poisson_weights():
    drawn = np.searchsorted(T._POISSON, T._uniform(np.arange(200_000), 42, 3), "right")
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.02
    other = np.searchsorted(T._POISSON, T._uniform(np.arange(200_000), 42, 4), "right")
    assert abs(np.corrcoef(drawn, other)[0, 1]) < 0.01


def test_forest_regression_matches_variance_splits(spark):
    x, y = table(11, n=90, width=2, classes=50)
    mean = sum(y) / len(y)
    tree = grow_plainly(x, [v - mean for v in y], [1.0] * len(y), 3, lambda a, b, n: a * a / n if n else 0,
                        lambda a, b: True)
    df = frame(spark, x, y)
    model = T.HistogramForest(trees=1, depth=3, bootstrap=False, regression=True,
                              nodeFeatures="all").fit(df)
    for (i, value), row in zip(answers(model, df), x):
        rows = leaf_of(tree, row)[3]
        assert value == pytest.approx(sum(y[r] for r in rows) / len(rows), abs=1e-6)


def test_many_values_are_cut_at_quantiles(spark, monkeypatch):
    values = np.repeat(np.arange(1000.0), 3)
    counts = np.ones(len(values))
    cuts = B._cut_points(np.unique(values), np.full(1000, 3), 16)
    assert len(cuts) == 15 and np.diff(cuts).min() > 50 and len(counts)
    monkeypatch.setattr(B, "SAMPLE_ROWS", 500)
    x = [[v] for v in range(3000)]
    y = [float(v[0] >= 1500) for v in x]
    models = [T.HistogramForest(trees=1, depth=2, bootstrap=False).fit(
        frame(spark, x, y).repartition(n)) for n in (1, 5)]
    found = [answers(m, frame(spark, x, y)) for m in models]
    assert found[0] == found[1]
    assert sum(a == b for (_, a, _), b in zip(found[0], y)) > 2950


def test_saved_models_answer_alike(spark):
    x, y = table(5, classes=3)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
                               f"id int, a double, b double, c double, {LABEL} double")
    assembler = VectorAssembler(inputCols=["a", "b", "c"], outputCol=FEATURES)
    for learner in (T.HistogramBooster(trees=3, **BOOSTER), T.HistogramForest(trees=3, depth=0),
                    T.HistogramForest(trees=2, regression=True)):
        model = Pipeline(stages=[assembler, learner]).fit(df)
        path = scratch_path(spark, "trees")
        model.save(path)
        assert answers(PipelineModel.load(path), df) == answers(model, df)


def test_odd_tables(spark):
    one = frame(spark, [[1, 2]], [1])
    assert answers(T.HistogramForest(trees=2, depth=0, bootstrap=False).fit(one), one)[0][1] == 1
    assert answers(T.HistogramBooster(trees=2, regression=True).fit(one), one) == [(0, 1.0)]
    same = frame(spark, [[3, 3]] * 10, [0, 1] * 5)
    assert [p for _, _, p in answers(T.HistogramBooster(trees=2, depth=3).fit(same), same)] == [[.5, .5]] * 10
    with pytest.raises(ValueError, match="no rows"):
        T.HistogramForest().fit(same.limit(0))
