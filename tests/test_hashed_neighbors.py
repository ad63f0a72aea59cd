"""Hash tables of random projections: recall against the exact search, completeness, odd rows."""

import numpy as np
import pytest

from tabscout.operators import hashed_neighbors as H, neighbors as N


def recall(found, true):
    got = {(r["query_key"], r["train_key"]) for r in found.collect()}
    want = {(r["query_key"], r["train_key"]) for r in true.collect()}
    return len(got & want) / len(want)


def frames(spark, points, n_query):
    rows = [(i, [float(v) for v in p], i % 3) for i, p in enumerate(points)]
    train = spark.createDataFrame(rows[n_query:], "k long, v array<double>, y int")
    query = spark.createDataFrame([r[:2] for r in rows[:n_query]], "q long, v array<double>")
    return train, query, (5, "k", "q", "v", "y")


@pytest.mark.parametrize("shape", ["clusters", "spread"])
def test_recall(spark, monkeypatch, shape):
    monkeypatch.setattr(H, "TRAIN_BLOCK", 200)
    monkeypatch.setattr(H, "QUERY_BLOCK", 40)
    monkeypatch.setattr(H, "BUNDLE_ROWS", 500)
    rng = np.random.default_rng(1)
    points = rng.normal(size=(3300, 12))
    if shape == "clusters":
        points = 0.3 * points + 4 * rng.normal(size=(60, 12))[rng.integers(0, 60, 3300)]
    train, query, args = frames(spark, points, 300)
    found = N.neighbours(train, query, *args, method="approximate")
    true = N.neighbours(train, query, *args)
    assert found.count() == 1500
    assert recall(found, true) >= 0.9
    exact = {(r["query_key"], r["train_key"]): r["distance"] for r in true.collect()}
    for r in found.collect():
        key = r["query_key"], r["train_key"]
        assert key not in exact or abs(exact[key] - r["distance"]) < 1e-9


def test_tuned_tables_compare_few_rows():
    rng = np.random.default_rng(2)
    centres = 4 * rng.normal(size=(200, 16))
    points = 0.2 * rng.normal(size=(4000, 16)) + centres[rng.integers(0, 200, 4000)]
    apart = N._distances(points[:100], points[100:])
    near = np.sort(apart, axis=1)[:, :5]
    n, width = H.tune(float(np.quantile(near[:, -1], 0.8)), apart.ravel(), H.TABLES, 0.95)
    tables = H.Tables(rng.standard_normal((16, H.TABLES * n)), rng.random(H.TABLES * n), width, n)
    own, other = tables.buckets(points[:100]), tables.buckets(points[100:])
    met = (own[:, None, :] == other[None, :, :]).any(2)
    assert met.mean() < 0.1
    assert met[np.arange(100)[:, None], np.argsort(apart, axis=1)[:, :5]].mean() >= 0.9


def test_copies_far_queries_and_empty_tables(spark):
    points = np.vstack((np.zeros((50, 4)), np.random.default_rng(3).normal(size=(100, 4)), [[1e6] * 4]))
    train, query, args = frames(spark, points[::-1].copy(), 20)
    found = N.neighbours(train, query, *args, method="approximate").collect()
    assert len(found) == 100 and {r["rank"] for r in found} == {1, 2, 3, 4, 5}
    same = frames(spark, np.ones((40, 3)), 10)
    assert N.neighbours(same[0], same[1], *same[2], method="approximate").count() == 50
    assert N.neighbours(train, query.limit(0), *args, method="approximate").count() == 0
    with pytest.raises(ValueError, match="5 neighbours"):
        N.neighbours(train.limit(2), query, *args, method="approximate")
    with pytest.raises(ValueError, match="unknown method"):
        N.neighbours(train, query, *args, method="guess")


def _by_hand(query, train, keys, k):
    apart = np.sqrt(((query[:, None, :] - train[None, :, :]) ** 2).sum(2))
    order = np.lexsort((np.broadcast_to(keys, apart.shape), apart), axis=1)[:, :k]
    return order, np.take_along_axis(apart, order, 1)


@pytest.mark.parametrize("kind", ["spread", "ties", "alike", "many columns", "few rows"])
def test_boxes_find_the_nearest_rows(kind):
    rng = np.random.default_rng(7)
    width = 30 if kind == "many columns" else 3
    train, query = rng.standard_normal((900, width)), rng.standard_normal((70, width))
    if kind in ("ties", "alike"):
        train, query = (np.round(a * (kind == "ties")) for a in (train, query))
    train = train[:4] if kind == "few rows" else train
    keys = rng.permutation(len(train))
    q, t, d = N._best(query, train, keys, 5)
    order, apart = _by_hand(query, train, keys, min(5, len(train)))
    by = np.lexsort((keys[t], d, q))
    assert t[by].reshape(order.shape).tolist() == order.tolist()
    np.testing.assert_allclose(d[by].reshape(apart.shape), apart, rtol=1e-12)


def test_few_pairs_of_a_block_are_compared(monkeypatch):
    rng = np.random.default_rng(8)
    train, query, pairs, plain = rng.random((8192, 3)), rng.random((1024, 3)), [], N._distances

    def counted(a, b):
        pairs.append(len(a) * len(b))
        return plain(a, b)

    monkeypatch.setattr(N, "_distances", counted)
    N._best(query, train, np.arange(len(train)), 5)
    assert sum(pairs) < 0.1 * len(train) * len(query)


def test_queries_go_to_few_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "TRAIN_BLOCK", 32)
    rng = np.random.default_rng(9)
    train, query = rng.random((4096, 3)), rng.random((200, 3))
    rows = spark.createDataFrame(
        [(i, v.tolist(), 0.0) for i, v in enumerate(train)], "key long, vector array<double>, outcome double")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(query)], "key long, vector array<double>")
    sent, plain = [], N._send

    def watch(*args):
        found = plain(*args)
        sent.append(found.count())
        return found

    monkeypatch.setattr(N, "_send", watch)
    found = {(r["query_key"], r["rank"]): r["train_key"] for r in N.exact_neighbours(rows, asked, 5).collect()}
    order, _ = _by_hand(query, train, np.arange(len(train)), 5)
    assert found == {(i, j + 1): t for i, own in enumerate(order.tolist()) for j, t in enumerate(own)}
    assert sent[0] == len(query) and sent[1] < 6 * len(query)
