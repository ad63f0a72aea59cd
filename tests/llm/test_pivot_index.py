"""Vector links against brute force: all found links hold, recall, odd rows."""

import numpy as np
import pytest

from tabscout.llm import pivot_index


def brute(rows, least=0.93):
    links = [set() for _ in rows]
    unit = []
    for _, v, g in rows:
        ok = v is not None and None not in v and len(v) and np.isfinite(v).all() and np.any(v)
        unit.append(np.array(v, float) / np.linalg.norm(v) if ok and g is not None else None)
    for i, a in enumerate(unit):
        for j in range(i):
            b = unit[j]
            if (a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b)
                    and a @ b >= least):
                links[i].add(j)
                links[j].add(i)
    return links


def test_recall_of_families(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK", 40)
    rng = np.random.default_rng(4)
    rows = []
    for family in range(25):
        base = rng.standard_normal(32)
        for _ in range(12):
            v = base + 0.25 * rng.standard_normal(32)
            rows.append((len(rows), v.tolist(), family % 3))
    rows += [(len(rows) + k, rows[k][1], rows[k][2]) for k in range(5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r for r in pivot_index.near_vectors(df).collect()}
    want = brute(rows)
    true = sum(map(len, want))
    assert true > 1000
    found = 0
    for i, links in enumerate(want):
        assert got[i].n_links <= len(links)
        assert got[i].kept == (got[i].component_id == i)
        found += got[i].n_links
    assert found >= 0.9 * true


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.01], 2), (4, None, 1), (5, [], 1),
            (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0], None),
            (10, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.05], 1), (None, [1.0, 0.0], 1), (11, [0.0, 1.0], 1),
            (12, [1e300, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr(
        "*", "1 AS node", "'x' AS `group`", "2 AS row")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept)
                  for r in pivot_index.near_vectors(df).collect()))
    assert got == [
        (0, 4, 1, False), (1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (3, 0, 3, True),
        (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True),
        (9, 0, 9, True), (10, 0, 10, True), (11, 0, 11, True), (12, 4, 1, False)]
    assert pivot_index.near_vectors(df.limit(0)).count() == 0


def test_blocks_that_hold_nobody(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK", 1)
    rows = [(i, [1.0, 0.01 * i, 0.0], "a") for i in range(3)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    got = pivot_index.near_vectors(vectors).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(0, 2, 0), (1, 2, 0), (2, 2, 0)]
