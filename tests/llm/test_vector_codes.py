"""Codes against exhaustive search in plain integers, odd rows, hot labels."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tabscout.llm import vector_codes as V

SMALL = st.integers(-6, 6)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 4).flatmap(lambda w: st.tuples(
    st.lists(st.lists(SMALL, min_size=w, max_size=w), min_size=1, max_size=20),
    st.lists(st.lists(SMALL, min_size=w, max_size=w), min_size=1, max_size=20))))
def test_search_is_exact(case):
    parts, book = (np.array(c, np.int64) for c in case)
    index, distance = V.nearest_entries(parts, book)
    for x, i, d in zip(parts, index, distance, strict=True):
        off = [(int(((x - c) ** 2).sum()), k) for k, c in enumerate(book)]
        assert (d, i) == min(off)


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(k, [math.floor(256 * x) for x in v], g) for k, v, g in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * size:(p + 1) * size]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for _, v, _ in kept:
                mine[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            for e, own in mine.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(
        str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [[nearest(cut(v, p), books[p]) for p in range(parts)] for _, v, _ in kept]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = defaultdict(int)
    for (_, _, g), error in zip(kept, errors, strict=True):
        by_label[g] += error
    return sorted((str(k), "".join(f"{e:02x}" for _, e in f), error, by_label[g], sha)
                  for (k, _, g), f, error in zip(kept, found, errors, strict=True))


def rows_of(n, width=32, seed=3):
    rng = np.random.default_rng(seed)
    vectors = np.round(rng.standard_normal((n, width)) * rng.choice([0.02, 1.0], (n, 1)), 2)
    vectors[::5] = vectors[0]
    return [(i if i % 7 else i // 2, v.tolist(), None if i % 3 == 0 else i % 4)
            for i, v in enumerate(vectors)]


SCHEMA = "vec_id bigint, embedding array<double>, label int"


@pytest.mark.parametrize("few_labels", [True, False])
def test_codes_match_brute_force(spark, monkeypatch, few_labels):
    if not few_labels:
        monkeypatch.setattr(V, "BROADCAST_LABELS", 0)
        monkeypatch.setattr(V, "FREQUENT", 60)
    nan = float("nan")
    rows = rows_of(300) + [(901, None, 1), (902, [nan] * 32, 1), (903, [None] * 32, 2),
                           (904, [float("inf")] * 32, 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 7):
        got = V.compress(frame.repartition(parts)).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows)


def test_few_vectors_and_wide_codes(spark):
    rows = rows_of(10)
    got = V.compress(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows)
    model = V.learn(spark.createDataFrame(rows_of(400), SCHEMA), 4, 300, 1)
    codes = V.encode(spark.createDataFrame(rows_of(400), SCHEMA), model)
    assert {len(r.code) for r in codes.collect()} == {12}
    back = V.decode(codes.where("vec_id = 1"), model).first()
    assert len(back["vector"]) == 32


def test_decoding_is_as_near_as_the_error_says(spark):
    rows = rows_of(300)
    frame = spark.createDataFrame(rows, SCHEMA)
    model = V.learn(frame, 8, 32, 2)
    for r in V.decode(V.encode(frame.where("vec_id = 30"), model), model).collect():
        own = [v for k, v, _ in rows if k == 30]
        off = [sum((math.floor(256 * a) - math.floor(256 * b)) ** 2
                   for a, b in zip(v, r["vector"], strict=True)) for v in own]
        assert r["error"] in off


def test_odd_rows(spark):
    rows = rows_of(20) + [(50, [1.0] * 30, 9), (51, [], 9), (52, [1e9] * 32, 9), (None, [0.5] * 32, 8)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1 AS kept", "'x' AS vector", "2 AS error", "3 AS code")
    found = V.compress(frame).collect()
    got = {r.vec_id: r for r in found}
    for key in (50, 51, 52):
        assert (got[key].code, got[key].error, got[key].label_error) == (None, None, None)
    assert len(got[None].code) == 32
    want = brute([r for r in rows if r[0] not in (50, 51, 52)])
    assert sorted((str(r.vec_id), r.code) for r in found if r.code) == [w[:2] for w in want]
    assert V.compress(frame.limit(0)).count() == 0
    nothing = V.compress(frame.where("vec_id BETWEEN 50 AND 51")).collect()
    assert [(r.code, r.error) for r in nothing] == [(None, None)] * 2
