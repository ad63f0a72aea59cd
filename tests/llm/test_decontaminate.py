"""Leaks against brute force, paraphrases, the subsequence length, and odd rows."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabscout.llm import decontaminate


@settings(max_examples=100, deadline=None, database=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=30), st.lists(st.integers(0, 5), max_size=30))
def test_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    masks = decontaminate._masks(np.array(a))
    assert decontaminate.common_subsequence(masks, len(a), np.array(b, np.int64)) == best[-1][-1]


def plain(text):
    return " " + " ".join(re.sub(r"[\W_]+", " ", (text or "").lower()).split()) + " "


def test_verbatim_recall(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    asked = [(r.item_id, plain(r.text)) for r in items.collect()]
    want = {(d.doc_id, i) for d in docs.collect() for i, t in asked if t in plain(d.text)}
    assert want and len(want & got) >= 0.9 * len(want)
    # Nothing but near-complete matches besides.
    assert len(got - want) <= 0.05 * len(want)


def test_paraphrases_and_odd_rows(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    item = [word() for _ in range(30)] + ["so."] + [word() for _ in range(9)]
    filler = lambda n: " ".join(word() for _ in range(n))
    light = [w if i % 8 else word() for i, w in enumerate(item)]
    medium = [word() if i < 31 and i % 3 == 0 else w for i, w in enumerate(item)]
    other = [word() if i % 2 else w for i, w in enumerate(item)]
    text = lambda w: f"{filler(400)} {' '.join(w)} {filler(300)}"
    rows = [(1, text(item)), (2, text(light)), (3, text(medium)), (4, text(other)), (5, filler(900)),
            (6, None), (7, ""), (8, text(item).upper()), (8, text(item)), (None, text(item)),
            (9, filler(60_000) + " " + " ".join(item)), (10, " ".join(item))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(
        {"item_id": F.lit("x"), "match": F.lit(0)})
    items = spark.createDataFrame(
        [(70, " ".join(item)), (71, None), (72, ""), (70, " ".join(item)), (73, filler(20))],
        "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    got = sorted((r.doc_id or 0, r.item_id) for r in decontaminate.leaks(docs, items).collect())
    once = [(0, 70), (1, 70), (2, 70), (3, 70), (8, 70), (8, 70), (9, 70), (10, 70)]
    assert got == sorted(once * 2)
    assert decontaminate.leaks(docs.limit(0), items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_copies_of_short_and_long_items(spark):
    """Verbatim and 80 % copies of items of many lengths, against the sequence rule on all pairs."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    filler = lambda n: [word() for _ in range(n)]
    items = {n * 10 + k: filler(n) for n in (5, 48, 80, 100, 200, 400) for k in range(3)}
    # Foreign passages share words with items too.
    known = [w for i in items.values() for w in i]
    noise = lambda n: [rng.choice(known) if rng.random() < 0.2 else word() for _ in range(n)]
    rows = {}
    for item in items.values():
        gone = set(rng.sample(range(len(item)), len(item) // 5))
        for copy in (item, [word() if i in gone else w for i, w in enumerate(item)]):
            for before in (0, 7, 300 + rng.randrange(16)):
                rows[len(rows)] = noise(before) + copy + noise(before and 200)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows.items()], "doc_id bigint, text string")
    asked = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, asked).collect()}
    number = {w: i for i, w in enumerate({w for t in [*rows.values(), *items.values()] for w in t})}
    want = set()
    for i, item in items.items():
        masks = decontaminate._masks(np.array([number[w] for w in item]))
        for d, text in rows.items():
            found = decontaminate.common_subsequence(masks, len(item), np.array([number[w] for w in text]))
            if found >= 0.8 * len(item):
                want.add((d, i))
    assert len(want) >= len(rows) and got >= want
    # Besides, only what has a whole answer and most of the item's words.
    assert len(got - want) <= 0.05 * len(want)


def test_only_spans_that_hold_enough_of_an_item_are_aligned(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tabscout.llm import decontaminate as D

    rng = np.random.default_rng(5)
    # The items share words with every text, but none holds two thirds of an item but the copy.
    rows = [(j, " ".join(f"w{x}" for x in rng.integers(0, 400, 30))) for j in range(20)]
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, 300)) for _ in range(40)]
    texts[7] += " " + rows[3][1]
    queries = D.queries_of(rows)
    parts = [queries.features(D.words([t.encode()], True)[0]).astype(np.int32) for t in texts]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(40), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
        names=["doc_id", "words"])
    aligned, real = [], D.common_subsequence
    monkeypatch.setattr(D, "in_batches", lambda docs, work, schema: work)
    monkeypatch.setattr(D, "common_subsequence", lambda *a: aligned.append(a) or real(*a))
    idf = np.append(np.ones(len(queries.vocabulary), np.float32), np.float32(0))
    basis = np.eye(len(idf), dtype=np.float32)
    (found,) = D._search(None, queries, idf, basis, 0.1, 0.8, 0.65)([batch])
    assert list(zip(*(c.to_pylist() for c in found.columns), strict=True)) == [(7, 3, 1.0, 1.0)]
    assert len(aligned) < 60

    # The bound is never less than the alignment.
    at = np.concatenate(parts)
    items = [queries.features(i) for i in queries.items]
    item = rng.integers(0, 20, 500)
    low = rng.integers(0, len(at) - 120, 500)
    high = low + rng.integers(0, 120, 500)
    bound = D.most_common([np.unique(i, return_counts=True) for i in items], at, item, low, high)
    exact = [real(D._masks(items[j]), 30, at[a:b]) for j, a, b in zip(item, low, high, strict=True)]
    assert (bound >= exact).all() and (bound <= 30).all()
