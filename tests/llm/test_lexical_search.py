"""Rankings against scoring every document in plain integers; pruning, blocks, odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tabscout.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, most=50):
    counted = [(k, Counter(plain_terms(t))) for k, t in docs]
    n_docs = sum(bool(c) for _, c in counted)
    n_terms = sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in counted:
            m = 50 + (50 * c.total() * n_docs) // n_terms if n_terms else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if t in c)
            if score > 0:
                scored.append((-score, key is None, key, score))
        for rank, (_, _, key, score) in enumerate(sorted(
                scored, key=lambda s: (s[0], s[1], s[2] or 0))[:most], 1):
            out.append((str(item), rank, str(key), score))
    return sorted(out)


def corpus(n=400, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    docs = []
    for i in range(n):
        text = " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))
        docs.append((i, text.upper() if i % 9 == 0 else text))
    docs += [(1000 + i, docs[7][1]) for i in range(80)] + [(3, docs[7][1]), (None, docs[7][1])]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(30)]
    return docs, items + [(5, docs[7][1]), (6, None), (7, "unheard of"), (None, "w1 W1, w2")]


@pytest.mark.parametrize("how", ["plain", "segments", "all terms", "blocks"])
def test_ranking_matches_brute_force(spark, monkeypatch, how):
    if how == "segments":
        monkeypatch.setattr(L, "SEGMENT_BYTES", 700)
    if how == "all terms":
        monkeypatch.setattr(L, "VOCABULARY_BYTES", 0)
    if how == "blocks":
        monkeypatch.setattr(L, "BLOCK_TERMS", 60)
    docs, items = corpus()
    documents = spark.createDataFrame(docs, "doc_id bigint, text string")
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    for parts in (1, 5):
        found = L.search(documents.repartition(parts), asked, most=20).collect()
        assert sorted((str(a), b, str(c), d) for a, b, c, d in found) == brute(docs, items, 20)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 9)), min_size=1, max_size=15,
                         unique_by=lambda p: p[0]), min_size=1, max_size=6),
       st.integers(1, 5), st.integers(1, 12))
def test_no_document_of_the_best_is_lost(lists, most, least):
    starts = np.cumsum([0, *map(len, lists)])
    docs = np.array([d for postings in lists for d, _ in postings])
    gains = np.array([g for postings in lists for _, g in postings])
    bounds = np.maximum.reduceat(gains, starts[:-1])
    found, scores = L.search_item(np.arange(len(lists)), starts, docs, gains, bounds, 15, most, least)
    whole = Counter()
    for d, g in zip(docs.tolist(), gains.tolist(), strict=True):
        whole[d] += g
    got = dict(zip(found.tolist(), scores.tolist(), strict=True))
    assert all(whole[d] == s for d, s in got.items())
    top = sorted(((-s, d) for d, s in whole.items() if s >= least))[:most]
    assert sorted((-s, d) for d, s in got.items())[:most] == top


def test_accumulators_are_limited():
    """Once the k-th score is out of reach no document is added, and the sums stay exact."""
    starts, docs = np.array([0, 2, 12]), np.array([0, 1, *range(10)])
    gains = np.array([50, 40, *[5] * 10])
    found, scores = L.search_item(
        np.array([0, 1]), starts, docs, gains, np.array([50, 5]), 10, 2, 1)
    assert found.tolist() == [0, 1] and scores.tolist() == [55, 45]


def test_terms_and_long_texts(monkeypatch):
    monkeypatch.setattr(L, "_PIECE", 5)
    for text in ("Ab-c é9 ÀB\x00z x", "", None, "a" * 40 + " b" * 30, " . "):
        found = [t.decode() for terms in L.terms_in(text) for t in terms]
        assert found == plain_terms(text)


def test_great_lengths_do_not_overflow():
    lengths = np.array([10 ** 9, 3])
    got = L.spread_of(lengths, 10 ** 10, 10 ** 13)
    assert got.tolist() == [50 + 50 * 10 ** 19 // 10 ** 13, 50]


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, "?!"), (None, "a b"), (4, "a b"), (4, "a b"), (5, "b")],
        "doc_id bigint, text string").selectExpr("*", "1 AS `key`", "2 AS item_id", "3 AS terms")
    items = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "zz")],
                                  "item_id bigint, text string").selectExpr("*", "9 AS doc_id", "8 AS item")
    got = sorted((r.item_id, r["rank"], str(r.doc_id)) for r in L.search(docs, items).collect())
    assert got == [(1, 1, "4"), (1, 1, "4"), (1, 2, "4"), (1, 2, "4"), (1, 3, "None"), (1, 3, "None")]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id < 4"), items)):
        empty = L.search(d, i)
        assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]
