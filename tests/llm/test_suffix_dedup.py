"""Removed bytes against brute force over all windows; merging of front-coded runs."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabscout.llm import suffix_dedup


def brute(rows, length=100):
    """rows: distinct (key, text), any order."""
    seen, out = set(), {}
    for name, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i:i + length]
            if window in seen:
                gone[i:i + length] = b"\x01" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[name] = (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(
        {"row": F.lit(1), "mark": F.lit("x"), "marks": F.lit(2)}).repartition(parts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in suffix_dedup.remove_repeats(docs).drop("kept").collect()}
    want = brute(rows)
    assert {k: v for k, v in got.items() if v != want[k]} == {} and len(got) == len(want)


def test_given_documents(spark, data):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(
        f"{data}/documents.parquet").select("doc_id", "text").collect()])


@pytest.mark.parametrize("slice_bytes", [1 << 20, 700])
def test_edges_ties_and_odd_texts(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(suffix_dedup, "SLICE", slice_bytes)
    rng = random.Random(9)
    letters = lambda n, a="abcdefghij é": "".join(rng.choice(a) for _ in range(n))
    passage, texts = letters(260), []
    for n in (99, 100, 101, 130, 260):
        for _ in range(4):
            at = rng.randrange(0, 260 - min(n, 250))
            texts.append(letters(rng.randrange(150)) + passage[at:at + n] + letters(rng.randrange(150)))
    texts += ["a" * 500, "a" * 99, "a" * 100, "ab" * 300, "", None, "é" * 120, passage * 3,
              letters(4000, "ab"), passage[:100], passage, passage, letters(30) + passage]
    rows = [(i * 2, t) for i, t in enumerate(texts)] + [(None, passage[50:170])]
    check(spark, rows)


def test_repeated_rows_and_empty(spark):
    text = "".join(random.Random(1).choices("abcdef", k=300))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id bigint, text string")
    got = suffix_dedup.remove_repeats(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 300)]
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


@settings(max_examples=100, deadline=None, database=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=8),
                min_size=1, max_size=5))
def test_merge_of_front_coded_runs(runs):
    runs = [sorted(r) for r in runs]
    iterators = [((s, n, s) for s, n in suffix_dedup.unfolded(*suffix_dedup.front_coded(r))) for r in runs]
    got, before = list(suffix_dedup.merge_runs(iterators)), b""
    assert [g[0] for g in got] == sorted(s for r in runs for s in r)
    for string, shared, payload in got:
        n = 0
        while n < min(len(string), len(before)) and string[n] == before[n]:
            n += 1
        assert string == payload and shared == n
        before = string


@pytest.mark.parametrize("many", [3, 40])
def test_one_passage_in_many_contexts(spark, monkeypatch, many):
    """More contexts than a task merges: windows are settled by their digests."""
    monkeypatch.setattr(suffix_dedup, "MANY_CONTEXTS", many)
    monkeypatch.setattr(suffix_dedup, "SLICE", 3000)
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, other = letters(150), letters(180)
    rows = [(None, letters(60) + passage + letters(40))]
    for i in range(120):
        cut = rng.randrange(0, 60)
        rows.append((i, letters(rng.randrange(90)) + passage[cut:] + letters(rng.randrange(90))))
        if i % 10 == 0:
            rows.append((500 + i, letters(30) + other + letters(30) + passage))
    check(spark, rows, 5)


def test_texts_are_dealt_once_for_few_and_many_contexts(spark, monkeypatch, tmp_path):
    """Only the first pass reads the texts before the query of the result does."""
    monkeypatch.setattr(suffix_dedup, "MANY_CONTEXTS", 3)
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, stored, reads = letters(150), suffix_dedup.materialise, []
    rows = [(i, letters(50) + passage + letters(50)) for i in range(30)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/docs")

    def watched(df):
        reads.append(any("/docs/" in f for f in df.inputFiles()))
        return stored(df)

    monkeypatch.setattr(suffix_dedup, "materialise", watched)
    docs = spark.read.parquet(f"{tmp_path}/docs")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {k: v[1] for k, v in brute(rows).items()} and sum(got.values()) >= 29 * 150
    assert reads == [True, False]
