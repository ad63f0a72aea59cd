"""Near duplicates against brute force over all pairs."""

import re

import pytest
from pyspark.sql import functions as F

from tabscout.llm import jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(text)
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    pairs = {(i, j) for m in index.values() for i in m for j in m if i < j}
    for i, j in pairs:
        common = len(sets[i] & sets[j])
        if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        known = [n for n in (least.get(find(i)), name) if n is not None]
        least[find(i)] = min(known, default=None)
    return sorted(((n, len(sets[i]), least[find(i)] if sets[i] else n, links[i])
                   for i, (n, _) in enumerate(rows)), key=str)


def check(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(
        {"n": F.lit("x"), "sig": F.lit(0), "rep": F.lit(1)}).repartition(3)
    got = jaccard_join.near_duplicates(docs, **kw).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=str) == \
        brute(rows, kw.get("percent", 80))


def test_given_documents(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(
        f"{data}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def family(rng, base, n, share):
    for _ in range(n):
        w = list(base)
        for i in rng.sample(range(len(w)), int(share * len(w))):
            w[i] = f"w{rng.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("block", [768, 7])
def test_families_ties_and_odd_rows(spark, monkeypatch, block):
    import random
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    rng = random.Random(5)
    texts = []
    for size, share in [(60, .02), (60, .04), (200, .03), (12, .08), (30, .01)]:
        base = [f"b{rng.randrange(400)}" for _ in range(size)]
        texts += family(rng, base, 25, share)
    line = " ".join(f"c{i}" for i in range(40))
    texts += [line + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(8)) for _ in range(20)]
    texts += [None, "", " \n\t", "One", "one", "a b c d", "a b c d e", "A\tB\nC d  e", "x y",
              "word " * 5000, "word " * 7]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(7, texts[0]), (7, "fresh text"), (None, texts[1])]
    check(spark, rows)


def test_few_long_texts_in_many_blocks(spark, monkeypatch):
    """Blocks are cut by shingles too, and some of a small cluster's hold nobody."""
    import random
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 300)
    rng = random.Random(9)
    texts = []
    for k, n in enumerate((2, 2, 2, 3, 3, 4)):
        texts += family(rng, [f"d{k}.{i}" for i in range(700)], n, .005)
    check(spark, list(enumerate(texts)))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard_join.near_duplicates(none).count() == 0
