"""Piecewise encoding equals whole encoding; wavelet index and packing against brute force."""

import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tabscout.llm import packing, wavelet  # noqa: E402
from tabscout.llm.tokens import PieceEncoder  # noqa: E402

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\nb", "a.\n\nB c", "it's we'll x'S",
    "Éé öä́ éx", "x²y 12a3 a_b", "<|endoftext|> a<|endoftext|>b", "\x1ca\x1c b",
    "a b   c", "T.\nHe said,\n\tok ", "e ́ \U0001f600 !!?? a!b", "of the of the " * 40,
]


@pytest.mark.parametrize("path,drops", [(WORD, True), (BYTE, False)])
def test_pieces_equal_whole(path, drops):
    whole, pieces = Tokenizer.from_file(path), PieceEncoder(path, 2, drops, most=5, most_parts=3)
    whole.encode_special_tokens = True

    def same(texts):
        want = [array("I", whole.encode(t, add_special_tokens=False).ids + [2]).tobytes()
                for t in texts]
        assert pieces.encode(texts) == want

    same(TEXTS)
    same(TEXTS[::-1])
    alphabet = st.sampled_from(list("abÀz  \n\t.,'s1²_́<|>\x85"))

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.lists(st.text(alphabet, max_size=30), min_size=1, max_size=4))
    def holds(texts):
        same(texts)

    holds()


@settings(max_examples=60, deadline=None, database=None)
@given(st.lists(st.integers(0, 40), max_size=80), st.integers(0, 63))
def test_wavelet_matrix(values, probe):
    zeros, planes = wavelet.build(np.array(values, np.uint16), 6)
    m = wavelet.WaveletMatrix(len(values), zeros, planes)
    assert m.values().tolist() == values
    assert [m.access(i) for i in range(len(values))] == values
    places = [i for i, v in enumerate(values) if v == probe]
    assert m.positions(probe).tolist() == places and m.count(probe) == len(places)
    assert [m.select(probe, k) for k in range(len(places))] == places
    assert [m.rank(probe, i) for i in range(len(values) + 1)] == [
        values[:i].count(probe) for i in range(len(values) + 1)]


def test_ids_beyond_the_width_and_places_beyond_the_count():
    with pytest.raises(ValueError, match="70000"):
        wavelet._pack(np.array([5, 70_000], np.uint32), [1], [2], 16)
    zeros, planes = wavelet.build(np.array([3, 1, 3], np.uint16), 4)
    m = wavelet.WaveletMatrix(3, zeros, planes)
    assert [m.select(3, k) for k in (0, 1)] == [0, 2]
    for value, k in ((3, 2), (3, -1), (2, 0), (99, 0), (-1, 0)):
        with pytest.raises(IndexError):
            m.select(value, k)


ROWS = [(7, "The cat sat."), (3, None), (1, "the of the of"), (9, ""), (7, "again"), (None, "x y"),
        (12, "word " * 3000)]


def test_index_round_trip(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").selectExpr(
        "*", "'x' AS part", "0 AS start", "text AS planes").repartition(3)
    path = wavelet.write_index(docs, WORD, block_tokens=8)
    tok = Tokenizer.from_file(WORD)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    ids_of = {}
    for name, text in order:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((name, start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
        ids_of.setdefault(name, []).extend([ids])
    got = [tuple(r) for r in wavelet.documents_of(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    the = tok.encode("the", add_special_tokens=False).ids[0]
    places = Counter((n, i) for n, docs in ids_of.items() for ids in docs
                     for i, t in enumerate(ids) if t == the)
    assert Counter(tuple(r) for r in wavelet.occurrences(spark, path, the).collect()) == places
    assert sum(r["n"] for r in wavelet.token_counts(spark, path, the).collect()) == sum(
        places.values())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert wavelet.documents_of(spark, wavelet.write_index(none, WORD)).count() == 0
    assert packing.pack_documents(none, BYTE).count() == 0


@pytest.mark.parametrize("group_items", [50_000, 3])
def test_packing(spark, group_items):
    rows = [*ROWS, *[(100 + i, "abc " * (i % 37)) for i in range(120)]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("id", rows_id())
    got = packing.pack_documents(docs, BYTE, 64, group_items=group_items).collect()
    tok = Tokenizer.from_file(BYTE)
    want = Counter()
    for name, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        low, high, piece = 0, len(ids) % 64 or min(64, len(ids)), 0
        while low < len(ids):
            part = ids[low:high]
            want[name, piece, low, len(part), zlib.crc32(array("I", part).tobytes())] += 1
            low, high, piece = high, high + 64, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 64) * 1.1 + 1


def rows_id():
    from pyspark.sql import functions as F
    return F.lit("clash")
