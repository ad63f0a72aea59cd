"""Compression classification: held-out accuracy, rejections and odd rows."""

import re

import pytest
import zstandard
from pyspark.sql import functions as F

from tabscout.llm import language, queries


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = queries.op4(spark, data)
    assert found.count() == docs.count()
    fair = found.join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where(
        "held_out AND n_chars > 100")
    right, total = fair.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert total > 20 and right / total > 0.95
    assert found.where("score < 0 OR score > 1 OR lang_pred IS NULL").count() == 0


def test_odd_rows(spark):
    rows = [(i, "der die das und nicht " * 30 if i % 2 else "the of and that with " * 30,
             "de" if i % 2 else "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    odd = spark.createDataFrame(
        [(1, None, None), (2, "", "en"), (3, "12 !! ²½", "de"), (4, "und nicht die der das " * 9000, None),
         (4, "the and of that " * 20, "xx"), (None, "the with of and " * 20, None)],
        "doc_id bigint, text string, lang string").withColumns(
            {"row": F.lit(1), "score": F.lit("clash"), "lang_pred": F.lit(2)})
    model = language.learn(docs)
    assert set(model) == {"en", "de"}
    got = language.classify(odd, model).select("row.doc_id", "lang_pred", "score", "rejected")
    assert sorted((r.doc_id or 0, r.lang_pred, r.rejected) for r in got.collect()) == [
        (0, "en", False), (1, "und", True), (2, "und", True), (3, "und", True),
        (4, "de", False), (4, "en", False)]
    assert language.learn(odd.limit(0)) == {}
    assert language.classify(odd, {}).where("lang_pred <> 'und'").count() == 0
    assert language.classify(odd.limit(0), model).count() == 0


def test_few_very_long_texts(spark):
    """A label of a few very long texts, one of a single word, and one of many equal rows."""
    rows = [(i, "the of and that with " * 30, "en") for i in range(400)]
    rows += [(1000 + i, "der die das und nicht " * (100_000 if i == 0 else 40_000), "de") for i in range(3)]
    rows += [(2000, "abc", "xx"), (2001, "12 34", "yy"), (2002, None, "zz")]
    rows += [(3000, "le la et les pour " * 50, "fr")] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.learn(docs, dictionary_bytes=1 << 10)
    assert set(model) == {"en", "de", "xx", "fr"}
    assert len(model["de"]) == 1 << 10 and all(len(m) <= 1 << 10 for m in model.values())
    texts = docs.where("doc_id IN (0, 1000, 3000)").distinct()
    got = language.classify(texts, model).select("row.lang", "lang_pred", "rejected").collect()
    assert [(r.lang_pred, r.rejected) for r in got] == [(r.lang, False) for r in got]


def test_every_text_compressed_by_itself(spark, data, monkeypatch):
    """Label, score and rejection against plain compression, text by text and block by block."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    model = language.learn(docs.where("doc_id % 3 = 0"))
    got = {r["doc_id"]: r for r in language.classify(docs, model, keep=("doc_id",)).select(
        "row.doc_id", "lang_pred", "score", "rejected").collect()}
    for r in docs.collect():
        words = re.sub(r"[^a-zà-ÿ]+", " ", (r["text"] or "").lower())
        if not words.strip():
            continue
        content = language.letters(r["text"])
        sizes = []
        for name, dictionary in sorted(model.items()):
            press = zstandard.ZstdCompressor(level=6, write_content_size=False, dict_data=(
                zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)))
            sizes.append((sum(len(press.compress(content[i:i + 4096]))
                              for i in range(0, len(content), 4096)), name))
        sizes.sort()
        score = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        row = got[r["doc_id"]]
        assert (row["lang_pred"], row["rejected"]) == (sizes[0][1], score < 0.003)
        assert row["score"] == pytest.approx(score)
    monkeypatch.setattr(language, "MODEL_BYTES", 1 << 16)
    with pytest.raises(ValueError, match="labels"):
        language.learn(docs)


def test_rows_without_an_id_teach_nothing(spark, tmp_path):
    rows = [(None, "qqq www zzz kkk " * 40, "odd")] * 30 + [
        (i, "the of and that with " * 30, "en") for i in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1).write.parquet(
        f"{tmp_path}/documents.parquet")
    found = queries.op4(spark, str(tmp_path))
    assert {r["lang_pred"] for r in found.select("lang_pred").distinct().collect()} == {"en"}
    assert found.where("doc_id IS NULL AND held_out").count() == 0
