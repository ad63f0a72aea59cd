"""The corpus pipeline: from documents to packed training sequences in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the
last return the columns of `documents`. Nulls may stand in any column and rows may repeat or share
an id: rows are told apart by a row id made for a stage's input, never joined by `doc_id`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscout.llm import decontaminate, jaccard_join, language, line_templates, packing
from tabscout.session import materialise

ROW = "row_id"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs):
    """The rows with a row id, stored so that it is the same for all who read it."""
    return materialise(docs.select(*COLUMNS, F.monotonically_increasing_id().alias(ROW)))


def identify_language(spark, docs, sf_dir):
    """Keeps the documents whose language is clear; the label becomes the prediction.

    Dictionaries are learned from labelled documents that are not held out. Documents without
    a letter and those between two languages go.
    """
    found = language.identify(
        docs.select(*COLUMNS), keep=("doc_id", "source", "n_chars"), with_text=True)
    return found.where("NOT rejected").select(
        "row.doc_id", "text", F.col("lang_pred").alias("lang"), "row.source", "row.n_chars")


def drop_repeated_lines(spark, docs, sf_dir):
    """Drops all but the first line of each template that recurs across documents.

    A document that loses every line goes; the count of characters follows the text.
    """
    kept = line_templates.drop_recurring_lines(docs, keep=("lang", "source"))
    return kept.where("n_dropped = 0 OR n_dropped < n_lines").select(
        "doc_id", "text", "kept.lang", "kept.source", F.length("text").cast("long").alias("n_chars"))


def keep_one_of_each_group(spark, docs, sf_dir):
    """Of each component of near-duplicate documents one row with the least id stays.

    Repeated rows are a component too; null ids come last. Documents without a word stay.
    """
    rows = _numbered(docs)
    groups = materialise(jaccard_join.near_duplicates(rows, key=ROW).select(
        F.col("doc_id").alias(ROW), "component_id"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW)
    first = groups.join(rows.select("doc_id", ROW), ROW).groupBy("component_id").agg(
        F.min(order).alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    gone = materialise(groups.select(ROW).join(first, ROW, "left_anti"))
    return rows.join(gone, ROW, "left_anti").select(*COLUMNS)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that leak an item of the benchmark go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _numbered(docs)
    leaked = materialise(decontaminate.leaks(rows, items, key=ROW).select(
        F.col("doc_id").alias(ROW)).distinct())
    return rows.join(leaked, ROW, "left_anti").select(*COLUMNS)


def pack_sequences(spark, docs, sf_dir):
    """Token pieces of the remaining documents, placed in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]
#: No SQL: compression and tokenizers are beyond it. Tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
