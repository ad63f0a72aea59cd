"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, slices

UNKNOWN = "und"
#: All dictionaries go to every task; labels that need more than this are an error, not a cut.
MODEL_BYTES = 1 << 28
#: So many labelled rows of each language are learned from, whatever the sample gives.
LEAST_ROWS = 16
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-cased words of letters with single spaces between them."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode()


def learn(labelled: DataFrame, dictionary_bytes: int = 1 << 16, key: str = "doc_id",
          text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A raw-content dictionary for each language label.

    The sample is bounded: of each language's labelled rows, in the order of a hash,
    about four dictionaries' worth of text, each text cut at one dictionary's size, and in any
    case the least row of each of `LEAST_ROWS` parts of the hash's range, so a language of a few
    long texts has its dictionary too. Rows with a null label or text or without a letter up to the
    cut are not used, equal rows count once. More labels than fit ``MODEL_BYTES`` are an error. The driver gets some dictionaries' worth of text per
    language, never more.
    """
    rows = labelled.select(
        F.xxhash64(key, text).alias("order"),
        F.substring(text, 1, dictionary_bytes).alias("text"), F.col(lang).alias("lang")
    ).where(F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}")))
    sizes, kept = {}, []
    for r in rows.groupBy("lang", F.pmod("order", F.lit(LEAST_ROWS)).alias("part")).agg(
            F.sum(F.least(F.octet_length("text"), F.lit(dictionary_bytes))).alias("n"),
            F.min("order").alias("least")).collect():
        sizes[r["lang"]] = sizes.get(r["lang"], 0) + r["n"]
        kept.append(r["least"])
    if not sizes:
        return {}
    if len(sizes) * dictionary_bytes > MODEL_BYTES:
        raise ValueError(f"{len(sizes)} labels; are these languages?")
    # A share of the hash's range for each language.
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (
        name, min(1.0, 4 * dictionary_bytes / max(n, 1)))])[F.col("lang")]
    place = F.pmod("order", F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where((place < share) | F.col("order").isin(kept)).groupBy("lang", "order").agg(
        F.first("text").alias("text")).select(
        "lang", F.struct(place.alias("place"), "text").alias("item"))
    model = {}
    for r in sample.groupBy("lang").agg(
            F.array_sort(F.collect_list("item")).alias("items")).collect():
        content = b" ".join(letters(i["text"]) for i in r["items"])[:dictionary_bytes]
        if content:
            # No dictionary is shorter than 8 bytes.
            model[r["lang"]] = content.rjust(8)
    return model


def classify(docs: DataFrame, model: dict[str, bytes], text: str = "text", level: int = 6,
             block: int = 4096, min_margin: float = 0.003,
             keep: tuple[str, ...] = ("*",), with_text: bool = False) -> DataFrame:
    """(row, lang_pred, score, rejected[, text]) for every row; ``row`` is a struct of the
    columns in ``keep``, all by default. A text that is wanted back travels once if it is
    left out of ``keep`` and asked for by ``with_text``.

    The letters of the whole text are compressed in blocks with each language's dictionary;
    the smallest total wins, the first name among equals. ``score`` is the saving over the
    second best, from 0 to 1 (1 with a single language); below ``min_margin`` the row is rejected.
    A text that is null or has no letter, or an empty model, gives `und`, score 0, rejected.
    """
    names = sorted(model)

    def work(batches):
        import zstandard

        presses = []
        for name in names:
            content = zstandard.ZstdCompressionDict(
                model[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            presses.append(zstandard.ZstdCompressor(
                level=level, dict_data=content, write_content_size=False))

        def judge(value):
            if not value or not names or not any(map(str.isalpha, value)):
                return UNKNOWN, 0.0, True
            data = letters(value)
            blocks = [data[i:i + block] for i in range(0, len(data), block)]
            sizes = [sum(len(p.compress(b)) for b in blocks) for p in presses]
            order = sorted(range(len(names)), key=sizes.__getitem__)
            best = sizes[order[0]]
            score = (sizes[order[1]] - best) / sizes[order[1]] if len(order) > 1 else 1.0
            return names[order[0]], score, score < min_margin

        for batch in slices(batches, "text", 2 << 20):
            found = [judge(t) for t in batch.column("text").to_pylist()]
            names_out = ["row", "lang_pred", "score", "rejected"] + ["text"] * with_text
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[2] for f in found], pa.bool_()),
                *([batch.column("text")] if with_text else [])], names=names_out)

    nested = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
    schema = T.StructType([
        nested.schema["row"], T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
        *([nested.schema["text"]] if with_text else [])])
    return in_batches(nested, work, schema)


def held_out(key):
    """Rows that no dictionary may learn from: a fifth of all, by a checksum of the id."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text",
             lang: str = "lang", **options) -> DataFrame:
    """Learn from the rows that are not held out and have a key, and classify all rows."""
    model = learn(docs.where(F.col(key).isNotNull() & ~held_out(F.col(key))),
                  key=key, text=text, lang=lang)
    return classify(docs, model, text, **options)
