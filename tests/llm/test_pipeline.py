"""The pipeline's stages, each against a plain rule on its own input."""

import random
import re

import duckdb
from test_jaccard_join import brute

import corpus_pipeline as pipeline
from tabscout.llm.queries import OP3_SQL
from tabscout.session import materialise


def plain(text):
    return " " + " ".join(re.sub(r"[\W_]+", " ", text.lower()).split()) + " "


def test_stages(spark, data, tmp_path):
    kept = [spark.read.parquet(f"{data}/documents.parquet")]
    for _, stage in pipeline.STAGES:
        kept.append(materialise(stage(spark, kept[-1], data)))
    docs, language, lines, near, clean, packed = kept
    for frame in kept[:-1]:
        assert frame.columns == pipeline.COLUMNS and frame.where("length(text) <> n_chars").count() == 0
    assert language.count() >= 0.97 * docs.count()
    assert language.join(docs, ["doc_id", "text", "source"]).count() == language.count()

    language.coalesce(1).write.parquet(str(tmp_path / "docs"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/docs/*.parquet'")
    want = {d: t for d, n, gone, t in con.sql(OP3_SQL).fetchall() if not gone or gone < n}
    assert {r.doc_id: r.text for r in lines.collect()} == want

    groups = brute([(r.doc_id, r.text) for r in lines.collect()])
    assert {r.doc_id for r in near.collect()} == {d for d, _, c, _ in groups if d == c}

    items = [plain(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    leaking = {r.doc_id for r in near.collect() if any(i in plain(r.text) for i in items)}
    left = {r.doc_id for r in clean.collect()}
    before = {r.doc_id for r in near.collect()}
    assert leaking and len(leaking & left) <= 0.1 * len(leaking)
    assert len(before - left - leaking) <= 0.02 * len(before)

    ends = packed.selectExpr("sequence_id", "offset + length AS e").groupBy("sequence_id").max("e")
    assert {r.doc_id for r in packed.collect()} == left
    assert ends.where("`max(e)` > 1024").count() == 0
    again = pipeline.run(spark, data)
    assert again.select("doc_id", "piece", "ids_crc32").exceptAll(
        packed.select("doc_id", "piece", "ids_crc32")).count() == 0


def test_null_and_repeated_ids(spark, data):
    """No stage loses or multiplies rows whose ids are null or shared."""
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    one, two, three, four, five = (text(60) for _ in range(5))
    rows = [(None, one, "en", None, 1), (None, two, None, "web", None),  # different rows without an id
            (5, three, "en", "a", 1), (5, four, "de", "b", 2),  # one id, two texts
            (7, five, "en", "a", 3), (7, five, "en", "a", 3), (None, five, "en", "a", 3), (9, five, None, None, 3),
            (8, "", "en", "a", 0), (8, "", "en", "a", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    shown = lambda frame: sorted(map(str, (tuple(r)[:4] for r in frame.collect())))
    whole = sorted(str(r[:4]) for r in rows)
    assert shown(pipeline.drop_repeated_lines(spark, docs, data)) == whole
    near = pipeline.keep_one_of_each_group(spark, docs, data)
    assert shown(near) == sorted(str(r[:4]) for r in [*rows[:5], *rows[8:]])

    item = spark.read.parquet(f"{data}/benchmark.parquet").where("length(text) > 80").first().text
    bad = [(None, f"{one} {item} {two}", "en", "a", 1), (5, item, "en", "a", 1), (5, item, "en", "a", 1)]
    leaky = spark.createDataFrame([*rows, *bad], docs.schema)
    assert shown(pipeline.drop_contaminated(spark, leaky, data)) == whole

    plain_text = spark.createDataFrame([(None, "the of and that with " * 30, "en", None, 5)] * 2 + [
        (i, "der die das und nicht " * 30, "de", "a", 5) for i in (1, 2, 2, 3, 4, 6, None)], docs.schema)
    assert pipeline.identify_language(spark, plain_text, data).count() == 9
    packed = pipeline.pack_sequences(spark, docs, data)
    assert packed.where("piece = 0").count() >= 8


def test_every_task_gives_freed_memory_back(spark):
    """Tasks that free 200 MB in small blocks leave a worker as small as it was."""
    import numpy as np
    import pyarrow as pa

    from tabscout.llm.common import in_batches

    def work(batches):
        for batch in batches:
            blocks = [np.ones(8000, np.uint8) for _ in range(25_000)]
            kept = blocks[-1].copy()
            del blocks
            yield pa.RecordBatch.from_arrays([pa.array([len(kept)] * batch.num_rows, pa.int64())], ["n"])

    def size(batches):
        list(batches)
        with open("/proc/self/smaps_rollup") as file:
            held = sum(int(x.split()[1]) for x in file if x.startswith("Pss_Anon"))
        yield pa.RecordBatch.from_arrays([pa.array([held // 1024], pa.int64())], ["mb"])

    one = spark.range(4).coalesce(1)
    assert in_batches(one, work, "n bigint").collect()
    assert one.mapInArrow(size, "mb bigint").first().mb < 150
