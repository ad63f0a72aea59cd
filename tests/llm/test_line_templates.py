"""Template tree: what recurs goes but for its first line; odd rows. SQL checks whole tables."""

from pyspark.sql import functions as F

from tabscout.llm import line_templates


def test_templates_and_odd_rows(spark):
    fixed = "copyright notice of the example press all rights are reserved since {}"
    field = "please click here to read more about {} in our daily newsletter today friend"
    names = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    rows = [(i, f"own line number {n}\n{fixed.format(1990 + i)}\n{field.format(n)}\n\nlast {n}")
            for i, n in enumerate(names)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, "only here"), (24, fixed.format(7)),
             (25, "one short"), (26, "x " * 50_000), (None, fixed.format(1)), (25, "one short")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(
        {"line_no": F.lit("x"), "leaf": F.lit(1), "gone": F.lit(1)}).repartition(3)
    got = line_templates.drop_recurring_lines(docs)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    found = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str)
    # The notice stays in the row without a key, which comes first; the field line in row 0.
    want = [(i, 5, 1 + (i > 0), "\n".join(
        [f"own line number {n}", *([field.format(n)] if i == 0 else []), "", f"last {n}"]))
        for i, n in enumerate(names)]
    want += [(20, 0, 0, None), (21, 1, 0, ""), (22, 3, 0, "\n\n"), (23, 1, 0, "only here"),
             (24, 1, 1, ""), (25, 1, 0, "one short"), (25, 1, 0, "one short"),
             (26, 1, 0, "x " * 50_000), (None, 1, 0, fixed.format(1))]
    assert found == sorted(want, key=str)
    assert line_templates.drop_recurring_lines(docs.limit(0)).count() == 0
