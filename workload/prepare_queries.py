"""Cleaning, encoding, imputing, splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscout.operators import prepare as D, split as S
from tabscout.operators.quantiles import exact_quantiles
from tabscout.operators.preprocess import CategoryPrep, NumericPrep, prep_stages
from tabscout.functions.scalars import as_number

from .fixtures import table, with_tables
from .profile_queries import rounded


def d01_drop_empty(spark, d):
    return D.drop_empty_columns(table(spark, d, "dirty"))[0].drop("num_inf")


def d02_drop_constant(spark, d):
    return D.drop_constant_columns(table(spark, d, "dirty"), ["target"])[0].drop("num_inf")


def d03_datetime_to_epoch(spark, d):
    return D.datetimes_to_epoch(table(spark, d, "orders").select("o_orderkey", "o_orderdate"))


def d04_bool_to_number(spark, d):
    return D.bools_to_numbers(table(spark, d, "dirty").select("row_id", "flag"))


def d05_coerce_numbers(spark, d):
    dirty = table(spark, d, "dirty").select("row_id", "numeric_text_96", "numeric_text_90")
    return D.coerce_numbers(dirty, ["numeric_text_96", "numeric_text_90"])


def d06_numeric_text(spark, d):
    dirty = table(spark, d, "dirty").select("row_id", "numeric_text_96", "numeric_text_90")
    return D.convert_numeric_text(dirty)[0]


def d07_category_codes(spark, d):
    return D.category_codes(
        table(spark, d, "dirty").select("row_id", "cat_nulls", "numeric_text_90"),
        ["cat_nulls", "numeric_text_90"])


def d08_infinity_to_missing(spark, d):
    return D.infinity_to_missing(table(spark, d, "dirty").select("row_id", "num_inf"))


def d09_label_codes(spark, d):
    return D.encode_labels(
        table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


def d10_drop_identifiers(spark, d):
    renamed = table(spark, d, "customer").withColumnsRenamed(
        {"c_custkey": "Customer_ID", "c_nationkey": "grid"})
    return D.drop_identifiers(renamed)[0]


def d11_median_impute(spark, d):
    dirty = table(spark, d, "dirty").select("row_id", "num_inf")
    prep = NumericPrep(inputCols=["num_inf"], outputCols=["imputed"], scale=False).fit(dirty)
    return rounded(prep.transform(dirty).select("row_id", "imputed"), 4)


def d11_exact_quantiles(spark, d):
    """Medians by the narrowing passes that large tables take."""
    lineitem = table(spark, d, "lineitem")
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    values = {n: as_number(n, lineitem.schema[n].dataType) for n in names}
    medians = exact_quantiles(lineitem, values, [0.5], small=1000)
    rows = lineitem.agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.select(
        "n_rows", *[F.round(F.lit(medians[n][0]), 4).alias(f"median_{n}") for n in names])


def d12_standard_scale(spark, d):
    lineitem = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    prep = NumericPrep(
        inputCols=["l_extendedprice", "l_discount"], outputCols=["price_z", "discount_z"])
    return rounded(prep.fit(lineitem).transform(lineitem)
                   .select("l_orderkey", "price_z", "discount_z"))


def d13_mode_impute(spark, d):
    dirty = table(spark, d, "dirty").select("row_id", "cat_nulls")
    prep = CategoryPrep(inputCols=["cat_nulls"], outputCols=["onehot"]).fit(dirty)
    return prep.transform(dirty).select("row_id", F.col("onehot_text").alias("imputed"))


def d14_one_hot(spark, d):
    """Long form: each row's hot category position."""
    from pyspark.ml.functions import vector_to_array

    customer = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    prep = CategoryPrep(inputCols=["c_mktsegment"], outputCols=["onehot"]).fit(customer)
    hot = prep.transform(customer).withColumn("cells", vector_to_array("onehot"))
    return hot.select("c_custkey", F.posexplode("cells").alias("position", "value")).select(
        "c_custkey", "position", "value")


def d15_assemble(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    orders = table(spark, d, "orders")
    features = orders.drop("o_orderkey", "o_orderstatus")
    model = Pipeline(stages=prep_stages(features)).fit(orders)
    cells = vector_to_array(F.col("ts_features"))
    return model.transform(orders).select(
        "o_orderkey", F.size(cells).alias("width"),
        F.round(cells[0], 6).alias("first_numeric"), F.round(cells[1], 6).alias("second_numeric"),
        F.aggregate(F.slice(cells, 3, 5), F.lit(0.0), lambda a, x: a + x).alias("hot_cells"))


def d16_unscaled(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    supplier = table(spark, d, "supplier")
    model = Pipeline(stages=prep_stages(supplier.select("s_nationkey", "s_acctbal"),
                                        scale=False)).fit(supplier)
    cells = vector_to_array(F.col("ts_features"))
    return model.transform(supplier).select(
        "s_suppkey", cells[0].alias("nation"), cells[1].alias("balance"))


def d17_prepare_features(spark, d):
    return D.prepare_features(table(spark, d, "dirty"), "target", "row_id")


def e01_stratified_split(spark, d):
    marked = S.mark_holdout(table(spark, d, "orders"), "o_orderstatus", "o_orderkey")
    return marked.select("o_orderkey", "o_orderstatus", "is_test")


def e01_plain_split(spark, d):
    """A target of unique values leaves one stratum."""
    marked = S.mark_holdout(table(spark, d, "customer"), "c_name", "c_custkey")
    return marked.select("c_custkey", "is_test")


def e02_stratified_folds(spark, d):
    return S.stratified_folds(table(spark, d, "orders"), "o_orderstatus", "o_orderkey").select(
        "o_orderkey", "fold")


_CLEAN = """SELECT * FROM dirty WHERE target IS NOT NULL AND target NOT IN ('nan', 'None', '')"""
_NUM = r"'^[+-]?[0-9]+$'"


def split_sql(name, label, key):
    """Window form of the split: quota by largest remainder, rows in hash order."""
    return f"""
    n AS (SELECT CAST({label} AS VARCHAR) AS stratum, count(*) AS n FROM {name} GROUP BY 1),
    s AS (SELECT *, n * CAST(0.2 AS DOUBLE) AS seats FROM n),
    q AS (SELECT *, CAST(floor(seats) AS BIGINT) AS base,
            round(seats - floor(seats), 9) AS rest FROM s),
    quota AS (SELECT stratum, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum)
                <= (SELECT CAST(ceil(round(sum(n) * CAST(0.2 AS DOUBLE), 9)) AS BIGINT) - sum(base) FROM q)
                THEN 1 ELSE 0 END AS quota FROM q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY CAST({label} AS VARCHAR)
                 ORDER BY md5(concat(CAST({key} AS VARCHAR), '|42')), {key}) AS rn FROM {name}),
    split AS (SELECT r.*, r.rn <= q.quota AS is_test FROM ranked r
              JOIN quota q ON q.stratum = CAST(r.{label} AS VARCHAR))
    """


QUERIES = {
    "d01_drop_empty_columns": (d01_drop_empty, with_tables("dirty", sql="""
        SELECT row_id, paid, constant_col, constant_with_nulls, numeric_text_96, numeric_text_90,
               cat_nulls, flag, ts, target FROM dirty""")),
    "d02_drop_constant_columns": (d02_drop_constant, with_tables("dirty", sql="""
        SELECT row_id, paid, numeric_text_96, numeric_text_90, cat_nulls, flag, ts, target
        FROM dirty""")),
    "d03_datetime_to_epoch": (d03_datetime_to_epoch, """
        SELECT o_orderkey, CAST(epoch_us(o_orderdate) AS DOUBLE) AS o_orderdate FROM orders"""),
    "d04_bool_to_number": (d04_bool_to_number, with_tables("dirty", sql="""
        SELECT row_id, CASE WHEN flag THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag FROM dirty""")),
    "d05_coerce_numbers": (d05_coerce_numbers, with_tables("dirty", sql="""
        SELECT row_id, try_cast(numeric_text_96 AS DOUBLE) AS numeric_text_96,
               try_cast(numeric_text_90 AS DOUBLE) AS numeric_text_90 FROM dirty""")),
    "d06_numeric_text": (d06_numeric_text, with_tables("dirty", sql="""
        SELECT row_id, try_cast(numeric_text_96 AS DOUBLE) AS numeric_text_96, numeric_text_90
        FROM dirty""")),
    "d07_category_codes": (d07_category_codes, with_tables("dirty", sql="""
        SELECT row_id, CASE WHEN cat_nulls IS NOT NULL THEN CAST(dense_rank() OVER
                 (ORDER BY cat_nulls NULLS LAST) - 1 AS DOUBLE) END AS cat_nulls,
               CAST(dense_rank() OVER (ORDER BY numeric_text_90) - 1 AS DOUBLE) AS numeric_text_90
        FROM dirty""")),
    "d08_infinity_to_missing": (d08_infinity_to_missing, with_tables("dirty", sql="""
        SELECT row_id, CASE WHEN isfinite(num_inf) THEN num_inf END AS num_inf FROM dirty""")),
    "d09_label_codes": (d09_label_codes, """
        SELECT o_orderkey, o_orderstatus,
               CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS label
        FROM orders"""),
    "d10_drop_identifiers": (d10_drop_identifiers, """
        SELECT c_name, c_nationkey AS grid, c_acctbal, c_mktsegment FROM customer"""),
    "d11_median_impute": (d11_median_impute, with_tables("dirty", sql="""
        SELECT row_id, round(coalesce(CASE WHEN isfinite(num_inf) THEN num_inf END,
          (SELECT median(num_inf) FROM dirty WHERE isfinite(num_inf))), 4) AS imputed
        FROM dirty""")),
    "d11_exact_quantiles": (d11_exact_quantiles, """
        SELECT count(*) AS n_rows, round(median(l_quantity), 4) AS median_l_quantity,
               round(median(l_extendedprice), 4) AS median_l_extendedprice,
               round(median(l_discount), 4) AS median_l_discount FROM lineitem"""),
    "d12_standard_scale": (d12_standard_scale, """
        SELECT l_orderkey,
          round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem))
            / (SELECT stddev_pop(l_extendedprice) FROM lineitem), 6) AS price_z,
          round((l_discount - (SELECT avg(l_discount) FROM lineitem))
            / (SELECT stddev_pop(l_discount) FROM lineitem), 6) AS discount_z FROM lineitem"""),
    "d13_mode_impute": (d13_mode_impute, with_tables("dirty", sql="""
        SELECT row_id, coalesce(cat_nulls, (SELECT cat_nulls FROM dirty WHERE cat_nulls IS NOT NULL
          GROUP BY cat_nulls ORDER BY count(*) DESC, cat_nulls LIMIT 1)) AS imputed FROM dirty""")),
    "d14_one_hot": (d14_one_hot, """
        SELECT c.c_custkey, CAST(v.position AS INTEGER) AS position,
               CASE WHEN c.c_mktsegment = v.c_mktsegment THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
               AS value FROM customer c CROSS JOIN
        (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS position
         FROM (SELECT DISTINCT c_mktsegment FROM customer) u) v"""),
    "d15_assemble": (d15_assemble, """
        SELECT o_orderkey, CAST(7 AS INTEGER) AS width,
          round((o_custkey - (SELECT avg(o_custkey) FROM orders))
            / (SELECT stddev_pop(o_custkey) FROM orders), 6) AS first_numeric,
          round((o_totalprice - (SELECT avg(o_totalprice) FROM orders))
            / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS second_numeric,
          CAST(1 AS DOUBLE) AS hot_cells FROM orders"""),
    "d16_scaling_off": (d16_unscaled, """
        SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS balance
        FROM supplier"""),
    "d17_prepare_features": (d17_prepare_features, with_tables("dirty", sql=f"""
        WITH t AS ({_CLEAN})
        SELECT row_id, CAST(paid AS DOUBLE) AS paid,
          CASE WHEN regexp_matches(numeric_text_96, {_NUM}) THEN try_cast(numeric_text_96 AS DOUBLE)
            END AS numeric_text_96,
          CAST(dense_rank() OVER (ORDER BY numeric_text_90) - 1 AS DOUBLE) AS numeric_text_90,
          CASE WHEN cat_nulls IS NOT NULL THEN CAST(dense_rank() OVER
            (ORDER BY cat_nulls NULLS LAST) - 1 AS DOUBLE) END AS cat_nulls,
          CASE WHEN flag THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag,
          CAST(epoch_us(ts) AS DOUBLE) AS ts,
          CASE WHEN isfinite(num_inf) THEN num_inf END AS num_inf,
          CAST(dense_rank() OVER (ORDER BY target) - 1 AS DOUBLE) AS label FROM t""")),
    "e01_stratified_split": (e01_stratified_split, "WITH "
        + split_sql("orders", "o_orderstatus", "o_orderkey").strip()
        + " SELECT o_orderkey, o_orderstatus, is_test FROM split"),
    "e01_plain_split": (e01_plain_split, """
        SELECT c_custkey, row_number() OVER (ORDER BY md5(concat(CAST(c_custkey AS VARCHAR), '|42')),
          c_custkey) <= (SELECT ceil(round(count(*) * CAST(0.2 AS DOUBLE), 9)) FROM customer) AS is_test
        FROM customer"""),
    "e02_stratified_folds": (e02_stratified_folds, """
        SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus
          ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), '|42')), o_orderkey) - 1) % 5
          AS INTEGER) AS fold FROM orders"""),
}
