"""Profiling and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscout.operators import profile as P

from .fixtures import table, with_tables


def rounded(df, digits=6):
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double"
        else F.col(f.name) for f in df.schema
    ])


NUMERIC = {
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "part": ["p_partkey", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax"],
    "events": ["event_id", "user_id", "value"],
    "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"],
}
PROFILED = {
    "orders": ("o_orderstatus", 5, 1), "customer": ("c_mktsegment", 4, 1),
    "part": ("p_brand", 5, 2), "lineitem": ("l_returnflag", 10, 1),
    "events": ("event_type", 5, 1),
}


def mean_of(expressions):
    """SQL: mean of the known values of a list of scalars."""
    return f"list_avg(list_filter([{', '.join(expressions)}], lambda x: x IS NOT NULL AND NOT isnan(x)))"


def profile_sql(name, target, features, categorical, task_id="NULL", label="NULL"):
    cols = NUMERIC[name]
    # A target that is numeric is not a feature.
    cols = [c for c in cols if c != target]
    pairs = [f"abs(corr({a}, {b}))" for i, a in enumerate(cols) for b in cols[i + 1:]]
    return f"""
    SELECT CAST({task_id} AS BIGINT) AS task_id, CAST({label} AS VARCHAR) AS dataset_name,
      a.n_samples, CAST({features} AS BIGINT) AS n_features,
      CAST({len(cols)} AS BIGINT) AS n_numeric, CAST({categorical} AS BIGINT) AS n_categorical,
      CAST(0 AS DOUBLE) AS missing_percentage, b.n_classes,
      round(b.imbalance_ratio, 6) AS imbalance_ratio, round(b.target_entropy, 6) AS target_entropy,
      round(a.mm, 3) AS mean_feature_mean, round(a.ms, 3) AS mean_feature_std,
      round(a.mv / 1e6, 4) AS mean_feature_variance, round(a.mc, 6) AS mean_abs_correlation
    FROM (SELECT count(*) AS n_samples, {mean_of([f'avg({c})' for c in cols])} AS mm,
            {mean_of([f'stddev_samp({c})' for c in cols])} AS ms,
            {mean_of([f'var_samp({c})' for c in cols])} AS mv, {mean_of(pairs)} AS mc
          FROM {name}) a
    CROSS JOIN (SELECT count(v) AS n_classes, min(n) / max(n) AS imbalance_ratio,
            -sum(n / t * log2(n / t)) AS target_entropy
          FROM (SELECT v, n, sum(n) OVER () AS t FROM
            (SELECT {target} AS v, CAST(count(*) AS DOUBLE) AS n FROM {name} GROUP BY 1) g) h) b
    """


def tidy_profile(df):
    return df.withColumns({
        "imbalance_ratio": F.round("imbalance_ratio", 6),
        "target_entropy": F.round("target_entropy", 6),
        "mean_feature_mean": F.round("mean_feature_mean", 3),
        "mean_feature_std": F.round("mean_feature_std", 3),
        "mean_feature_variance": F.round(F.col("mean_feature_variance") / 1e6, 4),
        "mean_abs_correlation": F.round("mean_abs_correlation", 6),
    })


def c01_shape(spark, d):
    return P.shape(table(spark, d, "orders"), "o_orderstatus")


def c02_column_kinds(spark, d):
    """Every policy's partition with the non-missing cells of each column behind it."""
    dirty = table(spark, d, "dirty")
    nulls = P.null_counts(dirty)
    kinds = None
    for policy in P.POLICIES:
        one = P.column_kinds(dirty, "target", policy).withColumn("policy", F.lit(policy))
        kinds = one if kinds is None else kinds.unionByName(one)
    return kinds.join(nulls, "column_name").select("policy", "column_name", "kind", "nulls")


def c03_missing_pct(spark, d):
    dirty = table(spark, d, "dirty")
    a = P.missing_pct(dirty, "target").withColumn("scope", F.lit("features"))
    b = P.missing_pct(dirty).withColumn("scope", F.lit("table"))
    return rounded(a.unionByName(b))


def c04_duplicate_rows(spark, d):
    # All columns; every event is there once, so a fifth of them is repeated.
    events = table(spark, d, "events")
    return P.duplicate_rows(events.unionAll(events.filter("event_id % 5 = 0")))


def c05_preview(spark, d):
    return P.preview(table(spark, d, "orders"), "o_orderkey", 5)


def c06_class_count(spark, d):
    return P.class_count(table(spark, d, "dirty"), "target")


def c07_class_distribution(spark, d):
    return P.class_distribution(table(spark, d, "orders"), "o_orderstatus")


def c08_target_summary(spark, d):
    return rounded(P.target_summary(table(spark, d, "lineitem"), "l_extendedprice"), 4)


def c09_target_entropy(spark, d):
    return rounded(P.class_balance(table(spark, d, "dirty"), "target").select("target_entropy"))


def c10_imbalance_ratio(spark, d):
    return rounded(P.class_balance(table(spark, d, "orders"), "o_orderstatus")
                   .select("imbalance_ratio"))


def c11_numeric_moments(spark, d):
    row = P.numeric_moments(table(spark, d, "lineitem"), NUMERIC["lineitem"])
    return row.select(
        F.round("mean_feature_mean", 3).alias("mean_feature_mean"),
        F.round("mean_feature_std", 3).alias("mean_feature_std"),
        F.round(F.col("mean_feature_variance") / 1e6, 4).alias("mean_feature_variance"))


def c12_mean_abs_correlation(spark, d):
    from tabscout.operators.correlate import mean_abs_correlation

    return rounded(mean_abs_correlation(table(spark, d, "lineitem"), NUMERIC["lineitem"]))


def c13_profile(spark, d):
    return tidy_profile(P.profile(table(spark, d, "orders"), "o_orderstatus", "orders", 1))


def c14_profile_many(spark, d):
    specs = [
        P.DatasetSpec(n, t, f"{d}/{n}.parquet", task_id=i)
        for i, (n, (t, _, _)) in enumerate(PROFILED.items())
    ]
    specs.append(P.DatasetSpec("broken", "no_such_column", f"{d}/orders.parquet"))
    return tidy_profile(P.profile_many(spark, specs)[0])


TASKS = [("orders", "o_orderstatus"), ("lineitem", "l_extendedprice"),
         ("lineitem", "l_quantity"), ("part", "p_size"), ("supplier", "s_acctbal"),
         ("labels", "quality")]


def c15_detect_task(spark, d):
    result = None
    for name, target in TASKS:
        one = P.task_facts(table(spark, d, name), target).withColumn("target", F.lit(target))
        result = one if result is None else result.unionByName(one)
    return result


def _task_sql(name, target):
    numeric = target in ("l_extendedprice", "l_quantity", "s_acctbal")
    test = f"max({target} <> floor({target}))" if numeric else "false"
    return (f"SELECT CASE WHEN {test} THEN 'regression' ELSE 'classification' END AS task_type, "
            f"'{target}' AS target FROM {name}" + ("" if numeric else " LIMIT 1"))


def c16_type_census(spark, d):
    """Columns per type over all tables, with the rows they carry."""
    result = None
    for name in ("orders", "lineitem", "part"):
        df = table(spark, d, name)
        rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
        one = P.type_census(df).withColumn("table_name", F.lit(name))
        rows = rows.withColumn("table_name", F.lit(name))
        one = one.join(rows, "table_name")
        result = one if result is None else result.unionByName(one)
    return result


def c17_describe(spark, d):
    return rounded(P.describe(table(spark, d, "lineitem")), 4)


def c18_unique_ratio(spark, d):
    orders = table(spark, d, "orders")
    return rounded(P.unique_ratio(orders, orders.columns))


def c19_null_counts(spark, d):
    return P.null_counts(table(spark, d, "dirty"))


DIRTY_COLUMNS = ["row_id", "paid", "all_null", "constant_col", "constant_with_nulls",
                 "numeric_text_96", "numeric_text_90", "cat_nulls", "flag", "ts", "num_inf",
                 "target"]


def nulls_of(c):
    return f"({c} IS NULL OR isnan({c}))" if c in ("num_inf", "all_null") else f"({c} IS NULL)"


_CELLS = {True: [c for c in DIRTY_COLUMNS if c != "target"], False: DIRTY_COLUMNS}
_MISSING = " UNION ALL ".join(
    f"SELECT CAST(sum({' + '.join(f'CAST({nulls_of(c)} AS INT)' for c in cols)}) AS BIGINT) "
    f"AS missing_cells, round(100.0 * sum({' + '.join(f'CAST({nulls_of(c)} AS INT)' for c in cols)})"
    f" / (count(*) * {len(cols)}), 6) AS missing_percentage, '{scope}' AS scope FROM dirty"
    for cols, scope in ((_CELLS[True], "features"), (_CELLS[False], "table")))
_NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {nulls_of(c)}) AS nulls FROM dirty"
    for c in DIRTY_COLUMNS)

_CLASSES = {
    "row_id": "number", "paid": "number", "all_null": "number", "constant_col": "number",
    "constant_with_nulls": "text", "numeric_text_96": "text", "numeric_text_90": "text",
    "cat_nulls": "text", "flag": "bool", "ts": "time", "num_inf": "number",
}
_KINDS = {
    "trainer": {"number": "numeric", "text": "categorical", "bool": "categorical",
                "time": "unused"},
    "suite": {"number": "numeric", "text": "categorical", "bool": "numeric",
              "time": "categorical"},
    "advisor": {"number": "numeric", "text": "categorical", "bool": "categorical",
                "time": "categorical"},
    "profiler": {"number": "numeric", "text": "categorical", "bool": "categorical",
                 "time": "numeric"},
    "page": {"number": "numeric", "text": "categorical", "bool": "categorical",
             "time": "unused"},
}
_KIND_ROWS = ", ".join(
    f"('{p}', '{c}', '{_KINDS[p][k]}')" for p in _KINDS for c, k in _CLASSES.items())


def describe_sql(name, cols):
    return " UNION ALL ".join(f"""
      SELECT '{c}' AS column_name, count({c}) AS "count", round(avg({c}), 4) AS mean,
        round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS "min",
        round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50,
        round(quantile_cont({c}, 0.75), 4) AS q75, CAST(max({c}) AS DOUBLE) AS "max"
      FROM {name}""" for c in cols)


ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
          "o_orderpriority"]
_MOMENTS = profile_sql("lineitem", "l_returnflag", 10, 1)

QUERIES = {
    "c01_shape": (c01_shape, """
        SELECT count(*) AS n_samples, CAST(5 AS BIGINT) AS n_features FROM orders"""),
    "c02_column_kinds": (c02_column_kinds, with_tables("dirty", sql=f"""
        SELECT k.policy, k.column_name, k.kind, n.nulls
        FROM (VALUES {_KIND_ROWS}) k(policy, column_name, kind)
        JOIN ({_NULLS}) n ON k.column_name = n.column_name""")),
    "c03_missing_pct": (c03_missing_pct, with_tables("dirty", sql=_MISSING)),
    "c04_duplicate_rows": (c04_duplicate_rows, """
        SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM
        (SELECT count(*) AS n FROM (SELECT * FROM events UNION ALL
          SELECT * FROM events WHERE event_id % 5 = 0) e
         GROUP BY event_id, ts, user_id, event_type, value, props) g"""),
    "c05_preview": (c05_preview, "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5"),
    "c06_class_count": (c06_class_count, with_tables(
        "dirty", sql="SELECT count(DISTINCT target) AS n_classes FROM dirty")),
    "c07_class_distribution": (c07_class_distribution, """
        SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1"""),
    "c08_target_summary": (c08_target_summary, """
        SELECT round(min(l_extendedprice), 4) AS target_min,
               round(max(l_extendedprice), 4) AS target_max,
               round(avg(l_extendedprice), 4) AS target_mean FROM lineitem"""),
    "c09_target_entropy": (c09_target_entropy, with_tables("dirty", sql="""
        SELECT round(-sum(n / t * log2(n / t)), 6) AS target_entropy FROM
        (SELECT target, CAST(count(*) AS DOUBLE) AS n,
                (SELECT CAST(count(*) AS DOUBLE) FROM dirty) AS t
         FROM dirty WHERE target IS NOT NULL GROUP BY target) g""")),
    "c10_imbalance_ratio": (c10_imbalance_ratio, """
        SELECT round(min(n) / max(n), 6) AS imbalance_ratio FROM
        (SELECT CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY o_orderstatus) g"""),
    "c11_numeric_moments": (c11_numeric_moments, f"""
        SELECT mean_feature_mean, mean_feature_std, mean_feature_variance FROM ({_MOMENTS}) p"""),
    "c12_mean_abs_correlation": (c12_mean_abs_correlation,
                                 f"SELECT mean_abs_correlation FROM ({_MOMENTS}) p"),
    "c13_profile": (c13_profile, profile_sql("orders", "o_orderstatus", 5, 1, "1", "'orders'")),
    "c14_profile_many": (c14_profile_many, " UNION ALL ".join(
        profile_sql(n, t, f, c, str(i), f"'{n}'")
        for i, (n, (t, f, c)) in enumerate(PROFILED.items()))),
    "c15_detect_task": (c15_detect_task, " UNION ALL ".join(
        f"SELECT * FROM ({_task_sql(n, t)}) t{i}" for i, (n, t) in enumerate(TASKS))),
    "c16_type_census": (c16_type_census, """
        SELECT t.table_name, t.data_type, CAST(t.columns AS BIGINT) AS columns, r.n_rows FROM
        (VALUES ('orders', 'bigint', 2), ('orders', 'string', 2), ('orders', 'double', 1),
         ('orders', 'timestamp', 1), ('lineitem', 'bigint', 3), ('lineitem', 'int', 1),
         ('lineitem', 'double', 4), ('lineitem', 'string', 2), ('lineitem', 'timestamp', 1),
         ('part', 'bigint', 1), ('part', 'string', 3), ('part', 'int', 1), ('part', 'double', 1))
        t(table_name, data_type, columns)
        JOIN (SELECT 'orders' AS table_name, count(*) AS n_rows FROM orders UNION ALL
              SELECT 'lineitem', count(*) FROM lineitem UNION ALL
              SELECT 'part', count(*) FROM part) r ON t.table_name = r.table_name"""),
    "c17_describe": (c17_describe, describe_sql("lineitem", NUMERIC["lineitem"])),
    "c18_unique_ratio": (c18_unique_ratio, " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, "
        f"round(count(DISTINCT {c}) / CAST(count(*) AS DOUBLE), 6) AS unique_ratio FROM orders"
        for c in ORDERS)),
    "c19_null_counts": (c19_null_counts, with_tables("dirty", sql=_NULLS)),
}
