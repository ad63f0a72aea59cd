"""Relational operators on the learner log: one row per dataset, learner and attempt.

``seq`` is the log order; wherever first or last matters it decides. Groups are
reduced with mergeable aggregates rather than windows, so a dataset that owns a
large share of the log is already folded before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import constants as K
from ..functions.names import folded_name, strict_name
from ..functions.scalars import (
    all_of, any_of, as_number, col, folded, integer_id, is_finite, present, strip, text_array,
)
from .columnstats import per_column
from .validate import drop_missing, project, project_available, require_columns

PAIR = ["dataset_id", "model"]


# --- names, types and flags -------------------------------------------------

def normalise_models(log: DataFrame, case_sensitive: bool = True) -> DataFrame:
    """Learner names as official labels: strictly (else null) or whatever the case."""
    name = strict_name(col("model")) if case_sensitive else folded_name(col("model"))
    return log.withColumn("model", name)


def official(log: DataFrame) -> DataFrame:
    """Rows of the six official learners."""
    return log.filter(col("model").isin(K.OFFICIAL_LEARNERS))


def clean_types(log: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Declared columns as numbers, bad values as missing. Whole numbers stay whole."""
    names = columns or (K.LOG_INTEGERS + K.METRICS)
    return log.withColumns({
        n: as_number(n, log.schema[n].dataType) for n in names
        if n in log.columns and not isinstance(log.schema[n].dataType, T.IntegralType)
    })


def clean_status(log: DataFrame) -> DataFrame:
    """Status trimmed, lower-cased, missing as empty."""
    return log.withColumn("status", folded(F.coalesce(col("status"), F.lit(""))))


def lower_status() -> Column:
    """Status in lower case only, the way the runner reads it; missing reads ``nan``."""
    return F.lower(F.coalesce(col("status"), F.lit("nan")))


def _metric(log: DataFrame, name: str) -> Column:
    return as_number(name, log.schema[name].dataType)


def _known(log: DataFrame, name: str) -> Column:
    return present(name, log.schema[name].dataType).isNotNull()


def metrics_complete(log: DataFrame) -> DataFrame:
    """Adds whether all six metrics are there."""
    return log.withColumn("metrics_complete", all_of([_known(log, m) for m in K.METRICS]))


def _valid(log: DataFrame) -> Column:
    return all_of([is_finite(_metric(log, m)) for m in K.METRICS])


def metrics_valid(log: DataFrame) -> DataFrame:
    """Adds whether all six metrics are there, numeric and finite."""
    return log.withColumn("metrics_valid", _valid(log))


# --- duplicates ---------------------------------------------------------------

def duplicate_members(log: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Rows that share their key with another row, all of them counted."""
    groups = log.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("bigint")
        .alias("duplicate_members")
    )


def _one_per_group(log: DataFrame, keys: Sequence[str], seq: str, pick) -> DataFrame:
    rest = [c for c in log.columns if c not in keys]
    picked = log.groupBy(*[col(k) for k in keys]).agg(
        pick(F.struct(*[col(c) for c in rest]), col(seq)).alias("_row")
    )
    return picked.select(*[
        col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in log.columns
    ])


def latest(log: DataFrame, keys: Sequence[str] = PAIR, seq: str = "seq") -> DataFrame:
    """The last row per key in log order; missing keys form a group of their own."""
    return _one_per_group(log, keys, seq, F.max_by)


def earliest(log: DataFrame, keys: Sequence[str] = PAIR, seq: str = "seq") -> DataFrame:
    """The first row per key in log order."""
    return _one_per_group(log, keys, seq, F.min_by)


def dataset_characteristics(log: DataFrame, seq: str = "seq") -> DataFrame:
    """The first row of each dataset name."""
    return earliest(log, ["dataset_name"], seq)


# --- status ---------------------------------------------------------------------

def mark_incomplete(log: DataFrame) -> DataFrame:
    """Successful rows lacking a metric become ``incomplete`` with an explanation."""
    lacking = (col("status") == "success") & any_of([~_known(log, m) for m in K.METRICS])
    text = strip(F.coalesce(col("error"), F.lit("")))
    explained = F.when(text == "", F.lit(K.INCOMPLETE_TEXT)).otherwise(text)
    return log.withColumns({
        "status": F.when(lacking, F.lit("incomplete")).otherwise(col("status")),
        "error": F.when(lacking, explained).otherwise(col("error")),
    })


def unsuccessful(log: DataFrame) -> DataFrame:
    """Rows that did not succeed, with what is needed to find them."""
    return log.filter(~col("status").eqNullSafe("success")).select(
        *[col(c) for c in ("dataset_id", "dataset_name", "model", "status", "error")]
    )


# --- the dataset by learner grid ---------------------------------------------------

def _missing_from(found: Column) -> Column:
    """Official learners not among ``found``, sorted by name."""
    return F.array_sort(F.array_except(text_array(K.OFFICIAL_LEARNERS), found))


def _found_learners(condition: Column | None = None) -> Column:
    """Aggregate: the set of official learners seen, never more than six."""
    seen = col("model").isin(K.OFFICIAL_LEARNERS)
    if condition is not None:
        seen = seen & condition
    return F.collect_set(F.when(seen, col("model")))


def missing_cells(log: DataFrame, seq: str = "seq") -> DataFrame:
    """Datasets of the log that lack a learner, with the sorted list of those lacking."""
    named = F.when(_known(log, "dataset_name"), col("dataset_name"))
    grouped = log.filter(_known(log, "dataset_id")).groupBy(col("dataset_id")).agg(
        F.coalesce(
            F.min_by(named, F.when(named.isNotNull(), col(seq))), F.lit("UNKNOWN")
        ).alias("dataset_name"),
        _found_learners().alias("found"),
    )
    return (
        grouped.withColumn("missing", _missing_from(F.col("found")))
        .filter(F.size("missing") > 0)
        .select("dataset_id", "dataset_name", F.array_join("missing", ", ").alias("missing"))
    )


def missing_pairs(log: DataFrame) -> DataFrame:
    """The same gaps, one row per dataset and missing learner."""
    grouped = log.filter(_known(log, "dataset_id")).groupBy(col("dataset_id")).agg(
        _found_learners().alias("found")
    )
    return grouped.select("dataset_id", F.explode(_missing_from(F.col("found"))).alias("model"))


def completed(catalog: DataFrame, log: DataFrame) -> DataFrame:
    """Per catalog dataset the learners with a valid success, matched by id or by name.

    The log is first folded to one row per id and one per name, so both joins meet
    at most one row, however often a dataset was tried.
    """
    status = folded(F.coalesce(col("status"), F.lit("")))
    good = (
        log.filter((status == "success") & _valid(log))
        .select(
            integer_id("dataset_id", log.schema["dataset_id"].dataType).alias("_id"),
            folded(col("dataset_name")).alias("_name"),
            strict_name(col("model")).alias("model"),
        )
        .filter(F.col("model").isNotNull())
    )
    by_id = good.filter("_id IS NOT NULL").groupBy("_id").agg(
        F.collect_set("model").alias("_from_id")
    )
    by_name = good.filter("_name <> ''").groupBy("_name").agg(
        F.collect_set("model").alias("_from_name")
    )
    keyed = catalog.withColumns({
        "_cat_id": integer_id("dataset_id", catalog.schema["dataset_id"].dataType),
        "_cat_name": folded(col("dataset_name")),
    })
    none = F.array().cast("array<string>")
    both = F.array_union(F.coalesce("_from_id", none), F.coalesce("_from_name", none))
    return (
        keyed.join(by_id, F.col("_cat_id") == F.col("_id"), "left")
        .join(by_name, F.col("_cat_name") == F.col("_name"), "left")
        .withColumn("completed", F.array_sort(both))
        .drop("_cat_id", "_cat_name", "_id", "_name", "_from_id", "_from_name")
    )


def missing_learners(catalog: DataFrame, log: DataFrame) -> DataFrame:
    """Per catalog dataset the learners still to run, one row each."""
    return completed(catalog, log).select(
        col("dataset_id"), col("dataset_name"),
        F.explode(_missing_from(F.col("completed"))).alias("model"),
    )


def resume_plan(catalog: DataFrame, log: DataFrame) -> DataFrame:
    """What to do per catalog dataset: skip it, resume it or start it."""
    n = F.size("completed")
    action = (
        F.when(n == len(K.OFFICIAL_LEARNERS), "skip").when(n > 0, "resume").otherwise("start")
    )
    return completed(catalog, log).select(
        col("dataset_id"), col("dataset_name"),
        n.cast("bigint").alias("completed"),
        action.alias("action"),
        F.array_join(_missing_from(F.col("completed")), ", ").alias("missing"),
    )


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("datasets"))


def incomplete_datasets(catalog: DataFrame, log: DataFrame) -> DataFrame:
    """Catalog datasets short of six successes, with k/6 and the learners lacking."""
    wins = (
        official(normalise_models(log)).filter(lower_status() == "success")
        .groupBy(integer_id("dataset_id", log.schema["dataset_id"].dataType).alias("_id"))
        .agg(F.collect_set("model").alias("_won"))
    )
    none = F.array().cast("array<string>")
    won = F.coalesce("_won", none)
    total = len(K.OFFICIAL_LEARNERS)
    return (
        catalog.withColumn(
            "_cat_id", integer_id("dataset_id", catalog.schema["dataset_id"].dataType))
        .join(wins, F.col("_cat_id") == F.col("_id"), "left")
        .filter(F.size(won) < total)
        .select(
            col("dataset_id"), col("dataset_name"),
            F.concat(F.size(won).cast("string"), F.lit(f"/{total}")).alias("progress"),
            F.array_join(_missing_from(won), ", ").alias("missing"),
        )
    )


# --- changing and reading single results ---------------------------------------------

def upsert(log: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """The log after storing new results: a known pair is replaced where it first
    stood, an unknown one appended. Rows without a usable id or an official learner
    are dropped, and of repeated old rows the first stays.

    Of several new results for a pair the last wins. One aggregate over the union.
    """
    def ready(df: DataFrame, is_new: bool) -> DataFrame:
        return official(
            normalise_models(df)
            .withColumn("dataset_id", integer_id("dataset_id", df.schema["dataset_id"].dataType))
            .filter(F.col("dataset_id").isNotNull())
        ).withColumn("_new", F.lit(is_new))

    both = ready(log, False).unionByName(ready(new, True), allowMissingColumns=True)
    rank = F.struct(
        col("_new"), F.when(col("_new"), col(seq)).otherwise(-col(seq)).alias("order")
    )
    rest = [c for c in both.columns if c not in (*PAIR, "_new", seq)]
    place = F.coalesce(F.min(F.when(~col("_new"), col(seq))), F.max(col(seq)))
    picked = both.groupBy(*[col(k) for k in PAIR]).agg(
        F.max_by(F.struct(*[col(c) for c in rest]), rank).alias("_row"),
        place.alias(seq),
    )
    return picked.select(*[
        col(c) if c in (*PAIR, seq) else F.col("_row").getField(c).alias(c)
        for c in both.columns if c != "_new"
    ])


def renumber(rows: DataFrame, first: int, seq: str = "seq") -> DataFrame:
    """Results of one write, few, numbered from ``first`` in their order."""
    order = Window.orderBy(col(seq))
    return rows.withColumn(seq, F.row_number().over(order).cast("bigint") - 1 + F.lit(first))


def find_result(log: DataFrame, dataset_id: int, model: str) -> DataFrame:
    """Rows of one dataset and learner, the learner given in any accepted spelling."""
    label = K.STRICT_ALIASES.get(str(model).strip())
    same_id = integer_id("dataset_id", log.schema["dataset_id"].dataType) == F.lit(int(dataset_id))
    return log.filter(same_id & strict_name(col("model")).eqNullSafe(F.lit(label)))


def read_checkpoint(log: DataFrame, seq: str = "seq") -> DataFrame:
    """Strict names, official learners, last row per pair: the state to resume from."""
    return latest(official(normalise_models(log)), PAIR, seq)


# --- order and reports -----------------------------------------------------------------

def model_position(model: Column) -> Column:
    return F.array_position(text_array(K.OFFICIAL_LEARNERS), model)


def ordered(log: DataFrame, seq: str | None = "seq") -> DataFrame:
    """By dataset id with missing ids last, then by the official learner order."""
    order = [
        col("dataset_id").asc_nulls_last(),
        F.nullif(model_position(col("model")), F.lit(0).cast("bigint")).asc_nulls_last(),
    ]
    if seq and seq in log.columns:
        order.append(col(seq).asc())
    return log.orderBy(*order)


def _pairs(log: DataFrame, success: Column) -> DataFrame:
    """Per dataset and learner: rows, successes and valid successes."""
    valid = success & all_of([_known(log, m) for m in K.METRICS])
    return log.groupBy(*[col(k) for k in PAIR]).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(success).alias("wins"),
        F.count_if(valid).alias("valid_wins"),
    )


def summary(
    log: DataFrame, expected_datasets: int | None = None, runner: bool = False
) -> DataFrame:
    """Counts describing the log, and whether the grid is complete.

    All of it derives from one grouped count per dataset and learner. ``runner``
    judges completeness by successes instead of by presence. The number of datasets
    expected defaults to the number seen.
    """
    learners = len(K.OFFICIAL_LEARNERS)
    success = (lower_status() if runner else col("status")).eqNullSafe("success")
    counted = F.col("wins") > 0 if runner else F.lit(True)
    per_dataset = _pairs(log, success).groupBy("dataset_id").agg(
        F.sum("rows").alias("rows"), F.sum("wins").alias("wins"),
        F.sum("valid_wins").alias("valid_wins"),
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(counted & col("model").isNotNull()).alias("learners_done"),
        F.array_sort(_found_learners()).alias("names"),
    )
    totals = per_dataset.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count("dataset_id").alias("datasets"),
        F.size(F.array_distinct(F.flatten(F.collect_set("names")))).cast("bigint")
        .alias("learners"),
        F.coalesce(F.sum(F.col("rows") - F.col("pairs")), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("wins"), F.lit(0)).alias("successful"),
        F.coalesce(F.sum("valid_wins"), F.lit(0)).alias("valid_successful"),
        F.count_if((F.col("learners_done") == learners) & F.col("dataset_id").isNotNull())
        .alias("complete_datasets"),
    )
    expected = F.lit(expected_datasets) if expected_datasets is not None else F.col("datasets")
    totals = totals.withColumns({
        "expected_datasets": expected.cast("bigint"),
        "expected_evaluations": (expected * learners).cast("bigint"),
        "unsuccessful": F.col("rows") - F.col("successful"),
    })
    totals = totals.withColumn(
        "incomplete_datasets",
        (F.col("expected_datasets") if runner else F.col("datasets")) - F.col("complete_datasets"),
    )
    complete = F.col("successful") == F.col("expected_evaluations")
    if not runner:
        complete = all_of([
            complete,
            F.col("rows") == F.col("expected_evaluations"),
            F.col("datasets") == F.col("expected_datasets"),
            F.col("learners") == learners,
            F.col("duplicates") == 0,
            F.col("complete_datasets") == F.col("expected_datasets"),
            F.col("valid_successful") == F.col("expected_evaluations"),
        ])
    return totals.withColumns({
        "remaining": F.col("expected_evaluations") - F.col("successful"),
        "matrix_complete": complete,
    })


def evaluations_histogram(log: DataFrame) -> DataFrame:
    """How many datasets have how many rows."""
    per_dataset = log.filter(_known(log, "dataset_id")).groupBy(col("dataset_id")).agg(
        F.count(F.lit(1)).alias("evaluations")
    )
    return per_dataset.groupBy("evaluations").agg(F.count(F.lit(1)).alias("datasets"))


def learner_counts(log: DataFrame) -> DataFrame:
    """Rows and successes per official learner, zero included, in report order."""
    counts = official(log).groupBy(col("model")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(lower_status() == "success").alias("successful"),
    )
    names = log.sparkSession.createDataFrame(
        [(i, name) for i, name in enumerate(K.OFFICIAL_LEARNERS)], "position int, model string"
    )
    return (
        names.join(counts, "model", "left").na.fill(0, ["rows", "successful"])
        .orderBy("position").select("model", "rows", "successful")
    )


def status_counts(log: DataFrame, lower: bool = False) -> DataFrame:
    """Rows per status; a missing status is a group of its own."""
    status = lower_status() if lower else col("status")
    return log.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def metric_nulls(log: DataFrame) -> DataFrame:
    """Missing values per metric."""
    return per_column(
        log, {m: ~_known(log, m) for m in K.METRICS}, {"nulls": F.count_if}, order=False
    ).withColumnRenamed("column_name", "metric")


def complete_datasets(
    log: DataFrame, runner: bool = False, expected: int | None = None
) -> DataFrame:
    """Datasets with all six learners present, or all six successful.

    The others are counted among the datasets found, or among ``expected`` ones.
    """
    rows = log.filter(lower_status() == "success") if runner else log
    per_dataset = rows.filter(_known(log, "dataset_id")).groupBy(col("dataset_id")).agg(
        F.size(_found_learners()).alias("learners")
    )
    full = F.col("learners") == len(K.OFFICIAL_LEARNERS)
    return per_dataset.agg(
        F.count_if(full).alias("complete"),
        (F.count_if(~full) if expected is None else F.lit(expected) - F.count_if(full))
        .cast("bigint").alias("incomplete"),
    )


def valid_successes(log: DataFrame) -> DataFrame:
    """Successful rows with every metric."""
    return log.filter(
        (col("status") == "success") & all_of([_known(log, m) for m in K.METRICS])
    )


def leaderboard(log: DataFrame, successful_only: bool = True) -> DataFrame:
    """Mean metrics per learner, best accuracy first.

    The runner's form takes successful rows of official learners and numbers them;
    the analysis form takes all rows and rounds to 4 digits.
    """
    rows = official(log).filter(lower_status() == "success") if successful_only else log.filter(
        col("model").isNotNull())
    means = rows.groupBy(col("model")).agg(*[F.avg(_metric(log, m)).alias(m) for m in K.METRICS])
    order = [F.col("accuracy").desc_nulls_last(), F.col("model").asc()]
    if successful_only:
        # At most six rows reach this window.
        return means.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    return means.withColumns({m: F.round(m, 4) for m in K.METRICS}).orderBy(*order)


def best_per_dataset(log: DataFrame, seq: str = "seq") -> DataFrame:
    """The row with the highest F1 per dataset name, the first one on ties.

    Datasets without any F1 are left out.
    """
    f1 = _metric(log, "f1_score")
    scored = log.filter(f1.isNotNull() & col("dataset_name").isNotNull())
    rank = F.struct(f1.alias("f1"), (-col(seq)).alias("order"))
    rest = [c for c in log.columns if c != "dataset_name"]
    picked = scored.groupBy(col("dataset_name")).agg(
        F.max_by(F.struct(*[col(c) for c in rest]), rank).alias("_row")
    )
    return picked.select(*[
        col(c) if c == "dataset_name" else F.col("_row").getField(c).alias(c) for c in log.columns
    ])


def best_cells_per_dataset(
    log: DataFrame, columns: Sequence[str] | None = None, seq: str = "seq"
) -> DataFrame:
    """Per dataset name and column the first known value, rows ordered by F1.

    Cells of one result row may come from different log rows when the best lacks some.
    """
    names = columns or ["model", *[m for m in K.METRICS]]
    f1 = _metric(log, "f1_score")
    rank = F.struct(f1.isNull().alias("last"), (-f1).alias("f1"), col(seq).alias("order"))
    return log.filter(_known(log, "dataset_name")).groupBy(col("dataset_name")).agg(*[
        F.min_by(present(c, log.schema[c].dataType), F.when(_known(log, c), rank)).alias(c)
        for c in names
    ])


def best_distribution(best: DataFrame) -> DataFrame:
    """How often each learner is best."""
    return (
        best.filter(col("model").isNotNull()).groupBy(col("model"))
        .agg(F.count(F.lit(1)).alias("datasets")).orderBy(F.desc("datasets"), F.asc("model"))
    )


def distinct_counts(log: DataFrame) -> DataFrame:
    """Distinct dataset names and learners."""
    pairs = log.groupBy(col("dataset_name"), col("model")).agg(F.lit(1).alias("seen"))
    return pairs.agg(
        F.count_distinct("dataset_name").alias("datasets"),
        F.count_distinct("model").alias("learners"),
    )


def attach_meta(log: DataFrame, profiles: DataFrame, on: str = "task_id") -> DataFrame:
    """The log with each dataset's feature counts and missing share.

    This produces the table the selector learns from. Left to Spark's own size
    check, the profiles are broadcast as long as they are small.
    """
    meta = profiles.select(
        col(on),
        col("n_numeric").alias("numeric_features"),
        col("n_categorical").alias("categorical_features"),
        col("missing_percentage"),
    )
    extra = [c for c in meta.columns if c != on and c in log.columns]
    return log.drop(*extra).join(meta, on, "left")


# --- whole chains ---------------------------------------------------------------------

def finalise(log: DataFrame, seq: str = "seq") -> DataFrame:
    """The log ready to publish: checked, typed, official learners only, one row per
    pair, incomplete successes marked, columns and rows in order."""
    require_columns(log, K.LOG_REQUIRED)
    typed = clean_status(clean_types(log))
    single = latest(official(normalise_models(typed, case_sensitive=False)), PAIR, seq)
    return ordered(project_available(mark_incomplete(single), K.LOG_FINAL), None)


def repair(log: DataFrame, seq: str = "seq") -> DataFrame:
    """Only valid evaluations of official learners, the last per pair."""
    named = official(normalise_models(log))
    return latest(named.filter(_valid(named)), PAIR, seq)


def clean(log: DataFrame) -> DataFrame:
    """Fixed columns, rows with dataset and learner, numbers coerced, completeness
    flagged. Duplicates stay; :func:`duplicate_members` reports them."""
    kept = drop_missing(project(log, K.CLEAN_COLUMNS), ["dataset_name", "model"])
    return metrics_complete(clean_types(kept, K.CLEAN_NUMERIC))
