"""Fitted preprocessing: impute, scale, one-hot encode and assemble.

The estimators compute exact statistics with DataFrame aggregates and return
Spark ML stages, so a fitted pipeline can be saved and scores streams. It runs in
the JVM but for the vectors of columns with very many categories.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler, VectorSizeHint,
)
from pyspark.ml.param.shared import HasInputCols, HasOutputCols, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import as_number, col, finite_or_null, quoted
from ..session import materialise
from .dictionary import StoredOneHot, store_dictionary
from .profile import partition_columns
from .quantiles import exact_quantiles

FEATURES = "ts_features"
LABEL = "ts_label"

# Categories and characters that become part of the model's stages, the smallest columns first; the
# dictionaries of the other columns are tables beside the model.
INLINE_CATEGORIES = 100_000
INLINE_CHARACTERS = 16_000_000


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _double(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def _usable(name: str) -> str:
    """SQL for a finite number or null."""
    c = f"CAST({quoted(name)} AS DOUBLE)"
    return f"CASE WHEN abs({c}) < CAST('Infinity' AS DOUBLE) THEN {c} END"


def _add_columns(expressions: Sequence[str]) -> SQLTransformer:
    return SQLTransformer(statement=f"SELECT *, {', '.join(expressions)} FROM __THIS__")


class NumericPrep(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable,
                  DefaultParamsWritable):
    """Exact median for missing values, then, if asked, zero mean and unit population deviation."""

    scale = Param(Params._dummy(), "scale", "standardise after imputing", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, scale=True):
        super().__init__()
        self._setDefault(scale=True)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        names, outputs = self.getInputCols(), self.getOutputCols()
        values = {
            n: finite_or_null(as_number(n, dataset.schema[n].dataType)) for n in names
        }
        medians = {n: q[0] if q[0] is not None else 0.0
                   for n, q in exact_quantiles(dataset, values, [0.5]).items()}
        filled = {n: F.coalesce(values[n], F.lit(medians[n])) for n in names}
        shift, spread = dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        if self.getOrDefault(self.scale):
            row = dataset.agg(
                *[F.avg(filled[n]).alias(f"m{i}") for i, n in enumerate(names)],
                *[F.stddev_pop(filled[n]).alias(f"s{i}") for i, n in enumerate(names)],
            ).first()
            for i, n in enumerate(names):
                shift[n] = row[f"m{i}"] or 0.0
                spread[n] = row[f"s{i}"] or 1.0
        expressions = []
        for n, out in zip(names, outputs):
            value = f"coalesce({_usable(n)}, {_double(medians[n])})"
            if self.getOrDefault(self.scale):
                value = f"({value} - {_double(shift[n])}) / {_double(spread[n])}"
            expressions.append(f"{value} AS {quoted(out)}")
        return _add_columns(expressions)


class CategoryPrep(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable,
                   DefaultParamsWritable):
    """Most frequent value for missing ones, smallest on ties, then one-hot with sorted
    categories; a value not seen in training becomes all zeros.

    Any number of categories will do: those of large columns are stored as a table with the model
    and joined when rows are encoded, with the same vectors as a result.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        names, outputs = self.getInputCols(), self.getOutputCols()
        cells = F.array(*[
            F.struct(F.lit(i).alias("i"), col(n).cast("string").alias("value"))
            for i, n in enumerate(names)
        ])
        counts = (
            dataset.select(F.inline(cells)).filter("value IS NOT NULL")
            .groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"))
        )
        counts = materialise(counts)
        facts = {r["i"]: r for r in counts.groupBy("i").agg(
            F.count(F.lit(1)).alias("entries"), F.sum(F.length("value")).alias("characters"),
            F.sum("n").alias("rows"), F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("top"),
        ).collect()}
        inline, entries, characters = [], 0, 0
        for i in sorted(facts, key=lambda i: (facts[i]["entries"], i)):
            entries += facts[i]["entries"]
            characters += facts[i]["characters"]
            if entries <= INLINE_CATEGORIES and characters <= INLINE_CHARACTERS:
                inline.append(i)
        labels: list[list[str]] = [[] for _ in names]
        for r in counts.filter(F.col("i").isin(inline)).collect() if inline else ():
            labels[r["i"]].append(r["value"])
        texts = [f"{o}_text" for o in outputs]
        stored = [i for i in facts if i not in inline]
        filled = [
            f"coalesce(CAST({quoted(n)} AS STRING), "
            f"{_text(facts[i]['top']['value'] if i in facts else '')})" for i, n in enumerate(names)]
        # Spark ML names the encoder's outputs by their values and wants no empty names.
        marks = {i: f"{outputs[i]}_mark" for i in range(len(names)) if i not in stored}
        fill = _add_columns([
            *[f"{filled[i]} AS {quoted(t)}" for i, t in enumerate(texts)],
            *[f"concat('=', {filled[i]}) AS {quoted(m)}" for i, m in marks.items()]])
        stages: list = [fill]
        codes = {i: f"{outputs[i]}_code" for i in range(len(names)) if i not in stored}
        if codes:
            # One indexer per column: label lists of unequal length cannot share one.
            index = PipelineModel(stages=[
                StringIndexerModel.from_labels(
                    [f"={v}" for v in sorted(labels[i]) or [""]], inputCol=marks[i], outputCol=code, handleInvalid="keep")
                for i, code in codes.items()
            ])
            # The encoder reads its sizes from column metadata, no pass over data is needed.
            one_hot = OneHotEncoder(
                inputCols=list(codes.values()), outputCols=[outputs[i] for i in codes], dropLast=True)
            sample = index.transform(fill.transform(dataset.limit(0)))
            stages += [index, one_hot.fit(sample)]
        for i in stored:
            size = facts[i]["entries"]
            path = store_dictionary(counts.filter(F.col("i") == i).select("value", "n"), size,
                                    facts[i]["rows"])
            stages += [
                StoredOneHot(inputCol=texts[i], outputCol=outputs[i], size=size, path=path),
                VectorSizeHint(inputCol=outputs[i], size=size, handleInvalid="optimistic")]
        return PipelineModel(stages=stages)


def prep_stages(
    df: DataFrame, scale: bool = True, policy: str = "trainer", output: str = FEATURES
) -> list:
    """Stages turning the columns of ``df`` into one feature vector.

    Numbers are imputed and optionally scaled, categories one-hot encoded, the
    rest dropped. Fit them on the training rows only.
    """
    numeric, categorical = partition_columns(df, policy=policy)
    if not numeric and not categorical:
        raise ValueError("no usable feature columns")
    stages: list = []
    parts: list[str] = []
    if numeric:
        outputs = [f"ts_num_{i}" for i in range(len(numeric))]
        stages.append(NumericPrep(inputCols=numeric, outputCols=outputs, scale=scale))
        parts += outputs
    if categorical:
        outputs = [f"ts_cat_{i}" for i in range(len(categorical))]
        stages.append(CategoryPrep(inputCols=categorical, outputCols=outputs))
        parts += outputs
    stages.append(VectorAssembler(inputCols=parts, outputCol=output))
    return stages


