"""Learner names: normalising, aliases and the gate before training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import constants as K
from .scalars import folded, lookup, strip


def strict_name(name: Column) -> Column:
    """Official label by exact spelling after trimming; unknown or null gives null."""
    return lookup(K.STRICT_ALIASES, strip(name))


def folded_name(name: Column) -> Column:
    """Official label whatever the case; unknown names are kept, null becomes empty."""
    text = strip(F.coalesce(name, F.lit("")))
    return F.coalesce(lookup(K.FOLDED_ALIASES, F.lower(text)), text)


def factory_name(name: Column) -> Column:
    """Name as the learner factory knows it, other names passed through in lower case."""
    text = folded(name)
    return F.coalesce(lookup(K.FACTORY_ALIASES, text), text)


def canonical_learner(name: str) -> str:
    """Driver-side twin of :func:`factory_name`, also reading selector labels."""
    text = str(name).strip().lower()
    return K.FACTORY_ALIASES.get(text, K.SELECTOR_LABEL_ALIASES.get(text, text))


def gated(name: Column, task: Column, strict: bool = False) -> Column:
    """The name itself when its task allows it, else that task's default.

    ``strict`` compares the plain lower-cased name, so labels without a space
    such as ``RandomForest`` fall to the default; otherwise aliases apply first.
    """
    if strict:
        known = F.lower(name)
    else:
        text = folded(name)
        known = F.coalesce(
            lookup({**K.FACTORY_ALIASES, **K.SELECTOR_LABEL_ALIASES}, text), text
        )
    regression = task == "regression"
    allowed = F.when(regression, known.isin(K.REGRESSORS)).otherwise(known.isin(K.CLASSIFIERS))
    default = F.when(regression, F.lit(K.DEFAULT_REGRESSOR)).otherwise(F.lit(K.DEFAULT_CLASSIFIER))
    return F.when(allowed, name).otherwise(default)


def gate(name: str, task: str, strict: bool = False) -> str:
    """Driver-side twin of :func:`gated` for one recommendation."""
    known = name.lower() if strict else canonical_learner(name)
    allowed = K.REGRESSORS if task == "regression" else K.CLASSIFIERS
    default = K.DEFAULT_REGRESSOR if task == "regression" else K.DEFAULT_CLASSIFIER
    return name if known in allowed else default


def alias_table(spark) -> DataFrame:
    """The factory's spellings as a small table."""
    return spark.createDataFrame(sorted(K.FACTORY_ALIASES.items()), "spelling string, learner string")
