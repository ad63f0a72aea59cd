"""Boosted trees and forests whose models do not depend on how the rows are dealt."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable, MLReadable, MLWritable
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import constants as K
from ..session import materialise, ship_package
from .arrays import ArrayReader, ArrayWriter
from .bins import Bins, Block, fit_bins, in_batches, lists_of, placed, plain
from .preprocess import FEATURES, LABEL
from .treegrow import Rules, Shape, Tree, grow, mixed

#: Gradients are kept as multiples of 2^-24, so that their sums are exact.
UNIT = 1 << 24
#: Labels of a regression are kept as integers below this.
LABEL_RANGE = 1 << 30
#: Margins are stored anew after this many rounds; between, trees are added up on the fly.
REFRESH_ROUNDS = 16
#: Trees of a forest that grow side by side.
TREES_AT_ONCE = 32

_POISSON = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 13)]))


def _uniform(hashes: np.ndarray, *seeds: int) -> np.ndarray:
    """A number in [0, 1) for each hash, another for each seed."""
    h = hashes.view(np.uint64)
    for s in seeds:
        h = mixed(h ^ mixed(np.uint64(s + 1)))
    return (h >> np.uint64(11)) * 2.0 ** -53


def tree_key(*numbers: int) -> int:
    key = np.uint64(0x5851F42D4C957F2D)
    for n in numbers:
        key = mixed(key ^ np.uint64(n + 1))
    return int(key)


class TreeModel(Model, HasFeaturesCol, MLWritable, MLReadable):
    """Fitted trees. Adds ``prediction`` and, for classifiers, ``probability``.

    ``kind`` says what leaf values are: "odds" (log odds of class 1), "margins" (one tree per class
    and round), "shares" (class shares, averaged) or "numbers" (averaged or summed up).
    """

    def __init__(self, bins: Bins | None = None, trees: Sequence[tuple[Shape, np.ndarray]] = (),
                 kind: str = "numbers", classes: int = 0, base: Sequence[float] = (),
                 mean: bool = False):
        super().__init__()
        self._setDefault(featuresCol=FEATURES)
        self.bins, self.trees = bins, list(trees)
        self.facts = {"kind": kind, "classes": classes, "base": list(base), "mean": mean}

    def scores(self, block: Block) -> np.ndarray:
        """Sums of leaf values (row, class) with the starting values."""
        return add_trees(np.tile(np.array(self.facts["base"], float), (block.n, 1)), block, self.trees)

    def answers(self, block: Block) -> tuple[np.ndarray, np.ndarray | None]:
        """Predictions and probabilities."""
        found, kind = self.scores(block), self.facts["kind"]
        if self.facts["mean"]:
            found /= max(1, len(self.trees))
        if kind == "numbers":
            return found[:, 0], None
        share = found if kind == "shares" else probabilities(found)
        return share.argmax(1).astype(float), share

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        sent = dataset.sparkSession.sparkContext.broadcast((self.bins, self.trees, self.facts))
        numbers = self.facts["kind"] == "numbers"
        size = 16_384

        def answer(vectors):
            bins, trees, facts = sent.value
            model = TreeModel.__new__(TreeModel)
            model.bins, model.trees, model.facts = bins, trees, facts
            values, shares = [], []
            for low in range(0, len(vectors), size):
                part = vectors.slice(low, size)
                value, share = model.answers(Block(bins, len(part), *placed(bins, part)))
                values.append(value)
                shares.append(share)
            value = np.concatenate(values) if values else np.zeros(0)
            if numbers:
                return pa.array(value)
            share = np.concatenate(shares) if shares else np.zeros((0, max(2, facts["classes"])))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(value) + 1) * share.shape[1], pa.int32()),
                pa.array(share.ravel()))
            return pa.StructArray.from_arrays([pa.array(value), lists], ["p", "s"])

        vector = plain(self.getFeaturesCol())
        if numbers:
            run = arrow_udf(answer, "double")
            return dataset.withColumn("prediction", run(vector))
        run = arrow_udf(answer, "struct<p:double,s:array<double>>")
        told = dataset.withColumn("ts_answer", run(vector))
        return told.withColumns({
            "prediction": F.col("ts_answer.p"),
            "probability": array_to_vector(F.col("ts_answer.s"))}).drop("ts_answer")

    def state(self):
        arrays = {"cuts": self.bins.cuts, "first": self.bins.first}
        for i, (shape, values) in enumerate(self.trees):
            arrays |= {f"{i}/{n}": getattr(shape, n) for n in ("feature", "bin", "left", "right")}
            arrays[f"{i}/value"] = values
        return arrays, {**self.facts, "trees": len(self.trees)}

    @classmethod
    def of_state(cls, arrays, facts):
        trees = [(Shape(*(arrays[f"{i}/{n}"] for n in ("feature", "bin", "left", "right"))),
                  arrays[f"{i}/value"]) for i in range(facts["trees"])]
        return cls(Bins(arrays["cuts"], arrays["first"]), trees,
                   **{k: v for k, v in facts.items() if k != "trees"})

    def write(self):
        return ArrayWriter(self)

    @classmethod
    def read(cls):
        return ArrayReader(cls)


def probabilities(margins: np.ndarray) -> np.ndarray:
    """Class probabilities of log odds (one column) or of margins per class."""
    if margins.shape[1] == 1:
        own = 1.0 / (1.0 + np.exp(-margins))
        return np.hstack((1.0 - own, own))
    raised = np.exp(margins - margins.max(1, keepdims=True))
    return raised / raised.sum(1, keepdims=True)


def add_trees(sums: np.ndarray, block: Block, trees) -> np.ndarray:
    """Adds each tree's leaf values; a tree of a single column belongs to class number % classes."""
    for i, (shape, values) in enumerate(trees):
        found = values[shape.nodes(block)]
        if found.ndim == 1:
            sums[:, i % sums.shape[1]] += found
        else:
            sums += found
    return sums


class _TreeEstimator(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable,
                     DefaultParamsWritable):
    """What boosting and forests share: reading rows, binning them, exact labels."""

    regression = Param(Params._dummy(), "regression", "numbers instead of classes",
                       TypeConverters.toBoolean)
    trees = Param(Params._dummy(), "trees", "rounds or trees", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "greatest depth; 0: no limit", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "of row and column draws", TypeConverters.toInt)

    def _prepared(self, dataset: DataFrame) -> "_Prepared":
        rows = materialise(dataset.select(
            plain(self.getFeaturesCol()).alias("vector"),
            F.col(self.getLabelCol()).cast("double").alias("label"),
        ).filter("label IS NOT NULL").withColumn("hash", F.xxhash64("vector", "label")))
        facts = rows.agg(
            F.count(F.lit(1)).alias("n"), F.max("vector.size").alias("size"),
            F.max(F.size("vector.values")).alias("stored"),
            F.min("label").alias("low"), F.max("label").alias("high")).first()
        if not facts["n"]:
            raise ValueError("no rows to train on")
        width = max(facts["size"] or 0, facts["stored"] or 0)
        bins = fit_bins(rows.select("hash", "vector"), facts["n"], width)

        def place(batches):
            for batch in batches:
                row, at = placed(bins, batch.column("vector"))
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column("hash"), batch.column("label"), pa.ListArray.from_arrays(
                        pa.array(ends, pa.int32()), pa.array(at.astype(np.int32)))],
                    names=["hash", "label", "bins"])

        binned = in_batches(rows, place, "hash bigint, label double, bins array<int>")
        return _Prepared(binned, bins, facts["n"], facts["low"], facts["high"])


def block_reader(bins: Bins):
    """Turns tables of binned rows into blocks."""
    def to_block(table: pa.Table) -> Block:
        block = Block(bins, table.num_rows, *lists_of(table.column("bins")))
        block.cache.update(hash=np.array(table.column("hash")), label=np.array(table.column("label")))
        if "margins" in table.column_names:
            block.cache["margins"] = lists_of(table.column("margins"))[1].reshape(block.n, -1)
        return block

    return to_block


class _Prepared:
    """Binned rows with what is known of their labels."""

    def __init__(self, binned: DataFrame, bins: Bins, n: int, low: float, high: float):
        self.binned, self.bins, self.n = binned, bins, n
        self.classes = max(2, int(high) + 1)
        # A regression's labels: (label - centre) * scale, rounded.
        self.centre = low + (high - low) / 2
        reach = max(high - self.centre, self.centre - low)
        most = min(LABEL_RANGE, (1 << 62) // n)
        self.scale = 2.0 ** np.floor(np.log2(most / reach)) if reach > 0 else 1.0

    def label_sums(self, regression: bool) -> list[float]:
        """Mean label of a regression, or the classes' shares; exact, whatever the partitioning."""
        if regression:
            whole = F.round((F.col("label") - self.centre) * self.scale).cast("decimal(38,0)")
            total = self.binned.agg(F.sum(whole)).first()[0]
            return [self.centre + int(total) / (self.n * self.scale)]
        found = {int(r["label"]): r["count"] for r in self.binned.groupBy("label").count().collect()}
        return [found.get(c, 0) / self.n for c in range(self.classes)]


class HistogramBooster(_TreeEstimator):
    """Second-order gradient boosting over binned features.

    Every round fits the gradients and hessians of the log loss (of the squared error, in a
    regression): one tree for two classes, one tree per class of a softmax for more. A leaf gives
    -G/(H+penalty) times ``rate``. ``rowShare`` of the rows (by the row's hash and the round) and
    ``columnShare`` of the columns (drawn per tree) take part. ``byHessian`` weighs sides of a split by
    hessians, else by rows; ``prior`` starts from the shares of the classes (the mean) instead of 0
    (one half of each class). Equal rows are drawn together.

    Gradients are rounded to multiples of 2^-24 (labels of a regression to 2^-30 of their range), so
    that sums are exact and the model does not depend on the partitioning. A round of depth d takes
    d passes over the binned rows, less where nodes have become small.
    """

    rate = Param(Params._dummy(), "rate", "learning rate", TypeConverters.toFloat)
    penalty = Param(Params._dummy(), "penalty", "L2 term of a leaf", TypeConverters.toFloat)
    minHessian = Param(Params._dummy(), "minHessian", "least hessian of a leaf",
                       TypeConverters.toFloat)
    rowShare = Param(Params._dummy(), "rowShare", "rows per round", TypeConverters.toFloat)
    columnShare = Param(Params._dummy(), "columnShare", "columns per tree", TypeConverters.toFloat)
    byHessian = Param(Params._dummy(), "byHessian", "weigh splits by hessians",
                      TypeConverters.toBoolean)
    prior = Param(Params._dummy(), "prior", "start from the label's mean", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, featuresCol=FEATURES, labelCol=LABEL, regression=False, trees=100, depth=3,
                 rate=0.1, penalty=0.0, minHessian=0.0, rowShare=1.0, columnShare=1.0,
                 byHessian=False, prior=True, seed=K.SEED):
        super().__init__()
        self._setDefault(featuresCol=FEATURES, labelCol=LABEL, regression=False, trees=100, depth=3,
                         rate=0.1, penalty=0.0, minHessian=0.0, rowShare=1.0, columnShare=1.0,
                         byHessian=False, prior=True, seed=K.SEED)
        self._set(**self._input_kwargs)

    def _settings(self) -> dict:
        return {p.name: self.getOrDefault(p) for p in self.params}

    def _fit(self, dataset: DataFrame) -> TreeModel:
        s = self._settings()
        ready = self._prepared(dataset)
        regression, seed = s["regression"], s["seed"]
        columns = 1 if regression or ready.classes == 2 else ready.classes
        known = ready.label_sums(regression)
        unit = ready.scale if regression else UNIT
        base = _start(known, columns, regression, s["prior"])
        # A class's own tree counts (K-1)/K in the classic form, doubles its hessian in the other.
        factor = (columns - 1) / columns if columns > 1 and not s["byHessian"] else 1.0
        doubled = 2.0 if columns > 1 and s["byHessian"] else 1.0
        rules = Rules(
            classes=1, depth=s["depth"] or None, min_hessian=s["minHessian"] * unit,
            penalty=s["penalty"] * unit, row_weight=0.0 if s["byHessian"] else unit,
            least_gain=1e-6 * unit * (unit if regression else 1.0) / unit)
        grown: list[tuple[Shape, np.ndarray]] = []
        rows, stored = materialise(ready.binned), 0
        for number in range(s["trees"]):
            recent = grown[stored:]
            trees = [Tree(tree_key(seed, number, c), columns=_drawn(
                ready.bins.width, s["columnShare"], seed, number, c)) for c in range(columns)]
            grow(rows, ready.n, ready.bins, trees, block_reader(ready.bins), _gradients(
                regression, columns, base, recent, ready.centre, unit, doubled, s["rowShare"],
                (seed, number)), rules)
            for tree in trees:
                own = np.array(tree.stats, float)
                weight = own[:, 1] + rules.penalty
                value = np.divide(-own[:, 0], weight, out=np.zeros(len(own)), where=weight > 0)
                # Hessians of a regression are rows in the labels' unit.
                grown.append((tree.shape(), value * s["rate"] * factor))
            if (number + 1) % REFRESH_ROUNDS == 0 and number + 1 < s["trees"]:
                rows, stored = _with_margins(rows, ready.bins, base, grown[stored:]), len(grown)
        kind = "numbers" if regression else "odds" if columns == 1 else "margins"
        return TreeModel(ready.bins, grown, kind, 0 if regression else ready.classes, base)._set(
            featuresCol=self.getFeaturesCol())


def _start(known: list[float], columns: int, regression: bool, prior: bool) -> list[float]:
    if regression:
        return [known[0] if prior else 0.5]
    if not prior:
        return [0.0] * columns
    safe = [min(max(p, 1e-9), 1 - 1e-9) for p in known]
    return [float(np.log(safe[1] / safe[0]))] if columns == 1 else [float(np.log(p)) for p in safe]


def _drawn(width: int, share: float, *seeds: int) -> np.ndarray | None:
    """The columns a tree may use, or None for all."""
    if share >= 1:
        return None
    order = np.argsort(_uniform(np.arange(width, dtype=np.int64), *seeds), kind="stable")
    return np.sort(order[:max(1, int(share * width))])


def _margins(block: Block, base, recent) -> np.ndarray:
    start = block.cache.get("margins")
    start = np.tile(np.array(base, float), (block.n, 1)) if start is None else start.copy()
    return add_trees(start, block, recent)


def _gradients(regression, columns, base, recent, centre, unit, doubled, share, seeds):
    """Statistics of a round's trees: G, H and the rows that take part."""
    def stats(block: Block, tree: int) -> np.ndarray:
        if "round" not in block.cache:
            block.cache["round"] = _margins(block, base, recent)
            use = np.ones(block.n, bool)
            if share < 1:
                use = _uniform(block.cache["hash"], *seeds) < share
            block.cache["use"] = use
        margins, label = block.cache["round"], block.cache["label"]
        if regression:
            # The exact label, so that sums over a node are those of the rounded labels.
            exact = np.rint((label - centre) * unit)
            g = np.rint((margins[:, 0] - centre) * unit) - exact
            h = np.full(block.n, unit)
        elif columns == 1:
            p = 1.0 / (1.0 + np.exp(-margins[:, 0]))
            g, h = (p - label) * UNIT, p * (1 - p) * UNIT
        else:
            p = probabilities(margins)[:, tree]
            g, h = (p - (label == tree)) * UNIT, doubled * p * (1 - p) * UNIT
        out = np.column_stack((np.rint(g), np.rint(h), np.ones(block.n))).astype(np.int64)
        out[~block.cache["use"]] = 0
        return out

    return stats


def _with_margins(rows: DataFrame, bins: Bins, base, recent) -> DataFrame:
    """The rows with their margins so far, written anew."""
    to_block = block_reader(bins)

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                margins = _margins(to_block(table), base, recent)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c) for c in ("hash", "label", "bins")), pa.ListArray.from_arrays(
                        pa.array(np.arange(batch.num_rows + 1) * margins.shape[1], pa.int32()),
                        pa.array(margins.ravel()))], names=["hash", "label", "bins", "margins"])

    return materialise(in_batches(
        rows, work, "hash bigint, label double, bins array<int>, margins array<double>"))


class HistogramForest(_TreeEstimator):
    """Random forest, or one tree, over binned features.

    A row takes part in a tree with a weight drawn from the Poisson distribution of mean 1 by the
    row's hash and the tree's number, which is what drawing as many rows with replacement amounts to;
    equal rows are drawn together. ``bootstrap`` off uses every row once. A node is split by the best of
    ``nodeFeatures`` ("sqrt", "all") features drawn for it among those that can split it. Without a
    depth limit nodes are split until they hold one class (until no split lowers the variance).
    Class shares of the leaves, or their means, are averaged over the trees.
    """

    bootstrap = Param(Params._dummy(), "bootstrap", "draw rows per tree", TypeConverters.toBoolean)
    nodeFeatures = Param(Params._dummy(), "nodeFeatures", "features per node: sqrt or all",
                         TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol=FEATURES, labelCol=LABEL, regression=False, trees=200, depth=15,
                 bootstrap=True, nodeFeatures="sqrt", seed=K.SEED):
        super().__init__()
        self._setDefault(featuresCol=FEATURES, labelCol=LABEL, regression=False, trees=200, depth=15,
                         bootstrap=True, nodeFeatures="sqrt", seed=K.SEED)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TreeModel:
        s: Mapping = {p.name: self.getOrDefault(p) for p in self.params}
        ready = self._prepared(dataset)
        regression, seed, bootstrap = s["regression"], s["seed"], s["bootstrap"]
        classes = 1 if regression else ready.classes
        wanted = None if s["nodeFeatures"] == "all" else max(1, int(ready.bins.width ** 0.5))
        rules = Rules(classes=classes, depth=s["depth"] or None, node_features=wanted,
                      least_gain=0.0 if regression else None)
        rows = materialise(ready.binned)
        done: list[tuple[Shape, np.ndarray]] = []
        for low in range(0, s["trees"], TREES_AT_ONCE):
            numbers = range(low, min(low + TREES_AT_ONCE, s["trees"]))
            trees = [Tree(tree_key(seed, number)) for number in numbers]
            grow(rows, ready.n, ready.bins, trees, block_reader(ready.bins), _weights(
                regression, classes, ready.centre, ready.scale, bootstrap, seed, low), rules)
            for tree in trees:
                own = np.array(tree.stats, float)
                weight = own[:, classes]
                share = np.divide(own[:, :classes], weight[:, None],
                                  out=np.zeros((len(own), classes)), where=weight[:, None] > 0)
                done.append((tree.shape(),
                             ready.centre + share / ready.scale if regression else share))
        kind = "numbers" if regression else "shares"
        return TreeModel(ready.bins, done, kind, 0 if regression else classes, [0.0] * classes,
                         True)._set(featuresCol=self.getFeaturesCol())


def _weights(regression, classes, centre, scale, bootstrap, seed, first):
    """Statistics of a forest's trees: weight per class (or weighted label), weight, rows."""
    def stats(block: Block, tree: int) -> np.ndarray:
        label = block.cache["label"]
        weight = np.ones(block.n, np.int64)
        if bootstrap:
            drawn = _uniform(block.cache["hash"], seed, first + tree)
            weight = np.searchsorted(_POISSON, drawn, "right")
        out = np.zeros((block.n, classes + 2), np.int64)
        if regression:
            out[:, 0] = weight * np.rint((label - centre) * scale).astype(np.int64)
        else:
            out[np.arange(block.n), label.astype(np.int64)] = weight
        out[:, classes] = weight
        out[:, classes + 1] = weight
        return out

    return stats
