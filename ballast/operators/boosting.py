"""Gradient boosting of all 49 balls at once: histograms of binned features, one job a level.

One forest predicts all balls: a tree's splits are shared, its leaves hold a value for each ball. Features are
binned once. A level of a tree is one job: tasks add up, for each (step, node, feature, bin), the first and
second derivatives of all balls' losses; an aggregate sums the tasks' histograms; and each node's best split
follows from its histograms, on the executors. The driver gets a row a node. So the number of jobs is trees x depth, whatever the
number of balls, rows or steps: the models of a backtest's steps grow side by side.

Rows carry no scores from job to job: a task computes them from the trees so far, which are small, so a
lost executor loses nothing but its tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ballast.functions.scan import running_totals
from ballast.operators import draws as dr
from ballast.operators.scoring import drawn, grid
from ballast.schema import BLUE_MAX, RED_MAX, WARM_UP
from ballast.sources.files import materialised

#: Rows that a task takes at once; rows and cells that are multiplied at once.
_BLOCK, _PART = 1 << 16, 2048
BALLS = [("red", b) for b in range(1, RED_MAX + 1)] + [("blue", b) for b in range(1, BLUE_MAX + 1)]


@dataclass(frozen=True)
class Settings:
    trees: int = 20
    depth: int = 3
    bins: int = 16
    rate: float = 0.1
    ridge: float = 1.0  #: added to each sum of second derivatives
    least: int = 20  #: rows of a leaf


@dataclass
class Forest:
    """One step's model: starting values, and trees as splits (feature, bin; left where bin <= it) by level, and leaves."""

    base: np.ndarray
    splits: list[np.ndarray] = field(default_factory=list)  #: (2^depth - 1, 2) a tree, nodes level by level
    leaves: list[np.ndarray] = field(default_factory=list)  #: (2^depth, balls) a tree

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.repeat(self.base[None], len(bins), 0)
        for splits, leaves in zip(self.splits, self.leaves):
            out += leaves[descend(splits, bins)]
        return out


def descend(splits: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The node of the last level that each row reaches, from 0."""
    node, first = np.zeros(len(bins), np.uint8 if len(splits) < 256 else np.int64), 0
    while first < len(splits):
        right = np.zeros(len(bins), bool)
        for i, (feature, upto) in enumerate(splits[first : 2 * first + 1]):
            right |= (node == i) & (bins[:, feature] > upto)
        node = 2 * node + right
        first = 2 * first + 1
    return node.astype(np.int64)


def sigmoid(x):
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def labels(next_mask: np.ndarray, next_blue: np.ndarray) -> np.ndarray:
    """(rows, 49): whether each ball came."""
    red = np.unpackbits(next_mask.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, 1 : RED_MAX + 1]
    return np.concatenate((red, next_blue[:, None] == np.arange(1, BLUE_MAX + 1)), 1).astype(bool)


def cut_points(rows: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """At most bins - 1 distinct values of each feature, at its quantiles.

    Tasks count the values, so a window holds a row a distinct value of one feature, of which draws' features have some hundreds.
    """

    def run(batches):
        for t in _blocks(batches):
            for c in features:
                value, n = np.unique(t.column(c).drop_null().to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(n), pa.string()), pa.array(value, pa.float64()), pa.array(n, pa.int64())], names=["feature", "value", "n"])

    counted = rows.select(*(F.col(c).cast("double").alias(c) for c in features)).mapInArrow(run, "feature string, value double, n long").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("feature")
    upto, whole = F.sum("n").over(own.orderBy("value")), F.sum("n").over(own)
    at = counted.select("feature", "value", "n", upto.alias("upto"), whole.alias("whole"))
    # a value is a cut where the place of some quantile is one of its own
    found = at.where(f"least(upto * {bins} div whole, {bins - 1}) > (upto - n) * {bins} div whole").select("feature", "value").collect()
    return {c: sorted(r.value for r in found if r.feature == c) for c in features}


def binned(rows: DataFrame, cuts: dict[str, list[float]], keep: list[str]) -> DataFrame:
    """keep and ``bins``, a byte a feature: how many of its cut points lie below the value."""

    def run(batches):
        for b in batches:
            cols = [np.searchsorted(cuts[c], b.column(c).to_numpy(zero_copy_only=False)).astype(np.uint8) for c in cuts]
            packed = np.stack(cols, 1).tobytes() if cols else b""
            k = len(cuts)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([packed[i : i + k] for i in range(0, len(packed), k)], pa.binary())], names=[*keep, "bins"])

    src = rows.select(*keep, *(F.col(c).cast("double").alias(c) for c in cuts))
    kinds = ", ".join(f"{c} {t}" for c, t in src.select(*keep).dtypes)
    return src.mapInArrow(run, f"{kinds}, bins binary")


def _unpack(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, n)


def _blocks(batches):
    """The batches as tables of about _BLOCK rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= _BLOCK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def cells(forest: Forest, partial: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that reach the same node of the growing tree and the same leaf of each tree before it have the same scores: they are a cell.

    The node and the first row of each cell, by node, and the cell of each row.
    """
    node = descend(partial, bins)
    code, bound = node, len(partial) + 1
    for splits in forest.splits:
        if bound * (len(splits) + 1) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            bound = len(code)
        code, bound = code * (len(splits) + 1) + descend(splits, bins), bound * (len(splits) + 1)
    _, first, cell = np.unique(code, return_index=True, return_inverse=True)
    return node[first], first, cell


def _add(total: np.ndarray, forest: Forest, partial: np.ndarray, own: np.ndarray, y: np.ndarray) -> None:
    """Adds the rows (their bins and labels) to total (nodes, features x bins, sums).

    Scores are a cell's, so they are weighted by how many of its rows have a bin. Labels are 0 and 1, and their sums over _PART rows exact in 32 bits.
    """
    nodes, wide, _ = total.shape
    n, k = len(BALLS), own.shape[1]
    top = own.max(0).astype(np.int64) + 1  # bins that occur
    begins, feature = np.cumsum(top) - top, np.repeat(np.arange(k), top)
    value = np.arange(len(feature)) - begins[feature]
    at, value = feature * (wide // k) + value, value.astype(np.uint8)[:, None]
    of, first, cell = cells(forest, partial, own)
    order = np.argsort(cell, kind="stable")
    shown, cell, own, y = own[first], cell[order], own[order], y[order]
    for i in range(nodes):
        lo, hi = np.searchsorted(of, (i, i + 1))
        for c0 in range(lo, hi, _PART):
            c1 = min(c0 + _PART, hi)
            r0, r1 = np.searchsorted(cell, (c0, c1))
            counts = np.bincount(((cell[r0:r1, None] - c0) * len(at) + (own[r0:r1] + begins)).ravel(), minlength=(c1 - c0) * len(at))
            p = sigmoid(forest.scores(shown[c0:c1]))
            total[i][at] += counts.reshape(-1, len(at)).T.astype(float) @ np.concatenate((p, p * (1 - p), np.ones((len(p), 1))), 1)
        r0, r1 = np.searchsorted(cell, (lo, hi))
        for r in range(r0, r1, _PART):
            rows = slice(r, min(r + _PART, r1))
            hot = np.ascontiguousarray(own[rows].T)[feature] == value
            total[i][at, :n] -= hot.astype(np.float32) @ y[rows].astype(np.float32)


def histograms(data: DataFrame, forests: dict[int, Forest], partial: dict[int, np.ndarray], level: int, n_features: int, bins: int) -> DataFrame:
    """(step, node, feature, bin, sums): of the rows that a step may learn from and that reach the node, first and second
    derivatives of the loss by ball, and last their number.

    data: idx, next_mask, next_blue, bins. A step s learns from rows of idx <= s - 2, whose next draw it knows. partial:
    the splits of the tree that is growing.
    """
    nodes, width = 1 << level, 2 * len(BALLS) + 1

    def run(batches):
        total = {s: np.zeros((nodes, n_features * bins, width)) for s in forests}
        for b in _blocks(batches):
            idx, own = b.column(0).to_numpy(), _unpack(b.column(3), n_features)
            y = labels(b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.int64))
            for s, forest in forests.items():
                seen = idx <= s - 2
                if seen.any():
                    _add(total[s], forest, partial[s], *((own, y) if seen.all() else (own[seen], y[seen])))
        rows = [(s, k, i // bins, i % bins, sums[k, i].tolist()) for s, sums in total.items() for k in range(nodes) for i in np.flatnonzero(sums[k, :, -1])]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["step", "node", "feature", "bin", "sums"])

    parts = data.select("idx", "next_mask", "next_blue", "bins").mapInArrow(run, "step long, node int, feature int, bin int, sums array<double>")
    return parts.groupBy("step", "node", "feature", "bin").agg(F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums"))


def best_split(hist: pd.DataFrame, n_features: int, bins: int, settings: Settings) -> tuple[int, int, float, np.ndarray, np.ndarray]:
    """(feature, bin, gain, sums left, sums right) of one node's histograms; without a split that gains, all rows go left."""
    sums = np.zeros((n_features, bins, 2 * len(BALLS) + 1))
    sums[hist["feature"], hist["bin"]] = np.stack(hist["sums"].to_list())
    left = sums.cumsum(1)
    whole = left[:, -1:, :]
    gains = split_gains(left, whole, settings)
    best = int(np.argmax(gains))
    f, b = divmod(best, bins)
    if not gains[f, b] > 1e-9:
        return 0, bins - 1, 0.0, whole[0, 0], np.zeros_like(whole[0, 0])
    return f, b, float(gains[f, b]), left[f, b], whole[f, 0] - left[f, b]


def split_gains(left: np.ndarray, whole: np.ndarray, settings: Settings) -> np.ndarray:
    """What each split takes off the loss, over all balls; -inf where a side has too few rows."""
    n = len(BALLS)
    worth = lambda x: (x[..., :n] ** 2 / (x[..., n : 2 * n] + settings.ridge)).sum(-1) / 2
    right = whole - left
    gains = worth(left) + worth(right) - worth(whole)
    return np.where(np.minimum(left[..., -1], right[..., -1]) >= settings.least, gains, -np.inf)


def first_gains(spark: SparkSession, rows: DataFrame, forests: dict[int, Forest], cuts: dict[str, list[float]], settings: Settings) -> DataFrame:
    """(step, feature, cut, n_left, gain) of every split that a first tree's root could have."""
    names, bins = list(cuts), settings.bins
    hist = histograms(rows, forests, {s: np.zeros((0, 2), np.int64) for s in forests}, 0, len(names), bins)

    def score(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros((bins, 2 * len(BALLS) + 1))
        sums[part["bin"]] = np.stack(part["sums"].to_list())
        left, own = sums.cumsum(0), cuts[names[key[1]]]
        gains = split_gains(left, left[-1], settings)
        return pd.DataFrame([(key[0], names[key[1]], c, int(left[b, -1]), gains[b]) for b, c in enumerate(own) if np.isfinite(gains[b])], columns=["step", "feature", "cut", "n_left", "gain"])

    return hist.groupBy("step", "feature").applyInPandas(score, "step long, feature string, cut double, n_left long, gain double")


class BoostScorer:
    """A learned scorer for backtests and analyses, in place of SqlScorer: (step, color, ball, prob).

    A step learns from the rows whose next draw it knows, warm-up aside, and predicts from the last one,
    whose null features take the means of what the step has seen. A ball that always or never came has no
    row; scores() reads that as 0. Bins come from what the first step has seen, so no step sees what comes after it.
    ``at_once``: how many steps grow side by side, which bounds a task's memory (about 3 MB a step at depth 3).
    """

    def __init__(self, features: list[str] | None = None, settings: Settings | None = None, at_once: int = 50):
        self.features, self.settings, self.at_once = features or dr.FEATURES, settings or Settings(), at_once

    def prepared(self, spark: SparkSession, draws: DataFrame, first_step: int) -> tuple[DataFrame, DataFrame, dict]:
        """(features and next draws by idx, training rows binned, cut points)."""
        ahead = dr.next_labels(draws).select("idx", "next_mask", "next_blue")
        data = materialised(spark, dr.features(draws).select("idx", *self.features).join(ahead, "idx", "left"), "boost-rows")
        known = data.where((F.col("idx") >= WARM_UP) & F.col("next_mask").isNotNull()).dropna(subset=self.features)
        cuts = cut_points(known.where(F.col("idx") <= first_step - 2), self.features, self.settings.bins)
        return data, materialised(spark, binned(known, cuts, ["idx", "next_mask", "next_blue"]), "boost-bins"), cuts

    def start(self, spark: SparkSession, draws: DataFrame, first_step: int, last_step: int) -> dict[int, Forest]:
        """Forests without trees: the log odds of each ball in what a step has seen, -inf and inf for never and always."""
        events = drawn(draws.where(F.col("idx") > WARM_UP)).withColumn("weight", F.lit(1.0))
        came = running_totals(events, grid(spark, first_step, last_step), ["color", "ball"], steps=(first_step, last_step))
        out, place = {s: Forest(np.zeros(len(BALLS))) for s in range(first_step, last_step + 1)}, {b: i for i, b in enumerate(BALLS)}
        for r in came.collect():  # 49 rows a step
            n = r.step - WARM_UP - 1
            with np.errstate(divide="ignore"):
                out[r.step].base[place[r.color, r.ball]] = np.log(r.total / (n - r.total)) if n > r.total else np.inf if n > 0 else -np.inf
        return out

    def fit(self, spark: SparkSession, rows: DataFrame, forests: dict[int, Forest]) -> dict[int, Forest]:
        """Grows the trees of all forests, a job a level."""
        st, k = self.settings, len(self.features)

        def choose(key: tuple, hist: pd.DataFrame) -> pd.DataFrame:
            f, b, gain, left, right = best_split(hist, k, st.bins, st)
            return pd.DataFrame({"step": [key[0]], "node": [key[1]], "feature": [f], "bin": [b], "gain": [gain], "left": [left.tolist()], "right": [right.tolist()]})

        schema = "step long, node int, feature int, bin int, gain double, left array<double>, right array<double>"
        for _ in range(st.trees):
            growing = {s: np.zeros((0, 2), np.int64) for s in forests}
            for level in range(st.depth):
                hist = histograms(rows, forests, growing, level, k, st.bins)
                found = hist.groupBy("step", "node").applyInPandas(choose, schema).collect()  # a row a node
                at = {(r.step, r.node): r for r in found}
                nodes, ends = 1 << level, {}
                for s in forests:
                    own = [at.get((s, i)) for i in range(nodes)]
                    growing[s] = np.concatenate((growing[s], [(r.feature, r.bin) if r else (0, st.bins - 1) for r in own]))
                    ends[s] = [x for r in own for x in ((r.left, r.right) if r else (None, None))]
            n = len(BALLS)
            for s, f in forests.items():
                sums = np.array([x if x is not None else [0.0] * (2 * n + 1) for x in ends[s]])
                f.splits.append(growing[s])
                f.leaves.append(-st.rate * sums[:, :n] / (sums[:, n : 2 * n] + st.ridge))
        return forests

    def last_rows(self, data: DataFrame, first_step: int, last_step: int) -> DataFrame:
        """idx and features of the row before each step, nulls filled with the means of the rows before it; only the first rows have any."""
        last = data.where(F.col("idx").between(first_step - 1, last_step - 1)).select("idx", *self.features)
        early = data.where(F.col("idx") <= WARM_UP).select("idx", *self.features)  # six rows
        seen = early.select(F.col("idx").alias("at"), *(F.col(c).alias(f"_{c}") for c in self.features))
        means = early.select("idx").join(F.broadcast(seen), F.col("at") <= F.col("idx")).groupBy("idx").agg(*(F.avg(f"_{c}").alias(f"_{c}") for c in self.features))
        return last.join(F.broadcast(means), "idx", "left").select("idx", *(F.coalesce(F.col(c).cast("double"), F.col(f"_{c}"), F.lit(0.0)).alias(c) for c in self.features))

    def probabilities(self, spark: SparkSession, draws: DataFrame, first_step: int, last_step: int) -> DataFrame:
        data, rows, cuts = self.prepared(spark, draws, first_step)
        out = []
        for s0 in range(first_step, last_step + 1, self.at_once):
            s1 = min(s0 + self.at_once - 1, last_step)
            forests = self.fit(spark, rows, self.start(spark, draws, s0, s1))
            for r in binned(self.last_rows(data, s0, s1), cuts, ["idx"]).collect():  # a row a step
                f = forests[r.idx + 1]
                score = f.scores(np.frombuffer(bytes(r.bins), np.uint8)[None])[0]
                out += [(r.idx + 1, c, b, float(sigmoid(x))) for (c, b), x in zip(BALLS, score) if np.isfinite(x)]
        return spark.createDataFrame(out, "step long, color string, ball int, prob double")
