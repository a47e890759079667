"""Tree ensembles: distributed training (M11, M14, M16, M18), the node table
(D13), table-driven scoring (M1, M17) and per-row contributions (M3).

Training is MLlib (``GBTClassifier`` / ``RandomForestClassifier`` with
``weightCol``).  A fitted ensemble becomes a node table
``(tree, node, left, right, feature, threshold, default_left, value, cover)``
read from the node data that MLlib saves: a DataFrame, no text is parsed and no
pass over the rows is needed for the covers.  The convention is the
reference's: go left when ``x < threshold``, missing goes to the default side.
Leaf values add up: of boosted trees to a margin (``link`` logistic: probability =
sigmoid of the sum plus ``logit(base_score)``), of forests to the mean of the leaves' class
shares (``link`` identity).  MLlib's ``x <= t`` becomes ``x < nextafter(t, +inf)``.

Scoring bins each feature of an Arrow batch once, by the thresholds that the ensemble has on
it.  Trees of up to ``FLAT_DEPTH`` levels then need no gathers but one: all comparisons of a
tree run over contiguous columns and the leaf's number is put together from the lowest level
upwards.  Deeper trees are walked level by level.  Contributions decompose every tree into
the paths of its leaves: a path is an interval of bins per feature, and what a leaf gives
each of them is tabulated once for all patterns of met and missed intervals.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrears.operators.scoring import score_rows
from arrears.session import checkpoint_dir, cut_lineage

MAX_BROADCAST_NODES = 5_000_000

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("default_left", T.IntegerType()), T.StructField("value", T.DoubleType()),
])


# ---------------------------------------------------------------- training
def train(df: DataFrame, features: Sequence[str], label: str = "y", kind: str = "gbt",
          weight_col: str | None = None, seed: int = 42, **params):
    """Fit an MLlib ensemble on the feature columns (one vector column
    assembled JVM-side).  ``weight_col`` carries M14 / M18 weights."""
    va = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    data = va.transform(df).select("_features", F.col(label).cast("double").alias("_label"),
                                   *([F.col(weight_col).cast("double").alias("_w")] if weight_col else []))
    return fit(data, kind, "_w" if weight_col else None, seed, **params)


def fit(data: DataFrame, kind: str, weight_col: str | None = None, seed: int = 42, **params):
    """An MLlib ensemble on assembled rows: ``_features``, ``_label`` and a weight column."""
    common = dict(featuresCol="_features", labelCol="_label", seed=seed)
    if weight_col:
        common["weightCol"] = weight_col
    if kind == "gbt":
        est = GBTClassifier(maxIter=params.get("n_trees", 20), maxDepth=params.get("max_depth", 4),
                            stepSize=params.get("step", 0.1), **common)
    elif kind == "rf":
        est = RandomForestClassifier(numTrees=params.get("n_trees", 20), maxDepth=params.get("max_depth", 6),
                                     **common)
    else:
        raise ValueError(kind)
    return est.fit(data)


def importances(model, features: Sequence[str], spark: SparkSession, name: str) -> DataFrame:
    """MLlib feature importances as a long (model, feature, importance) table."""
    imp = model.featureImportances.toArray().tolist()
    return spark.createDataFrame([(name, f, float(v)) for f, v in zip(features, imp)],
                                 "model string, feature string, importance double")


# ---------------------------------------------------------------- export
COVER = T.StructField("cover", T.LongType())
#: What the sum of a row's leaves is: a margin, or already a probability.
LINKS = {"gbt": "logistic", "rf": "identity"}


def node_table(spark: SparkSession, model, kind: str = "gbt") -> DataFrame:
    """The node table of a fitted MLlib ensemble, from its saved node data, staged.

    A boosted tree's leaf gives twice its weighted prediction (MLlib's probability is
    1 / (1 + exp(-2 m))), a forest's the share of class 1 among its weighted rows, over the
    number of trees."""
    if kind not in LINKS:
        raise ValueError(kind)
    path = f"{checkpoint_dir(spark)}/models/{uuid.uuid4().hex}"
    model.write().save(path)
    n = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    leaf = F.col("leftChild") < 0
    stats = F.col("impurityStats")
    if kind == "gbt":
        weights = F.array(*[F.lit(float(w)) for w in model.treeWeights])
        value = 2.0 * F.get(weights, F.col("tree")) * F.col("prediction")
    else:
        value = stats[1] / (stats[0] + stats[1]) / F.lit(float(model.getNumTrees))
    threshold = F.col("split.leftCategoriesOrThreshold")[0]
    return cut_lineage(next_after(n.select(
        "tree", F.col("id").alias("node"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.when(leaf, -1).otherwise(F.col("split.featureIndex")).cast("int").alias("feature"),
        F.when(leaf, 0.0).otherwise(threshold).alias("threshold"), F.lit(1).alias("default_left"),
        F.when(leaf, value).otherwise(0.0).alias("value"), F.col("rawCount").alias("cover"))))


def next_after(nodes: DataFrame) -> DataFrame:
    """Thresholds of ``x <= t`` as those of ``x < t'``: the next double above."""
    def run(batches):
        for pdf in batches:
            pdf["threshold"] = np.where(pdf["left"] >= 0, np.nextafter(pdf["threshold"], np.inf), 0.0)
            yield pdf
    return nodes.mapInPandas(run, T.StructType([*NODE_SCHEMA.fields, COVER]))


def base_margin(kind: str = "gbt", base_score: float = 0.5) -> float:
    """logit(base_score); MLlib ensembles fold everything into the leaves."""
    return -math.log(1.0 / base_score - 1.0)


def collected(nodes: DataFrame) -> pd.DataFrame:
    """The node table on the driver; its size is checked first."""
    n = nodes.count()
    if n > MAX_BROADCAST_NODES:
        raise ValueError(f"node table too large to broadcast: {n}")
    return nodes.toPandas().sort_values(["tree", "node"]).reset_index(drop=True)


# ---------------------------------------------------------------- scoring
FLAT_DEPTH = 6


class Forest:
    """An ensemble over bins: features by the thresholds that it has on them."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
        inner = nodes["left"].to_numpy() >= 0
        feature, threshold = nodes["feature"].to_numpy(np.int64), nodes["threshold"].to_numpy(float)
        self.cuts = {int(f): np.unique(threshold[inner & (feature == f)]) for f in np.unique(feature[inner])}
        most = max((len(c) for c in self.cuts.values()), default=0)
        self.kind = np.uint8 if most < 255 else np.uint16 if most < 65535 else np.int32
        self.missing = int(np.iinfo(self.kind).max)  # bin of a missing value
        self.trees = []
        for _, g in nodes.groupby("tree", sort=True):
            left, right = g["left"].to_numpy(np.int64), g["right"].to_numpy(np.int64)
            at = np.array([np.searchsorted(self.cuts[f], t) if f >= 0 and f in self.cuts else 0
                           for f, t in zip(g["feature"], g["threshold"])], np.int64)
            cover = g["cover"].to_numpy(float) if "cover" in g else np.zeros(len(g))
            self.trees.append(dict(left=left, right=right, feature=g["feature"].to_numpy(np.int64), cut=at,
                                   default_left=g["default_left"].to_numpy() == 1, value=g["value"].to_numpy(float),
                                   cover=cover))
        for t in self.trees:
            t["depth"] = self._depth(t)
            if t["depth"] <= FLAT_DEPTH:
                t["leaves"] = self._leaves(t)

    @staticmethod
    def _depth(t: dict) -> int:
        level, depth = [0], 0
        while True:
            level = [c for i in level if t["left"][i] >= 0 for c in (t["left"][i], t["right"][i])]
            if not level:
                return depth
            depth += 1

    @staticmethod
    def _leaves(t: dict) -> np.ndarray:
        """Values of the 2^depth places of the completed tree; a short branch fills its places."""
        out = np.zeros(1 << t["depth"])

        def fill(i: int, first: int, width: int) -> None:
            if t["left"][i] < 0:
                out[first:first + width] = t["value"][i]
            else:
                fill(t["left"][i], first, width // 2)
                fill(t["right"][i], first + width // 2, width // 2)

        fill(0, 0, len(out))
        return out

    def bins(self, X: np.ndarray) -> dict[int, np.ndarray]:
        """Per used feature the number of its thresholds at or below each value."""
        out = {}
        for f, cuts in self.cuts.items():
            b = np.searchsorted(cuts, X[:, f], "right").astype(self.kind)
            gone = np.isnan(X[:, f])
            if gone.any():
                b[gone] = self.missing
            out[f] = b
        return out

    def goes_right(self, t: dict, i: int, bins: dict, any_missing: bool) -> np.ndarray:
        b = bins[int(t["feature"][i])]
        right = b > t["cut"][i]
        return right & (b != self.missing) if any_missing and t["default_left"][i] else right

    def places(self, t: dict, i: int, depth: int, bins: dict, any_missing: bool) -> np.ndarray | int:
        """Leaf place of every row below node ``i``, ``depth`` levels above the leaves."""
        if t["left"][i] < 0:
            return 0
        right = self.goes_right(t, i, bins, any_missing)
        half = 1 << (depth - 1)
        if depth == 1:
            return right.view(np.uint8)
        low = self.places(t, t["left"][i], depth - 1, bins, any_missing)
        high = self.places(t, t["right"][i], depth - 1, bins, any_missing)
        return np.where(right, np.uint8(half) + high if isinstance(high, int) else high + np.uint8(half), np.uint8(low) if isinstance(low, int) else low)

    def walked(self, t: dict, bins: dict, n: int) -> np.ndarray:
        """Leaf values of a deep tree, level by level."""
        table = np.array([bins.get(f, np.zeros(n, self.kind)) for f in range(max(bins, default=0) + 1)])
        at, rows = np.zeros(n, np.int64), np.arange(n)
        while True:
            on = np.flatnonzero(t["left"][at] >= 0)
            if not len(on):
                return t["value"][at]
            i = at[on]
            b = table[t["feature"][i], rows[on]]
            right = np.where(b == self.missing, ~t["default_left"][i], b > t["cut"][i])
            at[on] = np.where(right, t["right"][i], t["left"][i])

    def total(self, X: np.ndarray) -> np.ndarray:
        """Sum of the rows' leaves."""
        out = np.zeros(len(X))
        bins = self.bins(X)
        any_missing = any((b == self.missing).any() for b in bins.values())
        for t in self.trees:
            if t["depth"] > FLAT_DEPTH:
                out += self.walked(t, bins, len(X))
            elif t["depth"] == 0:
                out += t["value"][0]
            else:
                out += t["leaves"].take(self.places(t, 0, t["depth"], bins, any_missing))
        return out

    def probability(self, X: np.ndarray, link: str, base: float) -> np.ndarray:
        if not self.trees:
            return np.full(len(X), 0.5)
        return self.total(X) if link == "identity" else 1.0 / (1.0 + np.exp(-(base + self.total(X))))


class TreeScorer:
    """An ensemble as a scorer: the collected node table, its size checked."""

    def __init__(self, nodes: DataFrame, link: str = "logistic", base_score: float = 0.5) -> None:
        self.table, self.link, self.base = collected(nodes), link, base_margin(base_score=base_score)

    def prepare(self):
        forest = Forest(self.table)
        return lambda X: forest.probability(X, self.link, self.base)


def score(df: DataFrame, nodes: DataFrame, features: Sequence[str], keep: Sequence[str],
          out: str = "probability", base_score: float = 0.5, link: str = "logistic") -> DataFrame:
    """M1: ``keep`` columns + probability; an empty ensemble scores 0.5."""
    return score_rows(df, {out: TreeScorer(nodes, link, base_score)}, features, keep)


# ---------------------------------------------------------------- contributions (M3)
def leaf_paths(t: dict) -> Iterator[tuple[float, list[tuple[int, int, int, bool, float]]]]:
    """(value, path) of every leaf; a path holds per feature: the interval of bins that stays
    on it, whether a missing value does, and the share of rows that its splits let through."""
    def walk(i: int, path: dict):
        if t["left"][i] < 0:
            yield t["value"][i], [(f, *v) for f, v in path.items()]
            return
        f, cut = int(t["feature"][i]), int(t["cut"][i])
        low, high, gone, share = path.get(f, (0, 1 << 30, True, 1.0))
        for child, side, default in ((t["left"][i], (low, min(high, cut)), bool(t["default_left"][i])),
                                     (t["right"][i], (max(low, cut + 1), high), not t["default_left"][i])):
            yield from walk(child, path | {f: (*side, gone and default, share * t["cover"][child] / t["cover"][i])})

    yield from walk(0, {})


def path_table(shares: np.ndarray) -> np.ndarray:
    """(pattern, feature): what a leaf of value 1 gives each feature of its path if the row
    meets the intervals of the pattern's bits.

    For a feature, the others' product of (share + met * t) holds in its powers of t the sums
    over subsets by size, which Shapley weights then add up."""
    m = len(shares)
    met = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
    weights = [math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)]
    out = np.zeros((1 << m, m))
    for i in range(m):
        poly = np.zeros((1 << m, m))
        poly[:, 0] = 1.0
        for j in range(m):
            if j != i:
                grown = poly * shares[j]
                grown[:, 1:] += poly[:, :-1] * met[:, j:j + 1]
                poly = grown
        out[:, i] = (poly @ weights) * (met[:, i] - shares[i])
    return out


class Paths:
    """All paths of an ensemble with their tables, and the expected value."""

    def __init__(self, forest: Forest, base: float) -> None:
        self.forest, self.expected, self.leaves = forest, base, []
        for t in forest.trees:
            if t["cover"][0] <= 0:
                continue
            t = t | {"cover": np.maximum(t["cover"], 1e-300)}
            inner = t["left"] < 0
            self.expected += float((t["cover"][inner] * t["value"][inner]).sum() / t["cover"][0])
            for value, path in leaf_paths(t):
                if path and value:
                    self.leaves.append((path, value * path_table(np.array([p[4] for p in path]))))

    def contributions(self, X: np.ndarray) -> np.ndarray:
        """(row, feature) and the expected value in the last column."""
        bins = self.forest.bins(X)
        any_missing = {f: (b == self.forest.missing).any() for f, b in bins.items()}
        out = np.zeros((X.shape[1] + 1, len(X)))
        out[-1] = self.expected
        for path, table in self.leaves:
            pattern = np.zeros(len(X), np.int64 if len(path) > 8 else np.uint8)
            for k, (f, low, high, gone, _) in enumerate(path):
                b = bins[f]
                met = (b >= low) & (b <= min(high, self.forest.missing - 1))
                if any_missing[f] and gone:
                    met |= b == self.forest.missing
                pattern |= met.astype(pattern.dtype) << pattern.dtype.type(k)
            for k, (f, *_) in enumerate(path):
                out[f] += table[:, k].take(pattern)
        return out.T


def contribution_arrays(df: DataFrame, nodes_with_cover: DataFrame, features: Sequence[str], keep: Sequence[str],
                        base_score: float = 0.5) -> DataFrame:
    """M3: ``keep`` columns, ``phi`` (one contribution per feature, in their order) and
    ``expected``; the sum of both is the margin."""
    bn = df.sparkSession.sparkContext.broadcast(collected(nodes_with_cover))
    feats, keep = list(features), list(keep)
    base = base_margin(base_score=base_score)

    def run(batches):
        paths = Paths(Forest(bn.value), base)
        for pdf in batches:
            phi = paths.contributions(pdf[feats].to_numpy(np.float64, na_value=np.nan))
            yield pdf[keep].assign(phi=list(phi[:, :-1]), expected=phi[:, -1])

    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField("phi", T.ArrayType(T.DoubleType())),
                           T.StructField("expected", T.DoubleType())])
    return df.select(*keep, *[F.col(f).cast("double").alias(f) for f in feats if f not in keep]).mapInPandas(run, schema)


def contributions(df: DataFrame, nodes_with_cover: DataFrame, features: Sequence[str], key: str,
                  base_score: float = 0.5) -> DataFrame:
    """M3, long: per-row contributions of every feature, zeros included, plus the
    ``__base__`` expected value; sum over a row = margin."""
    dense = contribution_arrays(df, nodes_with_cover, features, [key], base_score)
    names = F.array(*[F.lit(f) for f in [*features, "__base__"]])
    return dense.select(key, F.posexplode(F.concat("phi", F.array("expected"))).alias("_i", "value")).select(
        key, F.get(names, F.col("_i")).alias("feature"), "value")


def top_contributions(arrays: DataFrame, features: Sequence[str], n: int = 10) -> DataFrame:
    """``top``, the N features with the greatest |contribution| (1 <= N <= 69), found
    inside each row's array."""
    if not 1 <= n <= 69:
        raise ValueError("top_n must be within 1..69")
    names = F.array(*[F.lit(f) for f in features])
    every = F.transform("phi", lambda v, i: F.struct(F.abs(v).alias("magnitude"), F.get(names, i).alias("feature"), v.alias("value")))
    return arrays.withColumn("top", F.slice(F.sort_array(every, asc=False), 1, n))
