"""Networks: the embedding MLP's forward pass (M2, F10-F12, P14) and a trained perceptron.

Architecture of the first (the reference's): scale the continuous features, look up one
embedding per categorical code (clipped to the table), concatenate, dense + GELU, residual
blocks (dense + GELU + skip), dense to one logit, sigmoid.

* ``score`` - forward pass per Arrow batch (numpy matmuls, ``scoring``), weights
  broadcast once.  An embedding is multiplied with its part of the first layer beforehand, so
  a code costs one row look-up.  The weights are an artifact: the reference ships none, and
  ``init_params`` makes a network of its size.
* ``train_perceptron`` - MLlib's ``MultilayerPerceptronClassifier`` on the scaled features.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.operators.scoring import score_rows

SQRT2 = math.sqrt(2.0)


# FIXED VALUES: Abramowitz & Stegun 7.1.26 erf coefficients (p, a1..a5),
# the approximation the reference's TypeScript scorer uses (|error| < 1.5e-7).
AS_P = 0.3275911
AS_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _erf(x: np.ndarray) -> np.ndarray:
    s = np.sign(x)
    a = np.abs(x)
    t = 1.0 / (1.0 + AS_P * a)
    poly = ((((AS_A[4] * t + AS_A[3]) * t + AS_A[2]) * t + AS_A[1]) * t + AS_A[0]) * t
    return s * (1.0 - poly * np.exp(-a * a))


def gelu(x: np.ndarray) -> np.ndarray:
    """0.5 x (1 + erf(x / sqrt 2))."""
    return 0.5 * x * (1.0 + _erf(x / SQRT2))


def emb_dim(card: int) -> int:
    return min(50, (card + 1) // 2)


def init_params(n_cont: int, cards: Sequence[int], hidden: int = 192, n_blocks: int = 4, seed: int = 42) -> dict:
    rng = np.random.default_rng(seed)
    embs = [rng.normal(0, 0.1, (c, emb_dim(c))) for c in cards]
    d_in = n_cont + sum(e.shape[1] for e in embs)

    def lin(o, i):
        return rng.normal(0, math.sqrt(2.0 / i), (o, i)), np.zeros(o)

    p = {"emb": embs, "in_w": None, "in_b": None, "blocks": [], "out_w": None, "out_b": None}
    p["in_w"], p["in_b"] = lin(hidden, d_in)
    for _ in range(n_blocks):
        w, b = lin(hidden, hidden)
        p["blocks"].append([w * 0.1, b])
    p["out_w"], p["out_b"] = lin(1, hidden)
    return p


def prepared(p: dict, n_cont: int) -> dict:
    """Weights for ``forward``: each embedding table times its columns of the first layer."""
    tables, at = [], n_cont
    for e in p["emb"]:
        tables.append(e @ p["in_w"][:, at:at + e.shape[1]].T)
        at += e.shape[1]
    return p | {"tables": tables, "cont_w": np.ascontiguousarray(p["in_w"][:, :n_cont].T)}


def forward(p: dict, xc: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Logits; xc: (n, n_cont) already scaled; codes: (n, n_cat) ints."""
    z = xc @ p["cont_w"] + p["in_b"]
    for j, table in enumerate(p["tables"]):
        z += table[np.clip(codes[:, j], 0, table.shape[0] - 1)]   # P14
    h = gelu(z)
    for w, b in p["blocks"]:
        h = gelu(h @ w.T + b) + h
    return (h @ p["out_w"].T + p["out_b"])[:, 0]


def sigmoid(x: np.ndarray) -> np.ndarray:
    """F10."""
    return 1.0 / (1.0 + np.exp(-x))


# ---------------------------------------------------------------- Spark plumbing
def fit_scaler(df: DataFrame, cont: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population std per continuous feature in ONE
    aggregate (zero std -> scale 1)."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cont)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cont)]).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(len(cont))])
    sd = np.array([row[f"s{i}"] or 0.0 for i in range(len(cont))])
    return mean, np.where(sd > 0, sd, 1.0)


def network(df: DataFrame, cont: Sequence[str], cats: Sequence[str], cards: Sequence[int], hidden: int = 192,
            n_blocks: int = 4, seed: int = 42) -> dict:
    """A network of the given size with the scaler fitted on ``df`` and seeded weights."""
    mean, scale = fit_scaler(df, cont)
    return prepared(init_params(len(cont), cards, hidden, n_blocks, seed), len(cont)) | {
        "scaler_mean": mean, "scaler_scale": scale, "cont": list(cont), "cats": list(cats)}


def train_perceptron(df: DataFrame, features: Sequence[str], label: str = "y", hidden: Sequence[int] = (32, 16),
                     steps: int = 40, seed: int = 42):
    """An MLlib pipeline - assemble, scale to unit deviation, multilayer perceptron."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="_features", withMean=True),
        MultilayerPerceptronClassifier(featuresCol="_features", labelCol=label, layers=[len(features), *hidden, 2],
                                       maxIter=steps, seed=seed)]).fit(df)


def perceptron_score(df: DataFrame, model, keep: Sequence[str], out: str = "probability") -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias(out))


class PerceptronScorer:
    """A fitted perceptron pipeline as a scorer: its scaler and layers as arrays."""

    def __init__(self, model) -> None:
        _, scaler, net = model.stages
        std = scaler.std.toArray()
        self.mean, self.factor = scaler.mean.toArray(), np.where(std > 0, 1 / np.where(std > 0, std, 1), 0.0)
        sizes, weights, self.layers, at = list(net.getLayers()), net.weights.toArray(), [], 0
        for n_in, n_out in zip(sizes, sizes[1:]):
            w = weights[at:at + n_in * n_out].reshape(n_in, n_out)
            self.layers.append((w, weights[at + n_in * n_out:at + (n_in + 1) * n_out]))
            at += (n_in + 1) * n_out

    def prepare(self):
        return self.probability

    def probability(self, X: np.ndarray) -> np.ndarray:
        h = (X - self.mean) * self.factor
        for w, b in self.layers[:-1]:
            h = sigmoid(h @ w + b)
        w, b = self.layers[-1]
        z = h @ w + b
        e = np.exp(z - z.max(1, keepdims=True))
        return e[:, 1] / e.sum(1)


class NetworkScorer:
    """The embedding network as a scorer over ``features``."""

    def __init__(self, model: dict, features: Sequence[str]) -> None:
        self.model = model
        self.cont = [list(features).index(f) for f in model["cont"]]
        self.cats = [list(features).index(f) for f in model["cats"]]

    def prepare(self):
        return self.probability

    def probability(self, X: np.ndarray) -> np.ndarray:
        m = self.model
        with np.errstate(invalid="ignore"):
            xc = (X[:, self.cont] - m["scaler_mean"]) / m["scaler_scale"]  # non-finite -> 0
        xc[~np.isfinite(xc)] = 0.0
        return sigmoid(forward(m, xc, np.nan_to_num(X[:, self.cats]).astype(np.int64)))


def score(df: DataFrame, model: dict, keep: Sequence[str], out: str = "probability") -> DataFrame:
    """M2: forward pass per Arrow batch; the weights travel once as a broadcast."""
    features = [*model["cont"], *model["cats"]]
    return score_rows(df, {out: NetworkScorer(model, features)}, features, keep)
