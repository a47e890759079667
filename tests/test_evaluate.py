"""Evaluation operators vs brute-force numpy definitions (ties included)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arrears import constants as K
from arrears.functions import stats
from arrears.operators import compare as cmp
from arrears.operators import evaluate as ev


def _data(n=600, seed=5):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    s = np.round(np.clip(0.3 * y + rng.normal(0.35, 0.2, n), 0, 1), 2)   # many ties
    return pd.DataFrame({"y": y, "score": s, "model": "m"})


def _auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])


def _ap(y, s):
    order = np.unique(s)[::-1]
    P = y.sum()
    ap, prev = 0.0, 0.0
    for t in order:
        tp = ((s >= t) & (y == 1)).sum()
        fp = ((s >= t) & (y == 0)).sum()
        r = tp / P
        ap += (r - prev) * tp / (tp + fp)
        prev = r
    return ap


def test_auc_ap(spark):
    pdf = _data()
    df = spark.createDataFrame(pdf)
    a = ev.auc(df, by=["model"]).first()["auc"]
    p = ev.average_precision(df, by=["model"]).first()["average_precision"]
    assert a == pytest.approx(_auc(pdf.y.values, pdf.score.values), abs=1e-12)
    assert p == pytest.approx(_ap(pdf.y.values, pdf.score.values), abs=1e-12)
    # AUC is invariant under a monotone transform of the score
    a2 = ev.auc(df.withColumn("score", F.exp(F.col("score") * 3)), by=["model"]).first()["auc"]
    assert a2 == pytest.approx(a, abs=1e-12)


def test_roc_points_drop_collinear(spark):
    pdf = _data(300, 7)
    got = ev.roc_points(spark.createDataFrame(pdf), by=["model"]).toPandas().sort_values("threshold", ascending=False)
    s, y = pdf.score.values, pdf.y.values
    th = np.unique(s)[::-1]
    tps = np.array([((s >= t) & (y == 1)).sum() for t in th])
    fps = np.array([((s >= t) & (y == 0)).sum() for t in th])
    keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True]
    want = np.r_[np.inf, th[keep]]
    assert np.allclose(got.threshold.to_numpy(), want)


def test_grid_counts_vs_naive_twin(spark):
    """Slot histogram == naive rows x grid comparison."""
    pdf = _data(400, 9)
    df = spark.createDataFrame(pdf)
    got = ev.grid_counts(df, K.THRESHOLD_GRID, ["model"]).toPandas().sort_values("i")
    g = spark.createDataFrame([(i, t) for i, t in enumerate(K.THRESHOLD_GRID)], "i int, t double")
    naive = df.join(F.broadcast(g), F.lit(True)).groupBy("i").agg(
        F.sum(((F.col("score") >= F.col("t")) & (F.col("y") == 1)).cast("int")).alias("tp"),
        F.sum(((F.col("score") >= F.col("t")) & (F.col("y") == 0)).cast("int")).alias("fp")).toPandas().sort_values("i")
    assert (got.tp.to_numpy() == naive.tp.to_numpy()).all() and (got.fp.to_numpy() == naive.fp.to_numpy()).all()
    # monotone in the threshold
    assert (np.diff(got.tp.to_numpy()) <= 0).all() and (np.diff(got.fp.to_numpy()) <= 0).all()


def test_best_threshold_rules(spark):
    pdf = pd.DataFrame({"y": [0, 0, 0], "score": [0.1, 0.2, 0.3], "model": "m"})
    b = ev.best_threshold(spark.createDataFrame(pdf), ["model"]).first()
    assert b.threshold == 0.5 and b.best_score == 0.0          # nothing above 0 -> 0.5
    pdf = pd.DataFrame({"y": [1, 1, 0, 0], "score": [0.9, 0.8, 0.2, 0.1], "model": "m"})
    b = ev.best_threshold(spark.createDataFrame(pdf), ["model"]).first()
    first = next(t for t in K.THRESHOLD_GRID if t > 0.2)         # F1 = 1 from here to 0.8
    assert b.threshold == first and b.best_score == 1.0            # the first maximum wins


def test_confusion_and_one_class(spark):
    pdf = pd.DataFrame({"y": [1, 1, 1], "score": [0.9, 0.4, 0.5], "model": "m"})
    r = ev.rates(ev.confusion(spark.createDataFrame(pdf), 0.5, ["model"])).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (2, 0, 0, 1) and r.precision == 1.0


def test_mcnemar_golden(spark):
    """Convention check from published counts: b=120, c=44."""
    df = spark.createDataFrame([(120, 44)], "b long, c long")
    bc = F.col("b") + F.col("c")
    r = df.select((F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2) / bc).alias("chi2")) \
        .select("chi2", stats.chi2_1_sf(F.col("chi2")).alias("p")).first()
    assert r.chi2 == pytest.approx(34.2988, abs=1e-4)
    assert r.p == pytest.approx(4.7268e-09, rel=1e-3)
    assert min(1.0, 2 * stats.binom_cdf_half(44, 164)) == pytest.approx(2.4612e-09, rel=1e-3)


def test_special_functions():
    assert stats.t_ppf(0.975, 29) == pytest.approx(2.0452296, abs=1e-6)
    assert stats.t_two_sided(2.0452296, 29) == pytest.approx(0.05, abs=1e-7)
    for x in (0.1, 1.0, 2.5, 5.0):
        assert stats.betainc(2.0, 3.0, x / 6) == pytest.approx(
            sum(math.comb(4, j) * (x / 6) ** j * (1 - x / 6) ** (4 - j) for j in range(2, 5)), rel=1e-10)


def test_tails_on_rows(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (34.2988,), (None,)], "x double")
    got = [r[0] for r in df.select(stats.chi2_1_sf(F.col("x"))).collect()]
    assert got[:3] == [pytest.approx(math.erfc(math.sqrt(v / 2)), rel=1e-14) for v in (0.0, 1.0, 34.2988)] and got[3] is None


def test_bootstrap_weights_and_ties(spark):
    """Weights are Poisson(1), and buckets add up to what one sorted table gives."""
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(4)
    n, boot = 4000, 8
    score, y, h = rng.integers(0, 50, n) / 50, rng.integers(0, 2, n), rng.integers(0, 2 ** 32, n)
    def totals(on):
        t = pa.table({"model": ["a"] * on.sum(), "_bkt": [0.0] * on.sum(), "score": score[on], "y": y[on], "_h": h[on]})
        r = cmp._bucket_totals(boot, 0.5)(t).to_pydict()
        return {c: np.array(r[c][0]) for c in ("P", "N", "U", "tp", "fp")}
    whole, low, high = totals(score >= 0), totals(score < 0.3), totals(score >= 0.3)
    assert np.allclose(whole["U"], low["U"] + high["U"] + high["P"] * low["N"])
    assert np.allclose(whole["tp"], low["tp"] + high["tp"]) and np.allclose(whole["P"], low["P"] + high["P"])
    assert abs((whole["P"] + whole["N"]).mean() / n - 1) < 0.03


def test_null_and_nan_scores_are_below_every_threshold(spark):
    nan = float("nan")
    rows = [(1, 0.9), (0, 0.8), (1, 0.1), (0, 0.2), (1, nan), (0, nan), (0, None)]
    df = spark.createDataFrame(rows, "y int, score double")
    from arrears.operators import evaluate as ev
    cm = ev.confusion(df, 0.5).first()
    assert (cm.tp, cm.fp, cm.tn, cm.fn) == (1, 1, 3, 2)
    g = ev.grid_counts(df, [0.5]).first()
    assert (g.tp, g.fp, g.tn, g.fn) == (1, 1, 3, 2)
    assert abs(ev.auc(df).first().auc - 0.5) < 1e-12
