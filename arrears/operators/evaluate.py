"""Evaluation of scores.

Input is a long scored table ``[*by, y, score]`` (one row per scored invoice
and model); ``by`` names the grouping (model, seed, replicate ...).  Nothing
is collected: every metric is a DataFrame with one row per group (or one row
per curve point).  Curves and ranks collapse ties first
(``groupBy(by, score)``) and then run bucketed running sums (``ordered``), so
no window ever spans all rows in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears import constants as K
from arrears.operators import ordered
from arrears.session import cut_lineage


def grouped(fn):
    """Run ``fn`` with a constant group column when no grouping is given, so
    per-group totals are joined back by key (never a cross join)."""
    import functools

    @functools.wraps(fn)
    def wrapper(df, *args, by: Sequence[str] = (), **kw):
        if by:
            return fn(df, *args, by=list(by), **kw)
        return fn(df.withColumn("_all", F.lit(0)), *args, by=["_all"], **kw).drop("_all")
    return wrapper


def _div0(a: Column, b: Column) -> Column:
    """a / b, 0 when the denominator is 0 (the reference's zero_division=0)."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def browser_grid() -> list[float]:
    """A26 grid: 0.05 then repeated ``+= 0.01`` while ``<= 0.95``."""
    out, t = [], 0.05
    while t <= 0.95:
        out.append(t)
        t += 0.01
    return out


def reachable(score: Column) -> Column:
    """The score as thresholds see it: null and NaN are below every one of them (Spark orders
    NaN above all numbers)."""
    s = score.cast("double")
    return F.when(s.isNull() | F.isnan(s), F.lit(-math.inf)).otherwise(s)


# ---------------------------------------------------------------- A19-A21
def confusion(df: DataFrame, threshold: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """Score >= t is positive; anything else, a null or NaN score included, is
    negative."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = reachable(F.col("score")) >= t
    y = F.col("y")
    agg = df.groupBy(*by).agg(
        F.sum(F.when((y == 1) & pred, 1).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when((y == 0) & pred, 1).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when((y == 0) & ~pred, 1).otherwise(0)).cast("long").alias("tn"),
        F.count(F.lit(1)).alias("n"))
    return agg.withColumn("fn", F.col("n") - F.col("tp") - F.col("fp") - F.col("tn")).drop("n")


def rates(cm: DataFrame) -> DataFrame:
    """Precision, recall, F1 (2TP / (2TP+FP+FN)), accuracy; 0 on empty."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return cm.select("*",
                     _div0(tp, tp + fp).alias("precision"),
                     _div0(tp, tp + fn).alias("recall"),
                     _div0(2 * tp, 2 * tp + fp + fn).alias("f1"),
                     _div0(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def browser_f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, (2 * (p * r)) / (p + r)).otherwise(F.lit(0.0))


def cell_shares(cm: DataFrame) -> DataFrame:
    """Confusion cells as share of the total (0 if empty)."""
    tot = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return cm.select("*", *[_div0(F.col(c), tot).alias(f"{c}_share") for c in ("tp", "fp", "tn", "fn")])


def class_report(df: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Per-class precision/recall/F1/support + macro and weighted rows."""
    cm = confusion(df, threshold, by)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rows = []
    for label, (a, b, c, sup) in (("1", (tp, fp, fn, tp + fn)), ("0", (tn, fn, fp, tn + fp))):
        p, r = _div0(a, a + b), _div0(a, a + c)
        rows.append(cm.select(*by, F.lit(label).alias("label"), p.alias("precision"), r.alias("recall"),
                              _div0(2 * a, 2 * a + b + c).alias("f1"), sup.cast("double").alias("support")))
    per = rows[0].unionByName(rows[1])
    avg = per.groupBy(*by).agg(
        F.avg("precision").alias("m_p"), F.avg("recall").alias("m_r"), F.avg("f1").alias("m_f"),
        F.sum("support").alias("n"),
        F.sum(F.col("precision") * F.col("support")).alias("w_p"),
        F.sum(F.col("recall") * F.col("support")).alias("w_r"),
        F.sum(F.col("f1") * F.col("support")).alias("w_f"))
    macro = avg.select(*by, F.lit("macro avg").alias("label"), F.col("m_p").alias("precision"),
                       F.col("m_r").alias("recall"), F.col("m_f").alias("f1"), F.col("n").alias("support"))
    weighted = avg.select(*by, F.lit("weighted avg").alias("label"),
                          _div0(F.col("w_p"), F.col("n")).alias("precision"),
                          _div0(F.col("w_r"), F.col("n")).alias("recall"),
                          _div0(F.col("w_f"), F.col("n")).alias("f1"), F.col("n").alias("support"))
    return per.unionByName(macro).unionByName(weighted)


# ---------------------------------------------------------------- ranks, AUC, AP, curves
def score_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ties collapsed: one row per (group, distinct score) with pos / neg; a row without a
    score has no rank."""
    return df.filter(F.col("score").isNotNull() & ~F.isnan("score")).groupBy(*by, "score").agg(
        F.sum("y").cast("long").alias("pos"),
        (F.count(F.lit(1)) - F.sum("y")).cast("long").alias("neg"))


@grouped
def auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A22 (W3): Mann-Whitney with mid-ranks: sum pos*(neg below + neg/2) / (P*N)."""
    return ranking_metrics(score_counts(df, by), by).select(*by, "auc")


def ranking_metrics(counts: DataFrame, by: Sequence[str], staged: bool = False) -> DataFrame:
    """AUC (A22) and average precision (A23) from one ascending pass over the distinct
    scores' counts; what lies above a score is the total less what lies below it.  The counts
    are read several times and staged once, here unless they are already."""
    counts = counts if staged else cut_lineage(counts)
    c = ordered.prefix_sums(counts, "score", ["pos", "neg"], partition_cols=by, materialize=False)
    tot = counts.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    j = c.join(tot, list(by))
    tps, fps = F.col("P") - F.col("pos_cum") + F.col("pos"), F.col("N") - F.col("neg_cum") + F.col("neg")
    return j.groupBy(*by).agg(
        (F.sum(F.col("pos") * (F.col("neg_cum") - F.col("neg") + F.col("neg") / 2.0))
         / (F.sum("pos") * F.sum("neg"))).alias("auc"),
        F.sum(_div0(F.col("pos"), F.col("P")) * (tps / (tps + fps))).alias("average_precision"))


def _desc_cum(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(group, score, pos, neg, tps, fps): cumulative counts for score >= v."""
    sc = ordered.prefix_sums(score_counts(df, by), "score", ["pos", "neg"],
                             partition_cols=by, descending=True)
    return sc.withColumnRenamed("pos_cum", "tps").withColumnRenamed("neg_cum", "fps")


@grouped
def average_precision(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum over distinct thresholds of (R_i - R_{i-1}) * P_i."""
    return ranking_metrics(score_counts(df, by), by).select(*by, "average_precision")


@grouped
def roc_points(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC points per distinct score (descending), collinear interior
    points dropped (second differences), starting at (0, 0, +inf)."""
    c = _desc_cum(df, by)
    c = ordered.with_next(c, "score", ["pos", "neg"], partition_cols=by, descending=True)
    tot = c.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                             F.max("score").alias("smax"), F.min("score").alias("smin"))
    c = c.join(tot, list(by))
    keep = (F.col("score") == F.col("smax")) | (F.col("score") == F.col("smin")) | \
        (F.col("neg_next") != F.col("neg")) | (F.col("pos_next") != F.col("pos"))
    pts = c.filter(keep).select(*by, F.col("score").alias("threshold"),
                                (F.col("fps") / F.col("N")).alias("fpr"),
                                (F.col("tps") / F.col("P")).alias("tpr"))
    origin = tot.select(*by, F.lit(math.inf).alias("threshold"), F.lit(0.0).alias("fpr"),
                        F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


@grouped
def pr_points(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """precision/recall per distinct score plus the closing (r=0, p=1)."""
    c = _desc_cum(df, by)
    tot = c.groupBy(*by).agg(F.sum("pos").alias("P"))
    c = c.join(tot, list(by))
    pts = c.select(*by, F.col("score").alias("threshold"),
                   _div0(F.col("tps"), F.col("tps") + F.col("fps")).alias("precision"),
                   F.when(F.col("P") == 0, F.lit(1.0)).otherwise(F.col("tps") / F.col("P")).alias("recall"))
    end = tot.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                     F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


# ---------------------------------------------------------------- threshold grids
def grid_counts(df: DataFrame, grid: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """TP/FP/TN/FN at every grid threshold from ONE pass: each row gets its
    slot (binary search on the literal grid doubles), the slot histogram
    (<= len(grid)+1 rows per group) is turned into per-threshold counts."""
    grid = [float(t) for t in grid]
    b = Bucketizer(splits=[-math.inf] + grid + [math.inf], inputCol="_s", outputCol="_slot")
    slotted = b.transform(df.withColumn("_s", reachable(F.col("score"))))
    hist = slotted.groupBy(*by, "_slot").agg(F.sum("y").cast("long").alias("pos"),
                                             (F.count(F.lit(1)) - F.sum("y")).cast("long").alias("neg"))
    # score >= grid[i]  <=>  slot >= i + 1
    aggs = []
    for i in range(len(grid)):
        aggs.append(F.sum(F.when(F.col("_slot") >= i + 1, F.col("pos")).otherwise(0)).alias(f"tp{i}"))
        aggs.append(F.sum(F.when(F.col("_slot") >= i + 1, F.col("neg")).otherwise(0)).alias(f"fp{i}"))
    wide = hist.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), *aggs)
    items = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold"),
                               F.col(f"tp{i}").cast("long").alias("tp"), F.col(f"fp{i}").cast("long").alias("fp"))
                      for i, t in enumerate(grid)])
    long = wide.select(*by, "P", "N", F.inline(items))
    return long.select(*by, "i", "threshold", "tp", "fp",
                       (F.col("N") - F.col("fp")).alias("tn"), (F.col("P") - F.col("tp")).alias("fn"))


def sweep(df: DataFrame, by: Sequence[str] = (), grid: Sequence[float] | None = None) -> DataFrame:
    """The browser sweep (threshold shown rounded to 2 places, F1 as
    2PR/(P+R))."""
    g = grid if grid is not None else browser_grid()
    r = rates(grid_counts(df, g, by))
    return r.select(*by, "i", (F.round(F.col("threshold") * 100) / 100).alias("threshold"),
                    "precision", "recall", browser_f1(F.col("precision"), F.col("recall")).alias("f1"))


def best_threshold(df: DataFrame, by: Sequence[str] = (), metric: str = "f1",
                   grid: Sequence[float] | None = None) -> DataFrame:
    """A27 / A28 (W7): first grid threshold with the strictly best score;
    nothing above 0 -> 0.5."""
    g = grid if grid is not None else K.THRESHOLD_GRID
    r = rates(grid_counts(df, g, by))
    if metric == "f1":
        s = F.col("f1")
    elif metric == "recall_at_precision":
        s = F.when(F.col("precision") >= K.RECALL_PRECISION_FLOOR, F.col("recall")).otherwise(F.lit(0.0))
    else:
        raise ValueError(metric)
    r = r.withColumn("_m", s)
    best = r.groupBy(*by).agg(F.max_by(F.struct("threshold", "_m"), F.struct(F.col("_m"), -F.col("i"))).alias("b"))
    return best.select(*by, F.when(F.col("b._m") > 0, F.col("b.threshold")).otherwise(F.lit(0.5)).alias("threshold"),
                       F.greatest(F.col("b._m"), F.lit(0.0)).alias("best_score"))


@grouped
def metric_row(df: DataFrame, threshold: float | Column | DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 at a threshold + AUC + AP.
    ``threshold`` may be a per-group table ``[*by, threshold]``."""
    return threshold_rates(df, threshold, by).join(
        ranking_metrics(score_counts(df, by), by), list(by))


def threshold_rates(df: DataFrame, threshold: float | Column | DataFrame, by: Sequence[str]) -> DataFrame:
    """Confusion counts and rates at one threshold, or at each group's own."""
    if isinstance(threshold, DataFrame):
        d = df.join(F.broadcast(threshold.select(*by, F.col("threshold").alias("_t"))), list(by))
        cm = confusion(d, F.col("_t"), by)
        return rates(cm.join(threshold.select(*by, "threshold"), list(by)))
    cm = confusion(df, threshold, by)
    return rates(cm.withColumn("threshold", threshold if isinstance(threshold, Column) else F.lit(float(threshold))))


# ---------------------------------------------------------------- distribution, calibration
def histogram(df: DataFrame, n_bins: int = K.HIST_BINS, by: Sequence[str] = ()) -> DataFrame:
    """Per-class counts in ``min(floor(p / w), n-1)`` bins; every bin
    present (spine from ``sequence``, not a join against data)."""
    w = 1.0 / n_bins
    binned = df.filter(F.col("score").isNotNull() & ~F.isnan("score")).withColumn(
        "bin", F.least(F.floor(F.col("score") / F.lit(w)), F.lit(n_bins - 1)).cast("int"))
    counts = binned.groupBy(*by, "bin").agg(
        F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).cast("long").alias("on_time"),
        F.sum(F.when(F.col("y") != 0, 1).otherwise(0)).cast("long").alias("late"))
    spine = df.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    out = spine.join(counts, list(by) + ["bin"], "left").fillna(0, ["on_time", "late"])
    return out.select(*by, "bin", (F.col("bin") * w + w / 2).alias("bin_center"), "on_time", "late")


def brier(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of the probability."""
    return df.groupBy(*by).agg(F.avg(F.pow(F.col("score") - F.col("y"), 2)).alias("brier"))


def calibration_bins(df: DataFrame, n_bins: int = K.CALIBRATION_BINS, by: Sequence[str] = ()) -> DataFrame:
    """Reliability points (mean score, observed rate) of non-empty
    uniform bins; a score of exactly 1 falls in the last bin."""
    b = F.least(F.floor(F.col("score") * n_bins), F.lit(n_bins - 1)).cast("int")
    return df.filter(F.col("score").isNotNull() & ~F.isnan("score")).withColumn("bin", b).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg("y").alias("observed_rate"))


def ece(df: DataFrame, n_bins: int = K.CALIBRATION_BINS, by: Sequence[str] = ()) -> DataFrame:
    """Count-weighted |mean score - observed rate| over bins."""
    cb = calibration_bins(df, n_bins, by)
    return cb.groupBy(*by).agg(
        (F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("observed_rate"))) / F.sum("n")).alias("ece"))


def cost_thresholds(df: DataFrame, by: Sequence[str] = (), scenarios=K.COST_SCENARIOS,
                    grid: Sequence[float] | None = None) -> DataFrame:
    """Per scenario, the grid threshold minimising fp_cost*FP + fn_cost*FN
    (ties -> lowest threshold)."""
    g = grid if grid is not None else K.THRESHOLD_GRID
    r = rates(grid_counts(df, g, by))
    sc = F.array(*[F.struct(F.lit(f"{int(a)}:{int(b)}").alias("scenario"), F.lit(a).alias("fp_cost"),
                            F.lit(b).alias("fn_cost")) for a, b in scenarios])
    x = r.select("*", F.inline(sc)).withColumn(
        "cost", F.col("fp_cost") * F.col("fp") + F.col("fn_cost") * F.col("fn"))
    best = x.groupBy(*by, "scenario", "fp_cost", "fn_cost").agg(
        F.min_by(F.struct("threshold", "cost", "f1", "precision", "recall", "fp", "fn"),
                 F.struct(F.col("cost"), F.col("i"))).alias("b"))
    return best.select(*by, "scenario", "fp_cost", "fn_cost", F.col("b.threshold").alias("optimal_threshold"),
                       F.col("b.cost").alias("min_cost"), "b.f1", "b.precision", "b.recall",
                       F.col("b.fp").alias("fp"), F.col("b.fn").alias("fn"))


def base_rate(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A50."""
    return df.groupBy(*by).agg(F.avg("y").alias("base_rate"))


def focal_loss(df: DataFrame, alpha: float = 0.25, gamma: float = 2.0, smoothing: float = 0.0,
               weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """mean focal loss -alpha_t (1 - p_t)^gamma * BCE with label smoothing
    and an optional per-row weight (as an evaluation metric)."""
    eps = 1e-7
    p = F.least(F.greatest(F.col("score"), F.lit(eps)), F.lit(1 - eps))
    y = F.col("y") * (1 - smoothing) + 0.5 * smoothing
    bce = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    pt = y * p + (1 - y) * (1 - p)
    at = y * alpha + (1 - y) * (1 - alpha)
    loss = at * F.pow(1 - pt, gamma) * bce
    if weight:
        loss = loss * F.col(weight)
    return df.groupBy(*by).agg(F.avg(loss).alias("focal_loss"))

