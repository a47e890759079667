"""Model comparison and stability.

Everything is an aggregate over distributed rows; p-values are Column
expressions (normal / chi-square tails) or Arrow-batched pandas UDFs over a
handful of summary rows (Student t, exact binomial).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrears import constants as K
from arrears.functions import stats
from arrears.operators import evaluate as ev
from arrears.operators import ordered
from arrears.session import cut_lineage


# ---------------------------------------------------------------- A37 McNemar
def mcnemar(df: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """2x2 agreement of two models' correctness at ``threshold``;
    ``df`` is wide: ``y, score_a, score_b``.  chi2 with continuity correction,
    its chi-square(1) tail, and the exact two-sided binomial p."""
    t = F.lit(float(threshold))
    ca = ((F.col("score_a") >= t).cast("int") == F.col("y"))
    cb = ((F.col("score_b") >= t).cast("int") == F.col("y"))
    cnt = df.groupBy(*by).agg(
        F.sum((ca & cb).cast("int")).cast("long").alias("both_correct"),
        F.sum((ca & ~cb).cast("int")).cast("long").alias("b"),
        F.sum((~ca & cb).cast("int")).cast("long").alias("c"),
        F.sum((~ca & ~cb).cast("int")).cast("long").alias("both_wrong"))
    bc = F.col("b") + F.col("c")
    chi2 = F.when(bc > 0, F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2) / bc).otherwise(F.lit(0.0))
    return cnt.withColumn("chi2", chi2).withColumn("p_value", stats.chi2_1_sf(F.col("chi2")))


def mcnemar_exact(cnt: DataFrame) -> DataFrame:
    return cnt.withColumn("p_exact", stats.mcnemar_exact_udf()(F.col("b"), F.col("c")))


# ---------------------------------------------------------------- A38 DeLong
def placements(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per (group, distinct score): V10 = P(neg < s) + .5 P(neg = s) for
    positives, V01 = P(pos > s) + .5 P(pos = s) for negatives."""
    sc = ev.score_counts(long, by)
    up = ordered.prefix_sums(sc, "score", ["neg"], partition_cols=by)
    down = ordered.prefix_sums(sc, "score", ["pos"], partition_cols=by, descending=True)
    tot = sc.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    j = up.select(*by, "score", "neg", "neg_cum").join(down.select(*by, "score", "pos", "pos_cum"), list(by) + ["score"]) \
        .join(F.broadcast(tot), list(by))
    return j.select(*by, "score",
                    ((F.col("neg_cum") - F.col("neg") + F.col("neg") / 2.0) / F.col("N")).alias("v10"),
                    ((F.col("pos_cum") - F.col("pos") + F.col("pos") / 2.0) / F.col("P")).alias("v01"))


def delong(long: DataFrame, keys: Sequence[str], models=("a", "b"), by: Sequence[str] = ()) -> DataFrame:
    """Paired DeLong test of AUC(a) - AUC(b) on the same rows (J13: rows are
    aligned by key, not by position)."""
    grp = list(by) + ["model"]
    pl = placements(long, grp)
    rows = long.join(pl, grp + ["score"])
    rows = rows.withColumn("v", F.when(F.col("y") == 1, F.col("v10")).otherwise(F.col("v01")))
    a = rows.filter(F.col("model") == models[0]).select(*by, *keys, "y", F.col("v").alias("va"))
    b = rows.filter(F.col("model") == models[1]).select(*by, *keys, F.col("v").alias("vb"))
    ab = a.join(b, list(by) + list(keys))
    pos, neg = F.col("y") == 1, F.col("y") == 0
    s = ab.groupBy(*by).agg(
        F.sum(pos.cast("int")).alias("P"), F.sum(neg.cast("int")).alias("N"),
        F.avg(F.when(pos, F.col("va"))).alias("auc_a"), F.avg(F.when(pos, F.col("vb"))).alias("auc_b"),
        F.var_samp(F.when(pos, F.col("va"))).alias("s10_aa"), F.var_samp(F.when(pos, F.col("vb"))).alias("s10_bb"),
        F.covar_samp(F.when(pos, F.col("va")), F.when(pos, F.col("vb"))).alias("s10_ab"),
        F.var_samp(F.when(neg, F.col("va"))).alias("s01_aa"), F.var_samp(F.when(neg, F.col("vb"))).alias("s01_bb"),
        F.covar_samp(F.when(neg, F.col("va")), F.when(neg, F.col("vb"))).alias("s01_ab"))
    var = (F.col("s10_aa") + F.col("s10_bb") - 2 * F.col("s10_ab")) / F.col("P") + \
          (F.col("s01_aa") + F.col("s01_bb") - 2 * F.col("s01_ab")) / F.col("N")
    z = F.when(var > 0, (F.col("auc_a") - F.col("auc_b")) / F.sqrt(var))
    return s.select(*by, "auc_a", "auc_b", var.alias("variance"), z.alias("z"),
                    stats.normal_two_sided(z).alias("p_value"))


# ---------------------------------------------------------------- A31 bootstrap
MIX = 0x45D9F3B           # 32-bit integer mixer constant (products stay below 2^63)
MASK32 = 0xFFFFFFFF


def row_hash32(row_key: Column, seed: int = 42) -> Column:
    """One md5 per row: the first 8 hex digits as an unsigned 32-bit value."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), row_key)), 1, 8), 16, 10).cast("long")


def _np_mix32(x: np.ndarray) -> np.ndarray:
    """Two xor-shift-multiply rounds on 32-bit values held in 64 bits."""
    for _ in range(2):
        x = (((x >> np.uint64(16)) ^ x) * np.uint64(MIX)) & np.uint64(MASK32)
    return (x >> np.uint64(16)) ^ x


def _replicates(h: np.ndarray, y: np.ndarray, n_boot: int, chunk: int = 64):
    """(rows' positive weights, negative weights) of all replicates, ``chunk`` at a time."""
    cdf, term = [math.exp(-1.0)], math.exp(-1.0)
    for i in range(1, 14):  # beyond 13 the uniform has no resolution left
        term /= i
        cdf.append(cdf[-1] + term)
    for at in range(1, n_boot + 1, chunk):
        rep = _np_mix32(np.arange(at, min(at + chunk, n_boot + 1), dtype=np.uint64))
        u = _np_mix32(h[:, None] ^ rep) / 4294967296.0
        w = np.searchsorted(cdf, u, "right")
        yield w * (y == 1)[:, None], w * (y == 0)[:, None]


def _ordered_rows(t: pa.Table):
    """Scores ascending, labels, hashes, and where each distinct score begins."""
    score, y, h = (t[c].to_numpy() for c in ("score", "y", "_h"))
    order = np.argsort(score, kind="stable")
    score, y, h = score[order], y[order], h[order].astype(np.uint64)
    return score, y, h, np.flatnonzero(np.append(True, score[1:] != score[:-1]))


#: Totals of a bucket: positives, negatives, rank sum inside, and the positives and negatives
#: at or above the threshold and the model's tuned one.
TOTALS = ("P", "N", "U", "tp", "fp", "opt_tp", "opt_fp")


def _bucket_totals(n_boot: int, threshold: float, tuned: dict[str, float] | None = None):
    """All replicates' totals of one bucket, an array of ``n_boot`` each."""
    def run(t: pa.Table) -> pa.Table:
        score, y, h, first = _ordered_rows(t)
        above, best = score >= threshold, score >= (tuned or {}).get(t["model"][0].as_py(), threshold)
        out = [[] for _ in TOTALS]
        for pos, neg in _replicates(h, y, n_boot):
            p, n = np.add.reduceat(pos, first), np.add.reduceat(neg, first)
            below = n.cumsum(0) - n
            for kept, v in zip(out, (p.sum(0), n.sum(0), (p * (below + n / 2.0)).sum(0), pos[above].sum(0), neg[above].sum(0),
                                     pos[best].sum(0), neg[best].sum(0))):
                kept.append(v.astype(float))
        return pa.table({"model": t["model"][:1], "_bkt": t["_bkt"][:1]} | {
            c: pa.array([np.concatenate(v).tolist()], pa.list_(pa.float64())) for c, v in zip(TOTALS, out)})
    return run


def _bucket_precision(n_boot: int):
    """A bucket's part of all replicates' average precision (times the positives), from its
    rows and what lies above it in each replicate."""
    def run(rows: pa.Table, offsets: pa.Table) -> pa.Table:
        if not rows.num_rows or not offsets.num_rows:
            return pa.table({"model": rows["model"][:0], "part": pa.array([], pa.list_(pa.float64()))})
        _, y, h, first = _ordered_rows(rows)
        tps, fps = (np.array(offsets[c][0].as_py()) for c in ("p_above", "n_above"))
        out, at = [], 0
        for pos, neg in _replicates(h, y, n_boot):
            p, n = np.add.reduceat(pos, first)[::-1], np.add.reduceat(neg, first)[::-1]
            tp, fp = tps[at:at + p.shape[1]] + p.cumsum(0), fps[at:at + p.shape[1]] + n.cumsum(0)
            out.append((p * (tp / np.maximum(tp + fp, 1))).sum(0))
            at += p.shape[1]
        return pa.table({"model": rows["model"][:1], "part": pa.array([np.concatenate(out).tolist()], pa.list_(pa.float64()))})
    return run


#: Rows of a tie that a task takes.
TIE_ROWS = 50_000


def bootstrap(wide: DataFrame, row_key: Column, models: Sequence[str] = ("a", "b"), n_boot: int = K.BOOTSTRAP_N,
              threshold: float = 0.5, seed: int = 42, tuned: dict[str, float] | None = None) -> DataFrame:
    """Poisson bootstrap of AUC, average precision, and F1, precision and recall at the
    threshold and (``opt_``) at each model's ``tuned`` one.

    ``wide`` holds one row per scored invoice (``y`` and ``score_<model>``).
    Each invoice gets ONE weight per replicate (shared by every model, as a
    resample is of rows): one md5 per invoice, then integer mixing per
    replicate - reproducible and checkable in SQL.

    No row is copied per replicate.  Scores are cut into buckets once; a task
    computes all replicates' weights for its bucket in blocks and returns one
    row of totals per bucket, and replicates are put together from those.  For
    average precision the buckets' totals are summed from the top, and a second
    pass gives each bucket's part from its rows and what lies above it.
    Each boundary value is a bucket of its own, so a score that many rows
    share is one, and its rows - whose totals just add up, and whose part of the
    average precision follows from them - are salted once a task's share of them (``TIE_ROWS``) is passed.
    Replicates with one class are skipped.  Returns per model: mean, std
    (ddof 0), 2.5 / 97.5 percentiles.
    """
    items = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"score_{m}").cast("double").alias("score")) for m in models])
    rows = cut_lineage(wide.select(F.col("y").cast("int").alias("y"), row_hash32(row_key, seed).alias("_h"), F.inline(items))
                       .filter(F.col("score").isNotNull() & ~F.isnan("score")))
    n = rows.count()
    splits = [-math.inf]
    for b in ordered.boundaries(rows, "score", max(32, -(-n // 50_000))):
        if b > splits[-1]:
            splits += [b, math.nextafter(b, math.inf)]  # odd buckets hold one score
    cut = Bucketizer(splits=[*splits, math.inf], inputCol="score", outputCol="_bkt").transform(rows)
    tie = F.col("_bkt") % 2 == 1
    # a row per tie of more rows than a task should hold
    heavy = cut.where(tie).groupBy("model", "_bkt").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > TIE_ROWS).select(
        "model", "_bkt", F.ceil(F.col("_m") / TIE_ROWS).alias("_salts"))
    salted = cut.join(F.broadcast(heavy), ["model", "_bkt"], "left").withColumn(
        "_salt", F.coalesce(F.col("_h") % F.col("_salts"), F.lit(0))).drop("_salts")
    parts = salted.groupBy("model", "_bkt", "_salt").applyInArrow(
        _bucket_totals(n_boot, float(threshold), tuned),
        "model string, _bkt double, " + ", ".join(f"{c} array<double>" for c in TOTALS))
    # zero-weight replicates drop out below; a salted bucket's rank sum is that of one tie
    each = parts.select("model", "_bkt", F.posexplode(F.arrays_zip(*TOTALS)).alias("rep", "_t")).groupBy(
        "model", "rep", "_bkt").agg(*[F.sum(F.col("_t")[c]).alias(c) for c in TOTALS])
    rank = F.when(tie, F.col("P") * F.col("N") / 2.0).otherwise(F.col("U"))
    up = Window.partitionBy("model", "rep").orderBy("_bkt")
    whole = Window.partitionBy("model", "rep")
    placed = cut_lineage(each.select("*", (F.sum("N").over(up) - F.col("N")).alias("_before"),
                                     *[(F.sum(c).over(whole) - F.sum(c).over(up)).alias(f"{c.lower()}_above") for c in ("P", "N")]))
    tp_here = F.col("p_above") + F.col("P")
    tied = F.when(tie & (F.col("P") > 0), F.col("P") * tp_here / (tp_here + F.col("n_above") + F.col("N"))).otherwise(0.0)
    grp = ["model", "rep"]
    per = placed.withColumn("_u", rank + F.col("P") * F.col("_before")).withColumn("_ap", tied).groupBy(*grp).agg(
        *[F.sum(c).alias(c) for c in ("P", "N", "_u", "_ap", "tp", "fp", "opt_tp", "opt_fp")])
    offsets = placed.where(~tie).groupBy("model", "_bkt").agg(F.array_sort(F.collect_list(F.struct("rep", "p_above", "n_above"))).alias("o")).select(
        "model", "_bkt", F.col("o.p_above").alias("p_above"), F.col("o.n_above").alias("n_above"))
    inner = cut.where(~tie).select("model", "_bkt", "score", "y", "_h").groupBy("model", "_bkt").cogroup(
        offsets.groupBy("model", "_bkt")).applyInArrow(_bucket_precision(n_boot), "model string, part array<double>")
    inside = inner.select("model", F.posexplode("part").alias("rep", "v")).groupBy(*grp).agg(F.sum("v").alias("_inside"))
    per = per.join(inside, grp, "left").filter((F.col("P") > 0) & (F.col("N") > 0))

    def rates(tp: Column, fp: Column, prefix: str) -> list[Column]:
        fn = F.col("P") - tp
        return [F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias(f"{prefix}f1"),
                F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias(f"{prefix}precision"),
                F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0).alias(f"{prefix}recall")]

    per = per.select(*grp, (F.col("_u") / (F.col("P") * F.col("N"))).alias("auc"),
                     ((F.col("_ap") + F.coalesce("_inside", F.lit(0.0))) / F.col("P")).alias("ap"),
                     *rates(F.col("tp"), F.col("fp"), ""), *rates(F.col("opt_tp"), F.col("opt_fp"), "opt_"))
    aggs = [F.count(F.lit(1)).alias("n_replicates")]
    for m in BOOTSTRAPPED:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"),
                 F.percentile(m, 0.025).alias(f"{m}_ci_lower"), F.percentile(m, 0.975).alias(f"{m}_ci_upper")]
    return per.groupBy("model").agg(*aggs)


BOOTSTRAPPED = ("auc", "ap", "f1", "precision", "recall", "opt_f1", "opt_precision", "opt_recall")


# ---------------------------------------------------------------- A39-A41 stability
def stability_summary(results: DataFrame, metrics: Sequence[str], models=("a", "b")) -> DataFrame:
    """Per (metric, model) mean, std (ddof 1), t-interval, min, max over
    seeds.  ``results`` is long: ``seed, model, metric, value``."""
    s = results.filter(F.col("metric").isin(*metrics)).groupBy("metric", "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    tq = stats.t_ppf_udf()(F.lit(0.975), (F.col("n") - 1).cast("double"))
    half = tq * F.col("std") / F.sqrt(F.col("n").cast("double"))
    return s.select("metric", "model", "n", "mean", "std", (F.col("mean") - half).alias("ci_lower"),
                    (F.col("mean") + half).alias("ci_upper"), "min", "max")


def paired_differences(results: DataFrame, models=("a", "b")) -> DataFrame:
    """A40 + A41: per metric, paired delta stats, t statistic, two-sided p,
    significance at .05, and win / tie counts across seeds."""
    a = results.filter(F.col("model") == models[0]).select("seed", "metric", F.col("value").alias("va"))
    b = results.filter(F.col("model") == models[1]).select("seed", "metric", F.col("value").alias("vb"))
    d = a.join(b, ["seed", "metric"]).withColumn("d", F.col("va") - F.col("vb"))
    s = d.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("delta_mean"), F.stddev_samp("d").alias("delta_std"),
        F.sum((F.col("va") > F.col("vb")).cast("int")).cast("long").alias("wins_a"),
        F.sum((F.col("va") < F.col("vb")).cast("int")).cast("long").alias("wins_b"),
        F.sum((F.col("va") == F.col("vb")).cast("int")).cast("long").alias("ties"))
    tstat = F.when(F.col("delta_std") > 0, F.col("delta_mean") / (F.col("delta_std") / F.sqrt(F.col("n").cast("double"))))
    s = s.withColumn("t_stat", tstat)
    return s.withColumn("p_value", stats.t_two_sided_udf()(F.col("t_stat"), (F.col("n") - 1).cast("double"))) \
            .withColumn("significant", F.col("p_value") < 0.05)


# ---------------------------------------------------------------- A42, A43, A56, T3
def avg_rank(df: DataFrame, col: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Average (mid) rank of ``col`` within ``by`` (1-based), distributed."""
    by = list(by)
    key = by if by else []
    d = df if by else df.withColumn("_all", F.lit(0))
    key = by if by else ["_all"]
    cnt = d.groupBy(*key, col).agg(F.count(F.lit(1)).alias("_c"))
    cum = ordered.prefix_sums(cnt, col, ["_c"], partition_cols=key)
    r = cum.select(*key, col, (F.col("_c_cum") - F.col("_c") + (F.col("_c") + 1) / 2.0).alias(out))
    res = d.join(r, key + [col])
    return res if by else res.drop("_all")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman rho (Pearson on average ranks) and its t-based p."""
    r = avg_rank(avg_rank(df, x, "_rx"), y, "_ry")
    s = r.agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))
    return s.withColumn("p_value", stats.t_two_sided_udf()(t, (F.col("n") - 2).cast("double")))


def mean_abs_contribution(contrib: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean |contribution| per feature from a long ``(row, feature, value)`` table."""
    return contrib.groupBy(*by, "feature").agg(F.avg(F.abs("value")).alias("importance"))


def top_k(importance: DataFrame, k: int = 20, by: Sequence[str] = ("model",)) -> DataFrame:
    """The k most important features per group (a top-k report)."""
    from pyspark.sql import Window
    w = Window.partitionBy(*by).orderBy(F.desc("importance"), F.asc("feature"))
    return importance.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_overlap(top: DataFrame, models=("a", "b")) -> DataFrame:
    """Size and list of the intersection of two models' top sets."""
    a = top.filter(F.col("model") == models[0]).select("feature")
    b = top.filter(F.col("model") == models[1]).select("feature")
    both = a.intersect(b)
    return both.agg(F.count(F.lit(1)).alias("n_overlap"), F.array_sort(F.collect_list("feature")).alias("features"))
