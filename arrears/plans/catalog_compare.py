"""Registered queries: model comparison, significance, bootstrap, seed
stability (A31, A37-A42, A48, A52-A54, M15)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from arrears import constants as K
from arrears.functions import stats
from arrears.operators import compare as cmp
from arrears.operators import evaluate as ev
from arrears.operators import experiment
from arrears.plans import sql as S
from arrears.plans.base import KEYS, SCORED, base, featurized, rows, scorecards, scored_long
from arrears.plans.catalog_eval import SC_CTES, _metric_row_sql, _rates_sql, _with_extra
from arrears.plans.registry import query, r9
from arrears.session import cut_lineage
from arrears.sources.tables import version

WIDE = "wide AS (SELECT * FROM scored WHERE split = 'test')"
N_SEEDS = 30
SEEDS = list(range(1, N_SEEDS + 1))
_K = ", ".join(KEYS)


def _wide(spark, sf_dir):
    return scorecards(featurized(spark, sf_dir, features=SCORED)).filter(F.col("split") == "test") \
        .select(*KEYS, F.col("is_late").alias("y"), "score_a", "score_b")


_MC = """mc AS (SELECT
  CAST(sum(CASE WHEN CAST(score_a >= 0.5 AS INTEGER) = y AND CAST(score_b >= 0.5 AS INTEGER) = y THEN 1 ELSE 0 END) AS BIGINT) AS both_correct,
  CAST(sum(CASE WHEN CAST(score_a >= 0.5 AS INTEGER) = y AND CAST(score_b >= 0.5 AS INTEGER) <> y THEN 1 ELSE 0 END) AS BIGINT) AS b,
  CAST(sum(CASE WHEN CAST(score_a >= 0.5 AS INTEGER) <> y AND CAST(score_b >= 0.5 AS INTEGER) = y THEN 1 ELSE 0 END) AS BIGINT) AS c,
  CAST(sum(CASE WHEN CAST(score_a >= 0.5 AS INTEGER) <> y AND CAST(score_b >= 0.5 AS INTEGER) <> y THEN 1 ELSE 0 END) AS BIGINT) AS both_wrong
FROM (SELECT y, score_a, score_b FROM wide) w)"""


def _simpson(f: str, lo: str, width: float, n: int) -> str:
    """Integral of ``f`` (in ``x``) from ``lo`` on, by Simpson's rule as SQL."""
    h = width / n
    at = f.replace("{x}", f"({lo} + i * {h!r})")
    return (f"(SELECT sum(CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {at}) * {h!r} / 3 "
            f"FROM (SELECT CAST(range AS DOUBLE) AS i FROM range(0, {n + 1})) steps)")


def _erfc_sql(z: str) -> str:
    return f"(2 / sqrt(pi()) * {_simpson('exp(-{x} * {x})', z, 10.0, 10000)})"


def _t_tail_sql(t: str, df: str) -> str:
    """Two-sided tail of Student's t by integrating its density."""
    density = f"pow(1 + {{x}} * {{x}} / {df}, -({df} + 1) / 2.0)"
    return (f"(2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) * "
            f"{_simpson(density, f'abs({t})', 80.0, 40000)})")


def _ln(p) -> F.Column:
    """Logarithm of a p-value: tells small ones apart."""
    return F.round(F.log(F.when(p > 1e-290, p)), 5)


def _ln_sql(p: str) -> str:
    return f"round(ln(CASE WHEN {p} > 1e-290 THEN {p} END), 5)"


@query("a37_mcnemar", S.with_ctes(S.scored_ctes() + [WIDE, _MC], f"""
SELECT both_correct, b, c, both_wrong, round(chi2, 9) AS chi2, round(p, 12) AS p_value, {_ln_sql('p')} AS ln_p
FROM (SELECT *, {_erfc_sql('sqrt(chi2 / 2.0)')} AS p FROM (
  SELECT *, CASE WHEN b + c > 0 THEN pow(abs(b - c) - 1, 2) / (b + c) ELSE 0.0 END AS chi2 FROM mc) t) q"""))
def a37_mcnemar(spark, sf_dir):
    m = cmp.mcnemar(_wide(spark, sf_dir), 0.5)
    return m.select("both_correct", "b", "c", "both_wrong", r9("chi2", "chi2"), F.round("p_value", 12).alias("p_value"),
                    _ln(F.col("p_value")).alias("ln_p"))


@query("a37_mcnemar_exact", S.with_ctes(S.scored_ctes() + [WIDE, _MC], """
SELECT b, c, round(least(1.0, CASE WHEN b + c = 0 THEN 0.5 ELSE 2 * (
  SELECT sum(exp(lgamma(mc.b + mc.c + 1) - lgamma(k + 1) - lgamma(mc.b + mc.c - k + 1) - (mc.b + mc.c) * ln(2)))
  FROM range(0, least(mc.b, mc.c) + 1) r(k)) END), 12) AS p_exact
FROM mc"""))
def a37_mcnemar_exact(spark, sf_dir):
    """Exact two-sided binomial McNemar p (incomplete beta in a pandas UDF)."""
    m = cmp.mcnemar_exact(cmp.mcnemar(_wide(spark, sf_dir), 0.5))
    return m.select("b", "c", F.round("p_exact", 12).alias("p_exact"))


_DL = ["""pl AS (SELECT sc.model, sc.score,
   (sum(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg + neg / 2.0) / N AS v10,
   (sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - pos + pos / 2.0) / P AS v01
  FROM sc JOIN tot USING (model))""",
       f"""rv AS (SELECT ev.*, CASE WHEN y = 1 THEN v10 ELSE v01 END AS v FROM ev JOIN pl USING (model, score))""",
       f"""ab AS (SELECT a.{KEYS[0]}, a.y, a.v AS va, b.v AS vb FROM rv a JOIN rv b
   ON a.model = 'a' AND b.model = 'b' AND {" AND ".join(f"a.{k} = b.{k}" for k in KEYS)})""",
       """ds AS (SELECT sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS P, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS N,
   avg(CASE WHEN y = 1 THEN va END) AS auc_a, avg(CASE WHEN y = 1 THEN vb END) AS auc_b,
   var_samp(CASE WHEN y = 1 THEN va END) AS s10_aa, var_samp(CASE WHEN y = 1 THEN vb END) AS s10_bb,
   covar_samp(CASE WHEN y = 1 THEN va END, CASE WHEN y = 1 THEN vb END) AS s10_ab,
   var_samp(CASE WHEN y = 0 THEN va END) AS s01_aa, var_samp(CASE WHEN y = 0 THEN vb END) AS s01_bb,
   covar_samp(CASE WHEN y = 0 THEN va END, CASE WHEN y = 0 THEN vb END) AS s01_ab FROM ab)""",
       """dz AS (SELECT *, (s10_aa + s10_bb - 2 * s10_ab) / P + (s01_aa + s01_bb - 2 * s01_ab) / N AS variance FROM ds)"""]


@query("a38_delong", _with_extra(SC_CTES + _DL, f"""
SELECT round(auc_a, 9) AS auc_a, round(auc_b, 9) AS auc_b, round(variance, 12) AS variance,
       round(z, 6) AS z, round(pv, 12) AS p_value, {_ln_sql('pv')} AS ln_p
FROM (SELECT *, {_erfc_sql('abs(z) / sqrt(2.0)')} AS pv FROM (
  SELECT *, CASE WHEN variance > 0 THEN (auc_a - auc_b) / sqrt(variance) END AS z FROM dz) t) q"""))
def a38_delong(spark, sf_dir):
    d = cmp.delong(scored_long(spark, sf_dir), KEYS)
    return d.select(r9("auc_a", "auc_a"), r9("auc_b", "auc_b"), F.round("variance", 12).alias("variance"),
                    F.round("z", 6).alias("z"), F.round("p_value", 12).alias("p_value"), _ln(F.col("p_value")).alias("ln_p"))


# ------------------------------------------------------------------ bootstrap
_POIS = []
_c, _t, _k = 0.0, math.exp(-1.0), 0
while _k <= 13:
    _c += _t
    _POIS.append(_c)
    _k += 1
    _t /= _k


def _poisson_sql(u: str) -> str:
    return "CASE " + " ".join(f"WHEN {u} < {c!r} THEN {i}" for i, c in enumerate(_POIS)) + f" ELSE {len(_POIS)} END"


_RK = "concat_ws('-', order_key, line_no, part_key, supp_key)"


def _mix_sql(x: str) -> str:
    for _ in range(2):
        x = f"((xor(({x}) >> 16, ({x})) * {cmp.MIX}) & {cmp.MASK32})"
    return f"xor(({x}) >> 16, ({x}))"


_U = f"(CAST({_mix_sql('xor(h, ' + _mix_sql('CAST(rep AS BIGINT)') + ')')} AS DOUBLE) / 4294967296.0)"


def _tuned_ctes() -> list[str]:
    """``bt``: each model's threshold with the best F1 on validation rows (``va``)."""
    from arrears.plans.catalog_eval import _grid_values
    return [_grid_values(K.THRESHOLD_GRID), """gcv AS (SELECT model, i, t,
    CAST(sum(CASE WHEN score >= t AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
    CAST(sum(CASE WHEN score >= t AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN score < t AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM va, grid WHERE score IS NOT NULL GROUP BY model, i, t)""",
            """bt AS (SELECT model, CASE WHEN f1 > 0 THEN t ELSE 0.5 END AS t FROM (
  SELECT model, t, f1, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, i) AS rk FROM (
    SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM gcv) q) z
  WHERE rk = 1)"""]


def _boot_rates_sql(p: str) -> str:
    return f"""CASE WHEN 2 * {p}tp + {p}fp + (P - {p}tp) > 0 THEN 2 * {p}tp / (2 * {p}tp + {p}fp + (P - {p}tp)) ELSE 0.0 END AS {p}f1,
    CASE WHEN {p}tp + {p}fp > 0 THEN {p}tp / ({p}tp + {p}fp) ELSE 0.0 END AS {p}precision, CASE WHEN P > 0 THEN {p}tp / P ELSE 0.0 END AS {p}recall"""


@query("a31_bootstrap", _with_extra(["va AS (SELECT * FROM scores WHERE split = 'val')"] + _tuned_ctes() + [f"""bs AS (SELECT model, y, score, rep, {_poisson_sql('u')} AS w FROM (
    SELECT model, y, score, rep, {_U} AS u FROM (
    SELECT model, y, score, CAST(('0x' || substr(md5('42:' || {_RK}), 1, 8)) AS BIGINT) AS h FROM ev) e,
    (SELECT CAST(range AS INTEGER) AS rep FROM range(1, {K.BOOTSTRAP_N + 1})) r) q)""",
    """bsc AS (SELECT model, rep, score, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS pos,
    sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS neg FROM bs WHERE w > 0 GROUP BY model, rep, score)""",
    """per AS (SELECT model, rep, sum(pos) AS P, sum(neg) AS N, sum(pos * (neg_cum - neg + neg / 2.0)) AS u, sum(pos * tps / (tps + fps)) AS a,
    sum(CASE WHEN score >= 0.5 THEN pos ELSE 0 END) AS tp, sum(CASE WHEN score >= 0.5 THEN neg ELSE 0 END) AS fp,
    sum(CASE WHEN score >= t THEN pos ELSE 0 END) AS opt_tp, sum(CASE WHEN score >= t THEN neg ELSE 0 END) AS opt_fp
    FROM (SELECT *, sum(neg) OVER (PARTITION BY model, rep ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          AS neg_cum, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps FROM bsc
          WINDOW w AS (PARTITION BY model, rep ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) z JOIN bt USING (model)
    GROUP BY model, rep HAVING sum(pos) > 0 AND sum(neg) > 0)""",
    f"m AS (SELECT model, rep, u / (P * N) AS auc, a / P AS ap, {_boot_rates_sql('')}, {_boot_rates_sql('opt_')} FROM per)"],
    "SELECT model, count(*) AS n_replicates, " + ", ".join(
    f"round(avg({m}), 9) AS {m}_mean, round(stddev_pop({m}), 9) AS {m}_std, "
    f"round(quantile_cont({m}, 0.025), 9) AS {m}_ci_lower, round(quantile_cont({m}, 0.975), 9) AS {m}_ci_upper"
    for m in cmp.BOOTSTRAPPED) + " FROM m GROUP BY model"))
def a31_bootstrap(spark, sf_dir):
    """Intervals of AUC and average precision, and of F1, precision and recall at 0.5 and
    at the threshold tuned on validation rows."""
    rk = F.concat_ws("-", *[F.col(k).cast("string") for k in KEYS])
    best = ev.best_threshold(scored_long(spark, sf_dir, "val"), ["model"], "f1").collect()  # a row per model
    b = cmp.bootstrap(_wide(spark, sf_dir), rk, tuned={r["model"]: r["threshold"] for r in best})
    return b.select("model", "n_replicates", *[r9(c, c) for c in b.columns if c not in ("model", "n_replicates")])


# ------------------------------------------------------------------ seed stability
def _seed_sql() -> list[str]:
    h = "substr(md5(CAST(s.seed AS VARCHAR) || ':' || c.customer), 1, 2)"
    dims = ["salesperson", "division", "city", "customer_group", "amount_bin"]
    te_union = " UNION ALL ".join(
        f"SELECT seed, is_late, late_rate, '{d}' AS dim, {d} AS key FROM xb WHERE split = 'train'" for d in dims)
    joins = " ".join(f"LEFT JOIN te t_{d} ON t_{d}.seed = xb.seed AND t_{d}.dim = '{d}' AND t_{d}.key = xb.{d}"
                     for d in dims)
    co = {d: f"COALESCE(t_{d}.te, xb.late_rate)" for d in dims}
    return [
        f"seeds AS (SELECT CAST(range AS INTEGER) AS seed FROM range(1, {N_SEEDS + 1}))",
        f"""x AS (SELECT c.order_key, c.line_no, c.part_key, c.supp_key, c.customer, c.salesperson, c.division, c.city,
   c.customer_group, c.amount, c.is_late, s.seed,
   CASE WHEN {h} < 'b3' THEN 'train' WHEN {h} < 'd9' THEN 'val' ELSE 'test' END AS split
   FROM clean c CROSS JOIN seeds s)""",
        """ps AS (SELECT seed, quantile_cont(amount, 0.25) AS q0, quantile_cont(amount, 0.5) AS q1,
   quantile_cont(amount, 0.75) AS q2, avg(is_late) AS late_rate FROM x WHERE split = 'train' GROUP BY seed)""",
        """xb AS (SELECT x.*, ps.late_rate, CASE WHEN amount <= q0 THEN 'Q1_Low' WHEN amount <= q1 THEN 'Q2_Mid_Low'
   WHEN amount <= q2 THEN 'Q3_Mid_High' ELSE 'Q4_High' END AS amount_bin FROM x JOIN ps USING (seed))""",
        f"""te AS (SELECT seed, dim, key, (count(*) * avg(is_late) + 20 * max(late_rate)) / (count(*) + 20) AS te
   FROM ({te_union}) u WHERE key IS NOT NULL GROUP BY seed, dim, key)""",
        f"""ssc AS (SELECT xb.seed, xb.is_late AS y,
   ({co['salesperson']} + {co['division']} + {co['city']}) / 3 AS score_a,
   ({co['customer_group']} + {co['amount_bin']}) / 2 AS score_b
   FROM xb {joins} WHERE xb.split = 'test')""",
        """sl AS (SELECT seed, y, 'a' AS model, score_a AS score FROM ssc UNION ALL
   SELECT seed, y, 'b' AS model, score_b AS score FROM ssc)""",
        """scm AS (SELECT seed, model,
   CAST(sum(CASE WHEN y = 1 AND score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
   CAST(sum(CASE WHEN y = 0 AND score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
   CAST(sum(CASE WHEN y = 0 AND score < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
   CAST(sum(CASE WHEN y = 1 AND score < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM sl GROUP BY seed, model)""",
        f"srt AS ({_rates_sql('scm')})",
        """ssc2 AS (SELECT seed, model, score, CAST(sum(y) AS BIGINT) AS pos, CAST(count(*) - sum(y) AS BIGINT) AS neg
   FROM sl GROUP BY seed, model, score)""",
        """stot AS (SELECT seed, model, CAST(sum(pos) AS DOUBLE) AS P, CAST(sum(neg) AS DOUBLE) AS N FROM ssc2 GROUP BY 1, 2)""",
        """sau AS (SELECT seed, model, sum(pos * (neg_cum - neg + neg / 2.0)) / (max(P) * max(N)) AS auc FROM (
   SELECT ssc2.*, P, N, sum(neg) OVER (PARTITION BY seed, model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
   AS neg_cum FROM ssc2 JOIN stot USING (seed, model)) z GROUP BY seed, model)""",
        """sap AS (SELECT seed, model, sum(CASE WHEN P > 0 THEN pos / P ELSE 0.0 END * (tps / (tps + fps))) AS ap FROM (
   SELECT ssc2.*, P, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps FROM ssc2 JOIN stot USING (seed, model)
   WINDOW w AS (PARTITION BY seed, model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) z
   GROUP BY seed, model)""",
        """res AS (SELECT seed, model, metric, value FROM (
   SELECT seed, model, auc AS test_auc, f1 AS test_f1, precision AS test_precision, recall AS test_recall,
          ap AS test_ap, accuracy AS test_accuracy FROM srt JOIN sau USING (seed, model) JOIN sap USING (seed, model))
   UNPIVOT (value FOR metric IN (test_auc, test_f1, test_precision, test_recall, test_ap, test_accuracy)))""",
    ]


_SEED_RESULTS: dict = {}


def _seed_results(spark, sf_dir):
    key = version(spark, sf_dir)
    if key not in _SEED_RESULTS:
        counts = experiment.seed_score_counts(base(spark, sf_dir), SEEDS)
        _SEED_RESULTS[key] = cut_lineage(experiment.seed_results(counts, staged=True))
    return _SEED_RESULTS[key]


@query("m15_seed_results", S.with_ctes(S.base_ctes() + _seed_sql(),
                                       "SELECT seed, model, metric, round(value, 9) AS value FROM res"))
def m15_seed_results(spark, sf_dir):
    """30 seeds x (split, fit, score, evaluate) over shared scans."""
    r = _seed_results(spark, sf_dir)
    return r.select("seed", "model", "metric", r9("value", "value"))


# FIXED VALUE: the .975 quantile of Student's t with 29 degrees of freedom, from tables
T_975 = 2.045229642132703
STAB_METRICS = ["test_auc", "test_f1", "test_precision", "test_recall", "test_ap", "test_accuracy"]


@query("a39_stability_summary", S.with_ctes(S.base_ctes() + _seed_sql(), f"""
SELECT metric, model, count(*) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std,
       round(avg(value) - {T_975!r} * stddev_samp(value) / sqrt(count(*)), 9) AS ci_lower,
       round(avg(value) + {T_975!r} * stddev_samp(value) / sqrt(count(*)), 9) AS ci_upper,
       round(min(value), 9) AS min, round(max(value), 9) AS max
FROM res GROUP BY metric, model"""))
def a39_stability_summary(spark, sf_dir):
    s = cmp.stability_summary(_seed_results(spark, sf_dir), STAB_METRICS)
    return s.select("metric", "model", "n", *[r9(c, c) for c in ("mean", "std", "ci_lower", "ci_upper", "min", "max")])


@query("a40_paired_differences", S.with_ctes(S.base_ctes() + _seed_sql(), """
SELECT metric, count(*) AS n, round(avg(d), 9) AS delta_mean, round(stddev_samp(d), 9) AS delta_std,
       round(CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END, 6) AS t_stat,
       CAST(sum(CASE WHEN va > vb THEN 1 ELSE 0 END) AS BIGINT) AS wins_a,
       CAST(sum(CASE WHEN va < vb THEN 1 ELSE 0 END) AS BIGINT) AS wins_b,
       CAST(sum(CASE WHEN va = vb THEN 1 ELSE 0 END) AS BIGINT) AS ties
FROM (SELECT a.seed, a.metric, a.value AS va, b.value AS vb, a.value - b.value AS d
      FROM res a JOIN res b ON a.seed = b.seed AND a.metric = b.metric AND a.model = 'a' AND b.model = 'b') t
GROUP BY metric"""))
def a40_paired_differences(spark, sf_dir):
    """A40 (paired delta, t) + A41 (wins / ties) across seeds."""
    p = cmp.paired_differences(_seed_results(spark, sf_dir))
    return p.select("metric", "n", r9("delta_mean", "delta_mean"), r9("delta_std", "delta_std"),
                    F.round("t_stat", 6).alias("t_stat"), "wins_a", "wins_b", "ties")


@query("a40_paired_p_values", S.with_ctes(S.base_ctes() + _seed_sql(), f"""
SELECT metric, round(t, 6) AS t_stat, round(p, 9) AS p_value, {_ln_sql('p')} AS ln_p, p < 0.05 AS significant FROM (
  SELECT metric, t, {_t_tail_sql('t', 'v')} AS p FROM (
    SELECT metric, count(*) - 1.0 AS v, CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END AS t
    FROM (SELECT a.metric, a.value - b.value AS d FROM res a JOIN res b
          ON a.seed = b.seed AND a.metric = b.metric AND a.model = 'a' AND b.model = 'b') x GROUP BY metric) y) z"""))
def a40_paired_p_values(spark, sf_dir):
    """Two-sided Student-t p of the paired deltas."""
    p = cmp.paired_differences(_seed_results(spark, sf_dir))
    return p.select("metric", F.round("t_stat", 6).alias("t_stat"), r9("p_value", "p_value"),
                    _ln(F.col("p_value")).alias("ln_p"), "significant")


@query("f21_significance", S.with_ctes(S.base_ctes() + _seed_sql(), f"""
SELECT metric, CASE WHEN p < 0.001 THEN 'p < 0.001' WHEN p < 0.05 THEN 'significant' ELSE 'not significant' END AS flag FROM (
  SELECT metric, {_t_tail_sql('t', 'v')} AS p FROM (
    SELECT metric, count(*) - 1.0 AS v, CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END AS t
    FROM (SELECT a.metric, a.value - b.value AS d FROM res a JOIN res b
          ON a.seed = b.seed AND a.metric = b.metric AND a.model = 'a' AND b.model = 'b') x GROUP BY metric) y) z"""))
def f21_significance(spark, sf_dir):
    """significance flag of each metric's paired difference."""
    from arrears.operators.decide import significance
    p = cmp.paired_differences(_seed_results(spark, sf_dir))
    return p.select("metric", significance("p_value").alias("flag"))


@query("a42_spearman_scores", S.with_ctes(S.scored_ctes() + [WIDE], """
SELECT count(*) AS n, round(corr(ra, rb), 9) AS rho FROM (
  SELECT rank() OVER (ORDER BY score_a) + (count(*) OVER (PARTITION BY score_a) - 1) / 2.0 AS ra,
         rank() OVER (ORDER BY score_b) + (count(*) OVER (PARTITION BY score_b) - 1) / 2.0 AS rb FROM wide) t"""))
def a42_spearman_scores(spark, sf_dir):
    """Spearman rank correlation of the two models' scores."""
    s = cmp.spearman(_wide(spark, sf_dir), "score_a", "score_b")
    return s.select("n", r9("rho", "rho"))


@query("a42_spearman_p_value", S.with_ctes(S.scored_ctes() + [WIDE], f"""
SELECT n, round(rho, 9) AS rho, round({_t_tail_sql('(rho * sqrt((n - 2) / (1 - rho * rho)))', '(n - 2.0)')}, 9) AS p_value FROM (
  SELECT count(*) AS n, corr(ra, rb) AS rho FROM (
    SELECT rank() OVER (ORDER BY score_a) + (count(*) OVER (PARTITION BY score_a) - 1) / 2.0 AS ra,
           rank() OVER (ORDER BY score_b) + (count(*) OVER (PARTITION BY score_b) - 1) / 2.0 AS rb FROM wide) t) q"""))
def a42_spearman_p_value(spark, sf_dir):
    """The t-based p of Spearman's rho."""
    return cmp.spearman(_wide(spark, sf_dir), "score_a", "score_b").select("n", r9("rho", "rho"), r9("p_value", "p_value"))


@query("a48_class_balance", S.with_ctes(S.base_ctes(), """
SELECT count(*) AS n, CAST(sum(is_late) AS BIGINT) AS n_pos, CAST(count(*) - sum(is_late) AS BIGINT) AS n_neg,
       round((count(*) - sum(is_late)) / sum(is_late), 9) AS imbalance_ratio,
       round(count(*) / (2.0 * (count(*) - sum(is_late))), 9) AS weight_neg,
       round(count(*) / (2.0 * sum(is_late)), 9) AS weight_pos
FROM split WHERE split = 'train'"""))
def a48_class_balance(spark, sf_dir):
    """Neg:pos ratio and balanced class weights on train."""
    tr = rows(spark, sf_dir).filter(F.col("split") == "train")
    s = tr.agg(F.count(F.lit(1)).alias("n"), F.sum("is_late").cast("long").alias("n_pos"))
    s = s.withColumn("n_neg", F.col("n") - F.col("n_pos"))
    return s.select("n", "n_pos", "n_neg", r9(F.col("n_neg") / F.col("n_pos"), "imbalance_ratio"),
                    r9(F.col("n") / (2.0 * F.col("n_neg")), "weight_neg"),
                    r9(F.col("n") / (2.0 * F.col("n_pos")), "weight_pos"))


# ------------------------------------------------------------------ experiment tables
def _experiments(spark, sf_dir):
    """Long comparison table (model, experiment, threshold, metrics)."""
    val_best = ev.best_threshold(scored_long(spark, sf_dir, "val"), ["model"], "f1").select("model", "threshold")
    test, by = scored_long(spark, sf_dir), ["model"]
    ranking = cut_lineage(ev.ranking_metrics(ev.score_counts(test, by), by))  # the same for both
    tuned = ev.threshold_rates(test, val_best, by).join(ranking, by).withColumn("experiment", F.lit("tuned"))
    default = ev.threshold_rates(test, 0.5, by).join(ranking, by).withColumn("experiment", F.lit("default"))
    cols = ["model", "experiment", "threshold", "accuracy", "precision", "recall", "f1", "auc", "average_precision"]
    return tuned.select(*cols).unionByName(default.select(*cols))




def _exp_sql(body: str) -> str:
    grid = _tuned_ctes() + [
            """th2 AS (SELECT model, t, 'tuned' AS experiment FROM bt UNION ALL
  SELECT DISTINCT model, 0.5, 'default' FROM ev)""",
            """cm2 AS (SELECT ev.model, th2.experiment, th2.t AS threshold,
    CAST(sum(CASE WHEN y = 1 AND score >= th2.t THEN 1 ELSE 0 END) AS BIGINT) AS tp,
    CAST(sum(CASE WHEN y = 0 AND score >= th2.t THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN y = 0 AND score < th2.t THEN 1 ELSE 0 END) AS BIGINT) AS tn,
    CAST(sum(CASE WHEN y = 1 AND score < th2.t THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM ev JOIN th2 USING (model) GROUP BY ev.model, th2.experiment, th2.t)""",
            f"rt2 AS ({_rates_sql('cm2')})",
            """au2 AS (SELECT model, sum(pos * (neg_cum - neg + neg / 2.0)) / (max(P) * max(N)) AS auc FROM (
  SELECT sc.*, P, N, sum(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  AS neg_cum FROM sc JOIN tot USING (model)) z GROUP BY model)""",
            """ap2 AS (SELECT cd.model, sum(CASE WHEN P > 0 THEN pos / P ELSE 0.0 END * (tps / (tps + fps))) AS average_precision
  FROM cd JOIN tot USING (model) GROUP BY cd.model)""",
            """xp AS (SELECT model, experiment, threshold, accuracy, precision, recall, f1, auc, average_precision
  FROM rt2 JOIN au2 USING (model) JOIN ap2 USING (model))"""]
    return S.with_ctes(S.scored_ctes() + ["ev AS (SELECT * FROM scores WHERE split = 'test')",
                                          "va AS (SELECT * FROM scores WHERE split = 'val')"] + SC_CTES + grid, body)


@query("a54_comparison_table", _exp_sql("""
SELECT model, experiment, round(threshold, 9) AS threshold, round(accuracy, 9) AS accuracy,
       round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(auc, 9) AS auc,
       round(average_precision, 9) AS average_precision FROM xp"""))
def a54_comparison_table(spark, sf_dir):
    x = _experiments(spark, sf_dir)
    return x.select("model", "experiment", *[r9(c, c) for c in x.columns if c not in ("model", "experiment")])


@query("a52_leaderboard", _exp_sql("""
SELECT experiment, arg_max(model, auc) AS best_model, round(max(auc), 9) AS best_auc,
       round(arg_max(threshold, auc), 9) AS threshold FROM xp GROUP BY experiment"""))
def a52_leaderboard(spark, sf_dir):
    """Best model by test AUC per experiment, with its threshold."""
    x = _experiments(spark, sf_dir)
    return x.groupBy("experiment").agg(F.max_by("model", "auc").alias("best_model"), r9(F.max("auc"), "best_auc"),
                                       r9(F.max_by("threshold", "auc"), "threshold"))


@query("a53_experiment_deltas", _exp_sql("""
SELECT t.model, round(t.f1 - d.f1, 9) AS delta_f1, round(t.precision - d.precision, 9) AS delta_precision,
       round(t.recall - d.recall, 9) AS delta_recall, round(t.accuracy - d.accuracy, 9) AS delta_accuracy
FROM xp t JOIN xp d ON t.model = d.model AND t.experiment = 'tuned' AND d.experiment = 'default'"""))
def a53_experiment_deltas(spark, sf_dir):
    """Tuned-threshold experiment minus the default one, per model."""
    x = _experiments(spark, sf_dir)
    t = x.filter(F.col("experiment") == "tuned").alias("t")
    d = x.filter(F.col("experiment") == "default").alias("d")
    j = t.join(d, "model")
    return j.select("model", *[r9(F.col(f"t.{m}") - F.col(f"d.{m}"), f"delta_{m}")
                               for m in ("f1", "precision", "recall", "accuracy")])
