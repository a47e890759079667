"""Decisions on scores (F13-F17, F21, A44-A46): pure column expressions and
single-pass aggregates, applied late so the threshold stays a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears import constants as K


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def risk_label(score: Column | str, threshold: float | Column) -> Column:
    """score >= t -> BERISIKO else LAYAK; a missing score stays null."""
    s = _c(score)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(s.isNull(), F.lit(None).cast("string")) \
            .when(s >= t, F.lit(K.LABEL_RISKY)).otherwise(F.lit(K.LABEL_OK))


def risk_level(score: Column | str) -> Column:
    """< 0.4 low, < 0.7 medium, else high."""
    s = _c(score)
    return F.when(s.isNull(), F.lit(None).cast("string")) \
            .when(s < K.RISK_LOW_BELOW, F.lit("low")) \
            .when(s < K.RISK_MEDIUM_BELOW, F.lit("medium")).otherwise(F.lit("high"))


def threshold_regime(threshold: Column | str) -> Column:
    """<= .30 aggressive, <= .45 balanced-low, <= .54 balanced,
    <= .70 conservative, above very conservative."""
    t = _c(threshold)
    e = K.REGIME_EDGES
    return F.when(t <= e[0], F.lit("aggressive")).when(t <= e[1], F.lit("balanced_low")) \
            .when(t <= e[2], F.lit("balanced")).when(t <= e[3], F.lit("conservative")) \
            .otherwise(F.lit("very_conservative"))


def recommendation(label_a: Column | str, label_b: Column | str) -> Column:
    """F16: both low / both high / disagree (single model when b missing)."""
    a, b = _c(label_a), _c(label_b)
    return F.when(b.isNull(), F.when(a == K.LABEL_RISKY, F.lit("high")).otherwise(F.lit("low"))) \
            .when((a == K.LABEL_OK) & (b == K.LABEL_OK), F.lit("both_low")) \
            .when((a == K.LABEL_RISKY) & (b == K.LABEL_RISKY), F.lit("both_high")) \
            .otherwise(F.lit("disagree"))


def comparison_rows(df: DataFrame, threshold: float, models=("a", "b")) -> DataFrame:
    """one row per (invoice, model): probability, label, above-threshold, level."""
    items = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"score_{m}").alias("probability")) for m in models])
    x = df.select("*", F.inline(items))
    return x.withColumn("label", risk_label("probability", threshold)) \
            .withColumn("above_threshold", F.col("probability") >= F.lit(threshold)) \
            .withColumn("risk_level", risk_level("probability"))


def significance(p: Column | str) -> Column:
    """flag p < .05 and the display floor p < .001."""
    pc = _c(p)
    return F.when(pc < 0.001, F.lit("p < 0.001")).when(pc < 0.05, F.lit("significant")) \
            .otherwise(F.lit("not significant"))


def batch_summary(df: DataFrame, threshold: float, by=()) -> DataFrame:
    """Total, flagged (either model >= t), not flagged, mean score a
    (failed rows carry a null score; the reference's 0.0 view is
    ``coalesce(score, 0)``)."""
    t = F.lit(float(threshold))
    flagged = (F.coalesce(F.col("score_a") >= t, F.lit(False)) | F.coalesce(F.col("score_b") >= t, F.lit(False)))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(flagged.cast("int")).cast("long").alias("flagged"),
        F.sum((~flagged).cast("int")).cast("long").alias("not_flagged"),
        F.avg(F.coalesce(F.col("score_a"), F.lit(0.0))).alias("mean_score"))


def decision_summary(df: DataFrame, by=()) -> DataFrame:
    """Count, high-risk (either label risky), mean score (0 if empty)."""
    risky = (F.coalesce(F.col("label_a") == K.LABEL_RISKY, F.lit(False)) |
             F.coalesce(F.col("label_b") == K.LABEL_RISKY, F.lit(False)))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_decisions"),
        F.sum(risky.cast("int")).cast("long").alias("n_high_risk"),
        F.coalesce(F.avg("score_a"), F.lit(0.0)).alias("mean_score"))


def batch_totals(df: DataFrame, by=()) -> DataFrame:
    """Total / processed / failed rows of a scored batch."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.sum(F.col("error").isNull().cast("int")).cast("long").alias("processed_rows"),
        F.sum(F.col("error").isNotNull().cast("int")).cast("long").alias("failed_rows"))
