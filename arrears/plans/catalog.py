"""All registered queries (import side effect: registration)."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrears.plans import (catalog_batch, catalog_compare, catalog_eval, catalog_features, catalog_fit,  # noqa: F401
                           catalog_models, catalog_resample, catalog_training)
from arrears.plans.base import SCORED, featurized, scorecards


def flagship(spark, sf_dir):
    """Portfolio summary per split and risk level of scorecard ``a``."""
    from arrears.operators.decide import risk_level
    df = scorecards(featurized(spark, sf_dir, features=SCORED))
    return df.groupBy("split", risk_level(F.col("score_a")).alias("risk_level")).agg(
        F.count(F.lit(1)).alias("n_invoices"), F.round(F.sum("amount"), 2).alias("amount"),
        F.round(F.avg("is_late"), 6).alias("late_rate"), F.round(F.avg("score_a"), 6).alias("mean_score"))
