"""arrears — late-payment risk analytics on Spark.

Plain functions ``DataFrame -> DataFrame``; every stage is a lazy Spark
plan.  Driver-side work is limited to bounded scalars (quantile brackets,
p-values of a handful of counts, grid literals).
"""

from arrears.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
