"""Cleaning (P1-P6): target, category filter/merge, fills, flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears import constants as K


def parse_day_first(c: Column | str) -> Column:
    """Day-first date text (``31/1/2024``) -> date; bad text -> null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.to_date(F.try_to_timestamp(c, F.lit("d/M/yyyy")))


def late_flag(age: Column | str, late_days: int = K.LATE_DAYS) -> Column:
    """``age > late_days`` as int, missing age -> 0."""
    age = F.col(age) if isinstance(age, str) else age
    return F.coalesce((age > F.lit(late_days)).cast("int"), F.lit(0))


def clean(df: DataFrame, drop_category: str = K.DROP_CATEGORY,
          merge_categories: Sequence[str] = K.MERGE_CATEGORIES,
          late_days: int = K.LATE_DAYS) -> DataFrame:
    """P2-P5.  A missing category is kept (null-safe inequality)."""
    out = df.withColumn("is_late", late_flag("age_days", late_days))
    out = out.filter(~F.col("category").eqNullSafe(F.lit(drop_category)))
    out = out.withColumn(
        "category",
        F.when(F.col("category").isin(*merge_categories), F.lit(K.OTHER))
         .otherwise(F.col("category")))
    return out.fillna({"remark": K.NO_REMARK, "subdistrict": K.UNKNOWN,
                       "district": K.UNKNOWN})


def fixture_clean(df: DataFrame) -> DataFrame:
    return clean(df, K.FIXTURE_DROP_CATEGORY, K.FIXTURE_MERGE_CATEGORIES)
