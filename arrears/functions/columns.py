"""Small column-expression helpers.

Pure ``pyspark.sql.functions`` expressions: they stay inside whole-stage
codegen and can be dropped into any projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: column groups the reference excludes from the model (P17):
# leaky (age and the calendar features), the row id, and redundant codes.
EXCLUDED_LEAKY = ["age_days", "month", "day_of_week", "quarter", "day_of_month", "week_of_year",
                  "is_weekend", "is_month_end"]
EXCLUDED_ID = ["invoice_id"]
EXCLUDED_REDUNDANT = ["division_code", "category_code", "subcategory_code", "customer_group_code",
                      "salesperson_code"]
BALANCE_FEATURES = ["balance", "balance_winsor", "log_balance", "payment_ratio", "has_partial_payment",
                    "amount_minus_balance", "log_amount_minus_balance"]
CALENDAR_FEATURES = ["month", "day_of_week", "quarter", "day_of_month", "week_of_year", "is_weekend",
                     "is_month_end"]


def balance_features(df: DataFrame, lo: float, hi: float) -> DataFrame:
    """P20 (formulas ours, names from the reference's config): remaining
    balance, its winsorised form (train 1/99 % bounds), log1p, paid share
    1 - balance/amount, partial-payment flag, amount minus balance and its log1p."""
    a, b = F.col("amount"), F.col("balance")
    return df.select("*",
                     b.alias("balance_feature"),
                     F.least(F.greatest(b, F.lit(lo)), F.lit(hi)).alias("balance_winsor"),
                     F.log1p(b).alias("log_balance"),
                     F.when(a != 0, 1 - b / a).otherwise(F.lit(0.0)).alias("payment_ratio"),
                     (b < a).cast("int").alias("has_partial_payment"),
                     (a - b).alias("amount_minus_balance"),
                     F.log1p(a - b).alias("log_amount_minus_balance")).drop("balance_feature")


def calendar_features(df: DataFrame, date_col: str = "invoice_date") -> DataFrame:
    """P21 (conventions ours: Monday = 0; ISO week)."""
    d = F.col(date_col)
    dow = (F.dayofweek(d) + 5) % 7
    return df.select("*", F.month(d).alias("month"), dow.alias("day_of_week"), F.quarter(d).alias("quarter"),
                     F.dayofmonth(d).alias("day_of_month"), F.weekofyear(d).alias("week_of_year"),
                     (dow >= 5).cast("int").alias("is_weekend"), (d == F.last_day(d)).cast("int").alias("is_month_end"))


def drop_excluded(df: DataFrame) -> DataFrame:
    """Remove leaky, id and redundant-code columns when present."""
    return df.drop(*[c for c in EXCLUDED_LEAKY + EXCLUDED_ID + EXCLUDED_REDUNDANT if c in df.columns])


def partition_columns(columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """(categorical codes, continuous) by the ``code_`` prefix."""
    cat = [c for c in columns if c.startswith("code_")]
    return cat, [c for c in columns if c not in cat]


def prediction_id(ts: Column, key: Column) -> Column:
    """F18 (deterministic variant): ``pred_<utc yyyyMMdd_HHmmss>_<8 hex of md5(key)>``."""
    return F.concat(F.lit("pred_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit("_"),
                    F.substring(F.md5(key.cast("string")), 1, 8))


def metric_label(name: Column) -> Column:
    """strip ``test_`` and upper-case (``test_auc`` -> ``AUC``)."""
    return F.upper(F.regexp_replace(name, "^test_", ""))


def feature_label(name: Column) -> Column:
    """underscores to spaces for display."""
    return F.regexp_replace(name, "_", " ")


def percent_text(x: Column, decimals: int = 1) -> Column:
    """``12.3%``; a missing value shows a dash (export only)."""
    return F.when(x.isNull() | F.isnan(x), F.lit("-")).otherwise(
        F.concat(F.format_number(x * 100, decimals), F.lit("%")))


def fixed_text(x: Column, decimals: int = 4) -> Column:
    return F.when(x.isNull() | F.isnan(x), F.lit("-")).otherwise(F.format_number(x, decimals))


def clean_text(c: Column) -> Column:
    """trim and drop surrounding quotes."""
    return F.regexp_replace(F.trim(c), '^"|"$', "")


def model_pair_long(wide: DataFrame, metric: str, key: str = "seed", models=("xgb", "mlp")) -> DataFrame:
    """One metric's per-model columns (``<model>_<metric>``) -> long rows."""
    return wide.unpivot([key], [f"{m}_{metric}" for m in models], "column", "value") \
        .select(key, F.regexp_extract("column", "^([^_]+)_", 1).alias("model"), "value")
