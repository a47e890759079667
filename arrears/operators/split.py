"""Customer-disjoint split.

The split of a row is a pure function of ``md5('<seed>:' || customer)``: no
join, no shuffle, the same answer on every executor and in SQL.  Shares are
shares of customers (as in the reference), approximated by hash buckets;
``assign_split_exact`` numbers the customers and gives them exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears import constants as K


def cut_hex(share: float) -> str:
    """Two-hex-digit bucket bound for a cumulative share (0.70 -> 'b3')."""
    return format(min(int(share * 256), 255), "02x")


def split_expr(customer: Column, seed: Column | int,
               train_share: float = K.TRAIN_SHARE,
               val_share: float = K.VAL_SHARE) -> Column:
    return split_of(split_hash(customer, seed), train_share, val_share)


def split_hash(customer: Column, seed: Column | int) -> Column:
    """Two hex digits: a customer's place under a seed."""
    seed_c = seed if isinstance(seed, Column) else F.lit(seed)
    return F.substring(F.md5(F.concat(seed_c.cast("string"), F.lit(":"), customer)), 1, 2)


def split_of(h: Column, train_share: float = K.TRAIN_SHARE, val_share: float = K.VAL_SHARE) -> Column:
    return (F.when(h < F.lit(cut_hex(train_share)), F.lit("train"))
             .when(h < F.lit(cut_hex(train_share + val_share)), F.lit("val"))
             .otherwise(F.lit("test")))


def assign_split(df: DataFrame, seed: int = K.FIXTURE_SEED,
                 customer_col: str = "customer") -> DataFrame:
    return df.withColumn("split", split_expr(F.col(customer_col), seed))


def assign_split_exact(df: DataFrame, seed: int = K.FIXTURE_SEED, train_share: float = K.TRAIN_SHARE,
                       val_share: float = K.VAL_SHARE, customer_col: str = "customer") -> DataFrame:
    """The split with exact shares of customers: customers in the order of their hash, the
    first round(n * share) for training, the next ones for validation.  One shuffle of
    distinct customers to number them, and a join back."""
    from arrears.operators.fit import label_codes
    customers = df.select(F.col(customer_col).alias("_customer")).dropna().distinct().select(
        F.lit("customer").alias("dim"), "_customer",
        F.concat(F.md5(F.concat(F.lit(f"{seed}:"), "_customer")), F.lit(":"), "_customer").alias("_label"))
    ranked = customers.join(label_codes(customers.select("dim", "_label")), ["dim", "_label"])
    n = customers.count()
    first = int(n * train_share + 0.5)
    second = first + int(n * val_share + 0.5)
    named = ranked.select("_customer", F.when(F.col("code") < first, "train").when(F.col("code") < second, "val")
                          .otherwise("test").alias("split"))
    return df.join(named, df[customer_col] == F.col("_customer"), "left").drop("_customer")


def uniform_from(key: Column) -> Column:
    """Deterministic U[0,1) from the first 8 hex digits of md5(key)."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def split_profile(df: DataFrame) -> DataFrame:
    """Rows, customers and late rate per split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("customer").alias("n_customers"),
        F.avg("is_late").alias("late_rate"))
