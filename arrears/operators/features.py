"""Fitted tables -> the 69-column feature row.

One left join per key column (11) and per interaction pair (4), each against
a dim filtered out of the long fitted table; dims whose key count was
measured small at fit time are broadcast, the others (customers, pairs at
scale) are left to AQE and come first, while rows are narrow.  A caller that
reads a few features names them, and only their lookups are planned (an outer
join whose columns nobody reads is not dropped by Catalyst).  Every lookup has
the reference's default on a miss.

Two modes (train/serve skew is part of the reference's behaviour):
* ``offline`` - quartile bins right-closed, ``amount_pct`` is the true
  average-tie rank inside the row's split, customer late rate is
  leave-one-out on ``split == 'train'`` rows and a lookup elsewhere.
* ``online`` - bins left-closed with a top-bin default, ``amount_pct`` is the
  bin centre (i + 0.5) / 4, customer late rate is a lookup.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears import constants as K
from arrears.operators import ordered
from arrears.operators.fit import (AMOUNT_DIMS, FREQ_DIMS, LE_DIMS, PAIRS, SINGLE_DIMS, TE_DIMS, Fitted,
                                   bin_score, bin_train, dim_table, is_small, pair_key)

FEATURES: list[str] = (
    ["amount", "amount_winsor", "log_amount", "log_amount_winsor", "amount_pct",
     "is_group_customer", "has_remark",
     "cust_avg_amount", "cust_tx_count", "cust_std_amount", "cust_total_amount", "cust_late_rate"]
    + [f"{p}_{s}" for p in ("subcat", "div", "branch", "sales", "city")
       for s in ("avg_amount", "tx_count", "std_amount")]
    + ["branch_amount_ratio", "div_amount_ratio", "amount_cust_zscore",
       "log_amount_vs_branch", "log_amount_vs_div"]
    + [f"te_{d}" for d in TE_DIMS]
    + [f"freq_{d}" for d in FREQ_DIMS]
    + [f"te_{p}" for _, _, p in PAIRS]
    + [f"freq_{p}" for _, _, p in PAIRS]
    + ["sales_div_diversity", "sales_cust_count"]
    + [f"code_{d}" for d in LE_DIMS]
)
CAT_FEATURES = [f for f in FEATURES if f.startswith("code_")]
CONT_FEATURES = [f for f in FEATURES if f not in CAT_FEATURES]
BINARY_FEATURES = ["is_group_customer", "has_remark"]
INTEGER_FEATURES = [f"{p}_tx_count" for p in ("cust", "subcat", "div", "branch", "sales", "city")] \
    + ["sales_div_diversity", "sales_cust_count"] + CAT_FEATURES
assert len(FEATURES) == 69


def _lookup(df: DataFrame, fitted: Fitted, dim: str, key: Column, cols: list[str]) -> DataFrame:
    """Left equi-join against one fitted dim.  Dims with label codes join on
    the label (missing -> 'nan', one row per label), so a missing key still
    finds its code; its statistics are then blanked (a missing key never
    matches a statistic in the reference) and fall back to the defaults.
    Plain equality keys keep the generated code small."""
    if "code" in cols:
        t = dim_table(fitted, dim, cols, by_label=True)
        ren = t.select(F.col("label").alias(f"_k_{dim}"), *[F.col(c).alias(f"_{dim}_{c}") for c in cols])
        out = df.join(ren, F.coalesce(key, F.lit("nan")) == F.col(f"_k_{dim}"), "left").drop(f"_k_{dim}")
        stats = [c for c in cols if c != "code"]
        if stats:
            out = out.select(*[F.when(key.isNotNull(), F.col(c)).alias(c) if c in {f"_{dim}_{s}" for s in stats}
                               else F.col(c) for c in out.columns])
        return out
    t = dim_table(fitted, dim, cols)
    ren = t.select(F.col("key").alias(f"_k_{dim}"), *[F.col(c).alias(f"_{dim}_{c}") for c in cols])
    return df.join(ren, key == F.col(f"_k_{dim}"), "left").drop(f"_k_{dim}")


def pct_rank_within(df: DataFrame, part: str, col: str, out: str) -> DataFrame:
    """Average-tie percentile rank of ``col`` inside each ``part``
    (distributed prefix counts; no single-partition window)."""
    cnt = df.filter(F.col(col).isNotNull()).groupBy(part, col).agg(F.count(F.lit(1)).alias("_c"))
    cum = ordered.prefix_sums(cnt, col, ["_c"], partition_cols=[part])
    tot = cnt.groupBy(part).agg(F.sum("_c").alias("_n"))
    r = cum.join(F.broadcast(tot), part).select(
        part, col, ((F.col("_c_cum") - F.col("_c") + (F.col("_c") + 1) / 2.0) / F.col("_n")).alias(out))
    return df.join(r, [part, col], "left")


#: What a feature looks up: (dim, fitted column) each; features that look nothing up are absent.
LOOKUPS: dict[str, list[tuple[str, str]]] = (
    {f"{pre}_{f}": [(dim, c)] for dim, pre in AMOUNT_DIMS.items()
     for f, c in (("avg_amount", "amount_avg"), ("tx_count", "n"), ("std_amount", "amount_std"))}
    | {"cust_total_amount": [("customer", "amount_total")],
       "cust_late_rate": [("customer", c) for c in ("n", "late_mean", "late_sum")],
       "branch_amount_ratio": [("branch", "median")], "div_amount_ratio": [("division", "median")],
       "amount_cust_zscore": [("customer", "amount_avg"), ("customer", "amount_std")],
       "log_amount_vs_branch": [("branch", "amount_avg")], "log_amount_vs_div": [("division", "amount_avg")],
       "sales_div_diversity": [("salesperson", "n_divisions")], "sales_cust_count": [("salesperson", "n_customers")]}
    | {f"te_{d}": [(d, "te")] for d in TE_DIMS} | {f"freq_{d}": [(d, "freq")] for d in FREQ_DIMS}
    | {f"{c}_{p}": [(p, c)] for _, _, p in PAIRS for c in ("te", "freq")}
    | {f"code_{d}": [(d, "code")] for d in LE_DIMS})


def shuffle_groups(fitted: Fitted, features: Sequence[str], mode: str = "offline") -> list[list[str]]:
    """The features in groups that each shuffle the rows once at most: those of one look-up that is
    not broadcast, the percentile rank, and all others, for which no row moves.  A reader that only
    aggregates features asks ``transform`` for one group at a time: the rows it shuffles then carry
    what that group reads, not all keys."""
    groups: dict[str, list[str]] = {}
    for f in features:
        moved = [d for d, _ in LOOKUPS.get(f, ()) if not is_small(fitted, d)]
        by = "amount_pct" if f == "amount_pct" and mode == "offline" else moved[0] if moved else ""
        groups.setdefault(by, []).append(f)
    return list(groups.values())


def transform(df: DataFrame, fitted: Fitted, mode: str = "offline", features: Sequence[str] | None = None) -> DataFrame:
    """Append the 69 features, or those named, to ``df`` (keeps the input columns)."""
    wanted = [f for f in FEATURES if features is None or f in features]
    if features is not None and len(wanted) != len(set(features)):
        raise ValueError(f"no such features: {sorted(set(features) - set(wanted))}")
    g = fitted.g
    gl = F.lit(g["late_rate"])
    amount = F.col("amount").cast("double")
    if mode == "offline" and "amount_pct" in wanted:
        # W1 on the narrow input rows (the shuffle-join back carries ~20 columns, not ~90)
        df = pct_rank_within(df, "split", "amount", "amount_pct")
    out = df.withColumn("is_group_customer", (~F.col("customer_group").eqNullSafe(F.lit(K.NON_GROUP))).cast("int")) \
            .withColumn("has_remark", (~F.col("remark").eqNullSafe(F.lit(K.NO_REMARK))).cast("int"))
    if mode == "offline":
        out = out.withColumn("amount_bin", bin_train(amount, g["bin_edges"]))
    else:
        out = out.withColumn("amount_bin", bin_score(amount, g["bin_edges"]))
    keys = {dim: F.col(dim) for dim in SINGLE_DIMS} | {p: pair_key(F.col(a), F.col(b)) for a, b, p in PAIRS}
    used = {u for f in wanted for u in LOOKUPS.get(f, ())}
    want = {dim: cols for dim in keys if (cols := [c for d, c in sorted(used) if d == dim])}
    # a lookup that shuffles the rows moves what those before it have added: these come first, the least of them ahead
    for dim in sorted(want, key=lambda d: (is_small(fitted, d), len(want[d]))):
        out = _lookup(out, fitted, dim, keys[dim], want[dim])

    cols: dict[str, Column] = {}
    cols["amount"] = amount
    lo, hi = g["winsor_lo"], g["winsor_hi"]
    cols["amount_winsor"] = F.least(F.greatest(amount, F.lit(lo)), F.lit(hi))  # F1
    cols["log_amount"] = F.log1p(amount)  # F2
    cols["log_amount_winsor"] = F.log1p(F.least(F.greatest(amount, F.lit(lo)), F.lit(hi)))
    if mode == "online":
        idx = F.when(F.col("amount_bin") == K.BIN_LABELS[0], 0).when(F.col("amount_bin") == K.BIN_LABELS[1], 1) \
               .when(F.col("amount_bin") == K.BIN_LABELS[2], 2).otherwise(3)
        cols["amount_pct"] = (idx + F.lit(0.5)) / F.lit(4.0)  # F5
    cols["is_group_customer"] = F.col("is_group_customer")
    cols["has_remark"] = F.col("has_remark")
    gm = F.lit(g["amount_mean"])
    for dim, pre in AMOUNT_DIMS.items():
        cols[f"{pre}_avg_amount"] = F.coalesce(F.col(f"_{dim}_amount_avg"), gm)
        cols[f"{pre}_tx_count"] = F.coalesce(F.col(f"_{dim}_n"), F.lit(1)).cast("long")
        cols[f"{pre}_std_amount"] = F.coalesce(F.col(f"_{dim}_amount_std"), F.lit(0.0))
    cols["cust_total_amount"] = F.coalesce(F.col("_customer_amount_total"), F.lit(g["cust_total_mean"]))
    lookup_rate = F.coalesce(F.col("_customer_late_mean"), gl)
    if mode == "offline":
        n, s = F.col("_customer_n"), F.col("_customer_late_sum")
        loo = F.when(n > 1, (s - F.col("is_late")) / (n - 1)).otherwise(gl)   # W2
        cols["cust_late_rate"] = F.when(F.col("split") == "train", loo).otherwise(lookup_rate)
    else:
        cols["cust_late_rate"] = lookup_rate
    gmed = F.lit(g["amount_median"])
    cols["branch_amount_ratio"] = amount / (F.coalesce(F.col("_branch_median"), gmed) + 1)  # F6
    cols["div_amount_ratio"] = amount / (F.coalesce(F.col("_division_median"), gmed) + 1)
    cavg, cstd = cols["cust_avg_amount"], cols["cust_std_amount"]
    cols["amount_cust_zscore"] = F.when(cstd > 0, (amount - cavg) / cstd).otherwise(F.lit(0.0))  # F7
    cols["log_amount_vs_branch"] = F.log1p(amount) - F.log1p(cols["branch_avg_amount"])  # F8
    cols["log_amount_vs_div"] = F.log1p(amount) - F.log1p(cols["div_avg_amount"])
    for d in TE_DIMS:
        cols[f"te_{d}"] = F.coalesce(F.col(f"_{d}_te"), gl)
    for d in FREQ_DIMS:
        cols[f"freq_{d}"] = F.coalesce(F.col(f"_{d}_freq"), F.lit(0.0))
    for _, _, p in PAIRS:
        cols[f"te_{p}"] = F.coalesce(F.col(f"_{p}_te"), gl)
        cols[f"freq_{p}"] = F.coalesce(F.col(f"_{p}_freq"), F.lit(0.0))
    cols["sales_div_diversity"] = F.coalesce(F.col("_salesperson_n_divisions").cast("double"),
                                             F.lit(g["diversity_median"]))
    cols["sales_cust_count"] = F.coalesce(F.col("_salesperson_n_customers").cast("double"),
                                          F.lit(g["sales_cust_median"]))
    for d in LE_DIMS:  # J11: unseen -> number of classes
        cols[f"code_{d}"] = F.coalesce(F.col(f"_{d}_code"), F.lit(fitted.n_classes.get(d, 0))).cast("int")

    keep = [c for c in df.columns if c not in wanted and c != "amount_pct"] + ["amount_bin"]
    if mode == "offline":
        cols["amount_pct"] = F.col("amount_pct")
    return out.select(*keep, *[cols[k].alias(k) for k in wanted])


def model_matrix(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """P12 + P13: exactly the 69 features in order, absent -> 0.0, and
    non-finite values -> 0 (what both scorers see)."""
    sel = []
    for f in FEATURES:
        if f in df.columns:
            c = F.col(f).cast("double")
            sel.append(F.when(c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0))
                       .otherwise(c).alias(f))
        else:
            sel.append(F.lit(0.0).alias(f))
    return df.select(*(keep or []), *sel)
