"""Fit on the training rows only (A1-A18) -> ``Fitted(globals, dims)``.

The reference builds ~35 separate lookup maps.  Here every key column (and
the four interaction pairs) is stacked into one long ``(dim, key)`` stream
and aggregated in ONE pass with map-side partial aggregation - a hot key
(one customer holding a third of the rows) is pre-combined on every mapper
before the shuffle.  Medians and distinct counts, which do not combine that
way, are separate bounded jobs.  Global quantiles are exact (see
``ordered``) and come back as a handful of driver scalars.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrears import constants as K
from arrears.operators import ordered
from arrears.session import cut_lineage

# key column -> prefix used in feature names
AMOUNT_DIMS = {"customer": "cust", "subcategory": "subcat", "division": "div",
               "branch": "branch", "salesperson": "sales", "city": "city"}
TE_DIMS = ["salesperson", "subcategory", "division", "city", "branch", "district",
           "customer_group", "category", "amount_bin"]
FREQ_DIMS = [d for d in TE_DIMS if d != "amount_bin"]
LE_DIMS = ["category", "subcategory", "division", "branch", "province", "city",
           "amount_bin", "salesperson", "district", "customer_group"]
PAIRS = [("division", "branch", "div_branch"), ("salesperson", "division", "sales_div"),
         ("subcategory", "branch", "subcat_branch"), ("city", "division", "city_div")]
SINGLE_DIMS = ["customer", "subcategory", "division", "branch", "salesperson", "city",
               "district", "customer_group", "category", "amount_bin", "province"]
MEDIAN_DIMS = ["branch", "division"]
BROADCAST_MAX_KEYS = 500_000   # ~100 bytes per key row: <= ~50 MB per broadcast dim


@dataclass
class Fitted:
    g: dict                      # global scalars
    dims: DataFrame              # (dim, key, n, amount_avg, amount_std, amount_total, late_mean, te, freq, code, median, n_divisions, n_customers)
    dim_sizes: dict = field(default_factory=dict)   # dim -> number of keys (None = unknown)
    n_classes: dict = field(default_factory=dict)   # LE dim -> number of classes

    def globals_frame(self, spark) -> DataFrame:
        row = {k: (float(v) if v is not None else None) for k, v in self.g.items()
               if k != "bin_edges"}
        df = spark.createDataFrame([row])
        return df.withColumn("bin_edges", F.array(*[F.lit(float(e)) for e in self.g["bin_edges"]]))


def pair_key(a: Column, b: Column) -> Column:
    """``a__b``; a missing operand is the text ``nan`` (as str() of NaN)."""
    return F.concat(F.coalesce(a, F.lit("nan")), F.lit("__"), F.coalesce(b, F.lit("nan")))


def bin_train(amount: Column, edges: list[float]) -> Column:
    """right-closed quartile bins (a, b]; outer edges are +-inf."""
    e = edges
    return (F.when(amount.isNull() | F.isnan(amount), F.lit(None).cast("string"))
             .when(amount <= F.lit(e[1]), F.lit(K.BIN_LABELS[0]))
             .when(amount <= F.lit(e[2]), F.lit(K.BIN_LABELS[1]))
             .when(amount <= F.lit(e[3]), F.lit(K.BIN_LABELS[2]))
             .otherwise(F.lit(K.BIN_LABELS[3])))


def bin_score(amount: Column, edges: list[float]) -> Column:
    """left-closed bins [a, b); anything unmatched falls in the top bin."""
    e = [float("-inf")] + list(edges[1:4]) + [float("inf")]
    expr = F.lit(K.BIN_LABELS[-1])
    for i in reversed(range(4)):
        expr = F.when((amount >= F.lit(e[i])) & (amount < F.lit(e[i + 1])), F.lit(K.BIN_LABELS[i])).otherwise(expr)
    return expr


def stacked(df: DataFrame) -> DataFrame:
    """One row per (input row, dim): ``dim, key, amount, is_late``."""
    items = [F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("key")) for d in SINGLE_DIMS]
    items += [F.struct(F.lit(p).alias("dim"), pair_key(F.col(a), F.col(b)).alias("key"))
              for a, b, p in PAIRS]
    return df.select("amount", "is_late", F.inline(F.array(*items)))


def amount_stats() -> list[Column]:
    """mean, sample std (one row, or an infinite amount: 0) and total, in doubles; NaN is
    missing.  Spark's deviation merges central moments, so large amounts lose no digits."""
    x = F.when(~F.isnan("amount"), F.col("amount").cast("double"))
    std = F.stddev_samp(x)
    return [F.avg(x).alias("amount_avg"),
            F.when(std.isNull() | F.isnan(std), F.lit(0.0)).otherwise(std).alias("amount_std"),
            F.sum(x).alias("amount_total")]


def fit_globals(train: DataFrame) -> dict:
    """A2, A4, A5, A6 (global), A17 - bounded driver scalars."""
    row = train.agg(F.count(F.lit(1)).alias("n"), *amount_stats(), F.avg("is_late").alias("late_rate")) \
        .withColumnRenamed("amount_avg", "amount_mean").first()
    q = ordered.exact_quantiles(train, "amount",
                                [K.WINSOR_LOWER, K.WINSOR_UPPER, 0.0, 0.25, 0.5, 0.75, 1.0])
    edges = [float("-inf"), q[3], q[4], q[5], float("inf")]
    return {"n_train": row.n, "amount_mean": row.amount_mean, "late_rate": row.late_rate,
            "winsor_lo": q[0], "winsor_hi": q[1], "amount_median": q[4],
            "amount_min": q[2], "amount_max": q[6], "bin_edges": edges}


def fit(train: DataFrame, with_medians: bool = True) -> Fitted:
    """Fit every lookup table on ``train`` (rows of one split only).

    ``train`` is read by several passes (scalars, quantile brackets, the
    stacked aggregate, distinct pairs), each of a few columns, so it should be
    a staged table: a copy in the executors' caches would hold every column.
    The aggregate is staged, as five later steps read it; the fitted dims are
    cut from lineage with a reliable checkpoint.
    """
    g = fit_globals(train)
    tr = train.withColumn("amount_bin", bin_train(F.col("amount"), g["bin_edges"]))
    agg = cut_lineage(stacked(tr).groupBy("dim", "key").agg(
        F.count(F.lit(1)).alias("n"),
        *amount_stats(),
        F.avg("is_late").alias("late_mean"),
        F.sum("is_late").cast("long").alias("late_sum"),
    ))
    gl = F.lit(g["late_rate"])
    smooth = F.when(F.col("dim").isin(*[p for _, _, p in PAIRS]), F.lit(K.PAIR_TE_SMOOTHING)) \
              .otherwise(F.lit(K.TE_SMOOTHING))
    te = (F.col("n") * F.col("late_mean") + smooth * gl) / (F.col("n") + smooth)
    nonnull = F.col("key").isNotNull()
    # per-dim totals: one row per dim (<= 15 rows) -> broadcast, no window over keys
    totals = agg.filter(nonnull).groupBy("dim").agg(F.sum("n").alias("_dim_n"))
    dims = agg.join(F.broadcast(totals), "dim", "left").select(
        "dim", "key",
        F.when(nonnull, F.col("n")).alias("n"),
        F.when(nonnull, F.col("amount_avg")).alias("amount_avg"),
        F.when(nonnull, F.col("amount_std")).alias("amount_std"),
        F.when(nonnull, F.col("amount_total")).alias("amount_total"),
        F.when(nonnull, F.col("late_mean")).alias("late_mean"),
        F.when(nonnull, F.col("late_sum")).alias("late_sum"),
        F.when(nonnull, te).alias("te"),
        F.when(nonnull, F.col("n") / F.col("_dim_n")).alias("freq"),
    )
    # Codes of sorted labels (missing -> text 'nan') for the LE dims only
    labels = agg.filter(F.col("dim").isin(*LE_DIMS)).select(
        "dim", "key", F.coalesce("key", F.lit("nan")).alias("_label"))
    codes = labels.join(label_codes(labels.select("dim", "_label").distinct()), ["dim", "_label"]).select("dim", "key", "code")
    dims = dims.join(codes, (dims.dim == codes.dim) & dims.key.eqNullSafe(codes.key), "left") \
        .select(dims["*"], codes.code)
    # Distinct divisions / customers per salesperson (two-stage distinct)
    div_n = tr.select("salesperson", "division").distinct().groupBy("salesperson") \
        .agg(F.count("division").alias("n_divisions"))
    cust_n = tr.select("salesperson", "customer").distinct().groupBy("salesperson") \
        .agg(F.count("customer").alias("n_customers"))
    sales = div_n.join(cust_n, "salesperson", "full").select(
        F.lit("salesperson").alias("dim"), F.col("salesperson").alias("key"),
        "n_divisions", "n_customers")
    dims = dims.join(sales, ["dim", "key"], "left")  # null keys never match: fine
    if with_medians:
        # Branch / division medians (exact, bracketed)
        med_in = tr.select(F.inline(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("key"))
                                              for d in MEDIAN_DIMS])), "amount") \
                   .filter(F.col("key").isNotNull())
        meds = ordered.grouped_quantiles(med_in, ["dim", "key"], "amount", [0.5]) \
            .withColumnRenamed("q0", "median")
        dims = dims.join(meds, ["dim", "key"], "left")
    else:
        dims = dims.withColumn("median", F.lit(None).cast("double"))

    dims = cut_lineage(dims)
    # bounded scalars: dim sizes, class counts, A3, A13
    sizes = {r.dim: (r.n_keys, r.n_labels) for r in dims.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_distinct(F.coalesce("key", F.lit("nan"))).alias("n_labels")).collect()}
    dim_sizes = {d: v[0] for d, v in sizes.items()}
    n_classes = {d: sizes.get(d, (0, 0))[1] for d in LE_DIMS}
    cust_total_mean = dims.filter((F.col("dim") == "customer") & F.col("key").isNotNull()) \
        .agg(F.avg("amount_total")).first()[0]
    sales_tab = dims.filter((F.col("dim") == "salesperson") & F.col("key").isNotNull())
    div_med, cust_med = (ordered.exact_quantiles(sales_tab, "n_divisions", [0.5])[0],
                         ordered.exact_quantiles(sales_tab, "n_customers", [0.5])[0])
    g.update(cust_total_mean=cust_total_mean, diversity_median=div_med, sales_cust_median=cust_med)
    return Fitted(g=g, dims=dims, dim_sizes=dim_sizes, n_classes=n_classes)


def label_codes(labels: DataFrame) -> DataFrame:
    """0-based position of each distinct (dim, _label) among its dim's sorted labels.

    Labels are dealt by range and the part is kept as a column, so a window only ever holds
    one part of one dim; the parts' sizes, summed in front, make the codes run on."""
    parts = cut_lineage(labels.repartitionByRange("dim", "_label").withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("dim", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("dim").orderBy("_part")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("dim", "_part").orderBy("_label")) - 1
    return parts.withColumn("_at", inside).join(before, ["dim", "_part"]).select(
        "dim", "_label", (F.col("_before") + F.col("_at")).cast("int").alias("code"))


def dim_table(fitted: Fitted, dim: str, cols: list[str], by_label: bool = False) -> DataFrame:
    t = fitted.dims.filter(F.col("dim") == dim)
    if by_label:
        # one row per label; a real key wins over the missing-key row
        t = t.groupBy(F.coalesce("key", F.lit("nan")).alias("label")).agg(
            F.max_by(F.struct(*cols), F.col("key").isNotNull()).alias("_r")).select("label", "_r.*")
    else:
        t = t.filter(F.col("key").isNotNull()).select("key", *cols)
    return F.broadcast(t) if is_small(fitted, dim) else t


def is_small(fitted: Fitted, dim: str) -> bool:
    """Broadcast only a dim whose key count was measured at fit time."""
    n = fitted.dim_sizes.get(dim)
    return n is not None and n <= BROADCAST_MAX_KEYS
