"""Order statistics and running sums without a single-partition window.

A window with no ``partitionBy`` plans ``Exchange SinglePartition``: at scale
every row lands in one task.  Two helpers avoid it:

* ``exact_quantiles`` / ``grouped_quantiles`` - exact linear-interpolated
  quantiles (numpy's convention).  ``approxQuantile`` / ``percentile_approx``
  (mergeable sketches) give a value bracket around each wanted rank; one
  counting pass tells how many rows lie below the bracket; only the rows
  inside the bracket (a ~4/accuracy share) are ranked.  The global version
  narrows repeatedly until the bracket is small enough to fetch.
* ``prefix_sums`` / ``with_next`` - running totals (and successor values)
  over a table that holds one row per distinct ordering value.  Rows are
  range-bucketed by sketch boundaries (a bucket is a function of the value,
  so ties never straddle), bucket totals are prefix-summed on a table of one
  row per bucket and joined back, and the row-level window runs inside
  ``partitionBy(bucket)``.  The number of buckets grows with the table.
  Boundaries only steer balance; results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrears.session import cut_lineage

DEFAULT_ACCURACY = 10_000
MAX_FETCH = 100_000
#: Rows that a bucket's window should hold; the number of buckets follows from the table's size.
BUCKET_ROWS, LEAST_BUCKETS = 500_000, 32


def lerp(a: float, b: float, t: float) -> float:
    """numpy's linear interpolation (exact at both ends)."""
    d = b - a
    return b - d * (1.0 - t) if t >= 0.5 else a + d * t


def _positions(n: int, p: float) -> tuple[int, int, float]:
    pos = p * (n - 1)
    k0 = int(math.floor(pos))
    k1 = min(k0 + 1, n - 1)
    return k0, k1, pos - k0


def order_statistics(x: DataFrame, n: int, ranks: Sequence[int],
                     rel_err: float = 1.0 / DEFAULT_ACCURACY,
                     max_fetch: int = MAX_FETCH) -> dict[int, float]:
    """Exact 0-based order statistics of the double column ``x``.

    All wanted ranks narrow together: per round one sketch job (every
    bracket's bounds) and one counting job (rows below / inside every
    bracket); a bracket small enough is fetched and sorted on the driver
    (at most ``max_fetch`` values).  Brackets are guaranteed by the sketch's
    rank error; a violated guarantee falls back to a wider bracket.
    """
    out: dict[int, float] = {}
    # state per rank: (lo, hi, rows below lo, rows inside [lo, hi])
    state = {k: (-math.inf, math.inf, 0, n) for k in set(ranks)}
    while pending := {k: v for k, v in state.items() if k not in out}:
        small = {k: v for k, v in pending.items() if v[3] <= max_fetch}
        if small:
            cond = None
            for lo, hi, _, _ in set(small.values()):
                c = (F.col("x") >= lo) & (F.col("x") <= hi)
                cond = c if cond is None else cond | c
            vals = np.sort(np.array([r[0] for r in x.filter(cond).collect()], dtype=np.float64))
            for k, (lo, hi, below, _) in small.items():
                inside = vals[(vals >= lo) & (vals <= hi)]
                out[k] = float(inside[k - below])
            continue
        big = {k: v for k, v in pending.items() if v[3] > max_fetch}
        probs, keys = [], []
        for k, (lo, hi, below, m) in big.items():
            sub_rank = k - below
            margin = 2.0 * rel_err
            probs += [max(0.0, sub_rank / m - margin), min(1.0, (sub_rank + 1) / m + margin)]
            keys.append(k)
        # one job sketches every bracket, once for all ranks that share it
        shared = sorted({big[k][:2] for k in keys})
        at = {b: [p for i, k in enumerate(keys) if big[k][:2] == b for p in probs[2 * i:2 * i + 2]] for b in shared}
        sketch = x.agg(*[F.percentile_approx(F.when((F.col("x") >= b[0]) & (F.col("x") <= b[1]), F.col("x")),
                                             F.array(*[F.lit(p) for p in at[b]]), int(math.ceil(1 / rel_err))).alias(f"q{j}")
                         for j, b in enumerate(shared)]).first()
        told = {b: iter(sketch[f"q{j}"]) for j, b in enumerate(shared)}
        new = {}
        for i, k in enumerate(keys):
            lo_v, hi_v = next(told[big[k][:2]]), next(told[big[k][:2]])
            new[k] = (big[k][0] if probs[2 * i] == 0.0 else lo_v, big[k][1] if probs[2 * i + 1] == 1.0 else hi_v)
        aggs = []
        for i, k in enumerate(keys):
            lo_v, hi_v = new[k]
            x_ = F.col("x")
            aggs += [F.sum(F.when(x_ < lo_v, 1).otherwise(0)).alias(f"b{i}"),
                     F.sum(F.when((x_ >= lo_v) & (x_ <= hi_v), 1).otherwise(0)).alias(f"m{i}"),
                     F.sum(F.when(x_ == lo_v, 1).otherwise(0)).alias(f"el{i}"),
                     F.sum(F.when(x_ == hi_v, 1).otherwise(0)).alias(f"eh{i}")]
        row = x.agg(*aggs).first()
        for i, k in enumerate(keys):
            b, mm = int(row[f"b{i}"] or 0), int(row[f"m{i}"] or 0)
            el, eh = int(row[f"el{i}"] or 0), int(row[f"eh{i}"] or 0)
            lo_v, hi_v = new[k]
            lo0, hi0, below0, m0 = big[k]
            if not (b <= k < b + mm):
                rel_err /= 4.0                      # guarantee missed: tighten and retry
            elif b <= k < b + el:
                out[k] = float(lo_v)                # the rank sits on a repeated low edge
            elif eh and k >= b + mm - eh:
                out[k] = float(hi_v)                # ... or on a repeated high edge
            elif mm < m0:
                state[k] = (lo_v, hi_v, b, mm)
            else:
                # heavy edges stop the sketch from narrowing: exclude them strictly
                state[k] = (float(np.nextafter(lo_v, np.inf)) if el else lo_v,
                            float(np.nextafter(hi_v, -np.inf)) if eh else hi_v,
                            b + el, mm - el - eh)
    return out


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float],
                    rel_err: float = 1.0 / DEFAULT_ACCURACY) -> list[float | None]:
    """Exact quantiles of ``col`` (linear interpolation, NaN/null ignored)."""
    x = cut_lineage(df.select(F.col(col).cast("double").alias("x")).filter(
        F.col("x").isNotNull() & ~F.isnan("x")))
    n = x.count()
    if n == 0:
        return [None for _ in probs]
    pos = [_positions(n, p) for p in probs]
    stats = order_statistics(x, n, [r for k0, k1, _ in pos for r in (k0, k1)], rel_err, MAX_FETCH)
    return [lerp(stats[k0], stats[k1], t) for k0, k1, t in pos]


#: Rows of a group's bracket that a task may rank.
MAX_RANKED = 100_000


def grouped_quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float],
                      accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Exact per-group quantiles: ``keys..., q0, q1, ...`` (numpy linear).

    Every rank that is asked for (two a quantile) has a bracket of values that holds it.  All
    brackets are narrowed together, in rounds: one aggregate over the rows inside them sketches
    their inner quantiles, another counts the pieces between, and the piece that holds the rank
    becomes the bracket.  Ranks that share a bracket share its rows, and the sketch is only as
    fine as its pieces need.  A value at which a bracket is cut is a piece of its own, so many rows
    that share a value end the search.  A round divides a bracket by about ``PIECES``; it ends as
    soon as a bracket holds ``MAX_RANKED`` rows or fewer, or one value.  Only those rows are
    ranked, so no task holds a group, however large.
    """
    keys = list(keys)
    gk = [f"_g{i}" for i in range(len(keys))]
    x = cut_lineage(df.select(*[F.col(k).alias(g) for k, g in zip(keys, gk)], F.col(col).cast("double").alias("_x")).filter(
        F.col("_x").isNotNull() & ~F.isnan("_x")))
    sizes = x.groupBy(*gk).agg(F.count(F.lit(1)).alias("_in"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    at = [F.lit(float(p)) * (F.col("_in") - 1) for p in probs]
    low = [F.floor(a).cast("long") for a in at]
    ranks = F.array(*[F.struct(F.lit(i).alias("_qi"), F.lit(w).alias("_w"), F.least(k + w, F.col("_in") - 1).alias("_k"), (a - k).alias("_t"))
                      for i, (a, k) in enumerate(zip(at, low)) for w in (0, 1)])
    ids = [*gk, "_qi", "_w"]
    br = cut_lineage(sizes.select(*gk, F.inline(ranks), F.lit(0).cast("long").alias("_below"), "_in", "_lo", "_hi"))
    wide = (F.col("_in") > MAX_RANKED) & (F.col("_lo") < F.col("_hi"))
    span = [*gk, "_below", "_in", "_lo", "_hi"]
    while not (todo := br.where(wide)).isEmpty():
        cuts = _within(x, todo.select(*span).distinct(), gk).groupBy(*span).agg(F.array_distinct(F.percentile_approx(
            "_x", F.array(*[F.lit(i / PIECES) for i in range(1, PIECES)]), min(accuracy, 32 * PIECES))).alias("_cuts"))
        piece = F.size(F.filter("_cuts", lambda c: c < F.col("_x"))) + F.size(F.filter("_cuts", lambda c: c <= F.col("_x")))
        told = _within(x, cut_lineage(cuts), gk)
        counts = told.withColumn("_piece", piece).groupBy(*span, "_piece").agg(
            F.count(F.lit(1)).alias("_m"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
        upto = F.col("_below") + F.sum("_m").over(Window.partitionBy(*span).orderBy("_piece"))
        pieces = counts.withColumn("_to", upto).select(*[F.col(c).alias(f"_p{c}") for c in span], "_m", "_a", "_b", "_to")
        same = [F.col(c).eqNullSafe(F.col(f"_p{c}")) for c in span]
        hit = todo.join(pieces, same).where((F.col("_to") - F.col("_m") <= F.col("_k")) & (F.col("_k") < F.col("_to")))
        new = hit.select(*ids, "_k", "_t", (F.col("_to") - F.col("_m")).alias("_below"), F.col("_m").alias("_in"),
                         F.col("_a").alias("_lo"), F.col("_b").alias("_hi"))
        br = cut_lineage(br.where(~wide).unionByName(new.select(*br.columns)))
    one = br.where("_lo = _hi").select(*gk, "_qi", "_w", "_t", F.col("_lo").alias("_v"))
    own = _within(x, br.where("_lo < _hi"), gk)
    place = F.row_number().over(Window.partitionBy(*ids).orderBy("_x")) - 1 + F.col("_below")
    found = own.withColumn("_r", place).where("_r = _k").select(*gk, "_qi", "_w", "_t", F.col("_x").alias("_v")).unionByName(one)
    picked = found.groupBy(*gk, "_qi").agg(F.max(F.when(F.col("_w") == 0, F.col("_v"))).alias("_a"),
                                           F.max(F.when(F.col("_w") == 1, F.col("_v"))).alias("_b"), F.first("_t").alias("_t"))
    d = F.col("_b") - F.col("_a")
    val = F.when(F.col("_t") >= 0.5, F.col("_b") - d * (1.0 - F.col("_t"))) \
           .otherwise(F.col("_a") + d * F.col("_t"))
    return picked.select(*gk, "_qi", val.alias("_q")).groupBy(*gk).pivot("_qi", list(range(len(probs)))).agg(F.first("_q")) \
        .select(*[F.col(g).alias(k) for g, k in zip(gk, keys)], *[F.col(str(i)).alias(f"q{i}") for i in range(len(probs))])


#: Pieces into which a round cuts a bracket.
PIECES = 32


def _within(x: DataFrame, brackets: DataFrame, gk: list[str]) -> DataFrame:
    """Rows inside their groups' brackets, once per bracket; null keys match each other.

    A group may hold any share of the rows, so they meet the brackets - a row per group and
    quantile - by a broadcast while those are few, and in a join that AQE splits beyond."""
    named = brackets.select(*[F.col(g).alias(f"_b{g}") for g in gk], *[c for c in brackets.columns if c not in gk])
    same = None
    for g in gk:
        c = F.col(g).eqNullSafe(F.col(f"_b{g}"))
        same = c if same is None else same & c
    few = brackets.count() <= BROADCAST_BRACKETS
    return x.join(F.broadcast(named) if few else named, same & (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))).drop(*[f"_b{g}" for g in gk])


BROADCAST_BRACKETS = 100_000


def masked_quantiles(x: DataFrame, mask: str, n_masks: int, col: str, probs: Sequence[float],
                     accuracy: int = DEFAULT_ACCURACY) -> list[list[float | None]]:
    """Exact quantiles of ``col`` over the rows of each bit of ``mask``, without a copy of
    the rows per bit: one sketch cuts the values into slots for all bits, one aggregate counts
    each bit's rows of every slot, and only rows of a slot that holds a wanted rank are ranked."""
    rows = x.select(F.col(col).cast("double").alias("_v"), F.col(mask).alias("_mask")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    cuts = sorted({c for b in boundaries(rows, "_v", max(1, accuracy // PIECES)) for c in (b, math.nextafter(b, math.inf))})  # a value that cuts is a slot
    slotted = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_v", outputCol="_slot").transform(rows)
    on = [F.shiftright("_mask", i).bitwiseAND(F.lit(1)) for i in range(n_masks)]
    counts = slotted.groupBy("_slot").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), *[F.sum(c).alias(f"n{i}") for i, c in enumerate(on)]).collect()  # a row per slot
    counts.sort(key=lambda r: r["_slot"])
    wanted = {}  # (bit, quantile) -> slot, rows below it, and position
    for i in range(n_masks):
        upto = np.cumsum([r[f"n{i}"] for r in counts]) if counts else np.zeros(1)
        for q, p in enumerate(probs):
            if upto[-1]:
                k0, k1, t = _positions(int(upto[-1]), p)
                for w, k in enumerate((k0, k1)):
                    at = int(np.searchsorted(upto, k, "right"))
                    wanted[i, q, w] = (float(counts[at]["_slot"]), int(upto[at - 1]) if at else 0, k, t)
    out = [[None] * len(probs) for _ in range(n_masks)]
    if not wanted:
        return out
    # each bit's rows of each slot that it asks, once, with the ranks that are asked there
    single = {float(r["_slot"]): r["lo"] for r in counts if r["lo"] == r["hi"]}
    value = {(i, k): single[slot] for (i, _, _), (slot, _, k, _) in wanted.items() if slot in single}
    asked: dict = {}
    for (i, _, _), (slot, below, k, _) in wanted.items():
        if slot not in single:
            asked.setdefault((slot, i, below), set()).add(k)
    spark = x.sparkSession
    brackets = spark.createDataFrame([(*key, sorted(ks)) for key, ks in asked.items()], "_slot double, i int, below long, ks array<long>")
    near = slotted.join(F.broadcast(brackets), "_slot").where(F.expr("shiftright(_mask, i) & 1") == 1)
    at = F.row_number().over(Window.partitionBy("_slot", "i").orderBy("_v")) - 1 + F.col("below")
    found = near.select("_slot", "i", "_v", "ks", at.alias("at")).where(F.expr("array_contains(ks, cast(at as bigint))")).select("i", "at", "_v").collect()
    value |= {(r["i"], r["at"]): r["_v"] for r in found}  # two rows per bit and quantile at most
    for (i, q, w), (_, _, k, t) in wanted.items():
        if not w:
            out[i][q] = lerp(value[i, k], value[i, wanted[i, q, 1][2]], t)
    return out


# ---------------------------------------------------------------------------
# running sums over a distinct-value table
# ---------------------------------------------------------------------------

def bucket_count(rows: int) -> int:
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def boundaries(df: DataFrame, ord_col: str, n_buckets: int) -> list[float]:
    """Sketched values that cut the column into buckets of about equal size."""
    probs = [i / n_buckets for i in range(1, n_buckets)]
    bounds = df.approxQuantile(ord_col, probs, 1.0 / (4 * n_buckets)) if probs else []
    return sorted({b for b in bounds if b is not None and math.isfinite(b)})


def _bucketize(df: DataFrame, ord_col: str, n_buckets: int | None) -> DataFrame:
    splits = boundaries(df, ord_col, n_buckets or bucket_count(df.count()))
    if not splits:
        return df.withColumn("_bkt", F.lit(0.0))
    b = Bucketizer(splits=[-math.inf] + splits + [math.inf], inputCol=ord_col,
                   outputCol="_bkt", handleInvalid="keep")
    return b.transform(df)


def prefix_sums(df: DataFrame, order_col: str, sum_cols: Sequence[str],
                partition_cols: Sequence[str] = (), descending: bool = False,
                n_buckets: int | None = None, materialize: bool = True) -> DataFrame:
    """Add ``<c>_cum`` (inclusive running sum) for each ``c`` of ``sum_cols``.

    ``df`` must hold one row per (partition, order value).  Order is
    ascending by ``order_col`` (or descending) within ``partition_cols``.
    The input is read twice (boundary sketch, then the sums); it is cut from
    its lineage first (reliable checkpoint) unless ``materialize=False``.
    """
    part = list(partition_cols)
    if materialize:
        df = cut_lineage(df)
    ordc = F.col(order_col).cast("double")
    d = df.withColumn("_ord", -ordc if descending else ordc)
    d = _bucketize(d, "_ord", n_buckets)
    tot = d.groupBy(*part, "_bkt").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    wb = Window.partitionBy(*part).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*part, "_bkt", *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_o_{c}")
                                        for c in sum_cols])
    # the window below needs the rows by the same keys, so a shuffle join costs nothing more
    d = d.join(offs, part + ["_bkt"])
    w = Window.partitionBy(*part, "_bkt").orderBy("_ord").rowsBetween(Window.unboundedPreceding, 0)
    for c in sum_cols:
        d = d.withColumn(f"{c}_cum", F.col(f"_o_{c}") + F.sum(c).over(w))
    return d.drop("_ord", "_bkt", *[f"_o_{c}" for c in sum_cols])


def with_next(df: DataFrame, order_col: str, cols: Sequence[str],
              partition_cols: Sequence[str] = (), descending: bool = False,
              n_buckets: int | None = None, materialize: bool = True) -> DataFrame:
    """Add ``<c>_next``: value of ``c`` on the next row in the given order
    (null on the last row), without a global window."""
    part = list(partition_cols)
    if materialize:
        df = cut_lineage(df)
    ordc = F.col(order_col).cast("double")
    d = df.withColumn("_ord", -ordc if descending else ordc)
    d = _bucketize(d, "_ord", n_buckets)
    heads = d.groupBy(*part, "_bkt").agg(
        F.min_by(F.struct(*[F.col(c) for c in cols]), F.col("_ord")).alias("_head"))
    wb = Window.partitionBy(*part).orderBy("_bkt")
    heads = heads.select(*part, "_bkt", F.lead("_head").over(wb).alias("_nh"))
    d = d.join(heads, part + ["_bkt"])
    w = Window.partitionBy(*part, "_bkt").orderBy("_ord")
    for c in cols:
        d = d.withColumn(f"{c}_next", F.coalesce(F.lead(c).over(w), F.col("_nh")[c]))
    return d.drop("_ord", "_bkt", "_nh")
