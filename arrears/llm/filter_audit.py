"""Op 12: how quality filters interact, in every order of application.

Each row gets a number when its facts are written; numbers fall into ranges of ``RANGE``.
For every part and range there is one row of posting lists: the sorted numbers of the rows
that fail each filter, and of the rows with a good or toxic label.  A list holds at most
``RANGE`` numbers, so a part with a third of all rows is spread over its ranges.

A task merges the lists of a range: unions of the failing lists for every set of filters,
built up list by list, each step galloping through the longer list by doubling steps; and
the same within the good and the toxic rows, by intersection first.  Unions of different
ranges are disjoint, so their sizes are summed.  What a filter removes after a set of others
is the difference of two of these unions; every order, step and Shapley sum follows from the
sizes of 32 unions of a part, 120 orders being a fixed list.

Whether a text repeats an earlier one is decided over the whole table by its digest: groups
that hold over a thousandth of all rows are broadcast (fewer than a thousand), the others
are joined.

Cases: a null text is empty (no word: too short, but not repetitive); a null source is the
part of the empty source; a null doc_id has no smaller one, and no label; rows alike in
doc_id and text do not precede each other; a document with several labels is good or toxic
if any says so; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears.llm import common

FILTERS = "ABCDE"
GAP = r"[\x20\x09-\x0D]+"
#: Bits of a row number within a range; parts summed in a worker before they are sent on.
RANGE_BITS, PARTS = 16, 4096
TASK_ROWS = 1_000_000
HEAVY = 1000  # a group of texts with over 1/HEAVY of all rows is broadcast


def facts(docs: DataFrame) -> DataFrame:
    """One narrow row per document: doc_id, row, part, digest and what it fails of A to D."""
    text = F.col("text")
    found = F.array_remove(F.split(text, GAP), "")
    rows = common.documents(docs, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                            F.monotonically_increasing_id().alias("row"))
    size = F.size("words")
    return rows.select("doc_id", "row", "part", text, found.alias("words")).select(
        "doc_id", "row", "part", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        (size < 200).alias("A"), (100 * F.size(F.array_distinct("words")) < 50 * size).alias("B"),
        (100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text)).alias("C"),
        text.rlike("[#$%&*|]").alias("D"))


def repeated(rows: DataFrame) -> DataFrame:
    """``rows`` (staged) with E: the text is that of a smaller doc_id, anywhere in the table."""
    groups = common.stage(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"),
                          "repeated-texts")
    heavy = F.col("n") * HEAVY > F.lit(rows.count())
    hot = rows.join(F.broadcast(groups.where(heavy)), "digest")
    cold = rows.join(F.broadcast(groups.where(heavy).select("digest")), "digest", "left_anti").join(
        groups.where(~heavy), "digest", "left")
    return hot.unionByName(cold).withColumn("E", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).drop("least", "n", "digest")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``; rows without an id skip the join."""
    def any_is(name: str) -> Column:
        return F.coalesce(F.max((F.col(name) == 1).cast("int")) == 1, F.lit(False)).alias("good" if name == "quality" else name)

    flags = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where(
        "doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(any_is("quality"), any_is("toxic"))
    known = rows.where("doc_id IS NOT NULL").join(flags, "doc_id", "left")
    none = rows.where("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    return known.unionByName(none)


def postings(rows: DataFrame, tasks: int) -> DataFrame:
    """part, range, n and a sorted list of row numbers for each filter, good and toxic."""
    ranged = rows.withColumn("range", F.shiftright("row", RANGE_BITS)).repartition(tasks, "part", "range")
    return ranged.groupBy("part", "range").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sort_array(F.collect_list(F.when(F.col(c), F.col("row")))).alias(c) for c in (*FILTERS, "good", "toxic")])


def gallop(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where each number of sorted ``a`` would enter sorted ``b``.

    All of ``a`` search at once.  The first number of each run of 64 is placed first (by the
    same rule); the others start from there, double their step until they have passed, and
    halve back."""
    if not len(a) or not len(b):
        return np.zeros(len(a), np.int64)
    at = np.zeros(len(a), np.int64) if len(a) <= 64 else np.repeat(gallop(a[::64], b), 64)[:len(a)]
    last, step = len(b) - 1, np.ones(len(a), np.int64)
    on = np.flatnonzero(b[np.minimum(at, last)] < a)  # those whose place is after ``at``
    high = at.copy()
    while len(on):
        high[on] = at[on] + step[on]
        far = on[(high[on] <= last) & (b[np.minimum(high[on], last)] < a[on])]
        at[far] = high[far]
        step[far] *= 2
        on = far
    high = np.minimum(high, len(b))
    while len(on := np.flatnonzero(high - at > 0)):  # the place is in [at, high]
        mid = (at[on] + high[on]) // 2
        less = b[mid] < a[on]
        at[on[less]] = mid[less] + 1
        high[on[~less]] = mid[~less]
    return at


def held(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which numbers of ``a`` are in ``b``."""
    if not len(b):
        return np.zeros(len(a), bool)
    return b[np.minimum(gallop(a, b), len(b) - 1)] == a


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) < len(b):
        a, b = b, a
    new = b[~held(b, a)]
    return np.insert(a, gallop(new, a), new)


def union_sizes(lists: list[np.ndarray], within: np.ndarray | None = None) -> np.ndarray:
    """Size of the union of every subset of ``lists`` (bit k: list k), kept to ``within``."""
    if within is not None:
        lists = [x[held(x, within)] if len(x) <= len(within) else within[held(within, x)] for x in lists]
    unions = [np.zeros(0, np.int64)]
    for k, own in enumerate(lists):
        unions += [union(u, own) if k_set else own for k_set, u in enumerate(unions)]
    return np.array([len(u) for u in unions])


def _rows_of(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[i:j] for i, j in zip(at[:-1], at[1:])]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))],
                                          names=["part", "sizes"])

    for b in batches:
        lists = {c: _rows_of(b.column(c)) for c in (*FILTERS, "good", "toxic")}
        for i, (part, n) in enumerate(zip(b.column("part").to_pylist(), b.column("n").to_pylist())):
            own = [lists[c][i] for c in FILTERS]
            sizes = np.concatenate([[n], *(union_sizes(own, w) for w in (None, lists["good"][i], lists["toxic"][i]))])
            sums[part] = sums.get(part, 0) + sizes
        if len(sums) > PARTS:
            yield out()
            sums.clear()
    yield out()


def sizes(lists: DataFrame) -> DataFrame:
    """part and ``u``: its rows, then the union sizes of all, good and toxic rows."""
    common.small_batches(lists.sparkSession, 16)  # sixteen ranges at a time bound a worker's memory
    parts = lists.mapInArrow(_merge, "part string, sizes array<long>")
    return parts.select("part", F.posexplode("sizes").alias("at", "size")).groupBy("part", "at").agg(
        F.sum("size").alias("size")).groupBy("part").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("at", "size"))), lambda s: s["size"]).alias("u"))


def report(totals: DataFrame) -> DataFrame:
    """The audit's rows: every order and step of each part."""
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    rows = totals.select("part", "u", F.explode(orders).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    every = (1 << len(FILTERS)) - 1
    rows = rows.withColumn("bit", F.expr(f"shiftleft(1, instr('{FILTERS}', substr(filter_order, step, 1)) - 1)")) \
        .withColumn("prior", sum((F.when(F.instr("filter_order", c) < F.col("step"), 1 << k).otherwise(0) for k, c in enumerate(FILTERS)), F.lit(0)))

    def size(which: int, mask: Column) -> Column:
        return F.get("u", mask + (1 + which * (every + 1)))

    def gone(which: int) -> Column:
        return size(which, F.col("prior").bitwiseOR(F.col("bit"))) - size(which, F.col("prior"))

    own = size(0, F.col("bit"))
    # over all orders: a set of k others comes first in k! (n - 1 - k)! of them
    others = F.filter(F.sequence(F.lit(0), F.lit(every)), lambda m: m.bitwiseAND(F.col("bit")) == 0)
    n = len(FILTERS)
    ways = F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)])
    shapley = F.aggregate(others, F.lit(0).cast("long"), lambda acc, m: acc + F.get(ways, F.bit_count(m)) * (
        size(0, m.bitwiseOR(F.col("bit"))) - size(0, m)))
    return rows.select(
        "part", "filter_order", "step", (F.get("u", F.lit(0)) - size(0, F.col("prior").bitwiseOR(F.col("bit")))).alias("kept"),
        gone(0).alias("removed"), (own - gone(0)).alias("redundant"),
        (size(0, F.lit(every)) - size(0, F.lit(every).bitwiseXOR(F.col("bit")))).alias("unique_fails"),
        gone(1).alias("good_lost"), gone(2).alias("toxic_lost"), shapley.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley."""
    rows = common.stage(facts(docs), "filter-facts")
    # lists are short for the work they give: as many files as tasks, not as their bytes ask for
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // TASK_ROWS)
    lists = common.stage(postings(labelled(repeated(rows), labels), tasks), "postings")
    return report(sizes(lists))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN w.doc_id > least THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x AS (SELECT 'A' AS c UNION ALL SELECT 'B' UNION ALL SELECT 'C' UNION ALL SELECT 'D' UNION ALL SELECT 'E'),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, 1 << (instr('ABCDE', filter_order[step]) - 1) AS bit,
    list_sum(list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', filter_order[i]) - 1))) AS before
  FROM o, range(1, 6) r(step)),
g AS (SELECT part, filter_order, step, bit,
    CAST(sum(CASE WHEN mask & (coalesce(before, 0) | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & coalesce(before, 0) <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM cells, (SELECT filter_order, step, CAST(bit AS INTEGER) AS bit, CAST(before AS INTEGER) AS before FROM s) s
  GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM g
"""
