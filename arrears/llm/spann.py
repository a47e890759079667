"""Op 4: approximate nearest neighbours by balanced posting lists.

* Fit: recursive halving by two-means, each half taking the same number of vectors, gives
  lists of even size, one per ``LIST_ROWS`` vectors of the table, however many it has.  While a
  bounded sample has ``TEACH`` vectors for each list it is halved on the driver.  Beyond, it
  gives cells; a further sample, ``TEACH`` vectors a list, is sent to its cells, and each cell
  is halved into its lists by a task of its own.  The driver holds the centroids, one vector of
  ``LIST_ROWS`` (at most ``CENTROID_BYTES``; lists are longer beyond).  They form a graph in
  memory (nearest neighbours of each, and some random ones) that a best-first beam search walks.
* Index, over every row: a vector enters its nearest list and, when it lies near a boundary,
  up to ``COPIES`` - 1 others whose centroids are at most ``NEAR`` times as far.
* Search: a query probes the lists whose centroids are at most ``ratio`` times as far as its
  nearest one.  The ratio is calibrated on the sample, so that ``RECALL`` of its true
  neighbours lie in probed lists.  A query that all but touches a centroid (copies of the
  longest vector fill a list) has no such ratio; for those a distance is calibrated instead.
  There is no cap on lists: the beam widens until its farthest centroid is beyond.

Largest inner product is nearest distance after one more coordinate, sqrt(max |x|^2 - |x|^2),
is added to the vectors (0 to queries, which are scaled to the longest vector's length);
scores are inner products of the original vectors in double precision.  For all else vectors
are scaled by a power of two that brings the greatest component of the table (of a query:
its own) near 1, so any finite double may occur; scores that overflow are infinite, those
that are no number come last.

A list may hold any share of all vectors and be probed by any share of all queries (copies
of one vector), so the work is dealt in units of a block of a list's vectors and a block of
its queries.  A unit returns one row per query, its best k; the rows of a query are merged.

Cases: vectors that are null, zero, hold null or non-finite components or are not of the
commonest length take no part, nor do rows without an id; repeated rows of an id count once;
ties go to the smaller id; with fewer than k other vectors all are returned; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm import common

SAMPLE, SAMPLE_BYTES, LIST_ROWS = 20_000, 64 << 20, 512
TEACH, CELL_LISTS, CENTROID_BYTES, SEEN_BYTES = 16, 512, 256 << 20, 32 << 20
DEGREE, LINKS, COPIES, NEAR = 16, 4, 4, 1.15
TRIALS, RECALL = 256, 0.985
TOUCH = 1e-3  # of the longest vector's length: a distance too small to be multiplied
LEAST_BLOCK, MOST_BLOCK, STRIPE = 4096, 65_536, 256


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (the components as little-endian doubles) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    return rows.where(fine)


def packed(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().astype("<f8").tobytes()
            step = len(x) // max(1, b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array([x[k * step:(k + 1) * step] for k in range(b.num_rows)], pa.binary())],
                names=["vec_id", "vec"])

    return rows.mapInArrow(run, "vec_id long, vec binary").dropDuplicates(["vec_id"])


def matrix(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1)


def scaled(x: np.ndarray, power: int | np.ndarray) -> np.ndarray:
    """``x`` over two to the ``power``; what underflows is nothing beside the rest."""
    with np.errstate(under="ignore"):
        return np.ldexp(x, -power)


def exponents(x: np.ndarray) -> np.ndarray:
    """Of each row's greatest component."""
    return np.frexp(np.abs(x).max(1, keepdims=True))[1]


def halves(x: np.ndarray, rows: np.ndarray, leaves: int, rng) -> list[np.ndarray]:
    """Recursive two-means whose parts are of equal size."""
    if leaves <= 1 or len(rows) < 2:
        return [rows]
    own = x[rows]
    a, b = own[rng.choice(len(rows), 2, replace=False)]
    for _ in range(8):
        side = own @ (a - b)
        order = np.argsort(-side, kind="stable")
        left, right = order[:len(rows) // 2], order[len(rows) // 2:]
        a, b = own[left].mean(0), own[right].mean(0)
    return halves(x, rows[left], leaves // 2, rng) + halves(x, rows[right], leaves - leaves // 2, rng)


@dataclass
class Lists:
    centroids: np.ndarray
    graph: np.ndarray
    longest: float  # norm of the longest vector
    ratio: float = 1.0
    touching: float = 0.0  # distance to search from queries nearer than TOUCH to a centroid

    def reach(self, near: np.ndarray) -> np.ndarray:
        """Distance to search, from that of the nearest centroid."""
        return np.where(near > TOUCH * self.longest, self.ratio * near, self.touching)

    def placed(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the coordinate that turns inner products into distances."""
        extra = np.sqrt(np.maximum(self.longest ** 2 - (x * x).sum(1), 0))
        return np.column_stack([x, extra])

    def asked(self, q: np.ndarray) -> np.ndarray:
        q = scaled(q, exponents(q))
        q = q * (self.longest / np.sqrt((q * q).sum(1, keepdims=True)))
        return np.column_stack([q, np.zeros(len(q))])

    def beam(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances) of about the ``width`` nearest centroids of each row, nearest
        first; as many rows at a time as their marks of visited lists have room."""
        step = max(16, SEEN_BYTES // len(self.centroids))
        parts = [self._beam(x[at:at + step], width) for at in range(0, max(1, len(x)), step)]
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _beam(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search on the graph, all rows in step."""
        n, c = len(self.centroids), self.centroids
        width = min(width, n)
        square = (c * c).sum(1)

        def distance(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            return (x[rows] ** 2).sum(1)[:, None] + square[nodes] - 2 * np.einsum("rd,rkd->rk", x[rows], c[nodes])

        everyone = np.arange(len(x))
        entries = np.linspace(0, n - 1, min(n, width, 8)).astype(int)
        ids = np.full((len(x), width), -1)
        dist = np.full((len(x), width), np.inf)
        ids[:, :len(entries)] = entries
        dist[:, :len(entries)] = distance(everyone, np.broadcast_to(entries, (len(x), len(entries))))
        done = np.zeros((len(x), width), bool)
        seen = np.zeros((len(x), n), bool)
        seen[:, entries] = True
        while True:
            open_ = np.where(done | (ids < 0), np.inf, dist)
            at = open_.argmin(1)
            rows = np.flatnonzero(np.isfinite(open_[everyone, at]))
            if not len(rows):
                break
            done[rows, at[rows]] = True
            near = self.graph[ids[rows, at[rows]]]
            fresh = ~seen[rows[:, None], near]
            seen[rows[:, None], near] = True
            d = np.where(fresh, distance(rows, near), np.inf)
            all_d = np.concatenate([dist[rows], d], 1)
            all_i = np.concatenate([ids[rows], np.where(fresh, near, -1)], 1)
            all_e = np.concatenate([done[rows], np.zeros_like(fresh)], 1)
            best = np.argpartition(all_d, width - 1, 1)[:, :width]
            dist[rows], ids[rows], done[rows] = (np.take_along_axis(v, best, 1) for v in (all_d, all_i, all_e))
        order = dist.argsort(1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.sqrt(np.maximum(np.take_along_axis(dist, order, 1), 0))

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of each vector's copies."""
        ids, dist = self.beam(self.placed(x), 4 * COPIES)
        ids, dist = ids[:, :COPIES], dist[:, :COPIES]
        on = (dist <= NEAR * dist[:, :1]) & (ids >= 0)
        on[:, 0] = True
        row, k = np.nonzero(on)
        return row, ids[row, k]

    def probes(self, q: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists to search: by the ratio, and on until ``least`` entries."""
        x, n = self.asked(q), len(self.centroids)
        rows, lists = [], []
        left, width = np.arange(len(x)), 64
        while len(left):
            ids, dist = self.beam(x[left], width)
            size = np.where(ids >= 0, sizes[ids], 0)
            want = (ids >= 0) & ((dist <= self.reach(dist[:, :1])) | (size.cumsum(1) - size < least))
            enough = ~want[:, -1] | (ids.shape[1] >= n)
            row, k = np.nonzero(want & enough[:, None])
            rows.append(left[row])
            lists.append(ids[row, k])
            left, width = left[~enough], width * 2
        return np.concatenate([np.zeros(0, int), *rows]), np.concatenate([np.zeros(0, int), *lists])


def wanted_lists(total: int, width: int) -> int:
    return max(1, min(total // LIST_ROWS, CENTROID_BYTES // (8 * (width + 1))))


def centroids_of(points: DataFrame, x: np.ndarray, total: int, power: int, longest: float, seed: int = 4) -> np.ndarray:
    """Centroids of a table with more lists than its sample ``x`` can teach: the sample gives
    cells, each cell's lists come from its share of a larger sample, in a task of its own.
    Copies of a vector count once there, so no cell's share is crowded by them."""
    rng = np.random.default_rng(seed)
    lists = Lists(np.zeros((1, x.shape[1] + 1)), np.zeros((1, 1), int), longest)
    placed, leaves = lists.placed(x), wanted_lists(total, x.shape[1])
    cells = np.array([placed[p].mean(0) for p in halves(placed, np.arange(len(x)), min(max(1, -(-leaves // CELL_LISTS)), len(x) // TEACH), rng)])
    square = (cells * cells).sum(1)
    share = min(1.0, TEACH * leaves / total)
    drawn = points.where(F.pmod(F.xxhash64("vec_id", F.lit("lists")), F.lit(1 << 30)) < F.lit(share * (1 << 30))).select("vec").dropDuplicates()

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = lists.placed(scaled(matrix(b.column("vec")), power)) if b.num_rows else np.zeros((0, cells.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array((square - 2 * own @ cells.T).argmin(1) if len(own) else np.zeros(0, int)), b.column("vec")],
                                             names=["cell", "vec"])

    per = min(TEACH, total / leaves)

    def of_cell(t: pa.Table) -> pa.Table:
        own = lists.placed(scaled(matrix(t["vec"]), power))
        parts = halves(own, np.arange(len(own)), max(1, round(len(own) / per)), np.random.default_rng(seed))
        return pa.table({"vec": pa.array([own[p].mean(0).astype("<f8").tobytes() for p in parts], pa.binary())})

    found = common.stage(drawn.mapInArrow(to_cells, "cell long, vec binary").groupBy("cell").applyInArrow(of_cell, "vec binary"), "centroids")
    rows = sorted(r["vec"] for r in found.collect())  # a row per list, at most CENTROID_BYTES
    common.drop(found)
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1) if rows else cells


def fit(x: np.ndarray, total: int, longest: float, k: int, seed: int = 4, centroids: np.ndarray | None = None) -> Lists:
    """Lists, graph and ratio from a sample of the vectors, or around given centroids."""
    rng = np.random.default_rng(seed)
    lists = Lists(np.zeros((1, x.shape[1] + 1)), np.zeros((1, 1), int), longest)
    placed = lists.placed(x)
    if centroids is None:
        leaves = int(np.clip(total // LIST_ROWS, 1, max(1, len(x) // TEACH)))
        centroids = np.array([placed[p].mean(0) for p in halves(placed, np.arange(len(x)), leaves, rng)])
    lists.centroids = c = centroids
    n = len(c)
    degree, square, links = min(DEGREE, max(1, n - 1)), (c * c).sum(1), []
    for at in range(0, n, 1024):
        apart = square[at:at + 1024, None] + square - 2 * c[at:at + 1024] @ c.T
        apart[np.arange(len(apart)), np.arange(at, at + len(apart))] = np.inf
        links.append(np.argsort(apart, 1, kind="stable")[:, :degree])
    near = np.concatenate(links)
    links = np.sort(np.column_stack([near, rng.integers(0, n, (n, LINKS)), (np.arange(n) + 1) % n]), 1)
    again = np.column_stack([np.zeros(n, bool), links[:, 1:] == links[:, :-1]])
    lists.graph = np.where(again, np.arange(n)[:, None], links)  # a repeated link leads nowhere new
    # what ratio reaches the lists of true neighbours
    able = np.flatnonzero((x * x).sum(1) > 0)  # those that scaling has left a direction
    trial = rng.choice(able, min(TRIALS, len(able)), replace=False)
    scores = x[trial] @ x.T
    scores[np.arange(len(trial)), trial] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1 or n < 2 or not len(trial):
        return lists
    true = np.argpartition(-scores, k - 1, 1)[:, :k]
    asked = lists.asked(x[trial])
    away = np.sqrt(np.maximum((asked * asked).sum(1)[:, None] + (c * c).sum(1) - 2 * asked @ c.T, 0))
    row, home = lists.homes(x[true.ravel()])
    reach = np.full(true.size, np.inf)
    np.minimum.at(reach, row, away[row // k, home])
    # the larger the whole is beside the sample, the nearer the k nearest are: this errs to the safe side
    near = np.repeat(away.min(1), k)
    apart = near > TOUCH * longest
    if apart.any():
        lists.ratio = float(np.quantile(reach[apart] / near[apart], RECALL)) + 1e-9
    lists.touching = lists.ratio * TOUCH * longest
    if not apart.all():
        lists.touching = max(lists.touching, float(np.quantile(reach[~apart], RECALL)) + 1e-9 * longest)
    assert np.isfinite(lists.ratio) and np.isfinite(lists.touching)
    return lists


def best_of(q: np.ndarray, v: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query (ids, scores) of its k best, without itself."""
    with np.errstate(all="ignore"):
        norms = np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1).max(initial=0))
        slack = 1e-9 * norms
        # where products leave the doubles' range a rough score rules nothing out
        rough_serves = (norms > 1e-280) & (norms < 1e290)
        for r in range(len(q)):
            if r % STRIPE == 0:
                rough = q[r:r + STRIPE] @ v.T
            on = np.flatnonzero(ids != own[r])
            if len(on) > k and rough_serves[r]:
                s = rough[r % STRIPE, on]
                on = on[s >= np.partition(s, len(s) - k)[len(s) - k] - slack[r]]
            # the same vectors get the same score wherever they lie
            score = (v[on] * q[r]).sum(1)
            order = np.lexsort((ids[on], -score))[:k]
            yield ids[on][order], score[order]


def search(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(vectors)
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return empty
    d = length["d"]
    points = common.stage(packed(rows.where(F.size("x") == d)), "vectors")
    common.small_batches(spark, 2048)
    total = points.count()

    largest = rows.where(F.size("x") == d).agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0]
    power = int(np.frexp(largest)[1])

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = scaled(matrix(b.column("vec")), power)
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((x * x).sum(1).max()))])], names=["norm"])

    longest = points.mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0]
    most = min(SAMPLE, SAMPLE_BYTES // (8 * d))
    drawn = points.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < (1 << 20) * min(1.0, 0.9 * most / total)).limit(most)
    sample = drawn.toPandas().sort_values("vec_id")
    if not len(sample):
        sample = points.limit(most).toPandas()
    x = scaled(np.frombuffer(b"".join(sample["vec"]), "<f8").reshape(len(sample), d), power)
    many = wanted_lists(total, d) > max(1, len(x) // TEACH)
    lists = fit(x, total, longest, k, centroids=centroids_of(points, x, total, power, longest) if many and len(x) >= 2 * TEACH else None)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, home = lists.homes(scaled(matrix(b.column("vec")), power)) if b.num_rows else (np.zeros(0, int),) * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(home, pa.int32()), *(b.column(c).take(pa.array(row)) for c in ("vec_id", "vec"))],
                names=["list", "vec_id", "vec"])

    postings = common.stage(points.mapInArrow(index, "list int, vec_id long, vec binary"), "postings")
    counted = {r["list"]: r["count"] for r in postings.groupBy("list").count().collect()}  # a row per list
    sizes = np.array([counted.get(i, 0) for i in range(len(lists.centroids))])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, probed = lists.probes(matrix(b.column("vec")), sizes, COPIES * (k + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(probed, pa.int32()), *(b.column(c).take(pa.array(row)) for c in ("vec_id", "vec"))],
                    names=["list", "vec_id", "vec"])

    queries = points.where(F.col("vec_id") % every == 0).repartition(spark.sparkContext.defaultParallelism)
    asked = common.stage(queries.mapInArrow(ask, "list int, vec_id long, vec binary"), "probes")
    probing = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}  # a row per list
    block = int(np.clip(sizes.sum() // 1000, LEAST_BLOCK, MOST_BLOCK))
    plan = spark.createDataFrame(
        [(i, -(-counted[i] // block), -(-n // block)) for i, n in probing.items() if counted.get(i)] or [(-1, 1, 1)],
        "list int, v_blocks long, q_blocks long")
    zero = F.lit(0).cast("long")

    def dealt(rows: DataFrame, own: str, other: str, kind: int) -> DataFrame:
        """Rows of one side: in one of its blocks, against every block of the other side."""
        blocks = {own: F.pmod(F.xxhash64("vec_id"), F.col(f"{own}locks")),
                  other: F.explode(F.sequence(zero, F.col(f"{other}locks") - 1))}
        return rows.join(F.broadcast(plan), "list").withColumns(blocks).select(
            "list", "v_b", "q_b", F.lit(kind).alias("kind"), "vec_id", "vec")

    both = dealt(postings, "v_b", "q_b", 0).unionByName(dealt(asked, "q_b", "v_b", 1))

    def unit(table: pa.Table) -> pa.Table:
        kind, ids, x = table["kind"].to_numpy(), table["vec_id"].to_numpy(), matrix(table["vec"])
        v, q = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        found = list(best_of(x[q], x[v], ids[v], ids[q], k)) if len(v) else []
        return pa.table({"query_id": pa.array(ids[q][:len(found)], pa.int64()),
                         "ids": pa.array([i.tolist() for i, _ in found], pa.list_(pa.int64())),
                         "scores": pa.array([s.tolist() for _, s in found], pa.list_(pa.float64()))})

    partial = both.groupBy("list", "v_b", "q_b").applyInArrow(
        unit, "query_id long, ids array<long>, scores array<double>")

    def merge(table: pa.Table) -> pa.Table:
        ids = table["ids"].combine_chunks().flatten().to_numpy()
        scores = table["scores"].combine_chunks().flatten().to_numpy()
        order = np.lexsort((ids, -scores))
        ids, scores = ids[order], scores[order]
        _, first = np.unique(ids, return_index=True)  # copies of a vector in several lists
        first = np.sort(first)[:k]
        return pa.table({"query_id": pa.array([table["query_id"][0].as_py()] * len(first), pa.int64()),
                         "rank": pa.array(np.arange(1, len(first) + 1), pa.int32()),
                         "vec_id": pa.array(ids[first], pa.int64()), "score": pa.array(scores[first])})

    return partial.groupBy("query_id").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")
