"""Op 3: near-duplicate documents by an LSH forest over MinHash signatures.

1. One pass over whole texts gives each document its set of distinct word shingles (64-bit
   hashes), of which a digest and a MinHash signature are kept.  Documents with equal sets
   are one node from here on.
2. The forest: ``TREES`` orders of the signature's values.  In each the documents are sorted
   by their values, so that those with a long common prefix lie side by side; the rows that
   agree on the first ``DEPTH`` values are a region of the tree.
3. A document's neighbours in an order are the ``NEAR`` rows after it in its region: no other
   later rows share a longer prefix with it.  So the depth adapts to each region: where rows are
   few, all that share ``DEPTH`` values are neighbours, where they crowd, those that share many.
   Neighbours whose signatures agree enough (four standard deviations of leeway: a pair at
   exactly 0.8 falls below it with a probability of 4.2e-5) are candidates, confirmed on the
   full sets; what is confirmed joins documents into components.
4. Then nothing is left to the neighbours' luck: in each region, all candidate pairs between
   two components are confirmed, best first, until the components that can be joined are; a
   region of more than ``REGION`` rows is dealt into blocks, each compared with itself and every
   other, but for blocks of one same component.  So only pairs within one component are left
   out, and those cannot change the result.  A pair of similarity 0.8 shares no region of any
   tree with a probability of 3e-6.

Cases: null texts, and texts without a word, have an empty set and link with nothing; a text
of fewer words than a shingle is one shingle; rows that share a doc_id count as one document;
a null doc_id takes part in equal sets only and keeps a null component unless an equal set
has an id; ties go to the smaller id; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrears.llm import common
from arrears.llm.graph import components
from arrears.llm.tokens import Recent

WORDS, PERCENT = 4, 80
HASHES, TREES, DEPTH, REGION = 128, 24, 4, 2048
NEAR, WALK = 8, 2048  # later neighbours of a row in an order; rows walked at a time
LEEWAY = 4.0  # standard deviations of a signature's estimate
MOST_IDS = 200_000  # ids that are broadcast at most
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))

_WORDS: Recent = Recent(xxhash.xxh3_64_intdigest, 150_000)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.  bytes.lower() changes A-Z
    only and bytes.split() cuts at U+0020 and U+0009 to U+000D only."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(_WORDS.__getitem__, parts), np.uint64, len(parts))
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k:len(h) - n + 1 + k]) * MIX[k % 4]
        out ^= out >> np.uint64(31)
    return np.unique(out)


def hash_factors() -> np.ndarray:
    """Odd multipliers of the signature's hash functions."""
    return np.random.default_rng(3).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Least 32-bit value under each hash function."""
    out = np.full(len(factors), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(out, (factors[:, None] * shingles[at:at + 1024]).min(1), out)
    return (out >> np.uint64(32)).astype(np.uint32)


def tree_order(tree: int) -> np.ndarray:
    """The tree's order of the signature's values: its own DEPTH values first, all distinct
    between trees, then the others in an order of its own."""
    own = np.arange(tree * DEPTH, (tree + 1) * DEPTH)
    rest = np.setdiff1d(np.arange(HASHES), own)
    return np.concatenate([own, np.random.default_rng(tree).permutation(rest)])


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (two longs), keys (the region of each tree at
    the base depth) and bytes (the signature's values, a byte each)."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = hash_factors()
        for b in batches:
            sizes, first, second, keys, low = [], [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_hashes(text, words)
                sizes.append(len(s))
                raw = s.tobytes()
                first.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                second.append(xxhash.xxh3_64_intdigest(raw, seed=1) - (1 << 63))
                v = signature(s, factors)
                keys.append(region_keys(v))
                low.append(v.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                 pa.array(keys, pa.binary()), pa.array(low, pa.binary())],
                names=["doc_id", "n_shingles", "set1", "set2", "keys", "low"])

    return docs.mapInArrow(
        run, "doc_id long, n_shingles long, set1 long, set2 long, keys binary, low binary")


def region_keys(v: np.ndarray) -> bytes:
    """64-bit hash of each tree's first DEPTH values."""
    own = v[:TREES * DEPTH].reshape(TREES, DEPTH).astype(np.uint64)
    out = np.arange(1, TREES + 1, dtype=np.uint64)
    for k in range(DEPTH):
        out = (out ^ own[:, k]) * MIX[k % 4]
        out ^= out >> np.uint64(29)
    return out.astype("<u8").tobytes()


def by_tree(nodes: DataFrame) -> DataFrame:
    """A row per node and tree: tree, region, id, low."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.frombuffer(b"".join(b.column("keys").to_pylist()), "<i8")
            row = np.repeat(np.arange(b.num_rows), TREES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(TREES, dtype=np.int32), b.num_rows)), pa.array(keys),
                 b.column("id").take(pa.array(row))], names=["tree", "region", "id"])

    return nodes.select("id", "keys").mapInArrow(run, "tree int, region long, id long")


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` with the signatures' bytes in the order of the row's tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = np.array([tree_order(t) for t in range(TREES)])
        for b in batches:
            low = np.take_along_axis(bytes_of(b.column("low"), "u1", HASHES), orders[b.column("tree").to_numpy()], 1)
            yield b.set_column(b.schema.get_field_index("low"), "low", pa.array([v.tobytes() for v in low], pa.binary()))

    return rows.mapInArrow(run, rows.schema)


def forest(nodes: DataFrame) -> DataFrame:
    """Rows (tree, region, id, n, low, keys) of all regions with company, n being the region's
    rows and low in the tree's order; staged."""
    rows = by_tree(nodes)
    sizes = rows.groupBy("tree", "region").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # most documents are alone in every tree: only those with company carry their signatures on
    shared = common.stage(rows.join(sizes, ["tree", "region"]).select("tree", "region", "id", "n"), "regions")
    out = common.stage(in_order(shared.join(nodes.select("id", "low", "keys"), "id")), "forest")
    common.drop(shared)
    return out


def units(crowded: DataFrame, nodes: DataFrame, part: DataFrame) -> DataFrame:
    """Rows of crowded regions, dealt: each region is cut into blocks of half a REGION, those of
    a large component apart, and a unit (in ``region``'s place) holds two blocks as its sides 0
    and 1, or one block.  No unit is made of blocks of one same component."""
    block, here = REGION // 2, ["tree", "region"]
    rows = common.stage(placed(crowded, part), "crowded")
    sizes = common.stage(rows.groupBy(*here, "part").agg(F.count(F.lit(1)).alias("n")), "crowd-sizes")
    large = F.col("n") > block
    before = Window.partitionBy(*here).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = sizes.where(large).withColumn("blocks", F.ceil(F.col("n") / block)).withColumn(
        "first", F.coalesce(F.sum("blocks").over(before), F.lit(0))).drop("n")
    whole = sizes.groupBy(*here).agg(F.ceil(F.coalesce(F.sum(F.when(~large, F.col("n"))), F.lit(0)) / block).alias("small"),
                                     F.coalesce(F.sum(F.when(large, F.ceil(F.col("n") / block))), F.lit(0)).alias("others"))
    own, whole = (few(common.stage(x, "blocks")) for x in (own, whole))
    deal = F.xxhash64("id")
    low = F.coalesce(F.col("small") + F.col("first"), F.lit(0))
    rows = (rows.join(whole, here).join(own, [*here, "part"], "left").withColumns(
        {"low_block": low, "high_block": low + F.coalesce("blocks", F.lit(0)),
         "own": F.when(F.col("blocks").isNull(), F.pmod(deal, F.greatest("small", F.lit(1)))).otherwise(
             low + F.pmod(deal, F.coalesce("blocks", F.lit(1))))}))
    every = F.sequence(F.lit(0).cast("long"), F.col("small") + F.col("others") - 1)
    rows = rows.withColumn("other", F.explode(F.filter(every, lambda x: (x < F.col("low_block")) | (x >= F.col("high_block")))))
    unit = F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other"))
    return (rows.select("tree", unit.alias("region"), "id", "part", (F.col("own") > F.col("other")).cast("int").alias("side"))
            .join(nodes.select("id", "low", "keys"), "id"))


def placed(rows: DataFrame, part: DataFrame) -> DataFrame:
    """``rows`` with the components of their documents; a document without links is its own."""
    return rows.join(part.select(F.col("node").alias("id"), F.col("root").alias("part")), "id", "left").withColumn(
        "part", F.coalesce("part", "id"))


def least_matches(percent: int) -> int:
    """Signature values that must agree for a pair to be a candidate."""
    j = percent / 100
    seen = j + (1 - j) / 256
    return int(np.floor(HASHES * seen - LEEWAY * np.sqrt(HASHES * seen * (1 - seen))))


def matches(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Agreeing signature values of each row of x with each of y."""
    if len(y) <= 64:
        return (x[:, None, :] == y[None, :, :]).sum(2)
    out = np.zeros((len(x), len(y)), np.int16)
    for k in range(HASHES):
        out += x[:, k, None] == y[None, :, k]
    return out


def candidates(low: np.ndarray, group: np.ndarray, least: int, edge: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, matches) of all row pairs i < j in different groups that agree enough; with an
    ``edge``, of the pairs across it only."""
    found = [(np.zeros(0, np.int64),) * 3]
    end = len(low) if edge is None else edge
    for at in range(0, end, 256):
        start = at if edge is None else edge
        m = matches(low[at:min(at + 256, end)], low[start:])
        i, j = np.nonzero(m >= least)
        on = (i + at < j + start) & (group[i + at] != group[j + start])
        found.append((i[on] + at, j[on] + start, m[i[on], j[on]]))
    return tuple(np.concatenate(x) for x in zip(*found))


class Sets:
    """Union-find over a few members."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = a = self.up[self.up[a]]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def spanning(i: np.ndarray, j: np.ndarray, m: np.ndarray, n: int) -> list[int]:
    """Positions of a spanning forest of best-agreeing pairs."""
    sets, kept = Sets(n), []
    for k in np.argsort(-m, kind="stable").tolist():
        a, b = int(i[k]), int(j[k])
        if sets.root(a) != sets.root(b):
            sets.join(a, b)
            kept.append(k)
            if len(kept) == n - 1:
                break
    return kept


def bytes_of(column, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def by_region(rows: DataFrame, of_region: Callable, schema: str) -> DataFrame:
    """``of_region`` for the rows of each region, sorted by id.  A task walks its sorted
    regions, none with more than REGION rows, and holds one batch and an unfinished region."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if not t.num_rows:
                continue
            edges = edges_of(t)
            for at, to in zip(edges[:-2], edges[1:-1]):
                yield from of_region(t.slice(at, to - at))
            rest = t.slice(edges[-2])
        if rest is not None:
            yield from of_region(rest)

    common.small_batches(rows.sparkSession)
    return rows.repartition("tree", "region").sortWithinPartitions("tree", "region", "id").mapInArrow(run, schema)


def edges_of(t: pa.Table) -> np.ndarray:
    tree, region = t["tree"].to_numpy(), t["region"].to_numpy()
    return np.concatenate([[0], np.flatnonzero((tree[1:] != tree[:-1]) | (region[1:] != region[:-1])) + 1, [len(tree)]])


def neighbours(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct candidate pairs (a, b) among each row and the ``NEAR`` rows after it in its tree's
    sorted order and region, less those that a better pair of the same stretch makes needless.

    A stretch of the order is sorted by a task and walked batch by batch, the last ``NEAR`` rows
    being carried on; a region may go over many tasks (pairs across their edges are met in step 4)."""
    least = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            seen = 0 if rest is None else rest.num_rows
            t = t if rest is None else pa.concat_tables([rest, t])
            ids, low = t["id"].to_numpy(), bytes_of(t["low"], "u1", HASHES)
            tree, region = t["tree"].to_numpy(), t["region"].to_numpy()
            found = []
            for k in range(1, min(NEAR, len(ids) - 1) + 1):
                at = np.arange(max(0, seen - k), len(ids) - k)
                at = at[(tree[at] == tree[at + k]) & (region[at] == region[at + k]) & (ids[at] != ids[at + k])]
                m = (low[at] == low[at + k]).sum(1)
                found.append(np.array([at, at + k, m])[:, m >= least])
            if found:
                i, j, m = np.concatenate(found, axis=1)
                on = spanning(i, j, m, len(ids))
                if on:
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i[on]], ids[j[on]])),
                                                      pa.array(np.maximum(ids[i[on]], ids[j[on]]))], names=["a", "b"])
            rest = t.slice(max(0, t.num_rows - NEAR))

    common.small_batches(rows.sparkSession, WALK)
    order = ["tree", "region", "low", "id"]
    ordered = rows.select("tree", "region", "id", "low").repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, "a long, b long").distinct()


def between(t: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs between components that fall to this region or unit: a pair that several
    trees hold belongs to the first that does.  Regions are those of the base depth, whose
    keys the rows carry, and units hold all of a region's pairs, so that tree has it."""
    part, side = t["part"].to_numpy(), t["side"].to_numpy()
    if (part == part[0]).all():
        return (np.zeros(0, np.int64),) * 3
    order = np.argsort(side, kind="stable")
    i, j, m = candidates(bytes_of(t["low"], "u1", HASHES)[order], part[order], least,
                         int((side == 0).sum()) if side.any() else None)
    i, j = order[i], order[j]
    keys, tree = bytes_of(t["keys"], "<i8", TREES), t["tree"][0].as_py()
    on = np.zeros(len(i), bool)
    for at in range(0, len(i), 65_536):
        on[at:at + 65_536] = (keys[i[at:at + 65_536]] == keys[j[at:at + 65_536]]).argmax(1) == tree
    return i[on], j[on], m[on]


def unsettled(rows: DataFrame, percent: int) -> DataFrame:
    """The rows that have a candidate pair with another component in their region; staged."""
    least = least_matches(percent)

    def of_region(t: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j, _ = between(t, least)
        if len(i):
            yield from t.take(pa.array(np.unique(np.concatenate([i, j])))).to_batches()

    columns = "tree int, region long, id long, low binary, keys binary, part long, side int"
    return common.stage(by_region(rows.select("tree", "region", "id", "low", "keys", "part", "side"), of_region, columns), "unsettled")


def links_between(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components, confirmed on full sets; staged."""
    least = least_matches(percent)

    def of_region(t: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j, m = between(t, least)
        ids = t["id"].to_numpy()
        _, part = np.unique(t["part"].to_numpy(), return_inverse=True)
        full = [long(x) for x in t["shingles"].to_pylist()]
        joined, kept = Sets(len(ids)), []
        for k in np.argsort(-m, kind="stable").tolist():
            a, b = int(i[k]), int(j[k])
            if joined.root(part[a]) != joined.root(part[b]) and alike(full[a], full[b], percent):
                joined.join(part[a], part[b])
                kept.append(k)
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(ids[i[kept]]), pa.array(ids[j[kept]])], names=["a", "b"])

    ids = rows.select("id").distinct()
    near = rows.join(sets.join(few(ids), "id", "left_semi"), "id")
    return common.stage(by_region(near, of_region, "a long, b long").distinct(), "links")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether sorted sets reach the threshold."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    merged = np.sort(np.concatenate([x, y]), kind="stable")
    both = int((merged[1:] == merged[:-1]).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of the given documents, staged: 48 bits of each hash, sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_hashes(t, words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([short(s) for s in sets], pa.binary())],
                                             names=["id", "shingles"])

    wanted = docs.select(F.col("doc_id").alias("id"), "text").join(few(ids), "id", "left_semi")
    common.small_batches(docs.sparkSession)
    return common.stage(wanted.mapInArrow(run, "id long, shingles binary").dropDuplicates(["id"]), "sets")


def few(ids: DataFrame) -> DataFrame:
    """``ids`` marked for broadcast if their number is below the bound."""
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def short(s: np.ndarray) -> bytes:
    s = np.unique(s & np.uint64((1 << 48) - 1))
    return (s >> np.uint64(16)).astype("<u4").tobytes() + s.astype("<u2").tobytes()


def long(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw, "<u4", n).astype(np.uint64) << np.uint64(16) | np.frombuffer(raw, "<u2", n, 4 * n)


def confirmed(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose full sets are alike enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            on = [alike(long(x), long(y), percent) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

    ends = found.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    needed = common.stage(sets.join(few(ends), "id", "left_semi"), "needed")
    both = (found.join(needed.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
            .join(needed.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a"))
    common.small_batches(found.sparkSession)
    out = common.stage(both.mapInArrow(run, "a long, b long"), "links")
    common.drop(needed)
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = common.documents(docs)
    rows = common.stage(sketches(docs, words), "sketches")
    alike_sets = rows.groupBy("set1", "set2").agg(
        F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("group_size"), F.max("n_shingles").alias("size"),
        F.min("keys").alias("keys"), F.min("low").alias("low"))  # equal sets have equal keys and bytes
    alike_sets = common.stage(alike_sets, "equal-sets")
    nodes = alike_sets.where("size > 0 and id is not null").select("id", "keys", "low")
    trees = forest(nodes)
    found = common.stage(neighbours(trees, percent), "candidates")
    sets = full_sets(docs, found.select(F.explode(F.array("a", "b")).alias("id")).distinct(), words)
    part = components(confirmed(found, sets, percent))
    regions = placed(trees.where(F.col("n") <= REGION).drop("n"), part).withColumn("side", F.lit(0))
    crowded = trees.where(F.col("n") > REGION).select("tree", "region", "id")
    if not crowded.isEmpty():
        regions = regions.unionByName(units(crowded, nodes, part))
    open_ = unsettled(regions, percent)
    # documents that had no neighbour among their candidates have no set yet
    more = common.stage(open_.select("id").distinct().join(sets.select("id"), "id", "left_anti"), "more")
    if not more.isEmpty():
        sets = sets.unionByName(full_sets(docs, more, words))
    links = links_between(open_, sets, percent)
    everyone = common.stage(open_.select("id", "part").distinct(), "open").select(F.col("id").alias("node"), F.col("part").alias("root"))
    part = composed(part.unionByName(everyone).distinct(), components(contracted(links, everyone)))
    part = common.stage(part, "parts")
    common.drop(trees, found, open_, links)
    return labelled(rows, alike_sets, part)


def contracted(links: DataFrame, part: DataFrame) -> DataFrame:
    """Links as edges between components."""
    a = part.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = part.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return links.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()


def composed(part: DataFrame, joined: DataFrame) -> DataFrame:
    """(node, root) after the components' own roots have been joined."""
    up = joined.select(F.col("node").alias("root"), F.col("root").alias("up"))
    return part.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))


def labelled(rows: DataFrame, alike: DataFrame, part: DataFrame) -> DataFrame:
    """Component of every document, through its set's node."""
    groups = common.stage(
        alike.select("set1", "set2", "id", "group_size", "size").join(part, F.col("id") == F.col("node"), "left")
        .select(F.struct("set1", "set2").alias("set"), "group_size", F.col("size") > 0,
                F.coalesce("root", "id").alias("root")).toDF("set", "group_size", "filled", "root"), "groups")
    out = common.attach_groups(rows.select("doc_id", "n_shingles", F.struct("set1", "set2").alias("set")),
                               groups, "set", "group_size")
    component = F.when(F.col("filled"), F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))
