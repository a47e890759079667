"""Op 5: toxicity by a linear classifier on character n-grams whose features are scaled by
naive Bayes log-count ratios.

Training uses a bounded sample of labelled rows (at most ``SAMPLE`` of each class, taken by
a hash of the id).  Each n-gram's ratio is log((p/|p|) / (q/|q|)), p and q being smoothed
counts of toxic and clean documents that hold it; a logistic regression is then fitted on
binary features multiplied by their ratios, so that its penalty spares the n-grams that tell
the classes apart.  The n-grams with the greatest chi-square statistic, at most
``FEATURES``, are kept - that bounds the model that goes to executors.

Scoring is one pass without shuffle over whole texts, whatever their length: rolling hashes
of all n-grams, a table that rules most of them out, and an exact look-up of 64-bit hashes.
Only the text enters a score.

Cases: null and empty texts hold no n-gram and get the score of the intercept; labels that
are null, or of no document, teach nothing; a document labelled twice counts as toxic if any
label says so; if a class has no labelled row every score is the base rate (0 with no labels
at all); repeated rows are scored one by one; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm import common

#: n-gram lengths; sample rows of each class; kept features; fewest documents of a feature.
ORDERS, SAMPLE, FEATURES, LEAST = (4, 5, 6), 2500, 8192, 4
ALPHA, PENALTY, STEPS = 1.0, 0.02, 150
WINDOW = 1 << 18  # characters hashed at a time
TABLE_BITS = 22
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def ngrams(texts: list[str], orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, places, starts) window by window over all texts, joined by a NUL: ``places``
    is each n-gram's position in the whole, ``starts`` where each text begins.  Positions
    whose n-gram crosses a NUL are left out."""
    lowered = [t.lower().replace("\0", " ") for t in texts]
    starts = np.cumsum([0, *(len(t) + 1 for t in lowered)])[:-1]
    whole = "\0".join(lowered) + "\0"
    longest, powers = max(orders), MULTIPLIER ** np.arange(max(orders), dtype=np.uint64)
    for at in range(0, len(whole), WINDOW):
        codes = np.frombuffer(whole[at:at + WINDOW + longest - 1].encode("utf-32-le", "surrogatepass"), "<u4")
        size = min(WINDOW, len(whole) - at)
        codes64 = codes.astype(np.uint64)
        # the next NUL at or after each position
        ends = np.flatnonzero(codes == 0)
        room = np.append(ends, len(codes))[np.searchsorted(ends, np.arange(size))] - np.arange(size)
        h = np.zeros(len(codes), np.uint64)
        for n in range(1, longest + 1):
            if len(codes) < n:
                break
            h = h[:len(codes) - n + 1] + codes64[n - 1:] * powers[n - 1]
            if n in orders:
                fit = np.flatnonzero(room[:len(h)] >= n)
                yield mixed(h[fit] + np.uint64(n)), fit + at, starts


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        seen = np.zeros(1 << TABLE_BITS, bool)
        seen[(self.hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        return seen

    def present(self, texts: list[str], seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) of each feature that a text holds, once."""
        found = [np.zeros(0, np.int64)]
        m = max(1, len(self.hashes))
        for h, places, starts in ngrams(texts, ORDERS):
            if not len(self.hashes):
                break
            maybe = seen[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
            h, places = h[maybe], places[maybe]
            k = np.minimum(np.searchsorted(self.hashes, h), m - 1)
            right = self.hashes[k] == h
            text = np.searchsorted(starts, places[right], "right") - 1
            found.append(np.unique(text * m + k[right]))
        return np.divmod(np.unique(np.concatenate(found)), m)

    def scores(self, texts: list[str], seen: np.ndarray) -> np.ndarray:
        text, feature = self.present(texts, seen)
        z = self.intercept + np.bincount(text, self.weights[feature], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def training_sample(docs: DataFrame, labels: DataFrame, sample: int, modulus: int, held: int) -> tuple[DataFrame, dict]:
    """(text, toxic) of at most ``sample`` labelled rows of each class, staged; and how many
    labels each class has."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .dropna().where(common.fold("doc_id", modulus) != held)
             .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two classes
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # an id that several rows share gives one of its texts
    rows = common.documents(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    return common.stage(rows, "toxicity-sample"), sizes


def ngram_counts(rows: DataFrame) -> DataFrame:
    """Per n-gram hash: in how many toxic and how many clean sample documents it is."""
    common.small_batches(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        for b in batches:
            texts, y = b.column("text").to_pylist(), b.column("toxic").to_numpy()
            for h, places, starts in ngrams(texts, ORDERS):  # handed over window by window: Spark adds them up
                text = np.searchsorted(starts, places, "right") - 1
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                once = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])) if len(h) else np.zeros(0, bool)
                grams, of = h[once], y[text[once]]
                distinct, inverse = np.unique(grams, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(distinct.view(np.int64)),
                     *(pa.array(np.bincount(inverse[of == k], minlength=len(distinct)).astype(np.int64)) for k in (1, 0))],
                    names=["gram", "toxic", "clean"])
        common.release()

    return rows.mapInArrow(count, "gram long, toxic long, clean long").groupBy("gram").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit_logistic(rows: np.ndarray, features: np.ndarray, ratios: np.ndarray, y: np.ndarray,
                 penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the mean logistic loss plus penalty * |w|^2 / 2,
    classes weighted alike; x is binary times ratio."""
    n, m = len(y), len(ratios)
    x = ratios[features]
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    v = np.ones(m)
    for _ in range(8):  # largest eigenvalue of the weighted Gram matrix
        v = v / max(1e-12, np.linalg.norm(v))
        v = np.bincount(features, (share * np.bincount(rows, x * v[features], n))[rows] * x, m)
    rate = 1 / (0.3 * np.linalg.norm(v) + 0.25 + penalty)
    w, bias, w0, bias0 = np.zeros(m), 0.0, np.zeros(m), 0.0
    for k in range(steps):
        beta = k / (k + 3)
        u, c = w + beta * (w - w0), bias + beta * (bias - bias0)
        g = share * (1 / (1 + np.exp(-np.clip(np.bincount(rows, x * u[features], n) + c, -40, 40))) - y)
        w0, bias0 = w, bias
        w = u - rate * (np.bincount(features, g[rows] * x, m) + penalty * u)
        bias = c - rate * g.sum()
    return w, bias


def best_cut(z: np.ndarray, y: np.ndarray, weight1: float, weight0: float) -> float:
    """The margin value that errs least on the sample, rows weighted to the classes' real
    sizes; of equally good cuts the middle of the widest gap."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    missed = np.cumsum(np.where(y == 1, weight1, 0.0))[:-1]  # toxic below the cut after each row
    false = (y == 0).sum() * weight0 - np.cumsum(np.where(y == 0, weight0, 0.0))[:-1]
    gaps = np.diff(z)
    cuts = np.flatnonzero(gaps > 1e-12)
    if not len(cuts):
        return float(z[0])
    errors = (missed + false)[cuts]
    best = cuts[errors <= errors.min() + 1e-9]
    k = best[gaps[best].argmax()]
    return float((z[k] + z[k + 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, sample: int = SAMPLE) -> Model:
    rows, sizes = training_sample(docs, labels, sample, modulus, held)
    none = np.zeros(0, np.uint64), np.zeros(0)
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        rate = toxic / max(1, toxic + clean)
        return Model(*none, float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))))
    a, b = F.col("toxic"), F.col("clean")
    off = a * n0 - b * n1  # chi-square of the two-by-two table, but for a constant factor
    kept = (ngram_counts(rows).where(a + b >= LEAST)
            .withColumn("chi", off * off / ((a + b) * (n0 + n1 - a - b + 1)))
            .orderBy(F.desc("chi"), "gram").limit(FEATURES).collect())
    hashes = np.array([r["gram"] for r in kept], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    p, q = (np.array([r[c] for r in kept], float)[order] + ALPHA for c in ("toxic", "clean"))
    ratios = np.log((p / (p.sum())) / (q / (q.sum()))) if len(kept) else np.zeros(0)
    model = Model(hashes[order], ratios, 0.0)

    def held_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        seen = model.table()
        for batch in batches:
            text, feature = model.present(batch.column("text").to_pylist(), seen)
            cut = np.searchsorted(text, np.arange(1, batch.num_rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tolist() for x in np.split(feature, cut)], pa.list_(pa.int32())), batch.column("toxic")],
                names=["features", "toxic"])

    data = rows.mapInArrow(held_features, "features array<int>, toxic int").toPandas()  # at most 2 * sample rows
    common.drop(rows)
    lists = [np.asarray(x, np.int64) for x in data["features"]]
    y = data["toxic"].to_numpy(float)
    w, _ = fit_logistic(np.repeat(np.arange(len(y)), [len(x) for x in lists]),
                           np.concatenate([np.zeros(0, np.int64), *lists]), ratios, y)
    weights = w * ratios
    z = np.bincount(np.repeat(np.arange(len(y)), [len(x) for x in lists]),
                    weights[np.concatenate([np.zeros(0, np.int64), *lists])], len(y))
    return Model(model.hashes, weights, -best_cut(z, y, toxic / n1, clean / n0))


def score(docs: DataFrame, model: Model, modulus: int = 5, held: int = 0) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        seen = model.table()
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(model.scores(b.column("text").to_pylist(), seen))], names=["doc_id", "score"])
        common.release()

    return common.documents(docs).mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (common.fold("doc_id", modulus) == held).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, all columns, without the documents that the model calls toxic."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        seen = model.table()
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(model.scores(texts, seen) < 0.5))
        common.release()

    return docs.mapInArrow(run, docs.schema)
