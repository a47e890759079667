"""Op 7: URL filter by rules, and by a character language-model ratio where no rule fits.

Two smoothed variable-order Markov models are counted over the whole table, one on the URLs
that rules allow and one on those that rules block.  Each order's probabilities are mixed
with those of the order below by Witten-Bell weights, so a context that was seldom seen
leans on its shorter endings.  What is counted and scored is a URL's host and path, as the
rules read them: scheme, query string and fragment are cut.  The score is the difference of
log-likelihoods, divided by the length; the threshold is calibrated on a fold of the
rule-decided URLs that the models have not seen.

Characters are mapped to a small alphabet (letters, one digit, the URL's marks, and one sign
for all others), so the counts of all four-character strings, and with them what is
broadcast, have a fixed bound whatever the corpus.

Cases: a null url, or one without "://", has empty host and path, fits no rule and is judged
as an empty string; if no URL is blocked by rule (or none allowed) the method allows (or
blocks) all; ties at the threshold are allowed; repeated rows are judged one by one; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears.llm import common

#: The rules, longest first.  Fixed values.
RULES = (("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), ("net/es/", "block"),
         ("net/fr/", "block"))
ORDER, FOLDS, CALIBRATION = 4, 5, 0
#: Sign 0 stands before a URL's start and after its end; every digit is one sign, what is not listed another.
SIGNS = "\0" + string.ascii_lowercase + "0./-_?=&%#:~+" + "*"
WIDTH = 512.0  # buckets of scores, per nat


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    rule = verdict = None
    for text, says in sorted(RULES, key=lambda r: -len(r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return rule, verdict


def signs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of every string of ORDER signs, each text being padded in front."""
    table = np.full(0x110000 if any(not t.isascii() for t in texts) else 128, len(SIGNS) - 1, np.int64)
    for k, c in enumerate(SIGNS[:-1]):
        table[ord(c)] = k
    table[[ord(c) for c in string.digits]] = SIGNS.index("0")
    table[[ord(c) for c in string.ascii_uppercase]] = [SIGNS.index(c) for c in string.ascii_lowercase]
    pad = "\0" * (ORDER - 1)
    padded = [pad + t.replace("\0", "*") + "\0" for t in texts]
    codes = table[np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")]
    of = np.repeat(np.arange(len(texts)), [len(t) for t in padded])
    grams = np.zeros(max(0, len(codes) - ORDER + 1), np.int64)
    for k in range(ORDER):
        grams = grams * len(SIGNS) + codes[k:len(codes) - ORDER + 1 + k]
    inside = of[:len(grams)] == of[ORDER - 1:]
    return of[:len(grams)][inside], grams[inside]


def counted(urls: DataFrame) -> DataFrame:
    """(verdict, gram, n) over all rows of (verdict, text); summed in each task first."""
    common.small_batches(urls.sparkSession, 4096)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            of, grams = signs(b.column("text").to_pylist())
            allowed = np.array([v == "allow" for v in b.column("verdict").to_pylist()])
            for says in ("allow", "block"):
                values, n = np.unique(grams[allowed[of] == (says == "allow")], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([says] * len(values), pa.string()), pa.array(values), pa.array(n)],
                                                 names=["verdict", "gram", "n"])

    return urls.mapInArrow(count, "verdict string, gram long, n long").groupBy("verdict", "gram").agg(F.sum("n").alias("n"))


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities (context, sign) of the longest order from counts of strings."""
    size = len(SIGNS)
    p = np.full((1, size), 1 / size)
    for order in range(1, ORDER + 1):
        n = counts.reshape(-1, size ** (order - 1), size).sum(0)  # strings by their last ``order`` signs
        total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
        below = np.tile(p, (size if order > 1 else 1, 1))  # a context's shorter ending
        weight = np.maximum(total + kinds, 1)
        p = np.where(total > 0, (n + kinds * below) / weight, below)
    return np.log(p).astype(np.float32)


def scores(texts: list[str], ratio: np.ndarray) -> np.ndarray:
    of, grams = signs(texts)
    return np.bincount(of, ratio[grams], len(texts)) / np.maximum(1, np.bincount(of, minlength=len(texts)))


def scored(urls: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``urls`` with ``score`` in place of ``text``."""
    keep = [c for c in urls.columns if c != "text"]
    common.small_batches(urls.sparkSession, 4096)
    shared = urls.sparkSession.sparkContext.broadcast(ratio)  # len(SIGNS) ** ORDER floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores(b.column("text").to_pylist(), shared.value) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s)], names=[*keep, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema if f.name != "text")
    return urls.mapInArrow(run, schema + ", score double")


def threshold(rows: DataFrame) -> float:
    """The score that best parts allowed from blocked rows, both classes weighing the same."""
    bucket = F.floor(F.col("score") * WIDTH).cast("long")
    # log-probabilities are bounded, so buckets are
    found = rows.groupBy(bucket.alias("bucket")).agg(
        *(F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in ("allow", "block"))).orderBy("bucket").collect()
    allow, block = (np.array([r[v] for r in found], float) for v in ("allow", "block"))
    if not len(found) or not allow.sum() or not block.sum():
        return 0.0
    # cutting below bucket k: allowed rows under it and blocked rows from it on are wrong
    wrong = (allow.cumsum() - allow) / allow.sum() + (block.sum() - block.cumsum() + block) / block.sum()
    k = int(wrong.argmin())
    low = found[k - 1]["bucket"] + 1 if k else found[k]["bucket"]
    return (low + found[k]["bucket"]) / 2 / WIDTH


def judge(pages: DataFrame) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and the method's score."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "verdict": verdict, "text": F.concat("host", "path")})
    known = rows.where("verdict is not null").select("page_id", "verdict", "text")
    seen = known.where(common.fold("page_id", FOLDS) != CALIBRATION).select("verdict", "text")
    grams = counted(seen).toPandas()  # at most two rows for each string of signs
    models, sizes = [], []
    for says in ("allow", "block"):
        part = grams[grams["verdict"] == says]
        counts = np.zeros(len(SIGNS) ** ORDER)
        counts[part["gram"].to_numpy(np.int64)] = part["n"].to_numpy(float)
        sizes.append(counts.sum())
        models.append(log_model(counts))
    if not all(sizes):
        says = "allow" if sizes[0] or not sizes[1] else "block"
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(says)).alias("verdict"),
                           F.lit(0.0).alias("score"))
    ratio = (models[0] - models[1]).ravel()
    held = known.where(common.fold("page_id", FOLDS) == CALIBRATION)
    cut = threshold(scored(held, ratio))
    by_model = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return scored(rows, ratio).select("page_id", "host", "path", "rule",
                                      F.coalesce("verdict", by_model).alias("verdict"), "score")
