"""Op 13: importance resampling towards a target distribution.

Documents are drawn without replacement, a document being the likelier the more its hashed
word features look like those of the target texts:

1. A text's features (runs of 1 to ``longest`` words) become an array of buckets, written
   once, so later steps read no text again.
2. The buckets of all documents and of all target texts are counted, summed map-side first;
   ``BUCKETS`` counts of each go to the driver, whatever the input.
3. A document's weight is the floored mean of its features' gains, taken from one literal
   array of gains by a fold over the document's own array; adding Gumbel noise from a hash of
   the id gives its score.  Scores are written.
4. The draw's cutoff is found by bisection: exact count jobs over the written scores narrow
   the score that holds the last place, then the doc_id among rows tied there (and the row
   number among rows alike in both).  No sort, and no row reaches the driver.
5. Rows before the cutoff are range-partitioned by (score, doc_id); a rank is the place in
   the partition plus the rows of the partitions before.

Cases: a null or empty text has no feature, weight 0, and is too short to be drawn; a null
doc_id hashes as an empty id and comes after all others among ties; repeated rows are drawn
one by one; with no target text every gain comes from the documents alone; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrears.llm import common

BUCKETS, SEED = 10_000, "2024"
#: ASCII characters that are not part of words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Thresholds counted by one job, and drawn rows of one range partition.
PROBES, RANGE_ROWS = 15, 200_000
LAST = (1 << 63) - 1


def words(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, BETWEEN), "")


def features(found: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` consecutive words, joined by one space."""
    def runs_of(n: int) -> Column:
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(found, i, F.lit(n)), " "))

    runs = [found, *(runs_of(n) for n in range(2, longest + 1))]
    return F.concat(*runs) if longest > 1 else found


def bucketed(rows: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``rows`` with a text column in exchange for ``n_words`` and ``buckets``."""
    kept = [c for c in rows.columns if c != "text"]
    split = rows.select(*kept, words(F.col("text")).alias("words"))
    return split.select(*kept, F.size("words").cast("long").alias("n_words"), F.transform(
        features(F.col("words"), longest), lambda f: F.pmod(F.crc32(f.cast("binary")), F.lit(buckets)).cast("int")).alias("buckets"))


def bucket_counts(rows: DataFrame) -> dict[int, int]:
    """Features in each bucket: at most ``buckets`` rows to the driver."""
    return {r["bucket"]: r["count"] for r in rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    s_all, t_all = sum(source.values()), sum(target.values())
    return [math.floor(1000 * math.log(float(target.get(b, 0) + 1) * (s_all + buckets)
                                       / (float(source.get(b, 0) + 1) * (t_all + buckets)))) for b in range(buckets)]


def literal(values: Sequence[int]) -> Column:
    """A constant array; one string literal keeps the plan small."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def scored(rows: DataFrame, gain: Sequence[int], seed: str) -> DataFrame:
    """doc_id, row, n_words, n_features, weight, score."""
    table = literal(gain)
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.get(table, b))
    # floor division in whole numbers
    weight = F.when(F.col("n") > 0, F.expr("(total - pmod(total, n)) div n")).otherwise(F.lit(0)).cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8),
               16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return rows.select("doc_id", "row", "n_words", F.size("buckets").cast("long").alias("n"), total.alias("total"), noise.alias("noise")).select(
        "doc_id", "row", "n_words", F.col("n").alias("n_features"), weight.alias("weight"), (weight + F.col("noise")).alias("score"))


def cutoff(rows: DataFrame, keys: Sequence[str], taken: int) -> list[int]:
    """The keys, in ascending lexicographic order, of the row that takes place ``taken``
    (from 1) among ``rows``; fewer keys where all rows that tie on them are taken.

    Keys are whole numbers.  Each job counts the rows at or below ``PROBES`` evenly spaced
    thresholds exactly, so the interval shrinks sixteen-fold a job."""
    found: list[int] = []
    for key in keys:
        span = rows.agg(F.min(key), F.max(key)).first()
        low, high = span[0], span[1]  # the value sought is in [low, high]
        below, up_to = 0, None
        while low < high:
            step = max(1, -(-(high - low) // (PROBES + 1)))
            probes = list(range(low + step - 1, high, step))
            counts = rows.agg(*[F.count(F.when(F.col(key) <= F.lit(p), 1)) for p in probes]).first()
            for p, n in zip(probes, counts):
                if n >= taken:
                    high, up_to = p, n
                    break
                low, below = p + 1, n
        found.append(low)
        if up_to is None:
            up_to = rows.where(F.col(key) <= F.lit(low)).count()
        if up_to == taken:
            break
        rows, taken = rows.where(F.col(key) == F.lit(low)), taken - below
    return found


def at_or_before(keys: Sequence[str], values: Sequence[int]) -> Column:
    """Rows whose keys come no later than ``values`` in lexicographic order."""
    out = F.lit(True)
    for key, value in reversed(list(zip(keys, values))):
        out = (F.col(key) < F.lit(value)) | ((F.col(key) == F.lit(value)) & out)
    return out


def ranked(rows: DataFrame, n: int) -> DataFrame:
    """``rank`` from 1 by (descending score, place, row); ``n`` is how many rows there are."""
    order = ["last", "place", "row"]
    dealt = common.stage(rows.repartitionByRange(n // RANGE_ROWS + 1, *order).withColumn("part", F.spark_partition_id()), "drawn")
    sizes = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}  # a row per range partition
    before, seen = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(seen)
        seen += sizes.get(p, 0)
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("rank", own + F.get(literal(before or [0]), F.col("part")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1,
             buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null where not drawn).

    ``target``: a table with a ``text`` column.  Of the documents with at least
    ``least_words`` words, the floored ``percent`` of them with the highest scores are drawn."""
    rows = common.stage(bucketed(common.documents(docs, F.monotonically_increasing_id().alias("row")), longest, buckets), "buckets")
    wanted = bucketed(target.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), longest, buckets)
    out = common.stage(scored(rows, gains(bucket_counts(rows), bucket_counts(wanted), buckets), seed).withColumns(
        {"last": -F.col("score"), "place": F.coalesce("doc_id", F.lit(LAST))}), "scores")
    common.drop(rows)
    final = ["doc_id", "n_features", "weight", "score"]
    long_enough = out.where(F.col("n_words") >= least_words)
    taken = long_enough.count() * percent // 100
    if not taken:
        return out.select(*final, F.lit(None).cast("long").alias("rank"))
    keys = ["last", "place", "row"]
    drawn = (F.col("n_words") >= least_words) & at_or_before(keys, cutoff(long_enough, keys, taken))
    return ranked(out.where(drawn), taken).select(*final, F.col("rank").cast("long").alias("rank")).unionByName(
        out.where(~drawn).select(*final, F.lit(None).cast("long").alias("rank")))


# crc32 of the distinct words' bytes by the usual table of 256 remainders
SQL = r"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i] || range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(256) r(i))),
words AS (SELECT 'd' AS kind, doc_id AS id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 't', item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
each AS (SELECT kind, id, unnest(w) AS word FROM words),
hashed AS (SELECT word, xor(list_reduce([4294967295] || list_transform(range(len(h) // 2), lambda i:
      CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM each) d, crc),
found AS (SELECT kind, id, bucket, count(*) AS n FROM each JOIN hashed USING (word) GROUP BY ALL),
per AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 't'), 0) AS t
        FROM found GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM per) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM per) + 10000)::DOUBLE))) AS BIGINT) AS g FROM per),
mean AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * g)::DOUBLE / sum(n)::DOUBLE) AS BIGINT) AS weight
         FROM found JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY id),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN mean ON doc_id = id),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored s LEFT JOIN placed p ON s.doc_id = p.doc_id
"""
