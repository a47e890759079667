"""Op 2: exact dedup with a heavy-hitter split, in DataFrame functions only.

Equal texts have equal SHA-256 digests.  Grouping by digest alone would send every copy of
a text to one task, so frequent digests are taken out first:

1. ``approx_top_k``, Spark's Misra-Gries family sketch (it counts with at most ``TRACKED``
   counters and evicts by subtracting from all), names the digests that may be frequent.
   A digest with over about 3.5 / TRACKED of all rows cannot be missing.
2. Those candidates, at most ``WINNERS`` whatever the input, are verified: an exact count,
   equal lengths and equal second hashes over the group, summed map-side first.
3. The verified winners (digest, keeper, size) are broadcast; their copies are settled
   map-side, without a shuffle.
4. The remaining digests, none of them frequent, are shuffled and settled in a window.

The row with the largest doc_id stays.  Cases: null text counts as empty; a null doc_id
ranks below all others; of repeated rows (same doc_id and text) one stays, the others are
dropped with keep_id equal to their own doc_id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrears.llm import common

WINNERS, TRACKED = 1000, 65_536


def digested(docs: DataFrame) -> DataFrame:
    """Narrow rows in place of texts: doc_id, digest, row number, length and second hash."""
    body = F.col("text").cast("binary")
    return common.documents(docs).select(
        "doc_id", F.sha2(body, 256).alias("text_sha256"), F.octet_length("text").alias("bytes"),
        F.xxhash64("text").alias("second"), F.monotonically_increasing_id().alias("row"))


def frequent(rows: DataFrame, winners: int, tracked: int) -> DataFrame:
    """Verified frequent digests: text_sha256, keep (doc_id and row of the keeper), group_size."""
    sketch = rows.agg(F.expr(f"approx_top_k(text_sha256, {winners}, {tracked})").alias("top"))
    names = sketch.select(F.explode("top").alias("t")).select(F.col("t.item").alias("text_sha256"))
    exact = rows.join(F.broadcast(names), "text_sha256").groupBy("text_sha256").agg(
        F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct("bytes", "second")).alias("least"), F.max(F.struct("bytes", "second")).alias("most"))
    return exact.where((F.col("group_size") > 1) & (F.col("least") == F.col("most"))).select(
        "text_sha256", "keep", "group_size")


def exact_dedup(docs: DataFrame, winners: int = WINNERS, tracked: int = TRACKED) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = common.stage(digested(docs), "digests")
    won = common.stage(frequent(rows, winners, tracked), "frequent-digests")
    hot = rows.join(F.broadcast(won), "text_sha256")
    group = Window.partitionBy("text_sha256")
    cold = rows.join(F.broadcast(won.select("text_sha256")), "text_sha256", "left_anti").withColumns(
        {"keep": F.max(F.struct("doc_id", "row")).over(group), "group_size": F.count(F.lit(1)).over(group)})
    return hot.unionByName(cold).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256")


SQL = """
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW w AS (PARTITION BY t ORDER BY doc_id DESC NULLS LAST)
"""
