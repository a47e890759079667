"""Structured Streaming jobs.

* R1 - score a stream of raw invoice files against the static fitted
  tables.  A micro-batch holds whole files, so it is parsed by the very reader
  of uploads (``sources.records``: headers by name, line ends in quotes, decoding
  per file, wrong numbers of cells) and goes through the same online transform.
* R2 - ``foreachBatch`` routes each micro-batch: accepted rows to one table,
  rejected rows (with their reason, and the text of malformed records) to
  another; both appends are idempotent per batch id (a re-run batch overwrites
  its own folder).
* R3 - running decision summary per event-time window (count, high-risk,
  mean score) with a watermark; ``update`` mode, the sink keeps the latest
  row per window.

Sources are streams of text files; the sinks' columns are fixed; checkpoints live under the
folder the caller names, so a restarted driver resumes there (by default under
the application's own checkpoint folder).
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrears.operators import decide
from arrears.operators.clean import parse_day_first
from arrears.operators import features as feat
from arrears.operators.fit import Fitted
from arrears.session import checkpoint_dir
from arrears.sources import batch, records

#: Columns of a streamed upload that reach the sinks, beside the scores.
COLUMNS = ["order_key", "line_no", "part_key", "supp_key", *batch.REQUIRED, *batch.OPTIONAL_DEFAULTS, "tanggal"]


def parse(raw: DataFrame) -> DataFrame:
    """The raw lines of a micro-batch under fixed columns; what a file lacks is empty."""
    rows = batch.canonical(records.table(raw), fill=True)
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in (*COLUMNS, records.MALFORMED)])


def score_rows(df: DataFrame, fitted: Fitted, scorer, features: Sequence[str] | None = None) -> DataFrame:
    """Coerce -> validate -> online features -> scores (null on reject).  ``features``: those
    that the scorer reads, if not all; only these are looked up, kept and written."""
    v = batch.validate(batch.coerce(df), strict=True)
    s = scorer(feat.transform(v, fitted, mode="online", features=features))
    ok = F.col("error").isNull()
    return s.withColumn("score_a", F.when(ok, F.col("score_a"))).withColumn("score_b", F.when(ok, F.col("score_b")))


def route_batches(out_dir: str, fitted: Fitted, scorer, features: Sequence[str] | None = None):
    """R2: accepted / rejected sinks, idempotent per micro-batch."""
    def sink(batch_df: DataFrame, batch_id: int) -> None:
        scored = score_rows(parse(records.placed(batch_df)), fitted, scorer, features).persist()
        try:
            scored.filter(F.col("error").isNull()).write.mode("overwrite") \
                .parquet(os.path.join(out_dir, "accepted", f"batch={batch_id}"))
            scored.filter(F.col("error").isNotNull()).write.mode("overwrite") \
                .parquet(os.path.join(out_dir, "rejected", f"batch={batch_id}"))
        finally:
            scored.unpersist()
    return sink


def decision_windows(scored: DataFrame, threshold: float, window: str = "7 days",
                     watermark: str = "30 days") -> DataFrame:
    """Per event-time window: decisions, high-risk (either model risky),
    mean score of model a.  Decisions more than ``watermark`` behind the latest one are
    late and left out; a source in no order of time needs a wider one."""
    d = scored.filter(F.col("error").isNull()) \
        .withColumn("event_ts", F.to_timestamp(parse_day_first("tanggal"))) \
        .withColumn("label_a", decide.risk_label("score_a", threshold)) \
        .withColumn("label_b", decide.risk_label("score_b", threshold)) \
        .withWatermark("event_ts", watermark)
    risky = (F.col("label_a") == "BERISIKO") | (F.col("label_b") == "BERISIKO")
    return d.groupBy(F.window("event_ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("n_decisions"), F.sum(risky.cast("int")).cast("long").alias("n_high_risk"),
        F.sum("score_a").alias("sum_score"))


def window_sink(out_dir: str):
    def sink(batch_df: DataFrame, batch_id: int) -> None:
        batch_df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
            .parquet(os.path.join(out_dir, "windows", f"batch={batch_id}"))
    return sink


def run(spark: SparkSession, source: str, fitted: Fitted, scorer, name: str, threshold: float = 0.5,
        root: str | None = None, watermark: str = "30 days", features: Sequence[str] | None = None) -> str:
    """Run R1-R3 to completion over what is in ``source`` (availableNow) and
    return the output folder.  Rows are scored once; the windows read the accepted sink.

    With a ``root`` that outlives the application, a later run resumes where the last one
    ended: files that were scored are not scored again."""
    root = root or os.path.join(checkpoint_dir(spark), "streams", name)
    out = os.path.join(root, "out")
    empty = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in (*COLUMNS, records.MALFORMED)]))
    scored = score_rows(empty, fitted, scorer, features).schema
    q1 = (records.streamed_lines(spark, source).writeStream.foreachBatch(route_batches(out, fitted, scorer, features))
          .option("checkpointLocation", os.path.join(root, "ckpt_route")).trigger(availableNow=True).start())
    q1.awaitTermination()
    accepted = (spark.readStream.schema(T.StructType([*scored.fields, T.StructField("batch", T.IntegerType())]))
                .parquet(os.path.join(out, "accepted")))
    q2 = (decision_windows(accepted, threshold, watermark=watermark).writeStream.outputMode("update")
          .foreachBatch(window_sink(out)).option("checkpointLocation", os.path.join(root, "ckpt_windows"))
          .trigger(availableNow=True).start())
    q2.awaitTermination()
    return out


def final_windows(spark: SparkSession, out_dir: str) -> DataFrame:
    """Latest row per window across update-mode batches."""
    w = spark.read.parquet(os.path.join(out_dir, "windows"))
    last = w.groupBy("w").agg(F.max_by(F.struct("n_decisions", "n_high_risk", "sum_score"), F.col("batch_id")).alias("r"))
    return last.select(F.to_date(F.col("w.start")).alias("window_start"), "r.n_decisions", "r.n_high_risk",
                       (F.col("r.sum_score") / F.col("r.n_decisions")).alias("mean_score"))
