"""Training-data pipeline over ``documents``: five stages, each applying one operator of
``arrears.llm`` to all that the stage before it kept.

language     documents go of which the field does not expect two fifths of the words or more to be of
             one learned language (so do those without a word)
toxicity     documents that the classifier calls toxic go
exact_dedup  of equal texts the row with the largest doc_id stays
near_dedup   of each group of near-duplicates the smallest doc_id stays
packing      the documents' tokens, packed into sequences

Every stage's result is written as Parquet and read again as the next one's input.  All but
the last return the columns of ``documents``, whatever they are.  Nulls, empty tables,
repeated rows and clashing column names are handled as the operators' docstrings say; rows
that are alike in doc_id and text count as copies of each other, so one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.llm import common, crf_lang, exact_dedup, lsh_forest, packing, toxicity
from arrears.llm.tokens import tokenizer_path

#: Rows to drop that are broadcast: a list of ids and digests of at most some 20 MB.
LISTED = 200_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return crf_lang.with_language(docs, crf_lang.train(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def without(docs: DataFrame, dropped: DataFrame, condition) -> DataFrame:
    """``docs`` but for the few rows to drop, which are broadcast up to ``LISTED`` of them."""
    dropped = common.stage(dropped, "dropped")
    return docs.join(F.broadcast(dropped) if dropped.count() <= LISTED else dropped, condition, "left_anti")


def digest(docs: DataFrame):
    return F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"), 256)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(docs)
    dropped = found.where("NOT kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest"), "keep_id").distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (digest(docs) == F.col("__digest"))
    out = without(docs, dropped.select("__id", "__digest"), same)
    # where the row that stays is alike in id and text, its copies took it with them: one comes back
    again = common.stage(dropped.where(F.col("__id").eqNullSafe(F.col("keep_id"))).select("__digest"), "alike")
    if again.isEmpty():
        return out
    own = next(n for n in map("own{}".format, range(len(docs.columns) + 1)) if n not in docs.columns)
    alike = docs.withColumn(own, digest(docs)).join(again, F.col(own) == F.col("__digest"), "left_semi")
    return out.unionByName(last_of_each(alike, own))


def last_of_each(rows: DataFrame, by: str) -> DataFrame:
    """One row of each digest: of those with the greatest id any, as they are alike in id and text."""
    top = rows.groupBy(by).agg(F.max("doc_id").alias("__top")).withColumnRenamed(by, "__by")
    return rows.join(top, (F.col(by) == F.col("__by")) & rows["doc_id"].eqNullSafe(F.col("__top")), "left_semi").dropDuplicates([by]).drop(by)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = lsh_forest.near_duplicates(docs)
    dropped = found.groupBy(F.col("doc_id").alias("__id")).agg(F.max("kept").alias("any")).where("NOT any").select("__id")
    return without(docs, dropped, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", language), ("toxicity", not_toxic), ("exact_dedup", exact), ("near_dedup", near),
          ("packing", packed)]

#: Learned models, signatures and the packing program have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
