"""Artifacts and sinks (S4-S15): fitted tables, scaler, scored batches,
decision log, experiment metrics tree, JSON-safe records.

Sinks are plain DataFrame writers (distributed, one part file per task);
ordering happens at read time (``orderBy``), never by funnelling rows into
one writer.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrears.operators.decide import risk_label
from arrears.sources import records

JSON_BIG = 1e18


# ---------------------------------------------------------------- readers
def read_table_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV columns by the files' headers, cast to an explicit schema (never
    inferred; an empty or unreadable cell is null).  A record with a wrong number of cells is
    an error: these tables are written by programs."""
    raw = records.read(spark, path)
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; available: {sorted(raw.columns)}")
    sound = F.assert_true(F.col(records.MALFORMED).isNull(), F.concat(F.lit("wrong number of cells: "), F.col(records.MALFORMED)))
    return raw.where(sound.isNull()).select(*[
        F.when(F.col(f.name) != "", F.col(f.name)).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_optional_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Multi-line JSON artifact; a missing path gives a typed empty
    DataFrame, an unreadable one a row of nulls (PERMISSIVE), never an error."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


METRICS_TREE = T.StructType([T.StructField("experiments", T.MapType(T.StringType(), T.StructType([
    T.StructField("models", T.MapType(T.StringType(), T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))))
])))])


def flatten_experiments(tree: DataFrame) -> DataFrame:
    """Experiments -> models -> evaluations -> metrics, one row per
    (experiment, model, evaluation, metric) via ``explode`` of each map."""
    e = tree.select(F.explode("experiments").alias("experiment", "body"))
    m = e.select("experiment", F.explode("body.models").alias("model", "evals"))
    v = m.select("experiment", "model", F.explode("evals").alias("evaluation", "metrics"))
    return v.select("experiment", "model", "evaluation", F.explode("metrics").alias("metric", "value"))


def nest_experiments(long: DataFrame) -> DataFrame:
    """Inverse of ``flatten_experiments``: the nested map document."""
    a = long.groupBy("experiment", "model", "evaluation").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    b = a.groupBy("experiment", "model").agg(F.map_from_entries(F.collect_list(F.struct("evaluation", "metrics"))).alias("evals"))
    c = b.groupBy("experiment").agg(F.map_from_entries(F.collect_list(F.struct("model", "evals"))).alias("models"))
    return c.agg(F.map_from_entries(F.collect_list(F.struct("experiment", F.struct("models")))).alias("experiments"))


#: Names under which scored sets carry the two models' scores, the first present one counts.
SCORE_NAMES = (("score_a", "xgb_probability", "probability"), ("score_b", "mlp_probability"))


def normalize_scores(rows: DataFrame, n_col: str = "row_id", names: Sequence[Sequence[str]] = SCORE_NAMES,
                     label: str = "y_true") -> DataFrame:
    """One scored-set shape; the first present score column among each model's
    candidate ``names`` is used, a missing score is padded with 0.0 (the reference's
    normaliser), non-numeric -> 0."""
    def score(candidates: Sequence[str]) -> Column:
        found = next((c for c in candidates if c in rows.columns), None)
        return F.coalesce(F.col(f"`{found}`").cast("string").try_cast("double"), F.lit(0.0)) if found else F.lit(0.0)

    return rows.select(n_col, F.col(label).cast("int").alias("y_true"), *[score(c).alias(f"score_{m}") for m, c in zip("ab", names)])


# ---------------------------------------------------------------- JSON safety
def json_safe(df: DataFrame) -> DataFrame:
    """NaN -> null (records) and +-inf -> +-1e18 (export)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit(None)).when(c == F.lit(float("inf")), F.lit(JSON_BIG)) \
                 .when(c == F.lit(float("-inf")), F.lit(-JSON_BIG)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def to_records(df: DataFrame) -> DataFrame:
    """One JSON object per row (distributed ``to_json``)."""
    return json_safe(df).select(F.to_json(F.struct(*df.columns)).alias("record"))


def feature_vector_map(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Optional per-row name -> value map of the features, rounded to 6."""
    m = F.create_map(*[x for f in features for x in (F.lit(f), F.round(F.col(f).cast("double"), 6))])
    return df.select(*keep, m.alias("feature_vector"))


# ---------------------------------------------------------------- writers
def write_fitted(fitted, path: str) -> None:
    """Dims partitioned by dim + the globals row (label encoders are the
    ``code`` column: {class: index})."""
    fitted.dims.write.mode("overwrite").partitionBy("dim").parquet(os.path.join(path, "dims"))
    fitted.globals_frame(fitted.dims.sparkSession).write.mode("overwrite").json(os.path.join(path, "globals"))


def read_fitted(spark: SparkSession, path: str):
    """The maps that ``write_fitted`` wrote, ready to transform with."""
    from arrears.operators.fit import LE_DIMS, Fitted
    dims = spark.read.option("basePath", os.path.join(path, "dims")).parquet(os.path.join(path, "dims"))
    row = spark.read.json(os.path.join(path, "globals")).first().asDict()
    inf = float("inf")
    row["bin_edges"] = [-inf, *(float(e) for e in row["bin_edges"][1:-1]), inf]
    sizes = {r.dim: (r.n, r.k) for r in dims.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce("key", F.lit("nan"))).alias("k")).collect()}
    return Fitted(g=row, dims=dims, dim_sizes={d: v[0] for d, v in sizes.items()},
                  n_classes={d: sizes.get(d, (0, 0))[1] for d in LE_DIMS})


def write_scaler(spark: SparkSession, features: Sequence[str], mean: Sequence[float], scale: Sequence[float], path: str) -> None:
    """The fitted scaler as JSON rows in feature order: position, feature, mean, scale."""
    rows = [(i, f, float(m), float(s)) for i, (f, m, s) in enumerate(zip(features, mean, scale))]
    spark.createDataFrame(rows, SCALER).write.mode("overwrite").json(path)


def read_scaler(spark: SparkSession, path: str) -> tuple[list[str], list[float], list[float]]:
    """(features, means, scales) as written; a missing scaler is an error."""
    rows = spark.read.schema(SCALER).json(path).orderBy("position").collect()  # a row per feature
    if [r.position for r in rows] != list(range(len(rows))) or not rows:
        raise ValueError(f"no whole scaler at {path}")
    return [r.feature for r in rows], [r["mean"] for r in rows], [r.scale for r in rows]


SCALER = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("feature", T.StringType()),
                       T.StructField("mean", T.DoubleType()), T.StructField("scale", T.DoubleType())])


def write_scored_batch(df: DataFrame, path: str, threshold: float) -> None:
    """``row_index, score_a, score_b, label_a, label_b`` with header."""
    out = df.select("row_index", "score_a", "score_b",
                    risk_label("score_a", threshold).alias("label_a"),
                    risk_label("score_b", threshold).alias("label_b"))
    out.write.mode("overwrite").option("header", True).csv(path)


def append_decisions(df: DataFrame, path: str) -> None:
    """Append-only decision log (parquet); ``read_decisions`` orders newest first."""
    df.write.mode("append").parquet(path)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Newest first at read time."""
    return spark.read.parquet(path).orderBy(F.desc("timestamp"), F.desc("id"))


def write_decisions_csv(df: DataFrame, path: str) -> None:
    """A missing second-model value is written as an empty cell."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def shap_arrays(contrib: DataFrame, features: list[str], key: str = "row_id") -> DataFrame:
    """Long (row, feature, value) -> one dense array per row in
    the fixed feature order; a feature without an entry is 0, entries of other names
    (the base value) are left out (a row holds at most len(features) entries)."""
    c = contrib.where(F.col("feature").isin(*features))
    g = c.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("_v"))
    rows = contrib.select(key).distinct().join(g, key, "left")
    return rows.select(key, F.array(*[F.coalesce(F.col("_v")[f], F.lit(0.0)) for f in features]).alias("shap_values"))


def shap_long(arrays: DataFrame, features: list[str], key: str = "row_id") -> DataFrame:
    """S13 inverse: ``posexplode`` back to (row, feature, value)."""
    names = F.array(*[F.lit(f) for f in features])
    x = arrays.select(key, F.posexplode("shap_values").alias("_i", "value"))
    return x.select(key, names[F.col("_i")].alias("feature"), "value")
