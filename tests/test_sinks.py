"""Artifacts and sinks round trips."""

import math
import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from arrears.functions import columns as C
from arrears.operators import resample
from arrears.sources import artifacts as A


def test_decision_log_and_csv_sinks(spark, tmp_path):
    log = os.path.join(tmp_path, "log")
    rows = [(1, "2024-01-01 10:00:00", 5.0, "c1", 0.7, None, 0.5, "BERISIKO", None),
            (2, "2024-01-02 10:00:00", 6.0, "c2", 0.2, 0.3, 0.5, "LAYAK", "LAYAK")]
    schema = ("id long, timestamp string, jumlah double, kode_customer string, xgb_probability double, "
              "mlp_probability double, threshold double, xgb_label string, mlp_label string")
    df = spark.createDataFrame(rows, schema).withColumn("timestamp", F.to_timestamp("timestamp"))
    A.append_decisions(df.limit(1), log)
    A.append_decisions(df.filter("id = 2"), log)
    back = A.read_decisions(spark, log).collect()
    assert [r.id for r in back] == [2, 1]                        # newest first
    out = os.path.join(tmp_path, "csv")
    A.write_decisions_csv(df, out)
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".csv"))
    assert ",," in text or text.rstrip().endswith(",")            # null model -> empty cell


def test_optional_json_and_experiment_tree(spark, tmp_path):
    missing = A.read_optional_json(spark, os.path.join(tmp_path, "nope"), A.METRICS_TREE)
    assert missing.count() == 0 and missing.schema == A.METRICS_TREE
    long = spark.createDataFrame([("A", "rf", "test", "auc", 0.8), ("A", "rf", "test", "f1", 0.5),
                                  ("B", "gbt", "val", "auc", 0.7)],
                                 "experiment string, model string, evaluation string, metric string, value double")
    p = os.path.join(tmp_path, "tree")
    A.nest_experiments(long).write.json(p)
    flat = A.flatten_experiments(A.read_optional_json(spark, p, A.METRICS_TREE))
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, long.collect()))


def test_json_safe_records_and_vectors(spark):
    df = spark.createDataFrame([(1, float("nan"), float("inf")), (2, 1.5, -float("inf"))], "id int, a double, b double")
    recs = [r.record for r in A.to_records(df).collect()]
    assert '"b":1.0E18' in recs[0] and '"a"' not in recs[0]
    fv = A.feature_vector_map(df, ["a"], ["id"]).filter("id = 2").first().feature_vector
    assert fv == {"a": 1.5}


def test_shap_arrays_round_trip(spark):
    feats = ["f1", "f2", "f3"]
    long = spark.createDataFrame([(1, "f2", 0.2), (1, "f1", 0.1), (1, "f3", -0.3)], "row_id int, feature string, value double")
    arr = A.shap_arrays(long, feats)
    assert arr.first().shap_values == [0.1, 0.2, -0.3]
    back = A.shap_long(arr, feats)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.collect()))


def test_normalize_scores_pads_missing(spark):
    rows = spark.createDataFrame([(0, 1, "0.7"), (1, 0, "abc")], "row_id int, y_true int, xgb_probability string")
    out = A.normalize_scores(rows).orderBy("row_id").collect()
    assert out[0].score_a == 0.7 and out[1].score_a == 0.0 and out[0].score_b == 0.0


def test_postprocess_rounds_and_clips(spark):
    train = spark.createDataFrame([(0.0, 1.0, 2.0), (1.0, 5.0, 3.0)], "flag double, cnt double, x double")
    aug = spark.createDataFrame([(0.6, 2.5, 9.0), (-0.2, 3.5, 0.0)], "flag double, cnt double, x double")
    r = resample.postprocess(aug, train, ["flag", "cnt", "x"], ["flag"], ["cnt"]).collect()
    assert (r[0].flag, r[0].cnt, r[0].x) == (1.0, 2.0, 3.0)      # half-even rounding, clipped to train max
    assert (r[1].flag, r[1].cnt, r[1].x) == (0.0, 4.0, 2.0)


def test_text_helpers_and_unpivot(spark):
    df = spark.createDataFrame([("test_auc", "cust_avg_amount", 0.1234, 1, 0.8, 0.7)],
                               "m string, f string, x double, seed int, xgb_auc double, mlp_auc double")
    r = df.select(C.metric_label(F.col("m")).alias("a"), C.feature_label(F.col("f")).alias("b"),
                  C.percent_text(F.col("x")).alias("c")).first()
    assert (r.a, r.b, r.c) == ("AUC", "cust avg amount", "12.3%")
    long = C.model_pair_long(df.select("seed", "xgb_auc", "mlp_auc"), "auc").orderBy("model").collect()
    assert [(x.model, x.value) for x in long] == [("mlp", 0.7), ("xgb", 0.8)]


def test_raw_transactions_and_table_csv(spark, tmp_path):
    """S1 + P1 (day-first dates, explicit schema) and S4 / S6 (CSV with a schema)."""
    from pyspark.sql import types as T
    from arrears.sources import batch
    p = os.path.join(tmp_path, "raw.csv")
    header = ",".join(batch.RAW_COLUMNS)
    row = "T1,31/1/2024,45,1500.5,100,C1,NON-GROUP CUSTOMER,S1,D1,K1,SK1,B1,P1,K,KC,,"
    with open(p, "w") as fh:
        fh.write(header + "\n" + row + "\n")
    r = batch.read_raw_transactions(spark, p).first()
    assert str(r.invoice_date) == "2024-01-31" and r.age_days == 45 and r.amount == 1500.5
    assert r.subdistrict is None and r.remark is None
    schema = T.StructType([T.StructField("seed", T.IntegerType()), T.StructField("xgb_test_auc", T.DoubleType())])
    q = os.path.join(tmp_path, "seeds.csv")
    with open(q, "w") as fh:
        fh.write("seed,xgb_test_auc\n1,0.77\n2,bad\n")
    rows = A.read_table_csv(spark, q, schema).orderBy("seed").collect()
    assert rows[0].xgb_test_auc == 0.77 and rows[1].xgb_test_auc is None


def test_shap_arrays_are_dense(spark):
    from arrears.sources import artifacts
    rows = [(1, "f2", 0.5), (1, "__base__", -9.0), (2, "__base__", -9.0)]
    got = {r.row_id: list(r.shap_values) for r in artifacts.shap_arrays(
        spark.createDataFrame(rows, "row_id long, feature string, value double"), ["f0", "f1", "f2"]).collect()}
    assert got == {1: [0.0, 0.0, 0.5], 2: [0.0, 0.0, 0.0]}


HEADER = "jumlah,kode_customer,nama_salesman,nama_divisi,nama_kategori,nama_sub_kategori,kode_cabang,provinsi,kota,kecamatan"


def test_upload_quotes_miscounted_rows_and_latin1(spark, tmp_path):
    from arrears.sources import batch
    lines = [HEADER, '"1,000",C1,"PT ""MAJU"", Tbk",D,K,S,B,P,Kota,Kec', "5,C2,N,D,K,S,B,P", "6,C3,N,D,K,S,B,P,Kota,Kec,more"]
    (tmp_path / "a.csv").write_text("\n".join(lines), encoding="utf-8")
    rows = batch.validate(batch.coerce(batch.read_upload(spark, str(tmp_path / "a.csv")))).collect()
    by = {r.customer: r for r in rows}
    assert (by["C1"].salesperson, by["C1"].amount, by["C1"].error) == ('PT "MAJU", Tbk', 1000.0, None)
    assert by["C2"].error == by["C3"].error == "wrong number of cells"
    (tmp_path / "b.csv").write_bytes("\n".join([HEADER, "7,Café,N,D,K,S,B,P,Kota,Kec"]).encode("latin-1"))
    assert batch.read_upload(spark, str(tmp_path / "b.csv")).first().customer == "Café"


def test_row_index_follows_read_order(spark, tmp_path):
    from arrears.sources import batch
    df = spark.range(1000).repartition(7)
    df.write.parquet(str(tmp_path / "t"))
    got = batch.with_row_index(spark.read.parquet(str(tmp_path / "t"))).orderBy("row_index").collect()
    assert [r.row_index for r in got] == list(range(1000)) and sorted(r.id for r in got) == list(range(1000))
