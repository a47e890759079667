"""Pipeline invariants on the driver tables (sf0.001) and batch parsing edges."""

import pytest
from pyspark.sql import functions as F

from arrears.operators.fit import fit
from arrears.plans.base import base
from arrears.sources import batch
from tests.conftest import SMALL


def test_split_disjoint_and_train_only_fit(spark):
    df = base(spark, SMALL)
    shared = df.groupBy("customer").agg(F.count_distinct("split").alias("k")).filter("k > 1").count()
    assert shared == 0
    tr = df.filter("split = 'train'")
    f1 = fit(tr, with_medians=False)
    # fitted tables do not depend on val/test rows: refit after dropping them
    f2 = fit(df.filter("split = 'train'"), with_medians=False)
    a = f1.dims.select("dim", "key", "te", "freq", "code").exceptAll(f2.dims.select("dim", "key", "te", "freq", "code"))
    assert a.count() == 0


def test_amount_parsing_edges(spark):
    vals = ["1,000.5", "abc", "", "NaN", "inf", "0", "-5", "1.0f", "12d", " 12 "]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    got = [r[0] for r in df.select(batch.parse_amount(F.col("t"))).collect()]
    assert got[0] == 1000.5 and got[1] == 0.0 and got[2] == 0.0 and got[5] == 0.0 and got[6] == -5.0
    assert got[7] == 0.0 and got[8] == 0.0 and got[9] == 12.0 and got[4] == float("inf")


def test_headers_bom_defaults_and_missing(spark):
    df = spark.createDataFrame([("5", "c", "s", "d", "k", "sk", "b", "p", "ci", "di", "")],
                               ["﻿Jumlah", "kode_customer", "nama_salesman", "nama_divisi", "nama_kategori",
                                "nama_sub_kategori", "kode_cabang", "provinsi", "kota", "kecamatan", "keterangan"])
    c = batch.canonical(df)
    r = c.first()
    assert r.amount == "5" and r.customer_group == "NON-GROUP CUSTOMER" and r.remark == ""  # empty kept
    with pytest.raises(batch.MissingColumns):
        batch.canonical(df.drop("kota"))
    v = batch.validate(batch.coerce(c.withColumn("district", F.lit("")))).first()
    assert v.error == "district is empty"


def test_money_keeps_digits_and_infinities(spark):
    from arrears.operators import fit
    rows = [("a", 10.005), ("a", 10.004), ("a", 0.001), ("b", 2e16), ("c", float("inf")), ("c", 1.0), ("d", float("nan"))]
    got = {r.k: r for r in spark.createDataFrame(rows, "k string, amount double").groupBy("k").agg(*fit.amount_stats()).collect()}
    assert abs(got["a"].amount_std - 5.775523) < 1e-6 and got["b"].amount_total == 2e16 and got["b"].amount_std == 0
    assert got["c"].amount_avg == float("inf") and got["c"].amount_std == 0 and got["d"].amount_avg is None


def test_stream_resumes_after_a_restart(spark, tmp_path):
    """A second run on the same folder scores only the new file, and keeps what was there."""
    import os
    import shutil
    from pyspark.sql import functions as F
    from arrears.plans.base import fitted, scorecards
    from arrears.plans.catalog_batch import upload_file
    from arrears.streaming import scoring
    from tests.conftest import SMALL
    local = upload_file(spark, SMALL).removeprefix("file:")
    files = sorted(f for f in os.listdir(local) if f.endswith(".csv"))
    source, root = tmp_path / "in", str(tmp_path / "root")
    source.mkdir()
    half = max(1, len(files) // 2)
    fit = fitted(spark, SMALL)
    counts = []
    for part in (files[:half], files[half:]):
        for f in part:
            shutil.copy(f"{local}/{f}", source / f)
        out = scoring.run(spark, str(source), fit, scorecards, "t", root=root, watermark="3650 days")
        rows = spark.read.parquet(f"{out}/accepted").unionByName(spark.read.parquet(f"{out}/rejected"))
        counts.append(rows.count())
        assert counts[-1] == spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(source)).count()
        windows = scoring.final_windows(spark, out).agg(F.sum("n_decisions")).first()[0]
        assert windows == spark.read.parquet(f"{out}/accepted").count()
    assert len(files) == 1 or counts[0] < counts[1]


def test_fitted_maps_round_trip_and_scored_batch(spark, tmp_path):
    from arrears.operators import features
    from arrears.plans.base import base, fitted
    from arrears.sources import artifacts
    from tests.conftest import SMALL
    fit = fitted(spark, SMALL)
    artifacts.write_fitted(fit, str(tmp_path / "maps"))
    back = artifacts.read_fitted(spark, str(tmp_path / "maps"))
    rows = base(spark, SMALL).limit(50)
    key = ["order_key", "line_no", "part_key", "supp_key", "amount"]
    a, b = (sorted(map(str, features.transform(rows, f, mode="online").select(*key, *features.FEATURES[5:]).collect())) for f in (fit, back))
    assert a == b
    scored = spark.createDataFrame([(0, 0.9, 0.1), (1, 0.2, 0.3)], "row_index long, score_a double, score_b double")
    artifacts.write_scored_batch(scored, str(tmp_path / "scored"), 0.5)
    got = sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "scored")).collect()))
    assert got == [("0", "0.9", "0.1", "BERISIKO", "LAYAK"), ("1", "0.2", "0.3", "LAYAK", "LAYAK")]
