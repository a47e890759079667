"""The record reader (S1, S2, R1): quotes, splits, decodings, headers, odd records."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from arrears.plans.base import fitted, scorecards
from arrears.sources import batch, records
from arrears.streaming import scoring
from tests.conftest import SMALL


def odd_cell(r):
    k = r.random()
    return ('a,"b"\nc é' if k < .1 else "� x" if k < .15 else "l1\r\nl2" if k < .2 else "" if k < .25 else
            "".join(r.choice('abc xyz"é,') for _ in range(r.randint(0, 12))).strip())


@pytest.mark.parametrize("split", ["128m", "500"])
def test_against_a_plain_reader(spark, tmp_path, split):
    """Line ends in quotes, several encodings, header orders; splits of 500 bytes cut many records."""
    r, want = random.Random(4), {}
    for name, code, end, names in (("a", "utf-8", "\n", "xyz"), ("b", "latin-1", "\n", "yzx"), ("c", "utf-8-sig", "\r\n", "xyz")):
        s = io.StringIO(newline="")
        w = csv.writer(s, lineterminator=end)
        w.writerow(names)
        want[name] = []
        for _ in range(200):
            row = [odd_cell(r).replace("�", "?") if code == "latin-1" else odd_cell(r) for _ in names]
            row[0] = row[0] or "q"
            w.writerow(row)
            want[name].append(dict(zip(names, row)))
        (tmp_path / f"{name}.csv").write_bytes(s.getvalue().encode(code))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = records.read(spark, str(tmp_path)).orderBy(*records.POSITION).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, rows in want.items():
        mine = [g for g in got if g._file.endswith(f"{name}.csv")]
        assert [{k: g[k] for k in "xyz"} for g in mine] == [{k: v.strip() for k, v in row.items()} for row in rows]
        assert all(g.malformed_line is None for g in mine)


def test_malformed_blank_and_open_records(spark, tmp_path, monkeypatch):
    p = tmp_path / "a.csv"
    p.write_text('x,y\n1,2\n3\n\n4,5,6\n7,"8\n9,10\n11,12\n')
    got = records.read(spark, str(p)).orderBy(*records.POSITION)
    assert [(r.x, r.y, r.malformed_line) for r in got.collect()][:3] == [("1", "2", None), ("3", "", "3"), ("4", "5", "4,5,6")]
    assert got.count() == 4  # the open quote swallows the rest of its file
    monkeypatch.setattr(records, "RECORD_LINES", 2)
    got = records.read(spark, str(p)).orderBy(*records.POSITION).collect()
    assert [r.malformed_line for r in got] == [None, "3", "4,5,6", '7,"8', "9,10", "11,12"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("")
    assert records.read(spark, str(tmp_path / "none")).count() == 0


RAW = list(batch.RAW_COLUMNS)


def test_raw_transactions_by_header(spark, tmp_path):
    """Doubled quotes shift nothing; swapped columns are read by name; wrong counts have no values."""
    row = dict.fromkeys(RAW, "") | {"KodeTransaksi": "T1", "Tanggal": "31/1/2024", "Jumlah": "12.5", "NamaGroupCustomer": 'PT "MAJU", Tbk', "Kelurahan": "K"}
    swapped = [RAW[1], RAW[0], *RAW[2:]]
    with open(tmp_path / "raw.csv", "w", newline="") as f:
        w = csv.DictWriter(f, swapped)
        w.writeheader()
        w.writerow(row)
        f.write("T2,only,three\n")
    a, b = batch.read_raw_transactions(spark, str(tmp_path / "raw.csv")).orderBy(F.col("invoice_id").isNull()).collect()
    assert (a.invoice_id, str(a.invoice_date), a.amount, a.customer_group, a.subdistrict, a.malformed_line) == (
        "T1", "2024-01-31", 12.5, 'PT "MAJU", Tbk', "K", None)
    assert b.invoice_id is None and b.malformed_line == "T2,only,three"
    (tmp_path / "short.csv").write_text("KodeTransaksi,Jumlah\n1,2\n")
    with pytest.raises(batch.MissingColumns):
        batch.read_raw_transactions(spark, str(tmp_path / "short.csv"))


HEADER = ["order_key", "line_no", "part_key", "supp_key", "jumlah", "kode_customer", "nama_salesman", "nama_divisi", "nama_kategori",
          "nama_sub_kategori", "kode_cabang", "provinsi", "kota", "kecamatan", "nama_group_customer", "keterangan", "tanggal"]


def test_stream_rejects_and_reads_like_uploads(spark, tmp_path):
    cells = ["1", "1", "1", "1", "5", "c", "s", "d", "k", "sk", "b", "p", "ci", "di", "g", "r", "1/2/2024"]
    source = tmp_path / "in"
    source.mkdir()
    with open(source / "a.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(HEADER)
        w.writerow(cells)
        w.writerow([*cells, "extra"])
        w.writerow(cells[:-3])
        w.writerow([*cells[:9], 'PT "MAJU", Tbk', *cells[10:15], "two\nlines", cells[16]])
    with open(source / "b.csv", "w", newline="") as f:  # another order, and no district
        w = csv.DictWriter(f, [h for h in reversed(HEADER) if h != "kecamatan"], extrasaction="ignore")
        w.writeheader()
        w.writerow(dict(zip(HEADER, cells)) | {"order_key": "9"})
    out = scoring.run(spark, str(source), fitted(spark, SMALL), scorecards, "odd", root=str(tmp_path / "root"), watermark="3650 days")
    good = spark.read.parquet(os.path.join(out, "accepted")).collect()
    bad = spark.read.parquet(os.path.join(out, "rejected")).collect()
    assert sorted((r.subcategory, r.remark) for r in good) == sorted([("sk", "r"), ('PT "MAJU", Tbk', "two\nlines")])
    assert all(r.score_a is not None for r in good) and all(r.score_a is None for r in bad)
    assert sorted((r.error, r.malformed_line is None) for r in bad) == [
        ("district is empty", True), ("wrong number of cells", False), ("wrong number of cells", False)]
    assert scoring.final_windows(spark, out).agg(F.sum("n_decisions")).first()[0] == 2
