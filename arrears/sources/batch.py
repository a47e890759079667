"""Batch upload path.

A CSV of raw invoices -> canonical columns -> coerced amount -> per-row
validation with a reject reason.  Everything is a column expression over
the records of ``sources.records``; the header check (U3) is a set difference on
``df.columns`` done before any job runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrears import constants as K
from arrears.sources import records

# FIXED VALUES: accepted upload headers (the reference's snake_case and
# PascalCase names) and the canonical column each one maps to.
HEADER_MAP = {
    "jumlah": "amount", "kode_customer": "customer", "nama_salesman": "salesperson",
    "nama_divisi": "division", "nama_kategori": "category", "nama_sub_kategori": "subcategory",
    "kode_cabang": "branch", "provinsi": "province", "kota": "city", "kecamatan": "district",
    "nama_group_customer": "customer_group", "keterangan": "remark",
    "Jumlah": "amount", "KodeCustomer": "customer", "NamaSalesman": "salesperson",
    "NamaDivisi": "division", "NamaKategori": "category", "NamaSubKategori": "subcategory",
    "KodeCabang": "branch", "Provinsi": "province", "Kota": "city", "Kecamatan": "district",
    "NamaGroupCustomer": "customer_group", "Keterangan": "remark",
}
REQUIRED = ["amount", "customer", "salesperson", "division", "category", "subcategory",
            "branch", "province", "city", "district"]
OPTIONAL_DEFAULTS = {"customer_group": K.NON_GROUP, "remark": K.NO_REMARK}
STRING_FIELDS = [c for c in REQUIRED if c != "amount"]
UPLOAD_HEADER = {v: k for k, v in HEADER_MAP.items() if k[0].islower()}   # canonical -> snake_case


class MissingColumns(ValueError):
    pass


MALFORMED = records.MALFORMED


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """Uploads by their headers, with ``malformed_line`` and the records' positions
    (see ``records``); rows with too few or too many cells are rejected by ``validate``."""
    return canonical(records.read(spark, path))


def canonical(df: DataFrame, fill: bool = False) -> DataFrame:
    """P7 + U3 + P8 + P10: alias headers (BOM and blanks stripped), keep
    unknown ones, fail fast listing missing required columns, add literal
    defaults for *absent* optional columns only.  ``fill`` adds absent required columns as
    empty text instead, which ``validate`` rejects row by row."""
    ren = {}
    for c in df.columns:
        s = c.replace("\ufeff", "").strip()
        ren[c] = HEADER_MAP.get(s, s)
    df = df.withColumnsRenamed(ren)
    missing = sorted(set(REQUIRED) - set(df.columns))
    if missing and fill:
        df = df.withColumns({c: F.lit("") for c in missing})
    elif missing:
        raise MissingColumns(f"missing required columns: {missing}; available: {sorted(df.columns)}")
    for c, v in OPTIONAL_DEFAULTS.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(v))
    strings = [c for c in STRING_FIELDS + list(OPTIONAL_DEFAULTS)]
    return df.select(*[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) if c in strings
                       else F.col(c) for c in df.columns])


def parse_amount(text: Column) -> Column:
    """Strip thousands commas, parse; anything unparseable -> 0.0.
    Java-only forms (``1.0f``, ``12d``) are rejected like Python's float()."""
    t = F.trim(F.regexp_replace(text.cast("string"), ",", ""))
    java_suffix = t.rlike("[dDfF]$") & ~t.rlike("(?i)inf(inity)?$")
    return F.coalesce(F.when(~java_suffix, t.try_cast("double")), F.lit(0.0))


def coerce(df: DataFrame) -> DataFrame:
    return df.withColumn("amount_text", F.col("amount").cast("string")) \
             .withColumn("amount", parse_amount(F.col("amount")))


def validate(df: DataFrame, strict: bool = True) -> DataFrame:
    """``error`` is null for a valid row, else the first reason.
    ``strict`` applies the single-request rules (amount > 0, required text
    non-empty) to batches; lenient mode only rejects non-finite amounts."""
    amount = F.col("amount")
    nonfinite = F.isnan(amount) | (F.abs(amount) == F.lit(float("inf")))
    checks = [(F.col(MALFORMED).isNotNull(), "wrong number of cells")] if MALFORMED in df.columns else []
    checks.append((nonfinite, "amount is not a finite number"))
    if strict:
        checks.append((amount <= 0, "amount must be > 0"))
        checks += [(F.length(F.col(c)) == 0, f"{c} is empty") for c in STRING_FIELDS]
    err = F.lit(None).cast("string")
    for cond, msg in reversed(checks):
        err = F.when(cond, F.lit(msg)).otherwise(err)
    return df.withColumn("error", err)


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """0-based position in file order: the place within the file's split plus the row
    counts of the splits before (one small row per split)."""
    if "_file" not in df.columns:  # rows that come from no file: their partitions' order
        at = F.monotonically_increasing_id()
        df = df.withColumns({"_file": F.lit(""), "_split": F.shiftright(at, 33), "_line": at})
    own = Window.partitionBy("_file", "_split").orderBy("_line")
    sizes = df.groupBy("_file", "_split").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_split")) - F.col("_n")
    offsets = sizes.select("_file", "_split", before.alias("_before"))
    return df.withColumn("_at", F.row_number().over(own) - 1).join(offsets, ["_file", "_split"]).withColumn(
        name, F.col("_before") + F.col("_at")).drop("_at", "_before", *records.POSITION)


def input_summary(df: DataFrame) -> DataFrame:
    """The six-column echo of an input row."""
    return df.select(F.col("amount").alias("jumlah"), F.col("customer").alias("kode_customer"),
                     F.col("salesperson").alias("nama_salesman"), F.col("division").alias("nama_divisi"),
                     F.col("category").alias("nama_kategori"), F.col("branch").alias("kode_cabang"))


# FIXED VALUES: the reference's raw transaction columns and our names for them.
RAW_COLUMNS = {
    "KodeTransaksi": "invoice_id", "Tanggal": "invoice_date", "Umur": "age_days", "Jumlah": "amount",
    "Sisa": "balance", "KodeCustomer": "customer", "NamaGroupCustomer": "customer_group",
    "NamaSalesman": "salesperson", "NamaDivisi": "division", "NamaKategori": "category",
    "NamaSubKategori": "subcategory", "KodeCabang": "branch", "Provinsi": "province", "Kota": "city",
    "Kecamatan": "district", "Kelurahan": "subdistrict", "Keterangan": "remark",
}


def read_raw_transactions(spark: SparkSession, path: str) -> DataFrame:
    """S1 + P1: raw invoice files by their headers, every cell a string first (nothing is
    inferred); day-first dates parsed, numbers cast with ``try_cast`` (bad -> null).
    Records with a wrong number of cells keep their text in ``malformed_line`` and have no
    values, so nothing is shifted into another column."""
    from arrears.operators.clean import parse_day_first
    raw = records.read(spark, path)
    missing = sorted(set(RAW_COLUMNS) - set(raw.columns))
    if missing:
        raise MissingColumns(f"missing raw columns: {missing}; available: {sorted(raw.columns)}")
    whole = F.col(MALFORMED).isNull()
    df = raw.select(*[F.when(whole & (F.col(c) != ""), F.col(c)).alias(n) for c, n in RAW_COLUMNS.items()], MALFORMED)
    return df.withColumn("invoice_date", parse_day_first("invoice_date")) \
             .withColumn("age_days", F.col("age_days").try_cast("int")) \
             .withColumn("amount", F.col("amount").try_cast("double")) \
             .withColumn("balance", F.col("balance").try_cast("double"))
