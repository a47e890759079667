"""CSV files as records (S1, S2, R1): one reader for raw, uploaded and streamed files.

Lines are read in splits, raw, and become records by the parity of their quotes:

1. One pass notes for each file whether some line has an odd number of quotes.  In files
   without one a line is a record, and nothing more is shuffled.
2. In the others odd lines are counted, within each split and by prefix sums over a file's
   splits (one small row a split).  An even line after an even number of them is a record.
3. The other lines, those of records with line ends in quotes, are put together.

So a quoted cell may hold line ends, a file may have any size, and no task reads one whole.
Each file's bytes are UTF-8, or Latin-1 if some line of it is no valid UTF-8.  Each file's own
header, its first line, names its cells, in whatever order.

A record whose number of cells differs from its file's header keeps its text in
``malformed_line``.  A quote that is never closed would swallow the rest of its file, so the
lines of a record of over ``RECORD_LINES`` lines stay single records and are all malformed.
Blank records are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrears.session import cut_lineage

#: Holds the text of a record whose number of cells differs from the header's.
MALFORMED = "malformed_line"
#: Where a record begins: file, split and line.  Kept until rows are numbered or written.
POSITION = ["_file", "_split", "_line"]
RECORD_LINES = 10_000
#: Cells are trimmed, a doubled quote stands for one, empty cells are empty strings.
OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
           "nullValue": "\u0000", "emptyValue": "", "mode": "PERMISSIVE", "multiLine": "true", "maxCharsPerColumn": "-1"}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with their position: value (bytes as they are), _file, _split, _line."""
    return placed(_text(spark.read, path))


def streamed_lines(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """The same as a stream; ``placed`` completes each micro-batch (whole files)."""
    return _text(spark.readStream.option("maxFilesPerTrigger", max_files), path)


def _text(reader, path: str) -> DataFrame:
    return reader.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"))


def placed(raw: DataFrame) -> DataFrame:
    return raw.withColumn("_line", F.monotonically_increasing_id())


def _odd() -> Column:
    return F.regexp_count("value", F.lit('"')) % 2


def files_of(raw: DataFrame) -> DataFrame:
    """One staged row per file, from one pass: first (its first line), header, whether some
    line is odd, and whether some line is no UTF-8."""
    splits = raw.groupBy("_file", "_split").agg(
        F.min("_line").alias("first"), F.min_by("value", "_line").alias("header"), F.max(_odd()).alias("odd"),
        F.max((~F.is_valid_utf8("value")).cast("int")).alias("latin"))
    files = splits.groupBy("_file").agg(
        F.min_by("first", "_split").alias("first"), F.min_by("header", "_split").alias("header"),
        F.max("odd").alias("odd"), F.max("latin").alias("latin"))
    return cut_lineage(files.withColumn("header", _decoded("header")))


def _decoded(column: str) -> Column:
    text = F.when(F.col("latin") == 1, F.decode(F.col(column).cast("binary"), "ISO-8859-1")).otherwise(F.col(column))
    return F.regexp_replace(text, "\r$", "")


def _joined(raw: DataFrame) -> DataFrame:
    """Records of files with odd lines, ``text`` in place of ``value``.  A line is within a
    record that began before it if the number of odd lines before it is odd."""
    above = Window.partitionBy("_file", "_split").orderBy("_line").rowsBetween(Window.unboundedPreceding, -1)
    marked = raw.withColumn("odd", _odd()).withColumn("before", F.coalesce(F.sum("odd").over(above), F.lit(0)))
    earlier = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("_file", "_split").agg(F.sum(_odd()).alias("quotes")).select(
        "_file", "_split", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)).alias("quotes"))
    known = marked.join(splits, ["_file", "_split"]).withColumn("before", F.col("before") + F.col("quotes"))
    alone = (F.col("before") % 2 == 0) & (F.col("odd") == 0)
    single = known.where(alone).select(*POSITION, F.col("value").alias("text"), F.lit(False).alias("open"))
    parts = known.where(~alone).select(*POSITION, "value", F.expr("before div 2").alias("record"))
    parts = parts.join(parts.groupBy("_file", "record").agg(F.count(F.lit(1)).alias("n")), ["_file", "record"])
    long = F.col("n") > RECORD_LINES
    whole = parts.where(~long).groupBy("_file", "record").agg(
        F.sort_array(F.collect_list(F.struct("_split", "_line", "value"))).alias("all")).select(
        "_file", F.col("all")[0]["_split"].alias("_split"), F.col("all")[0]["_line"].alias("_line"),
        F.array_join(F.transform("all", lambda x: x["value"]), "\n").alias("text"), F.lit(False).alias("open"))
    apart = parts.where(long).select(*POSITION, F.col("value").alias("text"), F.lit(True).alias("open"))
    return single.unionByName(whole).unionByName(apart)


def records(raw: DataFrame, files: DataFrame) -> DataFrame:
    """Records of raw lines, header lines left out: ``POSITION``, text, open, header."""
    body = raw.join(files, "_file").where("_line > first")
    every = body.where("odd = 0").select(*POSITION, F.col("value").alias("text"), F.lit(False).alias("open"), "header", "latin")
    if not files.where("odd = 1").isEmpty():
        broken = _joined(body.where("odd = 1").select(*POSITION, "value")).join(files.select("_file", "header", "latin"), "_file")
        every = every.unionByName(broken)
    return every.select(*POSITION, _decoded("text").alias("text"), "open", "header")


def cells(text: Column, names: list[str]) -> Column:
    schema = ", ".join(f"c{i} string" for i in range(len(names))) + f", `{MALFORMED}` string"
    return F.from_csv(text, schema, OPTIONS | {"columnNameOfCorruptRecord": MALFORMED})


def header_names(line: str) -> list[str]:
    """The cells of a header, without byte order mark and blanks."""
    import csv
    import io
    return [c.replace("﻿", "").strip() for c in next(csv.reader(io.StringIO(line)), [])]


def table(raw: DataFrame) -> DataFrame:
    """The cells of raw lines under their files' headers, ``malformed_line`` and ``POSITION``.

    Files with different headers are read each by its own; a column that a file lacks is
    null there.  The different header lines (not files) come to the driver."""
    files = files_of(raw)
    different = sorted(r["header"] for r in files.select("header").distinct().collect())
    body = records(raw, files).where("trim(text) <> ''")
    out = None
    for line in different:
        names = header_names(line)
        own = body if len(different) == 1 else body.where(F.col("header") == F.lit(line))
        # a generator: conditions on cells stay above it, so a record is parsed once, not once per cell that they read
        parsed = own.select(*POSITION, "text", "open", F.inline(F.array(cells(F.col("text"), names))))
        bad = F.when(F.col("open") | F.col(MALFORMED).isNotNull(), F.col("text"))
        first = {n: i for i, n in reversed(list(enumerate(names)))}  # of equal names the first counts
        part = parsed.select(*POSITION, *[F.coalesce(F.col(f"c{i}"), F.lit("")).alias(n) for n, i in first.items() if n], bad.alias(MALFORMED))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        out = body.select(*POSITION, F.col("text").alias(MALFORMED))
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    return table(lines(spark, path))
