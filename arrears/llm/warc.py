"""Op 6: WARC archives with a two-level capture index.

Writing: a record per page, each its own gzip member, in files that tasks write to the
shared folder.  Of records with equal payloads of at least ``SHORTEST`` bytes the one with
the smallest page_id is a response, the others are revisits that refer to it.

Index: a line per record - reversed-host URL key, page_id, file, offset, length - sorted by
key over all files and cut into compressed blocks.  Each index file ends with a sparse
directory of its blocks' first lines.  A look-up finds the index file by its first line,
binary-searches the directory, range-reads one block, searches it, and range-reads the record.

Reading back: each page's record is looked up in that way by URL key and page_id, pages being
dealt by ranges of them, so that a task meets a block's lines one after another and reads the
block once; records that lie side by side are fetched with one range read and parsed.  What
is returned comes from the archives.

Cases: null html is an empty payload and null url an empty key; rows that repeat a page_id
are written alike; a null page_id ranks above all others; payloads of any length are
written whole; an empty table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.llm import common

SHORTEST, BLOCK_LINES, LEVEL = 100, 512, 3
FETCH_BYTES, STRIPE_BYTES = 4 << 20, 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PLACES = "key string, page_id long, file string, offset long, size long"


def rank(key: str, page_id: int | None) -> tuple[str, bool, int]:
    """Place of a line in the index's order: null ids come first, as Spark sorts them."""
    return key, page_id is not None, page_id or 0


def url_key(url: str) -> str:
    """Reversed host, port and path: com,example,www)/path?query."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return f"){url}"
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + f"){rest}"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page_id}>"),
              ("WARC-Date", DATE), ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record fields, HTTP fields, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = headers(head)
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, headers(http), payload


def headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def page_of(urn: str) -> int | None:
    value = urn.strip("<>").rpartition(":")[2]
    return None if value == "None" else int(value)


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, first (the response of equal payloads; null for short ones)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
                        F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    groups = common.stage(rows.select("digest", "page_id", (F.octet_length("html") >= SHORTEST).alias("long")).groupBy(
        "digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("long").alias("long")), "payloads")
    return common.attach_groups(rows, groups, "digest", "n").select(
        "page_id", "url", "html", "digest", F.when(F.col("long"), F.col("first")).alias("first"),
        (F.col("long") & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))


def write_archive(pages: DataFrame, uri: str) -> DataFrame:
    """Write the WARC files; returns the records' places, staged."""
    common.small_batches(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name, places = f"pages-{uuid.uuid4().hex}.warc.gz", []

        def body(out) -> None:
            at = 0
            for some in [first], batches:
                for b in some:
                    for r in b.to_pylist():
                        payload = r["html"].encode()
                        raw = gzip.compress(record(r["page_id"], r["url"], payload, hashlib.sha256(payload).hexdigest(),
                                                   r["first"], r["revisit"]), LEVEL, mtime=0)
                        out.write(raw)
                        places.append((url_key(r["url"]), r["page_id"], name, at, len(raw)))
                        at += len(raw)

        common.put_file(f"{uri}/{name}", body)
        for k in range(0, len(places), 10_000):
            yield batch_of(places[k:k + 10_000])

    return common.stage(decided(pages).mapInArrow(write, PLACES), "places")


def batch_of(places: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*places), types)],
                                      names=["key", "page_id", "file", "offset", "size"])


def write_index(places: DataFrame, uri: str) -> DataFrame:
    """Sort the places into index files; returns their manifest, staged: part, file, first key
    and its page_id, lines.  Lines alike in both may go over several files."""
    spark = places.sparkSession
    common.small_batches(spark, 8 * BLOCK_LINES)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        rows = (r for b in batches for r in b.to_pylist())
        name, directory, lines = f"index-{uuid.uuid4().hex}.cdx", [], 0
        head = next(rows, None)
        if head is None:
            return

        def body(out) -> None:
            nonlocal lines
            at, block = 0, [head]

            def flush() -> None:
                nonlocal at, lines
                raw = gzip.compress("\n".join(json.dumps(list(r.values())) for r in block).encode(), LEVEL, mtime=0)
                directory.append((block[0]["key"], block[0]["page_id"], at, len(raw)))
                at += out.write(raw)
                lines += len(block)
                block.clear()

            for r in rows:
                if len(block) == BLOCK_LINES:
                    flush()
                block.append(r)
            flush()
            raw = gzip.compress(json.dumps(directory).encode(), LEVEL, mtime=0)
            out.write(raw + at.to_bytes(8, "little"))

        common.put_file(f"{uri}/{name}", body)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([name]), pa.array([head["key"]]),
             pa.array([head["page_id"]], pa.int64()), pa.array([lines], pa.int64())], names=["part", "file", "first", "first_id", "lines"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "page_id", "file", "offset"]
    ordered = places.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return common.stage(ordered.mapInArrow(write, "part long, file string, first string, first_id long, lines long"), "index-manifest")


class IndexFile:
    """One index file: its sparse directory, and blocks by range reads."""

    def __init__(self, uri: str, file: str) -> None:
        system, path = common.open_fs(uri)
        self.file = system.open_input_file(f"{path}/{file}")
        size = self.file.size()
        at = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.directory = json.loads(gzip.decompress(self.file.read_at(size - 8 - at, at)))
        self.firsts = [rank(key, page_id) for key, page_id, *_ in self.directory]
        self.held: tuple[int, list[list]] = (-1, [])

    def block(self, k: int) -> list[list]:
        """Lines of a block; the last one read is kept."""
        if self.held[0] != k:
            *_, at, size = self.directory[k]
            self.held = k, [json.loads(x) for x in gzip.decompress(self.file.read_at(size, at)).decode().split("\n")]
        return self.held[1]

    def lines(self, key: str, page_id: int | None) -> Iterator[list[list]]:
        """Lines of a page, by blocks: binary search in the directory, then in each block."""
        at = rank(key, page_id)
        k = max(0, bisect.bisect_left(self.firsts, at) - 1)
        while k < len(self.firsts) and self.firsts[k] <= at:
            block = self.block(k)
            first = bisect.bisect_left(block, at, key=lambda x: rank(x[0], x[1]))
            yield block[first:bisect.bisect_right(block, at, first, key=lambda x: rank(x[0], x[1]))]
            k += 1

    def places(self, key: str) -> list[list]:
        """Lines of a key: binary search in the directory, then in blocks."""
        found, k = [], max(0, bisect.bisect_left([d[0] for d in self.directory], key) - 1)
        while k < len(self.directory) and self.directory[k][0] <= key:
            found += [x for x in self.block(k) if x[0] == key]
            k += 1
        return found


def look_up(manifest: DataFrame, uri: str, url: str) -> list[tuple[dict, dict, bytes]]:
    """All records of one URL."""
    key = url_key(url)
    before = manifest.where(F.col("first") < key).orderBy(F.desc("part")).limit(1)  # the last that may begin earlier
    files = [r["file"] for r in before.unionByName(manifest.where(F.col("first") == key)).collect()]
    system, path = common.open_fs(uri)
    out = []
    for _, _, file, at, size in (p for f in files for p in IndexFile(uri, f).places(key)):
        with system.open_input_file(f"{path}/{file}") as f:
            out.append(parse(gzip.decompress(f.read_at(size, at))))
    return out


def find_places(pages: DataFrame, manifest: DataFrame, uri: str) -> DataFrame:
    """The index's lines of all ``pages``, each looked up by its URL's key and page_id.  The
    manifest has at most a row per shuffle partition, which all tasks get."""
    common.small_batches(pages.sparkSession)
    files = manifest.orderBy("part").collect()
    firsts, names = [rank(r["first"], r["first_id"]) for r in files], [r["file"] for r in files]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column("url").to_pylist()], pa.string()), b.column("page_id")],
                                             names=["key", "page_id"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index, found = -1, None, []
        for b in batches:
            for key, page_id in zip(b.column("key").to_pylist(), b.column("page_id").to_pylist()):
                place = rank(key, page_id)
                for k in range(max(0, bisect.bisect_left(firsts, place) - 1), bisect.bisect_right(firsts, place)):
                    if k != at:
                        at, index = k, IndexFile(uri, names[k])
                    for lines in index.lines(key, page_id):
                        found += map(tuple, lines)
                        if len(found) >= BLOCK_LINES:
                            yield batch_of(found)
                            found = []
        if found:
            yield batch_of(found)

    wanted = pages.select(F.coalesce("url", F.lit("")).alias("url"), F.col("page_id").cast("long").alias("page_id"))
    wanted = wanted.mapInArrow(keys, "key string, page_id long").distinct()
    return wanted.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(find, PLACES)


def read_records(places: DataFrame, uri: str) -> DataFrame:
    """Per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    common.small_batches(places.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = common.open_fs(uri)
        name, file = None, None
        for b in batches:
            rows, out = b.to_pylist(), []
            at = 0
            while at < len(rows):
                to = at + 1  # records side by side
                while (to < len(rows) and rows[to]["file"] == rows[at]["file"]
                       and rows[to]["offset"] == rows[to - 1]["offset"] + rows[to - 1]["size"]
                       and rows[to]["offset"] + rows[to]["size"] - rows[at]["offset"] <= FETCH_BYTES):
                    to += 1
                if rows[at]["file"] != name:
                    if file is not None:
                        file.close()
                    name, file = rows[at]["file"], system.open_input_file(f"{path}/{rows[at]['file']}")
                start = rows[at]["offset"]
                raw = file.read_at(rows[to - 1]["offset"] + rows[to - 1]["size"] - start, start)
                for r in rows[at:to]:
                    fields, http, payload = parse(zlib.decompress(raw[r["offset"] - start:r["offset"] - start + r["size"]], 31))
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    if fields["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{name} at {r['offset']}: payload differs from its digest")
                    to_page = fields.get("warc-refers-to")
                    out.append((page_of(fields["warc-record-id"]), int(http["content-length"]), digest,
                                fields["warc-type"], page_of(to_page) if to_page else None))
                at = to
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    stripe = F.floor(F.col("offset") / STRIPE_BYTES)
    return places.repartition("file", stripe).sortWithinPartitions("file", "offset").mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    uri = common.shared_path(spark, "archive")
    places = write_archive(pages, uri)
    manifest = write_index(places, uri)
    common.drop(places)
    return read_records(find_places(pages, manifest, uri), uri)


SQL = f"""
SELECT page_id, octet_length(encode(h)) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM f AND octet_length(encode(h)) >= {SHORTEST} THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM f AND octet_length(encode(h)) >= {SHORTEST} THEN f END AS refers_to
FROM (SELECT page_id, h, d, min(page_id) OVER (PARTITION BY d) AS f
      FROM (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d FROM pages))
"""
