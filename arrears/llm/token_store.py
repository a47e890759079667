"""Op 8: token ids as compressed binary files with per-document access.

A store is a folder: ``dictionary.zstd``, one zstandard dictionary trained on serialized id
arrays of a bounded sample, and files of documents in ascending doc_id order.  Every
document is compressed by itself with the shared dictionary, so a short document neither
pays for a window of its own nor makes a reader decompress its neighbours.

File layout (little-endian): magic ``TKST``, SHA-256 of the dictionary, the documents'
frames, the index (four int64 columns: doc_id, frame offset, id count, ids before it in the
file), then index offset, document count and id count as int64.  A frame holds ids as 2 or 4
bytes each, whichever the vocabulary needs (its first byte says which).  A null doc_id is
stored as the smallest int64.

Cases: null text counts as empty (just the end id); repeated doc_ids are stored side by
side, each with its own entry; an empty table gives a store without files and an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrears.llm import common
from arrears.llm.tokens import ByteBpe, coder, grouped

MAGIC = b"TKST"
NO_ID = -(1 << 63)
#: Documents and bytes of each that the dictionary is trained on at most.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1024, 16_384, 112_640
ROWS_PER_FILE = 50_000
LEVEL = 1


def pack(ids: np.ndarray) -> bytes:
    """Serialized id array: width byte, then the ids."""
    if not len(ids) or int(ids.max()) < 1 << 16:
        return b"\x02" + ids.astype("<u2").tobytes()
    return b"\x04" + ids.astype("<u4").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[:1] == b"\x02" else "<u4", offset=1).astype("<u4")


def sample(docs: DataFrame, total: int) -> DataFrame:
    """About SAMPLE_DOCS of ``total`` documents, at most twice as many, drawn by a hash of doc_id
    over the whole table."""
    share = min(1.0, SAMPLE_DOCS / max(1, total))
    return docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (1 << 20) * share).limit(2 * SAMPLE_DOCS)


def train_dictionary(docs: DataFrame, tokenizer: str, total: int) -> bytes:
    """A dictionary from a bounded sample of the ``total`` documents; empty when there is too
    little text (frames are then plain zstandard)."""
    common.small_batches(docs.sparkSession)

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ByteBpe, tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([pack(np.frombuffer(x, "<u4"))[:SAMPLE_BYTES] for x in c.encode_all(b.column("text"))],
                          pa.binary())], names=["raw"])

    some = sample(docs, total).select("text")
    samples = [bytes(r.raw) for r in some.mapInArrow(serialized, "raw binary").collect()]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 10)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if size >= 1024 else b""
    except zstandard.ZstdError:  # too few or too equal samples
        return b""


def write_store(docs: DataFrame, uri: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encode ``docs`` (doc_id, text), append ``end_id`` to each, write the store below
    ``uri``; returns the manifest, staged: part, file, n_docs, n_tokens."""
    spark = docs.sparkSession
    total = docs.count()
    dictionary = train_dictionary(docs, tokenizer, total)
    common.put_file(f"{uri}/dictionary.zstd", lambda out: out.write(dictionary))
    files = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")),
                -(-total // ROWS_PER_FILE))
    common.small_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        c, end = coder(ByteBpe, tokenizer), array("I", [end_id]).tobytes()
        press = zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        batches = grouped(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part, name = TaskContext.get().partitionId(), f"ids-{uuid.uuid4().hex}.tkst"
        ids, offsets, counts = array("q"), array("q"), array("q")

        def body(out) -> None:
            at = out.write(MAGIC + hashlib.sha256(dictionary).digest())
            for b in [first], batches:
                for batch in b:
                    for doc, found in zip(batch.column("doc_id").to_pylist(), c.encode_all(batch.column("text"))):
                        tokens = np.frombuffer(found + end, "<u4")
                        ids.append(NO_ID if doc is None else doc)
                        offsets.append(at)
                        counts.append(len(tokens))
                        at += out.write(press.compress(pack(tokens)))
            n = np.frombuffer(counts, "<i8")
            for column in (ids, offsets, counts, np.cumsum(n) - n):
                out.write(np.asarray(column, "<i8").tobytes())
            out.write(np.array([at, len(ids), n.sum()], "<i8").tobytes())

        common.put_file(f"{uri}/{name}", body)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([name]), pa.array([len(ids)], pa.int64()),
             pa.array([sum(counts)], pa.int64())], names=["part", "file", "n_docs", "n_tokens"])

    ordered = docs.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    return common.stage(ordered.mapInArrow(write, "part long, file string, n_docs long, n_tokens long"), "manifest")


class StoreFile:
    """One open file of a store: its index, and documents by position or id."""

    def __init__(self, uri: str, file: str) -> None:
        system, path = common.open_fs(uri)
        with system.open_input_file(f"{path}/dictionary.zstd") as f:
            dictionary = f.read()
        self.file = system.open_input_file(f"{path}/{file}")
        size = self.file.size()
        if self.file.read_at(36, 0) != MAGIC + hashlib.sha256(dictionary).digest():
            raise ValueError(f"{file}: not written with this store's dictionary")
        self.end, n, self.n_tokens = np.frombuffer(self.file.read_at(24, size - 24), "<i8")
        self.index = np.frombuffer(self.file.read_at(int(32 * n), int(self.end)), "<i8").reshape(4, int(n))
        self.open = zstandard.ZstdDecompressor(
            dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def frames(self, block: int = 1 << 23) -> Iterator[bytes]:
        """Frames in order, read about ``block`` bytes at a time."""
        edges = np.append(self.index[1], self.end)
        at = 0
        while at < len(edges) - 1:
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + block, "right")) - 1)
            raw = self.file.read_at(int(edges[to] - edges[at]), int(edges[at]))
            for k in range(at, to):
                yield raw[edges[k] - edges[at]:edges[k + 1] - edges[at]]
            at = to

    def ids(self, frame: bytes) -> np.ndarray:
        return unpack(self.open.decompress(frame))

    def document(self, doc_id: int) -> np.ndarray | None:
        """Ids of one document by binary search and one range read."""
        k = int(np.searchsorted(self.index[0], doc_id))
        if k == self.index.shape[1] or self.index[0, k] != doc_id:
            return None
        edges = np.append(self.index[1], self.end)
        return self.ids(self.file.read_at(int(edges[k + 1] - edges[k]), int(edges[k])))


def read_store(manifest: DataFrame, uri: str) -> DataFrame:
    """Per document of the store, read from its files: doc_id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    # one row per file, thousands of documents each
    based = manifest.withColumn("base", F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens"))
    common.small_batches(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                store = StoreFile(uri, file)
                sums = [zlib.crc32(store.ids(f).tobytes()) for f in store.frames()]
                ids, _, counts, before = store.index
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(before + base), pa.array(counts),
                     pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))
    return based.select("file", "base").repartition(spread).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    uri = common.shared_path(spark, "token-store")
    return read_store(write_store(common.documents(docs), uri, tokenizer, end_id), uri)
