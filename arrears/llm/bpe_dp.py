"""Op 1: BPE encoding by dynamic programming over prefixes, and decoding.

BPE's result for a text has a property that allows a left-to-right program: every prefix of
the text has exactly one last token with which its own BPE encoding ends.  For each prefix
the candidates are the vocabulary's tokens that are suffixes of it (found for all prefixes
in one run of an automaton); the right one is the candidate whose start is a prefix that
ends in a token with which it is *compatible*: merging would not have joined anything
across the boundary of the two.  The last tokens are stored, and following them back from
the end gives the exact ids.  Time is linear in the text's length times the longest token.

The merge order enters only in the compatibility test of a pair of tokens, which undoes
their merges from the last one on and looks for an earlier merge across the boundary.

Cases: null texts count as empty (no tokens); the special token's own text becomes its id;
texts of any length are handled whole; rows are independent, so repeated rows and ties need
no rule; empty tables give empty results.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from arrears.llm import common
from arrears.llm.tokens import Recent, as_u32, byte_pieces, byte_symbols, spaced

#: The byte-level pretoken pattern that the vocabulary's public tokenizer uses.  Fixed value.
PATTERN = (r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


class PrefixBpe:
    """Encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, path: str, cap: int = 300_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbols = byte_symbols()
        self.shown = {ord(chr(b)): s for b, s in enumerate(symbols)}  # latin-1 char -> symbol
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.bytes_of = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items() if all(c in byte_of for c in s)}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        # a merge's rank orders merges; a token's parts undo its merge
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(merges):
            left, right = m if isinstance(m, list) else m.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = r
            self.parts.setdefault(c, (a, b, r))
        self.matches = ahocorasick.Automaton()
        for s, i in vocab.items():
            if i in self.parts or len(s) == 1:
                self.matches.add_word(s, (len(s), i))
        self.matches.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.splitter = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        self.words = Recent(self._word, cap)
        self.pieces = Recent(lambda piece: self._piece(spaced(piece)), cap)

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves the boundary between these two neighbours as it is.

        Run both tokens' merges backwards, always undoing the later one; the pair of
        tokens that then touch at the boundary was there while merges ranked below the one
        just undone ran (at equal rank the left occurrence goes first).  A merge of that
        pair would have come before it: the boundary would be gone."""
        key = (left, right)
        known = self.fits.get(key)
        if known is not None:
            return known
        rank, parts = self.rank, self.parts
        a, b = left, right
        before = 1 << 60
        while True:
            across = rank.get((a, b))
            if across is not None and across < before:
                ok = False
                break
            ra = parts[a][2] if a in parts else -1
            rb = parts[b][2] if b in parts else -1
            if ra < 0 and rb < 0:
                ok = True
                break
            if ra > rb:  # undo the left token's last merge: it is done at rank ra, left of the boundary
                before, a = ra, parts[a][1]
            else:  # a merge of equal rank across the boundary is further left and goes first
                before, b = rb + 1, parts[b][0]
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def _word(self, word: str) -> bytes:
        """Ids of one pretoken."""
        shown = word.encode().decode("latin-1").translate(self.shown)
        n = len(shown)
        last = [-1] * (n + 1)  # of each prefix: the unique last token
        back = [0] * (n + 1)  # and where it starts
        fits, compatible = self.fits, self.compatible
        for end, (size, token) in self.matches.iter(shown):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                prior = last[start]
                ok = fits.get((prior, token))
                if ok is None:
                    ok = compatible(prior, token)
                if not ok:
                    continue
            last[end], back[end] = token, start
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        return as_u32(ids)

    def _segment(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.splitter.findall(text)))

    def _piece(self, text: str) -> bytes:
        if self.cut is None or not self.cut.search(text):
            return self._segment(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._segment(text[at:m.start()]), as_u32([self.special[m[0]]])]
            at = m.end()
        return b"".join([*out, self._segment(text[at:])])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        first, *rest = byte_pieces(text)
        return self._piece(first) + b"".join(map(self.pieces.__getitem__, rest))

    def decode(self, ids: bytes) -> str:
        """Text of ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")


_CODERS: dict[str, PrefixBpe] = {}


def coder(path: str) -> PrefixBpe:
    if path not in _CODERS:
        _CODERS[path] = PrefixBpe(path)
    return _CODERS[path]


def encode_texts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded``
    (string) in place of ``text``; no shuffle, one pass."""
    keep = [c for c in docs.columns if c != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text),
                        "ids binary", "decoded string"])
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            ids = [c.encode(x or "") for x in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in keep), pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.string())],
                names=[*keep, "ids", "decoded"])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of its ids and of its decoded text."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            counts, id_hash, text_hash = [], [], []
            for x in b.column("text").to_pylist():
                ids = c.encode(x)
                counts.append(len(ids) // 4)
                id_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_hash), pa.array(text_hash)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.documents(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
