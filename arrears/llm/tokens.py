"""Token ids of whole texts through the installed tokenizers library, which is asked for each
distinct piece of text once, and for all that a group of texts brings anew in one call.

Both vocabularies cut a text at places that depend on the neighbouring characters only, so
the ids of a text are the ids of its pieces, one after the other:

* ``byte_bpe``: a space with a non-space on both sides always starts a pretoken, and a line
  end with a non-space on both sides is one, so they cut the text (a text with a longer run
  of white space is cut at such spaces only);
* ``word_bpe``: white space is dropped, so every run of ASCII white space cuts it.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from arrears.llm import common

#: White space as Unicode defines it (Python's \s also takes U+001C to U+001F).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CUT = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
#: White space beside white space.
WIDE = f"[{SPACE}][{SPACE}]"
#: Letters and a run of marks; and letters that have no composed form to seek and one
#: lower-case letter each.
PARTS = re.compile(r"([^\W\d_]+)([^\w\s']*)")
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]"
SIMPLE = re.compile(f"({LETTERS}+)([!-&(-/:-@\\[-`{{-~]*)")

#: ASCII marks that are one pretoken, however many follow a word (an apostrophe may begin another).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"
#: Bytes of the texts whose pieces are looked up together; words and odd pieces of a generation.
GROUP_BYTES, WORDS, ODD_PIECES = 1 << 22, 225_000, 50_000


class Recent(dict):
    """A dict that computes what it lacks and holds two generations of at most ``cap``
    entries, so frequent pieces stay and memory is bounded whatever the corpus holds."""

    def __init__(self, compute: Callable, cap: int = 300_000) -> None:
        super().__init__()
        self.compute, self.cap, self.older = compute, cap, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.cap:
            self.older = {}  # gone before the copy is made
            self.older = dict(self)
            self.clear()
        self[key] = value


def load(path: str):
    """The tokenizer of a file, without padding and truncation."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


def as_u32(ids) -> bytes:
    return array("I", ids).tobytes()


def byte_pieces(text: str) -> list[str]:
    """The text cut before each lone space and line end; see ``spaced`` for the pieces after
    the first."""
    if re.search(WIDE, text):
        return CUT.split(text)
    return text.replace("\n", " \n").split(" ")


def spaced(piece: str) -> str:
    """What a piece stands for: with its space, unless it begins with a line end."""
    return piece if piece[:1] == "\n" else " " + piece


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in these vocabularies: printable
    Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def laid(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The entries ``codes`` of a table, one after the other; ``sizes`` are the entries' lengths."""
    many = sizes[codes]
    stops = np.cumsum(many)
    return ids[np.repeat((np.cumsum(sizes) - sizes)[codes] - (stops - many), many) + np.arange(many.sum())]


def rest(strings: pa.Array, heads: pa.Array) -> pa.Array:
    """What follows the head of each of these large strings."""
    sizes = (pc.binary_length(strings).to_numpy() - pc.binary_length(heads).to_numpy()).astype(np.int64)
    _, offsets, data = strings.buffers()
    if data is None or not sizes.any():
        return pa.array([""] * len(strings), strings.type)
    ends = np.frombuffer(offsets, np.int64)[strings.offset + 1:strings.offset + 1 + len(strings)]
    stops = np.cumsum(sizes)
    raw = np.frombuffer(data, np.uint8)[np.repeat(ends - stops, sizes) + np.arange(sizes.sum())]
    return pa.LargeStringArray.from_buffers(len(strings), pa.py_buffer(np.append(0, stops)), pa.py_buffer(raw))


def numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each value's number, and the distinct values."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


class Coder:
    """A tokenizer, and its model alone for pieces that are one pretoken as they stand: the
    library then need neither normalise nor cut them.  ``encode(text)`` and ``encode_all(texts)``
    give ids as little-endian unsigned 32-bit integers.

    Of a group's distinct pieces those of letters and a run of ASCII marks after them are taken
    apart by Arrow; words, odd pieces and runs of marks are remembered, each by itself."""

    PLAIN: str  # words that are one pretoken
    LEAD: str  # what it begins with, but in a text's or a line's first word

    def __init__(self, path: str) -> None:
        self.tok = load(path)
        self.model = type(self.tok)(self.tok.model)
        self.symbols = dict(enumerate(byte_symbols()))
        self.line = self.shown("\n")
        self.at_edge = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
        self.at_edge[[k for token, k in self.tok.get_vocab().items() if self.edge(token)]] = True
        self.words = Recent(self.pretoken, WORDS)
        self.cache = Recent(self.piece, ODD_PIECES)
        self.marks = Recent(self.whole, 10_000)

    def whole(self, text: str) -> bytes:
        return as_u32(self.tok.encode(text, add_special_tokens=False).ids)

    def shown(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.symbols)

    def pretoken(self, text: str) -> bytes:
        return as_u32(self.model.encode(self.shown(text), add_special_tokens=False).ids)

    def known(self, words: list[str]) -> list[bytes]:
        """The ids of each word; the new ones among them go to the library in one call."""
        out, older = list(map(self.words.get, words)), self.words.older
        lacking = [k for k, ids in enumerate(out) if ids is None]
        new = []
        for k in lacking:
            out[k] = older.get(words[k])
            if out[k] is None and words[k].startswith(self.LEAD):
                new.append(k)
        if new:
            shown = self.shown("\n".join([words[k] for k in new])).split(self.line)
            ids = np.array(self.model.encode_batch_fast([shown], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            bounds = (4 * self.bounds(ids)).tolist()  # the call does not tell the words apart
            if len(bounds) == len(new) + 1:
                raw = ids.tobytes()
                for k, a, b in zip(new, bounds, bounds[1:]):
                    out[k] = raw[a:b]
        for k in lacking:
            if out[k] is None:
                out[k] = self.pretoken(words[k])
            self.words.put(words[k], out[k])
        return out

    def encode_all(self, texts: pa.Array | list[str]) -> Iterator[bytes]:
        """The ids of each text, groups of about ``GROUP_BYTES`` at a time."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        texts = texts.cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP_BYTES, "right")))
            yield from self.group(texts.slice(at, to - at))
            at = to

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def group(self, texts: pa.Array) -> Iterator[bytes]:
        cut = self.cut(texts)
        edges = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        codes, pieces = numbered(cut.flatten())
        opens = 0
        if self.LEAD:  # the first pieces become entries of their own
            opens, codes = len(texts), codes.copy()
            pieces = pa.concat_arrays([pieces, pieces.take(pa.array(codes[edges[:-1]]))])
            codes[edges[:-1]] = len(pieces) - opens + np.arange(opens)
        ids, sizes = self.table(pieces, opens)
        stops = np.append(0, np.cumsum(sizes[codes]))[edges]
        raw = laid(ids, sizes, codes).tobytes()
        bounds = (4 * stops).tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield raw[a:b]

    def table(self, pieces: pa.Array, opens: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after the other, and how many each has; the last ``opens``
        pieces begin a text."""
        first = np.arange(len(pieces)) >= len(pieces) - opens
        line, body = self.lines(pieces, first)
        head = pc.ascii_rtrim(body, MARKS)
        plain = pc.match_substring_regex(head, self.PLAIN).to_numpy(zero_copy_only=False)
        at, odd = np.flatnonzero(plain), np.flatnonzero(~plain)
        word, words = numbered(self.spelt(head.take(pa.array(at)), (line | first)[at]))
        tail, tails = numbered(rest(body.take(pa.array(at)), head.take(pa.array(at))))
        words, tails = words.to_pylist(), tails.to_pylist()
        others = pieces.take(pa.array(odd)).to_pylist()
        found = [b"", self.marks["\n"], *self.known(words), *(self.marks[t] if t else b"" for t in tails),
                 *(self.opening(p) if first[k] else self.cache[p] for p, k in zip(others, odd))]
        parts = np.zeros((len(pieces), 3), np.int64)  # of each piece: line end, word or odd piece, marks
        parts[line & plain, 0] = 1
        parts[at, 1] = 2 + word
        parts[at, 2] = 2 + len(words) + tail
        parts[odd, 1] = 2 + len(words) + len(tails) + np.arange(len(odd))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return laid(np.frombuffer(b"".join(found), "<u4"), sizes, parts.ravel()), sizes[parts].sum(1)


class ByteBpe(Coder):
    """A line end, the letters after it and the run of marks after those are pretokens; any
    other piece goes to the library."""

    PLAIN = r"^\p{L}+$"
    LEAD = " "

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.bare = Recent(self.pretoken, 10_000)

    def piece(self, piece: str) -> bytes:
        if piece.isalpha():
            return self.words[" " + piece]
        line = piece[:1] == "\n"
        found = PARTS.fullmatch(piece, line)
        if found is None or not found[1].isalpha():
            return self.whole(spaced(piece))
        word = self.marks["\n"] + self.bare[found[1]] if line else self.words[" " + found[1]]
        return word + self.marks[found[2]] if found[2] else word

    def edge(self, token: str) -> bool:
        return token.startswith(self.shown(" "))

    def bounds(self, ids: np.ndarray) -> np.ndarray:
        return np.append(np.flatnonzero(self.at_edge[ids]), len(ids))

    def spelt(self, heads: pa.Array, bare: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(pc.if_else(pa.array(bare), "", " ").cast(heads.type), heads, pa.scalar("", heads.type))

    def lines(self, pieces: pa.Array, first: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        line = pc.starts_with(pieces, "\n").to_numpy(zero_copy_only=False) & ~first
        return line, pc.if_else(pa.array(line), pc.utf8_slice_codeunits(pieces, 1), pieces) if line.any() else pieces

    def cut(self, texts: pa.Array) -> pa.Array:
        """Cut before each lone space and line end; see ``spaced`` for the pieces after the first."""
        out = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        wide = pc.match_substring_regex(texts, WIDE)
        if not pc.any(wide).as_py():
            return out
        return pa.array([CUT.split(t) if w else p for t, w, p in zip(texts.to_pylist(), wide.to_pylist(), out.to_pylist())], out.type)

    def opening(self, piece: str) -> bytes:
        return self.bare[piece] if piece.isalpha() else self.whole(piece)


class WordBpe(Coder):
    """Letters are a pretoken once they are lower-case, and so is the run of marks after them."""

    PLAIN = f"^{LETTERS}+$"
    LEAD = ""

    def piece(self, piece: str) -> bytes:
        found = SIMPLE.fullmatch(piece)
        if found is None:
            return self.whole(piece)
        word = self.words[found[1].lower()]
        return word + self.marks[found[2]] if found[2] else word

    def edge(self, token: str) -> bool:
        return token.endswith("</w>")

    def bounds(self, ids: np.ndarray) -> np.ndarray:
        return np.append(0, np.flatnonzero(self.at_edge[ids]) + 1)

    def spelt(self, heads: pa.Array, bare: np.ndarray) -> pa.Array:
        return pc.utf8_lower(heads)

    def lines(self, pieces: pa.Array, first: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        return np.zeros(len(pieces), bool), pieces

    def cut(self, texts: pa.Array) -> pa.Array:
        return pc.ascii_split_whitespace(texts)


def coder(kind, path: str):
    """The coder that this worker process keeps; another kind or file takes its place."""
    return common.kept((kind, path), lambda: kind(path))


def grouped(batches: Iterator[pa.RecordBatch], size: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches of at least ``size`` bytes, but for the last."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
