"""Op 10: language identification by a linear-chain conditional random field over words.

Every word of a text gets a distribution over the learned languages by forward-backward;
so a code-switched text is labelled word by word, and a document's language is the one with
the largest expected share of its words.  Features of a word: hashed character n-grams with
word-edge marks (those at the edges are its affixes), and whether it is in a language's
lexicon.  Transitions between the languages of neighbouring words are learned too.

Training uses a bounded sample (about ``SAMPLE`` documents of each of at most ``CLASSES``
languages, by a hash, and at most ``SAMPLE_CHARS`` characters of each).  Its passages are spliced into code-switched sequences, so that transitions have
something to learn from.

Inference is exact and vectorised: words fall into blocks, a block's product of transition
matrices is computed for all blocks at once, the products are chained along each document,
and the inside of all blocks is then filled in at once from their edges.

Cases: null texts and texts without a letter are ``und`` with score 0; so is everything
where no training row has a language; words without a letter are skipped; texts of any
length are labelled whole; repeated rows are independent; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm import common
from arrears.llm.toxicity import MULTIPLIER, mixed

SAMPLE, PASSAGE, STEPS = 250, 40, 30
#: Most languages, characters of a sampled text, and least share of words in a kept document's language.
CLASSES, SAMPLE_CHARS, LEAST_SHARE = 128, 50_000, 0.4
ORDERS, BITS = (1, 2, 3, 4), 17
LEXICON, LEAST = 3000, 3
BLOCK, BATCH_WORDS = 32, 200_000
UNKNOWN = "und"


def core(piece: str) -> str:
    """A piece of text between spaces, reduced to its letters, in lower case."""
    return piece.lower() if piece.isalpha() else "".join(filter(str.isalpha, piece)).lower()


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, feature) of all hashed n-grams, and a 64-bit hash of each word."""
    marked = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    of = np.cumsum(codes == 2) - 1
    whole = np.zeros(len(words), np.uint64)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), whole
    places = np.arange(len(codes)) - np.searchsorted(of, of)
    np.add.at(whole, of, mixed(codes + np.uint64(0x10000) * places.astype(np.uint64)))
    powers = MULTIPLIER ** np.arange(max(ORDERS), dtype=np.uint64)
    h, rows, features = np.zeros(len(codes), np.uint64), [], []
    for n in range(1, max(ORDERS) + 1):
        h = h[:len(codes) - n + 1] + codes[n - 1:] * powers[n - 1]
        inside = np.flatnonzero((of[:len(h)] == of[n - 1:]) & (codes[:len(h)] != 3))
        if n == 1:
            inside = inside[codes[inside] > 3]
        if n in ORDERS:
            rows.append(of[inside])
            features.append((mixed(h[inside] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(features), whole


def normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(-1, keepdims=True), 1e-30)


def posteriors(emit: np.ndarray, lengths: np.ndarray, step: np.ndarray, start: np.ndarray,
               visit=None) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over sequences laid end to end.

    emit: (words, labels), positive; lengths: words of each sequence (at least 1).  Returns
    the sum of the words' label distributions per sequence and, if
    ``visit`` is given, the expected number of transitions over all of them.
    ``visit(index, gamma)`` gets the distributions themselves, ``index`` being positions in
    ``emit``.
    """
    labels = emit.shape[1]
    blocks = -(-lengths // BLOCK)
    first_block = np.cumsum(blocks) - blocks
    first_word = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(lengths)), blocks)
    opens = np.arange(len(of)) == first_block[of]
    begin = first_word[of] + (np.arange(len(of)) - first_block[of]) * BLOCK
    size = np.minimum(BLOCK, first_word[of] + lengths[of] - begin)
    full = np.arange(BLOCK)[:, None] < size  # (place, block)
    at = np.where(full, begin + np.arange(BLOCK)[:, None], 0)
    e = emit[at]  # (place, block, label)
    # products of the blocks' matrices
    product = np.broadcast_to(np.eye(labels, dtype=emit.dtype), (len(of), labels, labels)).copy()
    for k in range(BLOCK):
        on = np.flatnonzero(full[k])
        if not len(on):
            break
        p = (product[on].reshape(-1, labels) @ step).reshape(-1, labels, labels) * e[k, on][:, None, :]
        product[on] = p / p.max((1, 2), keepdims=True)
    # along each document, from both ends; documents with many blocks stay active longest
    left, right = np.empty((len(of), labels), emit.dtype), np.empty((len(of), labels), emit.dtype)
    order = np.argsort(-blocks, kind="stable")
    active = np.searchsorted(-blocks[order], -np.arange(int(blocks.max(initial=0))), "left")
    a = np.broadcast_to(start, (len(lengths), labels)).astype(emit.dtype)
    b = np.ones((len(lengths), labels), emit.dtype)
    for k, n in enumerate(active):
        here = first_block[order[:n]] + k
        left[here] = a[:n]
        a = normal(np.einsum("ni,nij->nj", a[:n], product[here]))
        here = first_block[order[:n]] + blocks[order[:n]] - 1 - k
        right[here] = b[:n]
        b = normal(np.einsum("nij,nj->ni", product[here], b[:n]))
    # inside the blocks
    prior = np.empty_like(e)
    a = left
    for k in range(BLOCK):
        prior[k] = a @ step
        a = np.where(full[k][:, None], normal(prior[k] * e[k]), a)
    sums = np.zeros((len(of), labels), emit.dtype)
    moves = np.zeros((labels, labels))
    b = right
    for k in reversed(range(BLOCK)):
        on = full[k][:, None]
        gamma = np.where(on, normal(prior[k] * e[k] * b), 0)
        sums += gamma
        if visit:
            visit(at[k][full[k]], gamma[full[k]])
            before = normal(prior[k - 1] * e[k - 1]) if k else left
            pair = before[:, :, None] * step * (e[k] * b)[:, None, :]
            pair = pair / np.maximum(pair.sum((1, 2), keepdims=True), 1e-30)
            moves += pair[full[k] if k else ~opens].sum(0)
        b = np.where(on, normal((e[k] * b) @ step.T), b)
    out = np.zeros((len(lengths), labels))
    np.add.at(out, of, sums)
    return out, moves


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # feature x language
    lexicon: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted word hashes
    entry: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # language of each
    in_lexicon: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # lexicon's x language
    moves: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # log transitions

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Lexicon of each word; the number of languages for none."""
        if not len(self.lexicon):
            return np.full(len(hashes), len(self.languages))
        k = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[k] == hashes, self.entry[k], len(self.languages))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Positive scores (words, languages)."""
        rows, features, hashes = word_features(words)
        lex = np.vstack([self.in_lexicon, np.zeros((1, len(self.languages)))])[self.find(hashes)]
        return scaled(np.column_stack([np.bincount(rows, self.weights[features, k], len(words)) + lex[:, k]
                                       for k in range(len(self.languages))]))


def scaled(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(scores - scores.max(1, keepdims=True), -60, 0)).astype(np.float32)


class Labeller:
    """A worker's model, with the emissions of the words it has met."""

    def __init__(self, model: Crf, cap: int = 200_000) -> None:
        self.model, self.cap = model, cap
        self.step = np.exp(model.moves).astype(np.float32)
        self.start = np.full(len(model.languages), 1 / max(1, len(model.languages)), np.float32)
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages)), np.float32)
        self.used = 0

    def rows_of(self, pieces: list[str]) -> np.ndarray:
        """Row of each piece in the table of emissions; -1 without a letter."""
        new = list(set(pieces).difference(self.known))
        if len(self.known) + len(new) > self.cap:
            self.known, self.used, new = {}, 0, list(set(pieces))
        if new:
            words = [core(p) for p in new]
            lettered = [k for k, w in enumerate(words) if w]
            place = np.full(len(new), -1)
            place[lettered] = self.used + np.arange(len(lettered))
            if self.used + len(lettered) > len(self.rows):
                self.rows = np.resize(self.rows, (max(2 * len(self.rows), self.used + len(lettered), 1 << 12),
                                                  self.rows.shape[1]))
            if lettered:
                self.rows[self.used:self.used + len(lettered)] = self.model.emissions([words[k] for k in lettered])
            self.used += len(lettered)
            self.known.update(zip(new, place.tolist()))
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def label(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        languages, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.model.languages:
            return languages, scores
        group: list[int] = []
        rows: list[np.ndarray] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if group:
                sums, _ = posteriors(self.rows[np.concatenate(rows)], np.array([len(r) for r in rows]),
                                     self.step, self.start)
                share = normal(sums)
                for i, k, s in zip(group, share.argmax(1), share.max(1)):
                    languages[i], scores[i] = self.model.languages[k], min(1.0, float(s))
            group.clear()
            rows.clear()
            held = 0

        for i, text in enumerate(texts):
            pieces = text.split()
            if len(self.known) + len(pieces) > self.cap:
                flush()  # the table may be emptied: its rows must not be in use
            found = self.rows_of(pieces)
            found = found[found >= 0]
            if len(found):
                group.append(i)
                rows.append(found)
                held += len(found)
            if held > BATCH_WORDS:
                flush()
        flush()
        return languages, scores


def fit(texts: list[str], of: np.ndarray, languages: list[str], seed: int = 10, steps: int = STEPS) -> Crf:
    """Maximum likelihood with a Gaussian prior, by Adam on the whole sample."""
    rng, size = np.random.default_rng(seed), len(languages)
    index: dict[str, int] = {}
    passages, labels = [], []
    for text, k in zip(texts, of):
        words = [w for w in map(core, text.split()) if w]
        ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
        for at in range(0, len(ids), PASSAGE):
            passages.append(ids[at:at + PASSAGE])
            labels.append(k)
    if not passages:
        return Crf([])
    order = rng.permutation(len(passages))
    ids = np.concatenate([passages[k] for k in order])
    gold = np.repeat(np.array(labels)[order], [len(passages[k]) for k in order])
    groups = np.array_split(np.array([len(passages[k]) for k in order]), -(-len(order) // 4))
    lengths = np.array([g.sum() for g in groups])  # sequences of about four passages
    rows, features, hashes = word_features(list(index))
    # lexicons: words that the sample has, but for few, in one language only
    counts = np.zeros((len(index), size))
    np.add.at(counts, (ids, gold), 1)
    owner = counts.argmax(1)
    own = counts.max(1)
    sure = np.flatnonzero((own >= LEAST) & (own >= 0.9 * counts.sum(1)))
    listed = np.concatenate([np.zeros(0, np.int64), *(
        s[np.argsort(-own[s], kind="stable")][:LEXICON] for k in range(size) for s in [sure[owner[sure] == k]])])
    listed = listed[np.argsort(hashes[listed])]
    model = Crf(languages, np.zeros((1 << BITS, size)), hashes[listed], owner[listed], np.zeros((size, size)),
                np.zeros((size, size)))
    lex = model.find(hashes)
    target = np.zeros((len(index), size))
    np.add.at(target, (ids, gold), 1)
    first = np.zeros(len(ids), bool)
    first[np.cumsum(lengths) - lengths] = True
    moved = np.zeros((size, size))
    np.add.at(moved, (gold[:-1][~first[1:]], gold[1:][~first[1:]]), 1)
    params = [model.weights, model.in_lexicon, model.moves]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    start = np.full(size, 1 / size, np.float32)
    for t in range(1, steps + 1):
        expected = np.zeros((len(index), size))
        emit = np.column_stack([np.bincount(rows, model.weights[features, k], len(index)) for k in range(size)])
        emit += np.vstack([model.in_lexicon, np.zeros((1, size))])[lex]

        def add(at, gamma, expected=expected):
            for k in range(size):
                expected[:, k] += np.bincount(ids[at], gamma[:, k], len(index))

        _, moves = posteriors(scaled(emit)[ids], lengths, np.exp(model.moves).astype(np.float32), start, add)
        pull = (target - expected) / len(ids)
        by_lexicon = np.zeros((size + 1, size))
        np.add.at(by_lexicon, lex, pull)
        grads = [np.column_stack([np.bincount(features, pull[rows, k], 1 << BITS) for k in range(size)]) - 1e-7 * params[0],
                 by_lexicon[:size] - 1e-4 * params[1], (moved - moves) / len(ids) - 1e-4 * params[2]]
        for p, g, m, s, rate in zip(params, grads, means, squares, (0.05, 0.1, 0.2)):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p += rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-9)
    return model


def train(docs: DataFrame, modulus: int = 4, held: int = 2, sample: int = SAMPLE, classes: int = CLASSES) -> Crf:
    """The field of the ``classes`` commonest values of ``lang``, from about ``sample``
    documents of each: a draw by a hash over the whole table, copies of a text once, of each
    text at most ``SAMPLE_CHARS`` characters from its middle.  So neither odd tags nor long texts
    nor an id that many rows share make what the driver holds grow."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.fold("doc_id", modulus) != held))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(classes).collect()}
    if not sizes:
        return Crf([])
    languages = sorted(sizes)
    # a hash of the row takes each with the probability that leaves about ``sample`` of its language
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, sample / n)))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    middle = F.expr(f"substr(text, greatest(1, (length(text) - {SAMPLE_CHARS}) div 2), {SAMPLE_CHARS})")
    texts = known.where(F.col("lang").isin(languages)).select("lang", middle.alias("text"), (drawn < share[F.col("lang")]).alias("drawn"))
    most = 4 * sample * len(languages)
    rows = texts.where("drawn").select("text", "lang").dropDuplicates().limit(most).toPandas()
    if rows.empty:
        rows = texts.select("text", "lang").limit(sample).toPandas()
    place = {k: i for i, k in enumerate(languages)}
    rows = rows.sort_values(["lang", "text"])
    return fit(rows["text"].tolist(), rows["lang"].map(place).to_numpy(), languages)


def identify(docs: DataFrame, model: Crf, modulus: int = 4, held: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        labeller = Labeller(model)
        for b in batches:
            languages, scores = labeller.label(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores)],
                                             names=["doc_id", "lang_pred", "score"])
        del labeller
        common.release()

    return common.documents(docs).mapInArrow(run, "doc_id long, lang_pred string, score double").select(
        "doc_id", (common.fold("doc_id", modulus) == held).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, model: Crf, languages: list[str] | None = None, least: float = LEAST_SHARE) -> DataFrame:
    """``docs``, all columns, without those of which the field does not expect at least the
    share ``least`` of the words to be of one of ``languages`` (by default any it learned)."""
    common.small_batches(docs.sparkSession)
    wanted = set(model.languages if languages is None else languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        labeller = Labeller(model)
        for b in batches:
            found, scores = labeller.label([t or "" for t in b.column("text").to_pylist()])
            yield b.filter(pa.array([k in wanted and s >= least for k, s in zip(found, scores)], pa.bool_()))
        del labeller
        common.release()

    return docs.mapInArrow(run, docs.schema)
