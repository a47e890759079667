"""Op 11: personal data - e-mail and IP addresses, card and phone numbers.

Two finders work on every whole text.  Fixed patterns give the ``base`` spans, leftmost and
non-overlapping per kind, with a check of each match (octets, Luhn, number of digits).  A
linear-chain conditional random field over words adds what is written otherwise ("a (at) b
(dot) com", a number without its plus sign); it never touches a base span.

The field labels words O, or the begin or inside of a kind.  A word without digit, @ or a
bracketed "at" / "dot" beside it is O by constraint, so a text decodes exactly by Viterbi
over its runs of other words, each between two such words; runs of a batch advance together,
a place at a time, in numpy.  Features are a word's shape (runs of letters, lengths of digit
runs, punctuation as it is), its ends, its shape without outer punctuation, that of both
neighbours, and checks of its digits.

The labelled table is small and made from the corpus (``labelled``): at most ``PASSAGES``
passages of about ``SAMPLE`` documents, drawn by a hash over the whole table, labelled by the
base patterns; and the same passages with one generated item of a list of written forms put
in, either personal data or look-alikes (numbers that fail their check, dates, keys).

Cases: a null text is empty and has no span; texts of any length are read whole, word by
word; repeated rows are independent; a table without any personal data or without rows still
gives a model, from generated items in placeholder words; other columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears.llm import common
from arrears.llm.crf_lang import posteriors, scaled
from arrears.llm.tokens import Recent

KINDS = ("email", "ip", "card", "phone")
SAMPLE, PASSAGES, ITEMS, AROUND, STEPS = 4000, 2000, 2000, 12, 50
BATCH_WORDS = 200_000

# The base patterns; [0-9] runs are taken whole, which is what they match.
LOCAL = string.ascii_letters + string.digits + "._%+-"
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

WORDS = re.compile(r"\S+")
#: What makes a word free to be labelled; bracketed words free their neighbours too.
FREE = re.compile(r"[0-9@]|[(\[{<](?:[aA][tT]|[dD][oO][tT])[)\]}>]")
BRACKETED = re.compile(r"[(\[{<](?:at|dot)[)\]}>]", re.IGNORECASE)

Span = tuple[int, int, int]  # kind, start, end


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(number)):
        d = int(c) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def octets(s: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in s.split(".")))


def emails(text: str) -> Iterator[Span]:
    """Every match holds one @, which no local part contains: the run before each @ and the
    labels after it decide, in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(LOCAL))
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            yield 0, start, host.end()
        done = host.end() if host else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out = list(emails(text)) if "@" in text else []
    if FREE.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if octets(m[0])]
        for m in CARD.finditer(text):
            if 13 <= m.end() - m.start() and 13 <= len(number := digits(m[0])) <= 19 and luhn(number):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


# ---------------------------------------------------------------- words and shapes
def runs(text: str) -> Iterator[list[tuple[int, int, bool]]]:
    """Maximal runs of free words as (start, end, free), with the word before and the word
    after (or an empty place) where there is none."""
    if not FREE.search(text):
        return
    nothing = (0, 0, False)
    before, word, bracket_before = nothing, None, False
    run: list[tuple[int, int, bool]] = []

    def step(word, before, bracket_before, bracket_after):
        free = bracket_before or bracket_after or FREE.search(text, *word) is not None
        if free:
            if not run:
                run.append((*before[:2], False))
            run.append((*word, True))
            return None
        if run:
            done = [*run, (*word, False)]
            run.clear()
            return done
        return None

    for m in WORDS.finditer(text):
        here = m.span()
        bracket = here[1] - here[0] <= 7 and BRACKETED.search(text, *here) is not None
        if word is not None:
            done = step(word[:2], before, bracket_before, bracket)
            if done:
                yield done
            before, bracket_before = word, word[2]
        word = (*here, bracket)
    if word is not None:
        done = step(word[:2], before, bracket_before, False)
        if done:
            yield done
    if run:
        yield [*run, nothing]


def symbols(word: str) -> str:
    """The shape: A and a for runs of letters, a class of length for runs of digits, other
    characters as they are, repeats once; long shapes are cut in the middle."""
    out = []
    for m in re.finditer(r"[0-9]+|[A-Z]+|[^\W\d_A-Z]+|(.)\1*", word, re.DOTALL):
        s, n = m[0], m.end() - m.start()
        if "0" <= s[0] <= "9":
            out.append(str(n) if n <= 4 else "56"[n > 6] if n <= 8 else "x" if n <= 12 else "c" if n <= 19 else "z")
        elif s[0].isalpha():
            out.append("A" if s[0].isupper() else "a")
        else:
            out.append(s[0] if s[0] < "\x7f" else "?")
    shape = "".join(out)
    return shape if len(shape) <= 24 else shape[:12] + "~" + shape[-12:]


def key_of(word: str) -> str:
    """All that features depend on, as one short string."""
    if not word:
        return "^"
    inner = word.strip(string.punctuation) if len(word) <= 512 else word
    number = digits(inner) if len(inner) <= 64 else ""
    plain = re.fullmatch(r"[0-9]+(?:[-._/ ][0-9]+)*", inner) if number else None
    checks = ("L" if luhn(number) else "N") if plain and 13 <= len(number) <= 19 else ""
    checks += ("O" if octets(inner) else "o") if number and re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", inner) else ""
    checks += "B" + inner.lower() if len(word) <= 7 and BRACKETED.search(word) else ""
    mixed = len(re.findall(r"[0-9][A-Za-z]|[A-Za-z][0-9]", inner[:64]))
    return "\t".join((symbols(word), symbols(inner), str(min(len(number), 20)), str(min(inner.count("."), 4)),
                      str(min(word.count("@"), 2)), checks, str(min(mixed, 4))))


def own_features(key: str) -> list[str]:
    if key == "^":
        return []
    shape, inner, number, dots, at, checks, mixed = key.split("\t")
    return ["bias", f"s={shape}", f"c={inner}", f"p={shape[:2]}", f"q={shape[-2:]}", f"P={inner[:4]}", f"Q={inner[-4:]}",
            f"n={number}", f"d={dots}", f"@={at}", f"k={checks}", f"m={mixed}", f"nk={number}/{dots}/{checks}"]


def near_features(key: str, side: str) -> list[str]:
    if key == "^":
        return [f"{side}^"]
    parts = key.split("\t")
    # words that are O by constraint count alike, whatever they are
    return [f"{side}{parts[1]}", f"{side}k={parts[5]}"] if any(c.isdigit() or c in "xcz@" for c in parts[1]) or parts[5] else [f"{side}word"]


# ---------------------------------------------------------------- the field
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
SIZE = len(LABELS)


def legal() -> np.ndarray:
    """Inside follows the begin or inside of its own kind."""
    out = np.ones((SIZE, SIZE), bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = False
        out[[inside - 1, inside], inside] = True
    return out


@dataclass
class Field:
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, SIZE)))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((SIZE, SIZE)))

    def scores(self, key: str) -> np.ndarray:
        """What a word adds to its own place, to the next one's and to the one's before."""
        return np.array([self.weights[[self.index[f] for f in fs if f in self.index]].sum(0)
                         for fs in (own_features(key), near_features(key, "<"), near_features(key, ">"))])


def viterbi(emit: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of sequences laid end to end; each begins and ends in label 0 by its
    emissions.  Sequences advance together, longest first."""
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    active = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")
    back = np.zeros(emit.shape, np.int8)
    best = np.zeros((len(lengths), SIZE))
    for t, n in enumerate(active):
        at = first[order[:n]] + t
        if t == 0:
            best[:n] = emit[at]
            continue
        paths = best[:n, :, None] + moves
        back[at] = paths.argmax(1)
        best[:n] = paths.max(1) + emit[at]
    out = np.zeros(len(emit), np.int8)
    label = np.zeros(len(lengths), np.int64)
    label[order] = best.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        on = order[:active[t]]
        at = first[on] + t
        now = label[on]
        out[at] = now
        label[on] = back[at, now]
    return out


def trimmed(text: str, kind: int, start: int, end: int) -> tuple[int, int]:
    """Without the punctuation around: a phone number keeps its plus sign or bracket."""
    while start < end and not (text[start].isalnum() or kind == 3 and (
            text[start] == "+" or text[start] == "(" and ")" in text[start:min(end, start + 8)])):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


class Finder:
    """A worker's field, with the scores of the word shapes it has met."""

    def __init__(self, model: Field) -> None:
        self.moves = np.where(legal(), model.moves, -1e9)
        self.known = Recent(model.scores, 50_000)

    def added(self, texts: list[str]) -> Iterator[tuple[int, Span]]:
        """(text, span) of what the field finds."""
        held: list[tuple[int, list[tuple[int, int, bool]]]] = []
        words = 0
        for i, text in enumerate(texts):
            for run in runs(text):
                held.append((i, run))
                words += len(run)
                if words > BATCH_WORDS:
                    yield from self.decode(texts, held)
                    held, words = [], 0
        if held:
            yield from self.decode(texts, held)

    def decode(self, texts, held) -> Iterator[tuple[int, Span]]:
        lengths = np.array([len(run) for _, run in held])
        table = np.array([self.known[key_of(texts[i][s:e])] for i, run in held for s, e, _ in run])
        free = np.array([f for _, run in held for _, _, f in run])
        emit = table[:, 0].copy()
        emit[1:] += table[:-1, 1]  # a run's first and last places are fixed, so edges do not matter
        emit[:-1] += table[1:, 2]
        emit[~free] = -1e9
        emit[~free, 0] = 0
        labels = viterbi(emit, lengths, self.moves)
        at = 0
        for i, run in held:
            own = labels[at:at + len(run)]
            at += len(run)
            for span in spans_of(texts[i], run, own):
                yield i, span


def sound(kind: int, s: str) -> bool:
    """The kind's check of a found span: a word's field cannot see a sum over several words."""
    if kind == 2:
        return 13 <= len(number := digits(s)) <= 19 and luhn(number)
    if kind == 3:
        return 7 <= len(digits(s)) <= 15
    return kind == 0 or bool(digits(s))


def spans_of(text: str, run, labels) -> Iterator[Span]:
    """The runs of a begin and its insides, trimmed; those that fail their kind's check go."""
    begin = kind = last = None
    for (start, end, _), label in [*zip(run, labels), ((0, 0, False), 0)]:
        if begin is not None and not (label and label % 2 == 0):
            s, e = trimmed(text, kind, begin, last)
            if s < e and sound(kind, text[s:e]):
                yield kind, s, e
            begin = None
        if label % 2:
            begin, kind = start, int(label - 1) // 2
        last = end


# ---------------------------------------------------------------- the labelled table
def forms(rng: np.random.Generator) -> Iterator[tuple[int, str]]:
    """(kind or -1, item) without end, each of the forms below in turn."""
    def d(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def w(n: int = 6) -> str:
        return "".join(rng.choice(list(string.ascii_lowercase), int(rng.integers(3, n + 3))))

    def octet() -> str:
        return str(int(rng.integers(1, 256)))

    def number(good: bool) -> str:
        head = str(int(rng.integers(3, 10))) + d(14)
        check = next(c for c in string.digits if luhn(head + c))
        return head + (check if good else str((int(check) + int(rng.integers(1, 10))) % 10))

    def grouped(s: str, sep: str) -> str:
        return sep.join(s[i:i + 4] for i in range(0, 16, 4))

    def hexes(n: int) -> str:
        return "".join(rng.choice(list("0123456789abcdef"), n))

    makers = [
        (0, lambda: f"{w()}.{d(2)}@{w()}{d(1)}.{w(3)}.com"), (0, lambda: f"{w()}@{w()}.org"), (0, lambda: f"{w()}@{w()}"),
        (0, lambda: f"{w()} (at) {w()} (dot) com"), (0, lambda: f"{w()}.{w()} [at] {w()} [dot] net"), (0, lambda: f"{w()} (at) {w()}.com"),
        (1, lambda: ".".join(octet() for _ in range(4))),
        (2, lambda: number(True)), (2, lambda: grouped(number(True), " ")), (2, lambda: grouped(number(True), "-")),
        (2, lambda: grouped(number(True), ".")), (2, lambda: grouped(number(True), "_")), (2, lambda: grouped(number(True), "/")),
        (3, lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}"), (3, lambda: f"({d(3)}) {d(3)}-{d(4)}"), (3, lambda: f"{d(3)}-{d(3)}-{d(4)}"),
        (3, lambda: f"{d(3)}.{d(3)}.{d(4)}"), (3, lambda: f"+{d(2)}-{d(3)}-{d(7)}"), (3, lambda: f"+{d(2)} {d(3)} {d(7)}"),
        (-1, lambda: number(False)), (-1, lambda: grouped(number(False), " ")), (-1, lambda: grouped(number(False), "-")),
        (-1, lambda: grouped(number(False), ".")), (-1, lambda: grouped(number(False), "_")), (-1, lambda: grouped(number(False), "/")),
        (-1, lambda: f"password={hexes(18)}"), (-1, lambda: f'"{hexes(40)}"'), (-1, lambda: "AKIA" + hexes(16).upper()),
        (-1, lambda: f"{d(1)}."), (-1, lambda: f"{d(1)}.{d(1)}."), (-1, lambda: f"{d(1)}.{d(1)}.{d(1)}"), (-1, lambda: f"v{d(1)}.{d(2)}"),
        (-1, lambda: f"20{d(2)}-{d(2)}-{d(2)}"), (-1, lambda: f"{d(2)}/{d(2)}/{d(4)}"), (-1, lambda: f"{d(2)}:{d(2)}"),
        (-1, lambda: d(int(rng.integers(1, 13)))), (-1, lambda: f"${d(2)}.{d(2)}"), (-1, lambda: f"{d(3)},{d(3)}"), (-1, lambda: f"({d(4)})"),
        (-1, lambda: ".".join(str(int(rng.integers(256, 999))) for _ in range(4))), (-1, lambda: f"@{w()}"), (-1, lambda: f"{d(4)}-{d(4)}"),
        (-1, lambda: f"{d(3)}-{d(2)}"), (-1, lambda: f"{w()}{d(2)}"), (-1, lambda: f"[{d(2)}]"), (-1, lambda: f"{d(2)}%"),
        (-1, lambda: f"{d(1)}-{d(3)}-{d(5)}-{d(1)}"), (-1, lambda: f"{d(5)} {d(4)} {d(3)}"), (-1, lambda: f"({d(3)})"), (-1, lambda: f"+{d(1)}"),
    ]
    while True:
        for kind, make in makers:
            yield kind, make()


def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each text: around its first free words, and from its middle."""
    for b in batches:
        out = []
        for text in b.column("text").to_pylist():
            places = [m.start() for _, m in zip(range(8), FREE.finditer(text))]
            for at in {*places[::3], len(text) // 2}:
                piece = text[max(0, at - 100):at + 150]
                cut = piece.split(None, 1)[-1].rsplit(None, 1)[0] if " " in piece else piece
                if cut.strip():
                    out.append(cut)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["text"])


def labelled(docs: DataFrame, sample: int = SAMPLE, items: int = ITEMS, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """The labelled table: (passage, spans); at most ``PASSAGES`` + ``items`` rows of at most
    250 characters and an item."""
    rows = common.documents(docs)
    share = sample / max(1, rows.count())
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    found = sorted(r["text"] for r in rows.where(drawn < share).mapInArrow(passages, "text string").limit(PASSAGES).collect())
    return generated(found, items, seed)


def generated(found: list[str], items: int, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Passages labelled by the base patterns, and copies with a generated item put in."""
    out = [(t, base_spans(t)) for t in found]
    rng = np.random.default_rng(seed)
    around = found or ["some words stand here before and after it"]
    for (kind, item), k in zip(forms(rng), range(items)):
        # plain words only, so that nothing beside the item is left unlabelled
        words = [w for w in around[k % len(around)].split() if not FREE.search(w)][:AROUND] or ["word"]
        cut = int(rng.integers(0, len(words) + 1))
        head, tail = " ".join(words[:cut]), " ".join(words[cut:])
        opens, closes = ("(", ")") if k % 11 == 3 else ("", (".", ",", "", "", "", "%%%", "")[k % 7])
        start = len(head) + bool(head) + len(opens)
        text = f"{head}{' ' if head else ''}{opens}{item}{closes} {tail}"
        out.append((text, [(kind, start, start + len(item))] if kind >= 0 else []))
    return out


def tagged(text: str, spans: list[Span]) -> Iterator[tuple[list[str], list[bool], list[int]]]:
    """Words, which are free and gold labels of the runs of a passage."""
    for run in runs(text):
        labels, inside = [], {}
        for start, end, free in run:
            over = [k for k, (_, s, e) in enumerate(spans) if s < end and start < e]
            if not free or not over:
                labels.append(0)
            else:
                k = over[0]
                labels.append((2 if inside.get(k) else 1) + 2 * spans[k][0])
                inside[k] = True
        yield [text[s:e] for s, e, _ in run], [f for _, _, f in run], labels


def fit(table: list[tuple[str, list[Span]]], steps: int = STEPS) -> Field:
    """Maximum likelihood with a Gaussian prior, by Adam on the whole table."""
    index: dict[str, int] = {}
    places, features, gold, free, lengths = [], [], [], [], []
    for text, spans in table:
        for words, can, labels in tagged(text, sorted(spans, key=lambda s: s[1])):
            keys = [key_of(w) for w in words]
            for i, key in enumerate(keys):
                fs = own_features(key) + (near_features(keys[i - 1], "<") if i else []) + (
                    near_features(keys[i + 1], ">") if i + 1 < len(keys) else [])
                for f in fs if can[i] else ():
                    places.append(len(gold))
                    features.append(index.setdefault(f, len(index)))
                gold.append(labels[i])
                free.append(can[i])
            lengths.append(len(words))
    places, features, gold, free = np.array(places, int), np.array(features, int), np.array(gold, int), np.array(free, bool)
    lengths, n, can = np.array(lengths, int), len(gold), legal()
    model = Field(index, np.zeros((len(index), SIZE)), np.zeros((SIZE, SIZE)))
    if not n:
        return model
    target = np.zeros((n, SIZE))
    target[np.arange(n), gold] = 1
    opens = np.zeros(n, bool)
    opens[np.cumsum(lengths) - lengths] = True
    moved = np.zeros((SIZE, SIZE))
    np.add.at(moved, (gold[:-1][~opens[1:]], gold[1:][~opens[1:]]), 1)
    params = [model.weights, model.moves]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        score = np.column_stack([np.bincount(places, model.weights[features, k], n) for k in range(SIZE)])
        emit = scaled(score)
        emit[~free] = np.eye(SIZE, dtype=emit.dtype)[0]
        expected = np.zeros((n, SIZE))

        def keep(at, gamma, expected=expected):
            expected[at] = gamma

        step = np.where(can, np.exp(model.moves), 0).astype(np.float32)
        _, moves = posteriors(emit, lengths, step, np.full(SIZE, 1 / SIZE, np.float32), keep)
        pull = (target - expected) / len(lengths)
        grads = [np.column_stack([np.bincount(features, pull[places, k], len(index)) for k in range(SIZE)]) - 1e-4 * params[0],
                 np.where(can, (moved - moves) / len(lengths), 0) - 1e-3 * params[1]]
        for p, g, m, s in zip(params, grads, means, squares):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p += 0.15 * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-9)
    return model


def train(docs: DataFrame) -> Field:
    return fit(labelled(docs))


# ---------------------------------------------------------------- whole tables
SPANS = "array<struct<kind:int,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def both(texts: list[str], finder: Finder) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans, and those of the field that touch none, sorted."""
    base = [base_spans(t) for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    for i, span in finder.added(texts):
        if all(e <= span[1] or span[2] <= s for _, s, e in base[i]):
            added[i].append(span)
    return base, [sorted(a) for a in added]


def find(docs: DataFrame, model: Field) -> DataFrame:
    """Per document: doc_id, and the spans (kind's place in ``KINDS``, start, end in code
    points) of the patterns, ``base``, and of the field, ``added``."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model)
        for b in batches:
            base, added = both(b.column("text").to_pylist(), finder)
            columns = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in row] for row in found], _SPANS) for found in (base, added)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", "base", "added"])

    return common.documents(docs).mapInArrow(run, f"doc_id long, base {SPANS}, added {SPANS}")


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, model: Field) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (of the patterns), base_sha256,
    spans (all), n_added."""
    every = F.array_sort(F.concat("base", "added"))

    def number_of(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return find(docs, model).select(
        "doc_id", *[number_of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"),
        F.size("added").cast("long").alias("n_added"))
