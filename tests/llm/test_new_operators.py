"""PII (op11), filter audit (op12) and importance resampling (op13) against brute force."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from arrears.llm import common, filter_audit, pii, resampling
from tests.conftest import SMALL

ODD = "doc_id long, text string, source string, part string, row long, n long"


# ---------------------------------------------------------------- op 13
def brute_draw(docs, target, percent=10, least=20, longest=1):
    def grams(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        return len(w), [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % 10000

    own = [(i, *grams(t)) for i, t in docs]
    s, t = Counter(bucket(f) for _, _, g in own for f in g), Counter(bucket(f) for x in target for f in grams(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    out = []
    for i, n, g in own:
        weight = sum(gain[bucket(f)] for f in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    can = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0]))
    rank = {id(x): k + 1 for k, x in enumerate(can[:len(can) * percent // 100])}
    return Counter((*x[:4], rank.get(id(x))) for x in out)


@pytest.mark.parametrize("longest,percent", [(1, 10), (2, 35)])
def test_resample_against_brute_force(spark, longest, percent):
    docs, target = common.table(spark, SMALL, "documents"), common.table(spark, SMALL, "benchmark")
    found = resampling.resample(docs, target, percent=percent, longest=longest)
    want = brute_draw([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], percent, longest=longest)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()) == want


def test_resample_odd_rows(spark):
    words = " ".join("abcdefghijklmnopqrstuvwxyz")
    rows = [(1, words), (1, words), (2, words + " É x"), (None, words), (None, words), (3, None), (4, ""), (5, "Ünder 9 " * 30000), (6, "\x00 a@b `c` {D}")]
    docs = spark.createDataFrame([(i, t, "s", "p", 7, 8) for i, t in rows], ODD)
    for target in (spark.createDataFrame([("A b",), (None,)], "text string"), spark.createDataFrame([], "text string")):
        texts = [r.text for r in target.collect()]
        for percent in (0, 10, 50, 100):
            found = resampling.resample(docs, target, percent=percent)
            assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
            assert Counter(tuple(r) for r in found.collect()) == brute_draw(rows, texts, percent)
        assert resampling.resample(docs.limit(0), target).count() == 0


def test_cutoff_is_exact_at_every_place(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), k) for k, (a, b) in enumerate(zip(rng.integers(-5, 5, 60), rng.choice([-(1 << 62), 0, 7, (1 << 63) - 1], 60)))]
    df = common.stage(spark.createDataFrame(rows, "a long, b long, c long"), "test-cutoff")
    ordered = sorted(rows)
    for k in (1, 2, 17, 30, 59, 60):
        got = resampling.cutoff(df, ["a", "b", "c"], k)
        before = df.where(resampling.at_or_before(["a", "b", "c"], got)).collect()
        assert sorted(tuple(r) for r in before) == ordered[:k]


# ---------------------------------------------------------------- op 12
def brute_audit(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    rows = {}
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                                               re.search(r"[#$%&*|]", t), i is not None and least[t] < i)) if bad}
        mine = [(q, x) for d, q, x in labels if d is not None and d == i]
        rows.setdefault(part or "", []).append((fails, any(q == 1 for q, _ in mine), any(x == 1 for _, x in mine)))
    out, shapley = {}, Counter()
    for part, own in rows.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shapley[part, f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in r[0] for r in own) - len(gone), sum(r[0] == {f} for r in own),
                                          sum(r[1] for r in gone), sum(r[2] for r in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {(r["part"], r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in df.collect()}


def test_audit_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(250))
    rows = [(1, long, "a"), (2, long, "a"), (2, long, "a"), (None, long, "b"), (None, None, None), (3, None, ""), (4, "", "a"), (5, "A B #", "b"),
            (6, "x " * 300, "b"), (7, long + " |", "b"), (8, "É ü " * 400, "é"), (9, "y\x1cz\x0bq " * 90000, "a")]
    docs = spark.createDataFrame([(i, t, s, "p", 5, 6) for i, t, s in rows], ODD)
    marks = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (5, None, 1), (99, 1, 1), (9, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(docs, labels)
    assert audited(found) == brute_audit(rows, marks)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    none = audited(filter_audit.audit(docs, labels.limit(0)))
    assert none == brute_audit(rows, [])


def test_audit_against_brute_force(spark):
    docs, labels = common.table(spark, SMALL, "documents"), common.table(spark, SMALL, "labels")
    want = brute_audit([(r.doc_id, r.text, r.source) for r in docs.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert audited(filter_audit.audit(docs, labels)) == want


def test_galloping_merges():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, int(rng.choice([5, 400, 60000])), int(rng.choice([0, 1, 30, 3000])))) for _ in range(2))
        assert (filter_audit.gallop(a, b) == np.searchsorted(b, a)).all()
        assert (filter_audit.union(a, b) == np.union1d(a, b)).all()
        assert (a[filter_audit.held(a, b)] == np.intersect1d(a, b)).all()
    lists = [np.unique(rng.integers(0, 200, n)) for n in (0, 20, 90, 150, 5)]
    within = np.unique(rng.integers(0, 200, 80))
    for kept in (None, within, np.zeros(0, int)):
        sizes = filter_audit.union_sizes(lists, kept)
        for mask in range(32):
            union = {x for k in range(5) if mask >> k & 1 for x in lists[k].tolist()}
            assert sizes[mask] == len(union if kept is None else union & set(kept.tolist()))


# ---------------------------------------------------------------- op 11
def plain_base(text):
    """The patterns as they are stated."""
    def number(s):
        return re.sub("[^0-9]", "", s)

    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        n = number(m[0])
        twice = sum(map(int, n[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in n[-2::-2])
        if 13 <= len(n) <= 19 and twice % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(number(m[0])) <= 15]


def text_of(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)


def test_base_spans_as_stated():
    rng = np.random.default_rng(0)
    for _ in range(20000):
        text = "".join(rng.choice(list("0123456789.@+- ()a_%\n"), int(rng.integers(0, 30))))
        assert pii.base_spans(text) == plain_base(text)
    for text in ("a" * 300_000 + "@", "1" * 300_000, "+1" + " " * 300_000, "1." * 200_000, "@" * 300_000, "1.2.3." + "0" * 5000 + "9", "é@x.y z@é.x \U0001f600 q@r.s"):
        assert len(pii.base_spans(text)) <= 200_000 and text[:1]
    assert pii.base_spans("é q@r.s \U0001f600 1.2.3.4") == plain_base("é q@r.s \U0001f600 1.2.3.4")


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    moves = np.where(pii.legal(), rng.normal(size=(pii.SIZE, pii.SIZE)), -1e9)
    lengths = np.array([1, 4, 2, 3, 4])
    emit = rng.normal(size=(lengths.sum(), pii.SIZE)) * 2
    got, at = pii.viterbi(emit, lengths, moves), 0
    for n in lengths:
        paths = itertools.product(range(pii.SIZE), repeat=int(n))
        best = max(paths, key=lambda p: sum(emit[at + t, y] for t, y in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p)))
        assert tuple(got[at:at + n]) == best
        at += n


def test_pii_finds_written_forms_and_spares_look_alikes(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    table = pii.labelled(docs)
    assert len(table) <= pii.PASSAGES + pii.ITEMS
    model = pii.fit(table)
    finder = pii.Finder(model)
    test = pii.generated([t for t, _ in table[:-pii.ITEMS]], 1000, seed=77)[len(table) - pii.ITEMS:]
    hit = missed = wrong = 0
    for text, spans in test:
        base, added = pii.both([text], finder)
        found = set(base[0] + added[0])
        hit, missed, wrong = hit + len(found & set(spans)), missed + len(set(spans) - found), wrong + len(found - set(spans))
    assert hit >= 0.97 * (hit + missed) and wrong <= 0.02 * len(test)
    # the field alone, held against the patterns on documents of another draw
    texts = [r.text or "" for r in common.table(spark, "/root/testdata/sf0.1", "documents").where("doc_id >= 1000").select("text").collect()]
    alone, want = set(finder.added(texts)), {(i, s) for i, t in enumerate(texts) for s in pii.base_spans(t)}
    assert len(alone & want) >= 0.95 * len(want) and len(alone - want) <= 0.03 * len(want)
    clean = [t for t in texts if not pii.base_spans(t)]
    assert sum(1 for _ in finder.added(clean)) <= 0.001 * len(clean)
    # the labelled table teaches: without its items a bare number is not found
    assert not pii.both(["call (501) 532-9453 now"], pii.Finder(pii.Field()))[1][0]
    assert text_of(pii.both(["call (501) 532-9453 now, or me (at) site (dot) com"], finder)[1][0]) == "email:28:50,phone:5:19"


def test_pii_query_and_odd_rows(spark):
    long = "word " * 200_000 + "mail me.x@y.org"
    rows = [(1, "a@b.c 1.2.3.4 +1 (437) 555-0689"), (1, "a@b.c 1.2.3.4 +1 (437) 555-0689"), (2, None), (None, ""), (3, long), (4, "é\U0001f600 a@b.c"),
            (5, "9" * 100_000), (6, "x@" * 5000 + "y.z")]
    docs = spark.createDataFrame([(i, t, "s", "p", 5, 6) for i, t in rows], ODD)
    model = pii.train(docs)
    found = pii.digests(docs, model)
    got = sorted(((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found.collect()))
    want = []
    for i, t in rows:
        base = plain_base(t or "")
        want.append((str(i), *[sum(s[0] == k for s in base) for k in range(4)], hashlib.sha256(text_of(base).encode()).hexdigest()))
    assert got == sorted(want)
    for r in found.collect():
        mine = [plain_base(t or "") for i, t in rows if i == r.doc_id][0]
        assert set(text_of(mine).split(",")) <= set(r.spans.split(",")) | {""}
    assert pii.digests(docs.limit(0), pii.train(docs.limit(0))).count() == 0
    assert pii.digests(docs.limit(0), model).columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
