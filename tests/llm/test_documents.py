"""Ops 2, 3, 5 and 10: brute force, held-out accuracy, odd rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrears.llm import common, crf_lang, exact_dedup, graph, lsh_forest, queries, toxicity
from tests.conftest import SMALL
from tools.check_oracles import compare, duck

MIDDLE = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, kept string, component_id long, score double, lang string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 0.5, g) for i, t, g in rows], SCHEMA).repartition(4)


def test_op2_oracle(spark):
    name = "op2_exact_dedup"
    assert ": OK" in compare(spark, duck(SMALL), name, queries.QUERIES[name], queries.ORACLES[name], SMALL)


@pytest.mark.parametrize("winners", [1000, 1])
def test_op2_odd_rows(spark, winners):
    rows = [(i, "hot" if i % 3 else f"t{i % 40}", "en") for i in range(300)]
    rows += [(None, None, None), (None, "", None), (1000, "A", None), (1000, "A", None), (1001, "a", None), (1002, "a ", None)]
    got = exact_dedup.exact_dedup(frame(spark, rows), winners, max(64, winners)).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    keeps = {max((i for i in g if i is not None), default=None): len(g) for g in groups.values()}
    assert {(r.keep_id, r.group_size) for r in got} == set(keeps.items())
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.kept <= (r.doc_id == r.keep_id) for r in got)
    assert exact_dedup.exact_dedup(frame(spark, rows).limit(0)).count() == 0


def shingles(text, n=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_components(docs):
    sets = {i: shingles(t) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        common_ = defaultdict(int)
        for x in s:
            for j in holders[x]:
                common_[j] += 1
        for j, n in common_.items():
            if j < i and 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_op3_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in common.table(spark, MIDDLE, "documents").collect()]
    got = queries.op3_lsh_forest(spark, MIDDLE).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def edited(rng, words, share):
    return " ".join(rng.choice("uvwxyz") * 3 if rng.random() < share else w for w in words)


def test_op3_crowded_groups_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "REGION", 24)  # the driver's choice of regions to refine
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    rows = [(i, edited(rng, base, 0.03 * rng.random()), None) for i in range(120)]
    rows += [(200 + i, " ".join(base) + " " + " ".join(f"q{i}x{k}" for k in range(90)), None) for i in range(40)]
    rows += [(300, None, None), (301, "", None), (302, " \t\n", None), (303, "one two", None), (304, "ONE\ttwo", None),
             (305, "one two three", None), (306, "é É", None), (307, "É é", None), (308, " ".join(base), None)]
    got = lsh_forest.near_duplicates(frame(spark, rows)).collect()
    want = brute_components([(i, t) for i, t, _ in rows])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert lsh_forest.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_op3_null_and_repeated_ids(spark):
    long = "a b c d e f g h i j k l m n o p"
    rows = [(None, long, None), (5, long, None), (5, long, None), (None, "quite another text of words", None)]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in lsh_forest.near_duplicates(frame(spark, rows)).collect())
    assert got == [("5", "5", True), ("5", "5", True), ("None", "5", False), ("None", "None", True)]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(300, 299), (298, 300)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {298: 298, 299: 298, 300: 298}


def test_op5_held_out(spark):
    got = queries.op5_toxicity(spark, MIDDLE)
    labels = common.table(spark, MIDDLE, "labels")
    docs = common.table(spark, MIDDLE, "documents").count()
    rows = got.join(labels, "doc_id", "left").collect()
    assert len(rows) == docs and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.9


def test_op5_against_brute_force(spark):
    """Counts, selection, ratios and scores by Python sets; the fit by its optimum: at the
    weights that the penalised loss prefers, its slope is small in every direction."""
    import math
    docs, labels = common.table(spark, SMALL, "documents"), common.table(spark, SMALL, "labels")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    marks = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in texts}
    model = toxicity.train(docs, labels)

    def grams(text):
        t = text.lower().replace("\0", " ")
        return {t[i:i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)}

    held = {i: grams(texts[i]) for i in marks}
    counts = defaultdict(lambda: [0, 0])
    for i, found in held.items():
        for g in found:
            counts[g][marks[i]] += 1
    n1 = sum(marks.values())
    n0 = len(marks) - n1
    chi = {g: (q * n1 - p * n0) ** 2 for g, (q, p) in counts.items() if p + q >= toxicity.LEAST}
    kept = {}
    for g in chi:  # the operator's own hash names its features
        h = next(toxicity.ngrams([g], (len(g),)))[0][0]
        kept[int(h)] = g
    known = [kept[int(h)] for h in model.hashes]
    assert len(known) == min(toxicity.FEATURES, len(chi))
    p = np.array([counts[g][1] for g in known]) + toxicity.ALPHA
    q = np.array([counts[g][0] for g in known]) + toxicity.ALPHA
    ratios = np.log(p / p.sum() / (q / q.sum()))
    place = {g: k for k, g in enumerate(known)}
    weight = model.weights / np.where(ratios == 0, 1, ratios)
    x = np.zeros((len(marks), len(known)))
    for r, i in enumerate(held):
        x[r, [place[g] for g in held[i] if g in place]] = 1
    x *= ratios
    y = np.array([marks[i] for i in held], float)
    share = np.where(y == 1, 0.5 / n1, 0.5 / n0)

    def slope(w):
        bias = min(np.linspace(-8, 8, 321), key=lambda c: abs((share * (1 / (1 + np.exp(-(x @ w + c))) - y)).sum()))
        return np.linalg.norm(x.T @ (share * (1 / (1 + np.exp(-(x @ w + bias))) - y)) + toxicity.PENALTY * w)

    assert slope(weight) < 0.05 * slope(np.zeros(len(known)))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, text in texts.items():
        z = model.intercept + sum(model.weights[place[g]] for g in grams(text) if g in place)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=1e-9)


def test_op5_an_id_of_many_rows_teaches_once(spark):
    rows = [(i, f"mild text number {i} about trees", "en") for i in range(60)] + [(61, f"vile words {i}", "en") for i in range(500)]
    labels = spark.createDataFrame([(i, 0) for i in range(60)] + [(61, 1), (61, 1)], "doc_id long, toxic int")
    sample, sizes = toxicity.training_sample(frame(spark, rows), labels, 2500, 5, 0)
    assert sample.where("toxic = 1").count() == sizes.get(1, 0) == 1


def test_op5_learns_and_handles_odd_rows(spark):
    rng = random.Random(5)
    plain = ["the", "river", "garden", "stone", "walks", "idle", "moss"]
    rows = [(i, " ".join(rng.choice(plain) for _ in range(30)) + (" you scoundrel" if i % 5 == 1 else ""), None) for i in range(400)]
    rows += [(900, None, None), (901, "", None), (902, "x", None), (None, "You SCOUNDREL you", None), (903, "moss " * 30_000 + "scoundrel", None)]
    labels = spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(350)] + [(None, 1), (17, None), (9999, 1)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows)
    assert all(got[i].predicted == int(i % 5 == 1) for i in range(400))
    assert got[None].predicted == got[903].predicted == 1 and got[900].predicted == got[901].predicted == 0
    assert got[900].score == got[901].score
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got.values())
    for few, score in ((labels.where("toxic = 0"), 0.0), (labels.limit(0), 0.0), (labels.where("toxic = 1"), 1.0)):
        flat = toxicity.train(docs, few)
        assert {round(r.score, 6) for r in toxicity.score(docs, flat).collect()} == {score}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_op10_held_out(spark):
    docs = common.table(spark, MIDDLE, "documents").select("doc_id", "lang")
    rows = queries.op10_crf_language(spark, MIDDLE).join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in rows if r.held_out]) > 0.95


def test_op10_odd_rows(spark):
    rng = random.Random(3)
    words = {"aa": ["bola", "mira", "tola"], "bb": ["krek", "stup", "grond"]}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(40)), g) for i in range(200) for g in [("aa", "bb")[i % 2]]]
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "12 34 !!", "aa"), (503, "grond", None), (None, "mira, Tola!", None),
             (504, "bola " * 20_000 + "krek", None)]
    docs = frame(spark, rows)
    model = crf_lang.train(docs)
    got = {r.doc_id: r for r in crf_lang.identify(docs, model).collect()}
    assert all(got[i].lang_pred == ("aa", "bb")[i % 2] for i in range(200))
    assert [got[i].lang_pred for i in (500, 501, 502, 503, None, 504)] == ["und", "und", "und", "bb", "aa", "aa"]
    assert got[500].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert crf_lang.with_language(docs, model).count() == len(rows) - 3
    none = crf_lang.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in crf_lang.identify(docs, none).collect()} == {"und"}
    assert crf_lang.identify(docs.limit(0), model).count() == 0


def test_op10_words_of_code_switched_text():
    rng = random.Random(4)
    words = {0: ["bola", "mira", "tola", "sana"], 1: ["krek", "stup", "grond", "blitz"]}
    texts = [" ".join(rng.choice(words[k]) for _ in range(60)) for k in (0, 1) * 30]
    model = crf_lang.fit(texts, np.array([0, 1] * 30), ["aa", "bb"])
    spoken = [rng.choice(words[k]) for k in [0] * 25 + [1] * 25]
    gammas = np.zeros((50, 2))

    def keep(at, gamma):
        gammas[at] = gamma

    start = np.full(2, 0.5, np.float32)
    crf_lang.posteriors(model.emissions(spoken), np.array([50]), np.exp(model.moves).astype(np.float32), start, keep)
    assert (gammas.argmax(1) == [0] * 25 + [1] * 25).all()


def test_forward_backward_equals_plain_recursion():
    rng = np.random.default_rng(1)
    lengths, step, start = np.array([1, 32, 33, 20, 4, 97]), rng.random((3, 3)), np.full(3, 1 / 3)
    emit = rng.random((lengths.sum(), 3))
    sums, moves = crf_lang.posteriors(emit, lengths, step, start, lambda at, gamma: None)
    total, at = np.zeros((3, 3)), 0
    for k, n in enumerate(lengths):
        e, at = emit[at:at + n], at + n
        a, b = [start], [np.ones(3)]
        for t in range(n):
            a.append(a[-1] @ step * e[t])
            b.append(step @ (e[n - 1 - t] * b[-1]))
        b, z = b[::-1], a[-1].sum()
        assert np.allclose(sum(a[t + 1] * b[t + 1] / z for t in range(n)), sums[k])
        total += sum((np.outer(a[t], e[t] * b[t + 1]) * step / z for t in range(1, n)), np.zeros((3, 3)))
    assert np.allclose(total, moves)


def test_a_worker_keeps_one_operators_caches():
    first = common.kept("a", list)
    assert common.kept("a", list) is first
    assert common.kept("b", dict) == {} and list(common._KEPT) == ["b"]
    common.forget()
    assert not common._KEPT


def test_ngrams_handed_over_by_windows_add_up(spark):
    made = [(f"text {k % 7} of many", k % 2) for k in range(200)]
    rows = spark.createDataFrame(made, "text string, toxic int").coalesce(1)
    held: dict = {}
    for text, y in made:
        for gram in {int(x) for h, *_ in toxicity.ngrams([text], toxicity.ORDERS) for x in h.view(np.int64)}:
            held.setdefault(gram, [0, 0])[1 - y] += 1
    assert sorted(map(tuple, toxicity.ngram_counts(rows).collect())) == sorted((g, a, b) for g, (a, b) in held.items())
