"""k-NN exactness, SMOTE invariants, tree scorer parity, TreeSHAP additivity."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arrears.operators import knn, mlp, resample, trees
from arrears.operators.scoring import score_rows
from arrears.session import cut_lineage


def _points(spark, n=400, d=5, seed=11):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d))
    X[50:60] = X[0]                      # duplicates -> exact ties
    pdf = pd.DataFrame({"id": np.arange(n), "vec": [list(map(float, r)) for r in X],
                        "y": (rng.random(n) < 0.2).astype(int)})
    rows = [(int(i), v, int(y)) for i, v, y in zip(pdf.id, pdf.vec, pdf.y)]
    pdf["vec"] = list(X)
    return pdf, spark.createDataFrame(rows, "id long, vec array<double>, y int")


@pytest.mark.parametrize("rows", [16, 1024])
def test_knn_exact_vs_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(knn, "BLOCK_ROWS", rows)
    pdf, df = _points(spark)
    got = knn.knn(df.select("id", "vec"), 5).toPandas()
    X = np.stack(pdf.vec.to_numpy())
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    for i in range(len(X)):
        order = sorted((D[i, j], j) for j in range(len(X)) if j != i)[:5]
        g = got[got.id == i].sort_values("nn_rank")
        assert list(g.nn_id) == [j for _, j in order]


def test_knn_of_unequal_groups(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(2)
    sizes = {"a": 500, "b": 30, "c": 3, "d": 1}
    rows = [(g, i, rng.normal(size=4).tolist()) for g, n in sizes.items() for i in range(n)]
    got = knn.knn(spark.createDataFrame(rows, "g string, id long, vec array<double>"), 5, ["g"]).toPandas()
    for g, n in sizes.items():
        x = np.array([v for h, _, v in rows if h == g])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        for i in range(n):
            want = sorted((d[i, j], j) for j in range(n) if j != i)[:5]
            mine = got[(got.g == g) & (got.id == i)].sort_values("nn_rank")
            assert list(mine.nn_id) == [j for _, j in want]


def test_knn_lists_recall_and_work(spark):
    """Recall on all rows, pairs compared as counted, a hot vector, and a share of pairs that
    falls as the table grows."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 6)) * 5
    shares = []
    for n in (600, 2400):
        rows = [(f"r{i}", (centres[i % 60] + rng.normal(size=6) * 0.3).tolist() if i % 5 else centres[0].tolist()) for i in range(n)]
        df = spark.createDataFrame(rows, "id string, vec array<double>")
        lists = knn.fit_lists(df, 5)
        found = cut_lineage(knn.knn_lists(df, 5, lists=lists))
        r = knn.recall(knn.knn(df, 5), found).first()
        assert r.n_neighbours == 5 * n and r.recall >= 0.9
        some = knn.knn_lists(df, 5, lists=lists, queries=df.where("id in ('r1', 'r7')"))
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, found.where("id in ('r1', 'r7')").collect()))
        w = lists.work().first()
        home = {r.id: r.home for r in lists.rows.collect()}
        size = {h: sum(v == h for v in home.values()) for h in set(home.values())}
        pairs = sum(size.get(c, 0) for r in lists.rows.collect() for c in r.near)
        assert w.n_rows == n and w.pair_share == pytest.approx(pairs / n / n)
        shares.append((w.n_lists, w.probes))
    assert shares[1][0] > 1.5 * shares[0][0]
    assert knn.knn_lists(df.limit(0), 5).count() == 0


def test_smote_of_a_tiny_class_loses_no_copy(spark):
    rows = [(i, [float(i), 1.0], int(i < 3)) for i in range(23)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, y int")
    assert resample.smote(df).count() == 17
    with pytest.raises(ValueError):
        resample.smote(df.filter("id = 0 or y = 0"))


def test_smote_balances_and_stays_between(spark):
    pdf, df = _points(spark)
    syn = resample.smote(df, k=3).toPandas()
    n_min, n_maj = int(pdf.y.sum()), int((1 - pdf.y).sum())
    assert len(syn) == n_maj - n_min
    X = dict(zip(pdf.id, pdf.vec))
    for r in syn.head(50).itertuples():
        a, b = X[r.source_id], X[r.nn_id]
        assert np.allclose(r.vec, a + r.u * (b - a))
        assert pdf.loc[pdf.id == r.nn_id, "y"].item() == 1


@pytest.mark.parametrize("kind,depth", [("gbt", 3), ("rf", 4), ("rf", 9)])
def test_tree_scorer_equals_mllib(spark, kind, depth):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(800, 4))
    y = ((X[:, 0] + 0.5 * X[:, 1] * X[:, 2]) > 0).astype(int)
    pdf = pd.DataFrame(X, columns=list("abcd")).assign(y=y, rid=np.arange(800), w=1.0 + y)
    df = spark.createDataFrame(pdf)
    feats = list("abcd")
    m = trees.train(df, feats, kind=kind, weight_col="w", n_trees=6, max_depth=depth)
    nodes = cut_lineage(trees.node_table(spark, m, kind))
    ours = trees.score(df, nodes, feats, ["rid"], link=trees.LINKS[kind]).toPandas().sort_values("rid")
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    ml = m.transform(VectorAssembler(inputCols=feats, outputCol="_features").transform(df)) \
        .select("rid", vector_to_array("probability")[1].alias("p")).toPandas().sort_values("rid")
    assert np.allclose(ours.probability.to_numpy(), ml.p.to_numpy(), atol=1e-12)
    if kind == "gbt":  # covers are the rows that reach a node; forests count their own bootstrap samples
        walk = nodes.toPandas().set_index(["tree", "node"])
        for (tree, node), r in walk.iterrows():
            if node == 0:
                counts = {0: np.ones(800, bool)}
                stack = [0]
                while stack:
                    i = stack.pop()
                    n = walk.loc[(tree, i)]
                    assert counts[i].sum() == n.cover
                    if n.left >= 0:
                        left = X[:, int(n.feature)] < n.threshold
                        counts[int(n.left)], counts[int(n.right)] = counts[i] & left, counts[i] & ~left
                        stack += [int(n.left), int(n.right)]
        c = trees.contributions(df, nodes, feats, "rid")
        per = c.groupBy("rid").agg(F.count("value").alias("n"), F.sum("value").alias("s")).toPandas().sort_values("rid")
        assert set(per.n) == {5}  # a row for every feature, zeros too, and the base
        margin = np.log(ours.probability / (1 - ours.probability)).to_numpy()
        assert np.allclose(per.s.to_numpy(), margin, atol=1e-9)


def random_nodes(rng, n_trees, depth, features):
    rows = []
    for tree in range(n_trees):
        nodes = []

        def grow(level, cover):
            i = len(nodes)
            nodes.append(None)
            if level == depth or cover < 4 or rng.random() < 0.2:
                nodes[i] = (tree, i, -1, -1, -1, 0.0, 1, float(rng.normal()), cover)
                return i
            left = int(rng.integers(1, cover))
            f, thr, d = int(rng.integers(0, features)), float(np.round(rng.normal(), 1)), int(rng.integers(0, 2))
            a, b = grow(level + 1, left), grow(level + 1, cover - left)
            nodes[i] = (tree, i, a, b, f, thr, d, 0.0, cover)
            return i

        grow(0, 100)
        rows += nodes
    return pd.DataFrame(rows, columns=["tree", "node", "left", "right", "feature", "threshold", "default_left", "value", "cover"])


@pytest.mark.parametrize("depth", [2, 5, 8])
def test_walk_and_contributions_against_brute_force(depth):
    """Missing values and defaults, thresholds met exactly, uneven trees; contributions equal
    the Shapley values of the path-dependent expectation over all subsets of features."""
    import itertools
    import math
    rng = np.random.default_rng(depth)
    nodes = random_nodes(rng, 5, depth, 4)
    X = np.round(rng.normal(size=(40, 4)), 1)
    X[rng.random(X.shape) < 0.15] = np.nan
    forest = trees.Forest(nodes)

    def expect(tree, i, x, known):
        n = tree.loc[i]
        if n.left < 0:
            return n.value
        left, right = int(n.left), int(n.right)
        f = int(n.feature)
        if f in known:
            go = bool(n.default_left) if np.isnan(x[f]) else x[f] < n.threshold
            return expect(tree, left if go else right, x, known)
        return (tree.loc[left].cover * expect(tree, left, x, known) + tree.loc[right].cover * expect(tree, right, x, known)) / n.cover

    parts = [g.set_index("node") for _, g in nodes.groupby("tree")]
    total = [sum(expect(t, 0, x, set(range(4))) for t in parts) for x in X]
    assert np.allclose(forest.total(X), total)
    phi = trees.Paths(forest, 0.0).contributions(X)
    for x, own in zip(X[:12], phi):
        v = {s: sum(expect(t, 0, x, set(s)) for t in parts) for k in range(5) for s in itertools.combinations(range(4), k)}
        for f in range(4):
            rest = [s for s in v if f not in s]
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (v[tuple(sorted((*s, f)))] - v[s]) for s in rest)
            assert own[f] == pytest.approx(want, abs=1e-9)
        assert own[4] == pytest.approx(v[()], abs=1e-9)


def test_top_contributions_within_the_row(spark):
    df = spark.createDataFrame([(1, [0.1, -0.5, 0.0, 0.5]), (2, [0.0, 0.0, 0.0, 0.0])], "rid long, phi array<double>")
    got = {r.rid: [(t.feature, t.value) for t in r.top] for r in trees.top_contributions(df, list("abcd"), 2).collect()}
    assert got[1] == [("d", 0.5), ("b", -0.5)] and len(got[2]) == 2


def test_network_forward_equals_plain_layers(spark):
    """Scaling, clipped embeddings, GELU, residual blocks and the logit, one row at a time."""
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.normal()), float(rng.normal() * 3 + 1), int(rng.integers(-2, 9)), int(rng.integers(0, 3))) for i in range(40)]
    rows.append((99, float("nan"), float("inf"), 4, 1))
    df = spark.createDataFrame(rows, "rid long, a double, b double, code_x int, code_y int")
    m = mlp.network(df.filter("rid < 99"), ["a", "b"], ["code_x", "code_y"], [5, 3], hidden=7, n_blocks=2)
    got = {r.rid: r.probability for r in mlp.score(df, m, ["rid"]).collect()}
    for rid, a, b, x, y in rows:
        h = [(v - mu) / sd if np.isfinite(v) else 0.0 for v, mu, sd in zip((a, b), m["scaler_mean"], m["scaler_scale"])]
        h = np.array(h + list(m["emb"][0][min(max(x, 0), 4)]) + list(m["emb"][1][min(max(y, 0), 2)]))
        h = mlp.gelu(m["in_w"] @ h + m["in_b"])
        for w, bias in m["blocks"]:
            h = mlp.gelu(w @ h + bias) + h
        assert got[rid] == pytest.approx(1 / (1 + np.exp(-(m["out_w"] @ h + m["out_b"])[0])), abs=1e-12)


def test_perceptron_learns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    df = spark.createDataFrame([(*map(float, r), int(r[0] + r[1] > 0)) for r in x], "a double, b double, c double, y int")
    model = mlp.train_perceptron(df, ["a", "b", "c"], hidden=(8,), steps=40)
    rows = mlp.perceptron_score(df, model, ["y"]).collect()
    assert np.mean([(r.probability > 0.5) == r.y for r in rows]) > 0.93
    # one pass with another model beside it gives the same probabilities
    keep = df.withColumn("rid", F.monotonically_increasing_id())
    ours = {r.rid: r.p for r in score_rows(keep, {"p": mlp.PerceptronScorer(model), "q": mlp.PerceptronScorer(model)}, list("abc"), ["rid"]).collect()}
    assert all(ours[r.rid] == pytest.approx(r.probability, abs=1e-12) for r in mlp.perceptron_score(keep, model, ["rid"]).collect())
