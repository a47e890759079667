"""Distributed order statistics and running sums vs pandas / numpy."""

import numpy as np
import pandas as pd

from arrears.operators import ordered


def test_exact_quantiles_with_narrowing(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=3000), np.full(500, 0.25), rng.integers(0, 5, 500).astype(float)])
    df = spark.createDataFrame(pd.DataFrame({"v": x}))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    # a tiny fetch limit forces the sketch-bracket narrowing loop
    import arrears.operators.ordered as o
    old = o.MAX_FETCH
    o.MAX_FETCH = 50
    try:
        got = ordered.exact_quantiles(df, "v", probs)
    finally:
        o.MAX_FETCH = old
    want = np.quantile(x, probs)
    assert np.allclose(got, want, rtol=0, atol=1e-12)


def test_grouped_quantiles(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 2000), "v": rng.integers(0, 50, 2000).astype(float)})
    df = spark.createDataFrame(pdf)
    got = ordered.grouped_quantiles(df, ["g"], "v", [0.25, 0.5, 0.75], accuracy=50).toPandas().sort_values("g")
    want = pdf.groupby("g")["v"].quantile([0.25, 0.5, 0.75]).unstack()
    assert np.allclose(got[["q0", "q1", "q2"]].to_numpy(), want.to_numpy())


def test_grouped_quantiles_narrow_in_rounds(spark, monkeypatch):
    """Brackets of a few rows: hot values, a hot group, groups of one row, a null group,
    infinities; two joins (broadcast or not) give the same."""
    monkeypatch.setattr(ordered, "MAX_RANKED", 8)
    monkeypatch.setattr(ordered, "PIECES", 4)
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=900), np.full(700, 0.5), rng.integers(0, 3, 300).astype(float), [np.inf, -np.inf], np.arange(98.0)])
    g = [None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 7}" for i in range(len(v))]
    g[-1] = "single"
    rows = [(a, float(b), "x") for a, b in zip(g, v)] + [("hot", None, "x"), ("hot", float("nan"), "x")]
    df = spark.createDataFrame(rows, "g string, v double, h string")
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    pdf = pd.DataFrame({"g": g, "v": v})
    for few in (100_000, 0):
        monkeypatch.setattr(ordered, "BROADCAST_BRACKETS", few)
        got = {r.g: list(r)[2:] for r in ordered.grouped_quantiles(df, ["g", "h"], "v", probs, accuracy=100).collect()}
        assert set(got) == set(g)
        for k in got:
            own = np.sort(pdf.v[pdf.g.isna() if k is None else pdf.g == k].to_numpy())
            for p, q in zip(probs, got[k]):
                pos = p * (len(own) - 1)
                a, b = own[int(pos)], own[min(int(pos) + 1, len(own) - 1)]
                if np.isfinite([a, b]).all():
                    assert q == ordered.lerp(a, b, pos - int(pos))


def test_prefix_sums_and_next(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"p": rng.integers(0, 3, 900), "s": rng.normal(size=900), "c": rng.integers(1, 5, 900)})
    pdf = pdf.drop_duplicates(["p", "s"])
    df = spark.createDataFrame(pdf)
    for desc in (False, True):
        got = ordered.prefix_sums(df, "s", ["c"], partition_cols=["p"], descending=desc, n_buckets=7).toPandas()
        want = pdf.sort_values(["p", "s"], ascending=[True, not desc])
        want["c_cum"] = want.groupby("p")["c"].cumsum()
        m = got.merge(want, on=["p", "s"], suffixes=("", "_w"))
        assert len(m) == len(pdf) and (m["c_cum"] == m["c_cum_w"]).all()
    nxt = ordered.with_next(df, "s", ["c"], partition_cols=["p"], n_buckets=5).toPandas()
    w = pdf.sort_values(["p", "s"])
    w["c_next"] = w.groupby("p")["c"].shift(-1)
    m = nxt.merge(w, on=["p", "s"], suffixes=("", "_w"))
    assert ((m["c_next"].isna() & m["c_next_w"].isna()) | (m["c_next"] == m["c_next_w"])).all()
