"""What the large runs showed: queries stage and shuffle no more than they read."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.operators import features as feat
from arrears.operators import fit as fitmod
from arrears.operators import ordered
from arrears.plans import base as plans
from arrears.session import checkpoint_dir


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Sixty invoices of eight customers in tables of their own."""
    d = str(tmp_path_factory.mktemp("tables"))
    day = dt.datetime(1997, 1, 1)
    made = {
        "region": ("r_regionkey long, r_name string", [(0, "NORTH"), (1, "SOUTH")]),
        "nation": ("n_nationkey long, n_name string, n_regionkey long", [(0, "A", 0), (1, "B", 1), (2, "C", 1)]),
        "customer": ("c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string",
                     [(i, f"c{i}", i % 3, 0.0, ("BUILDING", "TOYS")[i % 2]) for i in range(8)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey long, s_acctbal double", [(i, f"s{i}", i % 3, 0.0) for i in range(4)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size long, p_retailprice double",
                 [(i, f"p{i}", f"Brand#{i % 3}", ("PROMO", "LARGE", "ECONOMY")[i % 3], i % 4, 1.0) for i in range(7)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
                   [(i, i % 8, "O", 1.0, day + dt.timedelta(days=i), ("5-LOW", "4-NOT SPECIFIED")[i % 2]) for i in range(30)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
                     [(i // 2, i % 7, i % 4, i % 2 + 1, 1.0, float(100 + 7 * (i % 23)), .1, .0, "N", "O", day + dt.timedelta(days=i // 2 + 11 * (i % 7)))
                      for i in range(60)]),
    }
    for name, (schema, rows) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def _joins(df: DataFrame) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter")


@pytest.mark.parametrize("mode", ["offline", "online"])
@pytest.mark.parametrize("limit", [500_000, 0])
def test_named_features_are_those_of_the_whole_row(spark, tables, mode, limit, monkeypatch):
    """Any subset has the values it has among all 69, by broadcast and by shuffled look-ups,
    and looks up only what it names."""
    monkeypatch.setattr(fitmod, "BROADCAST_MAX_KEYS", limit)
    rows, fitted = plans.base(spark, tables), plans.fitted(spark, tables)
    whole = {tuple(r[k] for k in plans.KEYS): r for r in feat.transform(rows, fitted, mode).collect()}
    assert len(whole) > 30
    for names in (plans.SCORED, ["amount_pct"], ["code_salesperson", "te_salesperson"], ["freq_sales_div", "cust_late_rate"], feat.FEATURES[7:40]):
        part = feat.transform(rows, fitted, mode, names)
        assert [c for c in part.columns if c in feat.FEATURES and c not in rows.columns] == [f for f in feat.FEATURES if f in names]
        got = part.collect()
        assert len(got) == len(whole)
        for r in got:
            other = whole[tuple(r[k] for k in plans.KEYS)]
            assert all(r[f] == other[f] for f in names)
    assert _joins(feat.transform(rows, fitted, mode, ["te_city"])) == 1
    with pytest.raises(ValueError):
        feat.transform(rows, fitted, mode, ["te_cities"])


def test_single_passes_stage_no_feature_rows(spark, tables):
    """A query of one pass writes neither the feature rows nor, without a fit, the invoices."""
    from arrears.plans import registry
    import arrears.plans.catalog  # noqa: F401
    plans._BASES.clear()
    folder = os.path.join(checkpoint_dir(spark).removeprefix("file:"), "tables")
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    registry.QUERIES["a48_class_balance"](spark, tables).collect()
    assert set(os.listdir(folder)) == before
    for name in ("a07_smoothed_target_mean", "a22_roc_auc", "a44_batch_summary", "f06_amount_ratios", "a18_feature_bounds", "w01_amount_percentile"):
        registry.QUERIES[name](spark, tables).collect()
    for t in set(os.listdir(folder)) - before:
        assert len(spark.read.parquet(os.path.join(folder, t)).columns) < 40


@pytest.mark.parametrize("limit", [500_000, 0])
def test_aggregated_features_shuffle_what_their_look_up_reads(spark, tables, limit, monkeypatch):
    """Bounds and scaler take the features in groups of one shuffled look-up at most; their figures
    are those of the whole rows."""
    from arrears.plans import catalog_models, registry
    import arrears.plans.catalog  # noqa: F401
    rows, fitted = plans.base(spark, tables), plans.fitted(spark, tables)
    whole = feat.model_matrix(feat.transform(rows, fitted).where("split = 'train'")).toPandas()
    monkeypatch.setattr(fitmod, "BROADCAST_MAX_KEYS", limit)
    monkeypatch.setattr(plans, "_FEATS", {})
    groups = feat.shuffle_groups(fitted, feat.FEATURES)
    assert sorted(f for g in groups for f in g) == sorted(feat.FEATURES) and ["amount_pct"] in groups
    assert len(groups) == (2 if limit else 17)  # all others; or those without a look-up and 15 keys
    if not limit:  # a plan per group; the queries below take a few of them
        assert all(_joins(feat.transform(rows, fitted, "offline", g)) <= 1 for g in groups)
        some = ["amount", "amount_pct", "amount_cust_zscore", "cust_late_rate", "te_sales_div"]
        monkeypatch.setattr(catalog_models, "FEATURES", [*some, "code_city"])
        monkeypatch.setattr(catalog_models, "CONT_FEATURES", some)
    groups = feat.shuffle_groups(fitted, catalog_models.FEATURES)
    asked = []
    inner = catalog_models.featurized
    monkeypatch.setattr(catalog_models, "featurized", lambda *a, **k: asked.append(k["features"]) or inner(*a, **k))
    got = [r.asDict() for r in registry.QUERIES["a18_feature_bounds"](spark, tables).collect()]
    assert asked == groups and [r["feature"] for r in got] == catalog_models.FEATURES
    assert all(r["min"] == whole[r["feature"]].min() and r["max"] == whole[r["feature"]].max() for r in got)
    got = registry.QUERIES["a55_scaler_fit"](spark, tables).collect()
    assert [r.feature for r in got] == catalog_models.CONT_FEATURES and len(asked) > len(groups)
    for r in got:
        assert r["mean"] == pytest.approx(whole[r.feature].mean())
        assert r["scale"] == pytest.approx(whole[r.feature].std(ddof=0) or 1.0, abs=1e-9)


def test_staged_tables_leave_no_shuffle_files(spark):
    """The shuffle files of a staged table's plan are gone when it is written; the setting is as before."""
    from arrears import session

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in str(found.mkString(" ")).split() if "shuffle_" in f}

    before, conf = files(), spark.conf.get(session.DROP_SHUFFLES, None)
    df = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    staged = session.cut_lineage(df)
    assert files() <= before
    assert spark.conf.get(session.DROP_SHUFFLES, None) == conf
    assert sorted(map(tuple, staged.collect())) == sorted(map(tuple, df.collect()))


def test_bootstrap_salts_only_ties_of_many_rows(spark, monkeypatch):
    """A tie is dealt over tasks by its own rows, not by the table's; results do not depend on it."""
    from arrears.operators import compare
    calls = spark.sparkContext.accumulator(0)
    inner = compare._bucket_totals

    def counted(*a):
        run = inner(*a)

        def call(t):
            calls.add(1)
            return run(t)
        return call

    monkeypatch.setattr(compare, "_bucket_totals", counted)
    rows = spark.range(60_000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3 == 0).cast("int").alias("y"),
                                      ((F.col("id") * 7919) % 2003 / 2003).alias("score_a"), ((F.col("id") * 31) % 1999 / 1999).alias("score_b"))
    one = compare.bootstrap(rows, F.col("id"), n_boot=3).collect()
    few, buckets = calls.value, 2 * (2 * 31 + 1)
    assert 2 * 32 <= few <= buckets
    monkeypatch.setattr(compare, "TIE_ROWS", 10)
    other = compare.bootstrap(rows, F.col("id"), n_boot=3).collect()
    assert calls.value - few > buckets
    assert [r.model for r in sorted(one)] == ["a", "b"]
    for r, s in zip(sorted(one), sorted(other)):
        assert tuple(r)[:1] == tuple(s)[:1] and tuple(r)[1:] == pytest.approx(tuple(s)[1:])


def test_fit_caches_no_rows_and_aggregates_once(spark, tables, monkeypatch):
    """The training rows are read as staged, not copied into the executors' caches."""
    train = plans.base(spark, tables).filter("split = 'train'")
    monkeypatch.setattr(DataFrame, "persist", lambda *a: pytest.fail("rows were cached"))
    monkeypatch.setattr(type(train), "persist", lambda *a: pytest.fail("rows were cached"))
    asked = []
    inner = fitmod.stacked
    monkeypatch.setattr(fitmod, "stacked", lambda df: asked.append(1) or inner(df))
    f = fitmod.fit(train)
    assert asked == [1] and "lookup" not in f.dims.columns
    got = {r.key: r for r in f.dims.where("dim = 'division'").collect()}
    want = train.groupBy("division").agg(F.count(F.lit(1)).alias("n"), F.expr("median(amount)").alias("m")).collect()
    assert want and all(got[r.division].n == r.n and got[r.division].median == pytest.approx(r.m) for r in want)


def test_ranks_share_their_bracket(spark, monkeypatch):
    """Ranks of one bracket are sketched once; the statistics stay exact, with ties and nulls as keys."""
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=3000), np.full(900, .25), rng.integers(0, 5, 300)])
    sketches = []
    real = F.percentile_approx
    monkeypatch.setattr(ordered.F, "percentile_approx", lambda *a: sketches.append(1) or real(*a))
    x = spark.createDataFrame([(float(a),) for a in v], "x double")
    ranks = [0, 41, 42, 2100, 2101, 4199]
    got = ordered.order_statistics(x, len(v), ranks, rel_err=.01, max_fetch=4000)
    assert [got[k] for k in ranks] == [float(np.sort(v)[k]) for k in ranks]
    assert sketches == [1]
    monkeypatch.setattr(ordered, "MAX_RANKED", 20)
    keyed = spark.createDataFrame([((None, "a", "b")[i % 3], float(a)) for i, a in enumerate(v)], "k string, x double")
    out = {r.k: r for r in ordered.grouped_quantiles(keyed, ["k"], "x", [.5, .03]).collect()}
    for j, k in enumerate((None, "a", "b")):
        assert out[k].q0 == pytest.approx(np.quantile(v[j::3], .5)) and out[k].q1 == pytest.approx(np.quantile(v[j::3], .03))


def test_seeds_share_passes_and_count_in_bounded_tasks(spark, tables, monkeypatch):
    """Scores of all seeds follow each seed's own split, fit and bins, a missing amount included; rows
    are dealt over tasks by their number before they are copied per seed."""
    from arrears.operators import experiment
    from arrears.operators.split import split_expr
    rows = plans.base(spark, tables).withColumn("amount", F.when(F.col("line_no") * F.col("order_key") != 6, F.col("amount")))
    monkeypatch.setattr(experiment, "SCORED_ROWS", 4)
    dealt = []
    for kind in {DataFrame, type(rows)}:
        monkeypatch.setattr(kind, "repartition", lambda df, *a, inner=kind.repartition: dealt.append(a) or inner(df, *a))
    seeds = [3, 4, 7]
    got = {(r.seed, r.model, round(r.score, 9)): (r.pos, r.neg) for r in experiment.seed_score_counts(rows, seeds).collect()}
    assert max(n for n, *_ in dealt) >= rows.count() / 4
    want = {}
    for seed in seeds:
        every = [r.asDict() for r in rows.withColumn("s", split_expr(F.col("customer"), seed)).collect()]
        train = [r for r in every if r["s"] == "train"]
        rate = sum(r["is_late"] for r in train) / len(train) if train else 0.0
        amounts = [r["amount"] for r in train if r["amount"] is not None]
        edges = np.quantile(amounts, [.25, .5, .75]) if amounts else None
        for r in every:
            a = r["amount"]
            r["bin"] = 0 if edges is None else 3 if a is None else int((a > edges).sum())

        def te(r, dim):
            own = [t["is_late"] for t in train if t[dim] == r[dim]]
            return (sum(own) + 20 * rate) / (len(own) + 20) if own else rate

        for r in (r for r in every if r["s"] == "test"):
            scores = {"a": sum(te(r, d) for d in ("salesperson", "division", "city")) / 3, "b": (te(r, "customer_group") + te(r, "bin")) / 2}
            for m, s in scores.items():
                p, n = want.get((seed, m, round(s, 9)), (0, 0))
                want[seed, m, round(s, 9)] = (p + r["is_late"], n + 1 - r["is_late"])
    assert want and got == want


def test_ranking_stages_the_counts_once(spark, monkeypatch):
    """The collapsed scores are one table, whatever reads them: groups' totals are not counted again from the rows."""
    from arrears.operators import evaluate as ev
    staged = []
    for module in (ev, ordered):
        monkeypatch.setattr(module, "cut_lineage", lambda df, inner=module.cut_lineage: staged.append(df.columns) or inner(df))
    scored = spark.createDataFrame([("a", i % 2, (i % 7) / 7) for i in range(40)], "model string, y int, score double")
    out = ev.metric_row(scored, 0.5, by=["model"]).first()
    assert staged == [["model", "score", "pos", "neg"]]
    rows = scored.collect()
    pairs = [(p.score > n.score) + (p.score == n.score) / 2 for p in rows for n in rows if p.y == 1 and n.y == 0]
    assert out.auc == pytest.approx(sum(pairs) / len(pairs))


def test_stream_keeps_the_features_it_is_asked_for(spark, tables, tmp_path):
    """Sinks of a stream that names its scorer's features hold no others; scores are the same."""
    from arrears.sources import batch
    from arrears.streaming import scoring
    source, fitted = str(tmp_path / "in"), plans.fitted(spark, tables)
    plans.base(spark, tables).select(*plans.KEYS, *[F.col(c).alias(h) for c, h in batch.UPLOAD_HEADER.items()],
                                     F.date_format("invoice_date", "d/M/yyyy").alias("tanggal")).write.option("header", True).csv(source)
    keys = [*plans.KEYS, "score_a", "score_b"]
    got = []
    for name, features in (("all", None), ("some", plans.SCORED)):
        out = scoring.run(spark, source, fitted, plans.scorecards, name, root=str(tmp_path / name), watermark="3650 days", features=features)
        rows = spark.read.parquet(f"{out}/accepted")
        held = [f for f in feat.FEATURES if f in rows.columns and f != "amount"]
        assert held == [f for f in feat.FEATURES if f != "amount" and (features is None or f in features)]
        got.append(sorted(map(str, rows.select(*keys).collect())))
    assert got[0] and got[0] == got[1]


def test_records_are_parsed_once_whatever_reads_their_cells(spark, tmp_path):
    """Conditions on many cells are not moved below the parser, where each cell would parse the record again."""
    from arrears.sources import batch
    names = [h for h in batch.UPLOAD_HEADER.values()]
    good = dict.fromkeys(names, "x") | {"jumlah": "5"}
    lines = [",".join(r[n] for n in names) for r in (good, good | {"jumlah": "0"}, good | {"kota": ""}, good)] + ["x,y"]
    (tmp_path / "a.csv").write_text("\n".join([",".join(names), *lines]) + "\n")
    up = batch.validate(batch.coerce(batch.read_upload(spark, str(tmp_path))), strict=True).where("error is not null")
    assert up._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1
    assert sorted(r.error for r in up.collect()) == ["amount must be > 0", "city is empty", "wrong number of cells"]


def test_neighbour_tasks_read_few_units(spark, monkeypatch):
    """The blocks' pairs grow with the square of the table; so does the number of tasks, not what one reads."""
    from arrears.operators import knn
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3)).round(1)
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    plain = sorted(map(tuple, knn.knn(points, 4).select("id", "nn_id", "nn_rank").collect()))
    monkeypatch.setattr(knn, "SMALL_BLOCK", 10)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 10)
    monkeypatch.setattr(knn, "TASK_UNITS", 2)
    dealt = []
    for kind in {DataFrame, type(points)}:
        monkeypatch.setattr(kind, "repartition", lambda df, *a, inner=kind.repartition: dealt.append(a) or inner(df, *a))
    assert sorted(map(tuple, knn.knn(points, 4).select("id", "nn_id", "nn_rank").collect())) == plain
    assert [n for n, *_ in dealt] == [41]


@pytest.fixture
def dealt(spark, tables, monkeypatch):
    """The same tables with rows in every split."""
    from arrears import constants as K
    from arrears.plans import catalog_models
    from arrears.sources.tables import version
    for kept in ("_BASES", "_FITS", "_FEATS"):
        monkeypatch.setattr(plans, kept, {})
    monkeypatch.setattr(catalog_models, "_MODELS", {})
    split = F.array(F.lit("train"), F.lit("val"), F.lit("test"))[(F.col("order_key") % 3).cast("int")]
    plans._BASES[version(spark, tables), K.FIXTURE_SEED] = plans.base(spark, tables).withColumn("split", split)
    return tables


@pytest.mark.parametrize("name", ["m01_tree_walk", "m03_additivity", "m02_tiny_network"])
def test_small_models_stage_no_feature_rows(spark, dealt, name):
    """A stated small model reads the features that it names, and no feature row is written for it."""
    from arrears.plans import registry
    import arrears.plans.catalog  # noqa: F401
    plans.fitted(spark, dealt)
    folder = os.path.join(checkpoint_dir(spark).removeprefix("file:"), "tables")
    before = set(os.listdir(folder))
    lean = sorted(map(tuple, registry.QUERIES[name](spark, dealt).collect()))
    assert set(os.listdir(folder)) == before and not plans._FEATS and lean
    plans.featurized(spark, dealt)
    assert sorted(map(tuple, registry.QUERIES[name](spark, dealt).collect())) == lean


def test_queries_wait_for_the_models_that_they_name(spark, dealt, monkeypatch):
    """A query fits its own models, once; the network of seeded weights needs none of them."""
    from arrears.operators import mlp, trees
    from arrears.plans import registry
    import arrears.plans.catalog  # noqa: F401
    fits = []
    monkeypatch.setattr(trees, "train", lambda *a, kind, inner=trees.train, **k: fits.append(kind) or inner(*a, kind=kind, **k))
    monkeypatch.setattr(mlp, "train_perceptron", lambda *a, inner=mlp.train_perceptron, **k: fits.append("mlp") or inner(*a, **k))
    for name, fitted in (("m02_mlp_scores", []), ("m01_tree_scores", ["gbt"]), ("m03_tree_contributions", ["gbt"]),
                         ("m12_perceptron", ["gbt", "mlp"]), ("m11_tree_importances", ["gbt", "mlp", "rf"])):
        assert registry.QUERIES[name](spark, dealt).count() > 0
        assert fits == fitted


@pytest.mark.parametrize("kind", ["long", "string"])
def test_neighbours_by_cells_are_those_of_the_blocks(spark, monkeypatch, kind):
    """The same neighbours in the same order, ties, copies and own ids included, for all rows and for some
    of them; rows that repeat go by blocks; cells that cannot hold a nearer row are not read."""
    from arrears.operators import knn
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(20, 4))[rng.integers(0, 20, 700)] * 40 + rng.integers(0, 4, (700, 4)), np.zeros((60, 4))])
    rows = [(i if kind == "long" else f"r{i}", [float(v) for v in r]) for i, r in enumerate(x)]
    points = spark.createDataFrame(rows, f"id {kind}, vec array<double>")
    twice = spark.createDataFrame(rows + rows[:9], f"id {kind}, vec array<double>")
    some = points.where(F.col("id").isin([r[0] for r in rows[::7]])).withColumn("vec", F.transform("vec", lambda v: v + 1))
    want = [sorted(map(tuple, knn.knn(p, 6, candidates=points).collect())) for p in (points, some)]
    repeated = sorted(map(tuple, knn.knn(twice, 6).collect()))
    assert len(want[0]) == 6 * 760
    monkeypatch.setattr(knn, "CELL_PAIRS", 1)
    monkeypatch.setattr(knn, "PIECE_ROWS", 16)
    monkeypatch.setattr(knn, "GROUP_ROWS", 8)
    monkeypatch.setattr(knn, "VISIT_ROWS", 20)
    assert sorted(map(tuple, knn.knn(twice, 6).collect())) == repeated
    monkeypatch.setattr(knn, "_search", None)
    assert sorted(map(tuple, knn.knn(points, 6).collect())) == want[0]
    assert sorted(map(tuple, knn.knn(points, 6, candidates=points).collect())) == want[0]
    assert sorted(map(tuple, knn.knn(some, 6, candidates=points).collect())) == want[1]
    c = np.array([[0.0], [10.0], [100.0]])
    read, ids = [], [np.arange(5 * i, 5 * i + 5) for i in range(3)]
    held = [knn.pa.RecordBatch.from_arrays([knn.pa.array(n), knn.pa.FixedSizeListArray.from_arrays(knn.pa.array(v + n / 10.0), 1), knn.pa.array((v + n / 10.0) ** 2)],
                                           names=["id", "vec", "norm"]) for n, v in zip(ids, (0.0, 10.0, 100.0))]
    got = knn._nearest(np.array([[0.0]]), knn.pa.array([0]), 0, c, (c * c).sum(1), np.arange(3), np.full(3, 5), np.array([.4, .9, 1.4]),
                       lambda i: read.append(i) or held[i], 3, 5)
    assert read == [0]
    assert got["nn_id"].to_pylist() == [1, 2, 3]


def test_masked_quantiles_are_exact_and_sketch_once(spark, monkeypatch):
    """Every bit's quantiles are numpy's, many equal and missing values included, from one sketch."""
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.lognormal(size=900), np.full(600, 1.25), [0.0, 9.5]])
    mask = rng.integers(0, 8, len(v)) * 2  # nothing has bit 0
    rows = spark.createDataFrame([(float(a), int(m)) for a, m in zip(v, mask)] + [(None, 15), (float("nan"), 15)], "amount double, m long")
    sketched = []
    monkeypatch.setattr(ordered, "boundaries", lambda *a, inner=ordered.boundaries: sketched.append(1) or inner(*a))
    got = ordered.masked_quantiles(rows, "m", 4, "amount", [0.25, 0.5, 0.9], accuracy=320)
    assert len(sketched) == 1 and got[0] == [None] * 3
    for i in (1, 2, 3):
        assert got[i] == [float(q) for q in np.quantile(v[(mask >> i & 1) == 1], [0.25, 0.5, 0.9])]


def test_a_customer_is_hashed_once(spark, tables):
    """Masks are those of the rows' own splits, a missing customer's too, from as many hashed rows as customers."""
    from arrears.operators import experiment
    from arrears.operators.split import split_expr
    rows = plans.base(spark, tables).withColumn("customer", F.when(F.col("customer") != "3", F.col("customer")))
    got = experiment.placed(rows, [3, 4, 7], ["train", "val", "test"], ["order_key", "line_no", "customer"])
    for r in got.join(rows.select("order_key", "line_no", *[split_expr(F.col("customer"), s).alias(f"s{s}") for s in (3, 4, 7)]),
                      ["order_key", "line_no"]).collect():
        for split in ("train", "val", "test"):
            assert r[split] == sum(1 << i for i, s in enumerate((3, 4, 7)) if r[f"s{s}"] == split)
    assert got.count() == rows.count()
    assert "md5" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_seeds_leave_their_counts_only(spark, tables):
    """What a seed trains on is removed with it."""
    from arrears.operators import training
    from arrears.operators.clean import late_flag
    clean = plans.base(spark, tables).withColumn("id", F.concat_ws("-", *plans.KEYS))
    group = training.Seeds(clean, late_flag("age_days", 630), [3])
    group.rare()
    folder = os.path.join(checkpoint_dir(spark).removeprefix("file:"), "tables")
    before = set(os.listdir(folder))
    counts = group.counts(0, dict(n_trees=1, max_depth=2), 2)
    kept = [set(spark.read.parquet(os.path.join(folder, t)).columns) for t in set(os.listdir(folder)) - before]
    assert "score" in counts.columns and kept and not any("log_amount" in c or "vec" in c for c in kept)


def test_search_fits_equal_settings_once(spark, monkeypatch):
    """Settings that are one model with one tree are fitted once, and each has the score of its own fit."""
    from pyspark.ml.feature import VectorAssembler
    from arrears.operators import evaluate as ev
    from arrears.operators import training, trees
    rng = np.random.default_rng(6)
    rows = [(float(a), float(b), int(a + b + e > 0)) for a, b, e in rng.normal(size=(300, 3))]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    found = [training.Candidate("gbt", 2, False, .05), training.Candidate("gbt", 2, False, .3), training.Candidate("rf", 2, False, .05), training.Candidate("gbt", 3, False, .3)]
    fits = []
    monkeypatch.setattr(trees, "fit", lambda *a, inner=trees.fit, **k: fits.append((a[1], k["max_depth"], k["n_trees"], k["step"])) or inner(*a, **k))
    trace = training.search(df, df, ["a", "b"], found, rungs=(1, 3), keep=1.0).collect()
    assert len(trace) == 8 and sorted(fits) == sorted([("gbt", 2, 1, .05), ("rf", 2, 1, .05), ("gbt", 3, 1, .3)] + [(c.kind, c.max_depth, 3, c.step) for c in found])
    data = VectorAssembler(inputCols=["a", "b"], outputCol="_features").transform(df).selectExpr("_features", "double(y) AS _label").coalesce(1)
    c = found[1]
    alone = trees.TreeScorer(trees.node_table(spark, trees.fit(data, c.kind, None, n_trees=1, max_depth=2, step=c.step)))
    scored = training.long_scores(df, {"x": alone}, ["a", "b"], ["y"])
    assert [r.val_auc for r in trace if (r.rung, r.candidate) == (0, 1)] == pytest.approx([ev.auc(scored, by=["model"]).first()["auc"]])


def test_strategies_share_their_neighbours(spark, monkeypatch):
    """Four searches serve all strategies, and each has the rows that it has alone."""
    from arrears.operators import knn, resample
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(30, 3)), rng.normal(size=(90, 3)) + 1])
    p = spark.createDataFrame([(i, [float(a) for a in v], int(i < 30)) for i, v in enumerate(x)], "id long, vec array<double>, y int")
    smote = resample.augment(p, resample.smote(p))
    alone = {"smote": smote, "adasyn": resample.augment(p, resample.adasyn(p)), "borderline_smote": resample.augment(p, resample.borderline_smote(p)),
             "smote_tomek": resample.tomek_clean(smote), "original": resample.augment(p, resample.smote(p).limit(0))}
    alone = {n: sorted((r.id, *r.vec) for r in d.collect()) for n, d in alone.items()}
    searches = []
    monkeypatch.setattr(knn, "knn", lambda *a, inner=knn.knn, **k: searches.append(1) or inner(*a, **k))
    made = resample.strategies(p)
    assert {n: sorted((r.id, *r.vec) for r in made[n].collect()) for n in alone} == alone
    assert len(made) == 7 and len(searches) == 4
