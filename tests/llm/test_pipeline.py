"""The pipeline against its stages' brute-force forms, and on odd tables."""

import dataclasses

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from arrears.llm import common, crf_lang, queries
from tests.conftest import SMALL
from tests.llm.test_documents import brute_components


def test_stages_and_query(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "exact_dedup", "near_dedup", "packing"]
    docs = common.table(spark, SMALL, "documents")
    columns, at = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at.append(common.stage(stage(spark, at[-1], SMALL), name))
        assert at[-1].columns == columns
    rows = [{r.doc_id: r for r in d.collect()} for d in at]
    toxic = {r.doc_id for r in common.table(spark, SMALL, "labels").where("toxic = 1").collect()}
    model = crf_lang.train(docs)
    scored = {r.doc_id: r for r in crf_lang.identify(docs, model).collect()}
    assert set(rows[1]) == {i for i, r in scored.items() if r.lang_pred != "und" and r.score >= crf_lang.LEAST_SHARE}
    assert len(rows[1]) >= 0.98 * sum(any(c.isalpha() for c in r.text or "") for r in rows[0].values())
    lost = set(rows[1]) - set(rows[2])
    assert len(lost & toxic) >= 0.8 * len(set(rows[1]) & toxic) and len(lost) < 0.3 * len(rows[1])
    keep = {}
    for i, r in rows[2].items():
        keep[r.text] = max(keep.get(r.text, i), i)
    assert set(rows[3]) == set(keep.values())
    roots = brute_components([(i, r.text) for i, r in rows[3].items()])
    assert set(rows[4]) == {i for i, (_, root) in roots.items() if i == root}
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in packed} == set(rows[4])


def test_language_stage_follows_its_model(spark):
    """Another model keeps other documents; so do stated languages and a higher share."""
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    model = crf_lang.train(docs)
    rng = np.random.default_rng(0)
    other = dataclasses.replace(model, weights=rng.normal(size=model.weights.shape), moves=rng.normal(size=model.moves.shape))

    def kept(m, **how):
        return {r.doc_id for r in crf_lang.with_language(docs, m, **how).collect()}

    all_kept = kept(model)
    assert kept(other) != all_kept
    scored = crf_lang.identify(docs, model).collect()
    assert kept(model, languages=["de"]) == {r.doc_id for r in scored if r.lang_pred == "de" and r.score >= crf_lang.LEAST_SHARE}
    assert kept(model, least=0.97) == {r.doc_id for r in scored if r.lang_pred != "und" and r.score >= 0.97} < all_kept


def test_language_sample_is_bounded(spark):
    """Odd tags, long texts and an id that many rows share."""
    rows = [(i, f"ein zwei drei vier {i}", "de") for i in range(40)] + [(1000 + i, f"one two three four {i}", "en") for i in range(40)]
    rows += [(7, "un deux trois " * 40_000, "fr"), (None, "x y", "xx")] + [(5, "immer der gleiche satz", "de")] * 300
    rows += [(2000 + i, "odd tag", f"t{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = crf_lang.train(docs, classes=3)
    assert len(model.languages) == 3 and {"de", "en"} < set(model.languages)
    got = {r.doc_id: r.lang_pred for r in crf_lang.identify(docs, model).collect()}
    assert got[3] == "de" and got[1003] == "en"


def test_exact_and_near_stages_on_odd_rows(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, "a b c d e", "kept", 1), (1, "a b c d e", "kept", 2), (2, None, None, None), (3, "", "x", 3), (None, long, "y", 4), (None, long, "y", 4),
            (4, "A b c d e", "z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, component_id long").withColumns(
        {"__own": F.lit("mine"), "own0": F.lit(1)})
    exact = corpus_pipeline.exact(spark, docs, SMALL)
    assert exact.columns == docs.columns and {r["__own"] for r in exact.collect()} == {"mine"}
    assert sorted((str(r.doc_id), r.text or "") for r in exact.collect()) == sorted([("1", "a b c d e"), ("3", ""), ("None", long), ("4", "A b c d e")])
    near = corpus_pipeline.near(spark, exact, SMALL)
    assert sorted(str(r.doc_id) for r in near.collect()) == ["1", "3", "None"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, common.table(spark, SMALL, "documents").limit(0), SMALL).count() == 0


def test_registered():
    import __spark_entry__
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
