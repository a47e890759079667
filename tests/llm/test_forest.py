"""Op 3 beside crowds: lone pairs in families that share a template."""

import random

import pytest

from arrears.llm import lsh_forest
from tests.llm.test_documents import brute_components, frame


def templates(seed, families):
    """Families of eight documents a little too far apart to link, but for one pair; all families
    share a template.  The nearest by signature are often not the pair, so that regions'
    spanning forests lack it."""
    rng = random.Random(seed)
    shared, rows = [f"t{i}" for i in range(150)], []
    for f in range(families):
        family = [f"f{f}x{i}" for i in range(40)]
        for d in range(8):
            own = [f"d{d}y{f}x{i}" for i in range(26)]
            if d < 2:
                own[:4] = [f"pair{f}x{i}" for i in range(4)]
            rows.append((8 * f + d, " ".join(shared + family + own), None))
    rng.shuffle(rows)
    return rows


def sizes_of_groups(want):
    roots = [root for _, root in want.values()]
    return {roots.count(r) for r in set(roots)}


@pytest.mark.parametrize("region", [96])
def test_op3_pairs_crowded_in_some_trees(spark, monkeypatch, region):
    monkeypatch.setattr(lsh_forest, "REGION", region)
    rows = templates(1, 40)
    want = brute_components([(i, t) for i, t, _ in rows])
    assert sizes_of_groups(want) == {1, 2}
    got = lsh_forest.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize("region", [4, 24])
def test_op3_pairs_parted_by_refinement(spark, monkeypatch, region):
    """Nearly every region is crowded and refined, to depths at which lone pairs part."""
    monkeypatch.setattr(lsh_forest, "REGION", region)
    rows = templates(2, 20)
    # beside them one large group, all linked, with a lone document that links to one of its members
    base = [f"b{i}" for i in range(400)]
    group = [base[:20 + 8 * k] + [f"g{k}"] + base[21 + 8 * k:] for k in range(40)]
    far = group[5][:-60] + [f"far{i}" for i in range(24)]
    rows += [(1000 + k, " ".join(words), None) for k, words in enumerate([*group, far])]
    want = brute_components([(i, t) for i, t, _ in rows])
    got = lsh_forest.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
