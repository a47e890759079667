"""Driver contract smoke + a sample of oracle checks at sf0.001."""

import pytest

import __spark_entry__ as E
from tools.check_oracles import compare, duck
from tests.conftest import SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert {"split", "risk_level", "n_invoices"} <= set(df.columns)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


SAMPLE = ["a07_smoothed_target_mean", "a01_group_amount_stats", "a15_label_codes", "w01_amount_percentile",
          "a22_roc_auc", "a24_roc_curve", "a26_threshold_sweep", "a36_cost_thresholds", "a38_delong",
          "j10_batch_scoring", "j15_knn_minority", "m05_smote"]


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle_sample(spark, name):
    con = duck(SMALL)
    msg = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SMALL)
    assert ": OK" in msg, msg
