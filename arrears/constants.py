"""Fixed values that must equal the reference's for equal results.

FIXED VALUES (reference conventions, stated plainly):
- late threshold: age in days > 30 is late
- split shares of customers: train 0.70, validation 0.15, test 0.15
- winsor quantiles: 0.01 and 0.99
- target-encoding smoothing: 20; doubled (40) for interaction pairs
- quartile bin probabilities: 0, 0.25, 0.5, 0.75, 1 with outer edges opened
- quartile bin labels: Q1_Low, Q2_Mid_Low, Q3_Mid_High, Q4_High
- "no group" customer label: NON-GROUP CUSTOMER
- missing remark: No Remark; missing district / sub-district: Unknown
- dropped category: OTOMOTIVE; merged small categories: INSTITUSI, NON-KATEGORI -> OTHER
- SMOTE: k = 5 neighbours, sampling ratio 1.0 (balance to 1:1)
- decision labels: score >= threshold -> BERISIKO, else LAYAK
- risk levels: < 0.4 low, < 0.7 medium, else high
- threshold regimes: <= 0.30, <= 0.45, <= 0.54, <= 0.70, above
- threshold grid for best-threshold search: numpy arange(0.05, 0.95, 0.01)
- score histogram: 20 bins; calibration: 10 uniform bins
- cost scenarios (fp_cost:fn_cost): 1:1, 1:2, 1:5, 1:10
- bootstrap: 1000 resamples, 2.5 / 97.5 percentiles
- recall-at-precision floor: 0.4
- synthetic row weight in treatment C: 0.75
"""

from __future__ import annotations

import numpy as np

LATE_DAYS = 30
TRAIN_SHARE = 0.70
VAL_SHARE = 0.15
TEST_SHARE = 0.15
WINSOR_LOWER = 0.01
WINSOR_UPPER = 0.99
TE_SMOOTHING = 20.0
PAIR_TE_SMOOTHING = 40.0
BIN_LABELS = ["Q1_Low", "Q2_Mid_Low", "Q3_Mid_High", "Q4_High"]
NON_GROUP = "NON-GROUP CUSTOMER"
NO_REMARK = "No Remark"
UNKNOWN = "Unknown"
DROP_CATEGORY = "OTOMOTIVE"
MERGE_CATEGORIES = ("INSTITUSI", "NON-KATEGORI")
OTHER = "OTHER"
SMOTE_K = 5
SMOTE_RATIO = 1.0
LABEL_RISKY = "BERISIKO"
LABEL_OK = "LAYAK"
RISK_LOW_BELOW = 0.4
RISK_MEDIUM_BELOW = 0.7
REGIME_EDGES = (0.30, 0.45, 0.54, 0.70)
HIST_BINS = 20
CALIBRATION_BINS = 10
COST_SCENARIOS = ((1.0, 1.0), (1.0, 2.0), (1.0, 5.0), (1.0, 10.0))
BOOTSTRAP_N = 1000
RECALL_PRECISION_FLOOR = 0.4
SYNTHETIC_WEIGHT = 0.75

# The best-threshold grid: the exact doubles numpy produces (they are not
# the decimal literals: 0.22000000000000003, 0.4800000000000001, ...).
THRESHOLD_GRID: list[float] = [float(x) for x in np.arange(0.05, 0.95, 0.01)]

# Fixture mapping of the driver tables onto the reference's categories:
# p_type ECONOMY plays the dropped category, PROMO and SMALL the merged ones,
# and market segment BUILDING plays the no-group customer.
FIXTURE_DROP_CATEGORY = "ECONOMY"
FIXTURE_MERGE_CATEGORIES = ("PROMO", "SMALL")
FIXTURE_NON_GROUP_SEGMENT = "BUILDING"
FIXTURE_SEED = 42
