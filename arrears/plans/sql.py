"""DuckDB oracle SQL fragments (CTEs) mirroring ``plans.base``.

Written independently of the Spark code: plain SQL over the driver tables,
composed into ``WITH ...`` queries by ``with_ctes``.
"""

from __future__ import annotations

from arrears import constants as K
from arrears.operators.split import cut_hex

GEO = """geo AS (
  SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""

RECEIVABLES = """receivables AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line_no, l_partkey AS part_key, l_suppkey AS supp_key,
         CAST(o_orderdate AS DATE) AS invoice_date,
         date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS age_days,
         l_extendedprice AS amount, l_extendedprice * l_discount AS balance,
         CAST(o_custkey AS VARCHAR) AS customer,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'NON-GROUP CUSTOMER' ELSE c_mktsegment END AS customer_group,
         s_name AS salesperson, p_brand AS division, p_type AS category,
         'SIZE-' || CAST(p_size AS VARCHAR) AS subcategory,
         sg.r_name AS branch, cg.r_name AS province, cg.n_name AS city,
         CASE WHEN c_custkey % 11 = 0 THEN NULL
              ELSE cg.n_name || '-' || CAST(c_custkey % 7 AS VARCHAR) END AS district,
         CAST(NULL AS VARCHAR) AS subdistrict,
         NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS remark
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN geo cg ON c_nationkey = cg.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN geo sg ON s_nationkey = sg.n_nationkey
  JOIN part ON l_partkey = p_partkey)"""

CLEAN = """clean AS (
  SELECT order_key, line_no, part_key, supp_key, invoice_date, age_days, amount, balance, customer,
         customer_group, salesperson, division,
         CASE WHEN category IN ('PROMO', 'SMALL') THEN 'OTHER' ELSE category END AS category,
         subcategory, branch, province, city,
         COALESCE(district, 'Unknown') AS district, COALESCE(subdistrict, 'Unknown') AS subdistrict,
         COALESCE(remark, 'No Remark') AS remark,
         COALESCE(CAST(age_days > 30 AS INTEGER), 0) AS is_late
  FROM receivables WHERE category IS DISTINCT FROM 'ECONOMY')"""


def split_cte(seed: int = K.FIXTURE_SEED, name: str = "split") -> str:
    t = cut_hex(K.TRAIN_SHARE)
    v = cut_hex(K.TRAIN_SHARE + K.VAL_SHARE)
    h = f"substr(md5('{seed}:' || customer), 1, 2)"
    return f"""{name} AS (
  SELECT *, CASE WHEN {h} < '{t}' THEN 'train' WHEN {h} < '{v}' THEN 'val' ELSE 'test' END AS split
  FROM clean)"""


GLOBALS = """g AS (
  SELECT avg(is_late) AS late_rate, avg(amount) AS amount_mean, count(*) AS n_train,
         quantile_cont(amount, 0.01) AS winsor_lo, quantile_cont(amount, 0.99) AS winsor_hi,
         quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS q2,
         quantile_cont(amount, 0.75) AS q3
  FROM split WHERE split = 'train')"""

BINNED = """binned AS (
  SELECT s.*, CASE WHEN amount <= g.q1 THEN 'Q1_Low' WHEN amount <= g.q2 THEN 'Q2_Mid_Low'
                   WHEN amount <= g.q3 THEN 'Q3_Mid_High' ELSE 'Q4_High' END AS amount_bin
  FROM split s, g)"""


def te_cte(dim: str, smoothing: float = K.TE_SMOOTHING, key_expr: str | None = None) -> str:
    k = key_expr or dim
    s = int(smoothing)
    return f"""te_{dim} AS (
  SELECT {k} AS key, count(*) AS n,
         (count(*) * avg(is_late) + {s} * (SELECT late_rate FROM g)) / (count(*) + {s}) AS te
  FROM binned WHERE split = 'train' AND {k} IS NOT NULL GROUP BY {k})"""


def scored_cte() -> str:
    """Test-split scorecards (see ``plans.base.scorecards``)."""
    return """scored AS (
  SELECT b.order_key, b.line_no, b.part_key, b.supp_key, b.split, b.is_late AS y,
         (COALESCE(ts.te, g.late_rate) + COALESCE(td.te, g.late_rate) + COALESCE(tc.te, g.late_rate)) / 3 AS score_a,
         (COALESCE(tg.te, g.late_rate) + COALESCE(tb.te, g.late_rate)) / 2 AS score_b
  FROM binned b CROSS JOIN g
  LEFT JOIN te_salesperson ts ON b.salesperson = ts.key
  LEFT JOIN te_division td ON b.division = td.key
  LEFT JOIN te_city tc ON b.city = tc.key
  LEFT JOIN te_customer_group tg ON b.customer_group = tg.key
  LEFT JOIN te_amount_bin tb ON b.amount_bin = tb.key)"""


SCORES_LONG = """scores AS (
  SELECT order_key, line_no, part_key, supp_key, split, y, 'a' AS model, score_a AS score FROM scored
  UNION ALL
  SELECT order_key, line_no, part_key, supp_key, split, y, 'b' AS model, score_b AS score FROM scored)"""


def base_ctes(seed: int = K.FIXTURE_SEED) -> list[str]:
    return [GEO, RECEIVABLES, CLEAN, split_cte(seed)]


def scored_ctes(seed: int = K.FIXTURE_SEED) -> list[str]:
    return base_ctes(seed) + [GLOBALS, BINNED] + [
        te_cte(d) for d in ("salesperson", "division", "city", "customer_group", "amount_bin")
    ] + [scored_cte(), SCORES_LONG]


def with_ctes(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def test_scores(body: str, split: str = "test") -> str:
    """Oracle over the long scored table restricted to one split: ``ev``."""
    return with_ctes(scored_ctes() + [f"ev AS (SELECT * FROM scores WHERE split = '{split}')"], body)
