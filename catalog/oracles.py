"""The registered results in DuckDB SQL, independent of the package.

Tail probabilities have no SQL function; they are integrated numerically.
"""

from __future__ import annotations

import math

from .inputs import (DOUBLE_LOGGED_SQL, EXPERIMENT_SQL, KEPT_LINES_SQL, RAW_EVENTS_SQL, SCENARIOS_SQL,
                     SCORED_SQL, UPLIFT_SQL)

# The names by which roles are recognised, stated here once more as a check.
OUTCOME_TOKENS = [
    "converted", "conversion", "click", "clicked", "purchase", "purchased", "order", "ordered",
    "signup", "signed_up", "subscribe", "subscribed", "revenue", "spend", "spent", "value", "ltv",
    "gmv", "session", "retention",
]
COVARIATE_PREFIXES = [
    "pre_", "prior_", "baseline_", "user_", "device", "country", "region",
]

Z = "CAST(1.959963984540054 AS DOUBLE)"


def r(expression: str, digits: int) -> str:
    return f"ROUND(CAST({expression} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE)"


def simpson(density: str, start: str, width: float, steps: int) -> str:
    """Integral of ``density`` (a function of {x}) over [start, start + width]."""
    h = f"CAST({width / steps!r} AS DOUBLE)"
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    at = density.format(x=f"(({start}) + i * {h})")
    return f"({h} / 3 * LIST_SUM(LIST_TRANSFORM(RANGE(0, {steps + 1}), lambda i: ({weight}) * {at})))"


def normal_tail(z: str) -> str:
    return f"({simpson('EXP(-0.5 * {x} * {x})', z, 10.0, 2000)} / SQRT(2 * PI()))"


def t_two_sided(t: str, df: str) -> str:
    """Two-sided p of Student's t."""
    scale = f"EXP(LGAMMA(({df} + 1) / 2) - LGAMMA({df} / 2)) / SQRT({df} * PI())"
    body = f"POWER(1 + {{x}} * {{x}} / {df}, -({df} + 1) / 2)"
    return f"(2 * {scale} * {simpson(body, f'ABS({t})', 40.0, 8000)})"


def t_975(df: str) -> str:
    """0.975 quantile of Student's t, expanded in 1/df."""
    z = 1.959963984540054
    g = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96,
         (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
         (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    terms = " + ".join(f"CAST({c!r} AS DOUBLE) / POWER({df}, {k})" for k, c in enumerate(g, 1))
    return f"({Z} + {terms})"


def arms(by: str, metric: str, arm: str = "variant_conf", table: str = "experiment") -> str:
    """CTE ``arms``: both arms of one metric side by side, per group."""
    cells = []
    for side, name in (("c", "control"), ("t", "treatment")):
        only = f"FILTER (WHERE {arm} = '{name}')"
        cells += [f"COUNT({metric}) {only} AS n_{side}", f"SUM({metric}) {only} AS s_{side}",
                  f"AVG({metric}) {only} AS m_{side}", f"VAR_SAMP({metric}) {only} AS v_{side}"]
    return f"arms AS (SELECT {by}, {', '.join(cells)} FROM {table} GROUP BY {by})"


def wilson(s: str, n: str) -> tuple[str, str]:
    p = f"(CAST({s} AS DOUBLE) / {n})"
    centre = f"({p} + {Z} * {Z} / (2 * {n})) / (1 + {Z} * {Z} / {n})"
    half = (f"{Z} * SQRT({p} * (1 - {p}) / {n} + {Z} * {Z} / (4 * CAST({n} AS DOUBLE) * {n}))"
            f" / (1 + {Z} * {Z} / {n})")
    return f"({centre} - {half})", f"({centre} + {half})"


WELCH = """
welch AS (
  SELECT *, (m_t - m_c) / SQRT(v_c / n_c + v_t / n_t) AS t, SQRT(v_c / n_c + v_t / n_t) AS se,
         POWER(v_c / n_c + v_t / n_t, 2) / (POWER(v_c / n_c, 2) / (n_c - 1)
           + POWER(v_t / n_t, 2) / (n_t - 1)) AS df,
         SQRT(((n_c - 1) * v_c + (n_t - 1) * v_t) / (n_c + n_t - 2)) AS sd
  FROM arms)"""


def rank_sums(source: str, value: str, flag: str, by: str) -> str:
    """CTE ``ranks``: midrank sums per group over rows with a boolean flag."""
    return f"""
placed AS (
  SELECT {by}, {flag} AS flag,
         RANK() OVER w + (COUNT(*) OVER (PARTITION BY {by}, {value}) - 1) / CAST(2 AS DOUBLE) AS midrank,
         COUNT(*) OVER (PARTITION BY {by}, {value}) AS c
  FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY {value})),
ranks AS (
  SELECT {by}, CAST(COUNT(*) AS DOUBLE) AS n, CAST(COUNT(*) FILTER (WHERE flag) AS DOUBLE) AS n_t,
         COALESCE(SUM(midrank) FILTER (WHERE flag), 0) AS rank_sum,
         SUM(midrank * midrank) AS rank_sq_sum,
         SUM(CAST(c AS DOUBLE) * c - 1) AS tie_sum
  FROM placed GROUP BY {by})"""


NATION_SRM = """
orders_by_nation AS (
  SELECT r_name, n_name, o_orderpriority AS level, COUNT(*) AS o
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3),
sizes AS (
  SELECT r_name, n_name, SUM(o) AS n, COUNT(*) AS k FROM orders_by_nation GROUP BY 1, 2),
tests AS (
  SELECT r_name, n_name, CAST(n AS BIGINT) AS n, k, chi2,
         CASE k WHEN 5 THEN EXP(-chi2 / 2) * (1 + chi2 / 2) END AS p_value
  FROM (SELECT r_name, n_name, n, k,
               SUM(POWER(o - CAST(n AS DOUBLE) / k, 2) / (CAST(n AS DOUBLE) / k)) AS chi2
        FROM orders_by_nation JOIN sizes USING (r_name, n_name) GROUP BY ALL)),
stepped AS (
  SELECT *, LEAST(MIN(p_value * m / rk) OVER (
             PARTITION BY r_name ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS bh
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY r_name ORDER BY p_value) AS rk,
               COUNT(*) OVER (PARTITION BY r_name) AS m FROM tests))"""


def planned_srm(by: str, control: float, treatment: float) -> str:
    select_by = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
counts AS (
  SELECT {select_by}CAST(COUNT(*) AS DOUBLE) AS n, COUNT(DISTINCT variant_conf) AS k,
         COUNT(*) FILTER (WHERE variant_conf = 'control') AS c,
         COUNT(*) FILTER (WHERE variant_conf = 'treatment') AS t
  FROM experiment {group}),
srm AS (
  SELECT *, POWER(c - {control} * n, 2) / ({control} * n)
            + POWER(t - {treatment} * n, 2) / ({treatment} * n) AS chi2 FROM counts)"""


def smd(t: str, c: str, where_t: str = "", where_c: str = "") -> str:
    return (f"(AVG({t}) {where_t} - AVG({c}) {where_c}) / "
            f"SQRT((VAR_SAMP({t}) {where_t} + VAR_SAMP({c}) {where_c}) / 2)")


def newton(steps: int = 10) -> str:
    """CTEs up to ``model(b0, b1)``: penalised logistic fit on the scaled price."""
    parts = ["""
design AS (
  SELECT CASE WHEN variant_conf = 'treatment' THEN 1 ELSE 0 END AS t, device, pre_value,
         (pre_value - AVG(pre_value) OVER ()) / STDDEV_POP(pre_value) OVER () AS x
  FROM experiment),
step_0 AS (SELECT CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1)"""]
    for k in range(steps):
        parts.append(f"""
sums_{k} AS (
  SELECT b0, b1, SUM(p - t) AS g0, SUM((p - t) * x) + b1 AS g1, SUM(p * (1 - p)) AS h00,
         SUM(p * (1 - p) * x) AS h01, SUM(p * (1 - p) * x * x) + 1 AS h11
  FROM (SELECT t, x, b0, b1, 1 / (1 + EXP(-(b0 + b1 * x))) AS p FROM design, step_{k})
  GROUP BY b0, b1),
step_{k + 1} AS (
  SELECT b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0,
         b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1 FROM sums_{k})""")
    parts.append(f"\nmodel AS (SELECT * FROM step_{steps})")
    return ",".join(parts)


def newton_by(group: str, steps: int = 10) -> str:
    """CTEs up to ``model(<group>, n, b0, b1)``: the same fit in every group, on the price scaled within it."""
    parts = [f"""
design AS (
  SELECT CASE WHEN variant_conf = 'treatment' THEN 1 ELSE 0 END AS t, {group},
         (pre_value - AVG(pre_value) OVER w) / STDDEV_POP(pre_value) OVER w AS x
  FROM experiment WINDOW w AS (PARTITION BY {group})),
step_0 AS (SELECT {group}, COUNT(*) AS n, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1 FROM design GROUP BY {group})"""]
    for k in range(steps):
        parts.append(f"""
sums_{k} AS (
  SELECT {group}, n, b0, b1, SUM(p - t) AS g0, SUM((p - t) * x) + b1 AS g1, SUM(p * (1 - p)) AS h00,
         SUM(p * (1 - p) * x) AS h01, SUM(p * (1 - p) * x * x) + 1 AS h11
  FROM (SELECT {group}, t, x, n, b0, b1, 1 / (1 + EXP(-(b0 + b1 * x))) AS p FROM design JOIN step_{k} USING ({group}))
  GROUP BY {group}, n, b0, b1),
step_{k + 1} AS (
  SELECT {group}, n, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0,
         b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1 FROM sums_{k})""")
    parts.append(f"\nmodel AS (SELECT * FROM step_{steps})")
    return ",".join(parts)


def newton_levels(steps: int = 14) -> str:
    """CTEs up to ``dense_n`` and ``levels_n``: the price and the dummies of ``shop``, the latter eliminated in each step."""
    parts = ["""
design AS (
  SELECT CASE WHEN variant_conf = 'treatment' THEN 1 ELSE 0 END AS t, CAST(o_custkey AS VARCHAR) || '/' || device AS shop,
         (pre_value - AVG(pre_value) OVER ()) / STDDEV_POP(pre_value) OVER () AS x
  FROM experiment),
counted AS (SELECT shop, COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS m FROM design GROUP BY shop),
dense_0 AS (SELECT CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1),
levels_0 AS (SELECT shop, m * (1 - m) AS ridge, CAST(0 AS DOUBLE) AS beta FROM counted
             WHERE shop > (SELECT MIN(shop) FROM counted))"""]
    for k in range(steps):
        parts.append(f"""
judged_{k} AS (
  SELECT t, x, shop, b0, b1, ridge, beta, 1 / (1 + EXP(-(b0 + b1 * x + COALESCE(beta, 0)))) AS p
  FROM design LEFT JOIN levels_{k} USING (shop), dense_{k}),
whole_{k} AS (
  SELECT b0, b1, SUM(p - t) AS g0, SUM((p - t) * x) + b1 AS g1, SUM(p * (1 - p)) AS h00,
         SUM(p * (1 - p) * x) AS h01, SUM(p * (1 - p) * x * x) + 1 AS h11 FROM judged_{k} GROUP BY b0, b1),
each_{k} AS (
  SELECT shop, ridge, beta, SUM(p * (1 - p)) AS a0, SUM(p * (1 - p) * x) AS a1, SUM(p * (1 - p)) + ridge AS d,
         SUM(p - t) + ridge * beta AS g FROM judged_{k} WHERE ridge IS NOT NULL GROUP BY shop, ridge, beta),
part_{k} AS (
  SELECT SUM(a0 * a0 / d) AS s00, SUM(a0 * a1 / d) AS s01, SUM(a1 * a1 / d) AS s11, SUM(a0 * g / d) AS r0,
         SUM(a1 * g / d) AS r1 FROM each_{k}),
solved_{k} AS (
  SELECT b0, b1, ((h11 - s11) * (r0 - g0) - (h01 - s01) * (r1 - g1)) / det AS e0,
         ((h00 - s00) * (r1 - g1) - (h01 - s01) * (r0 - g0)) / det AS e1
  FROM (SELECT *, (h00 - s00) * (h11 - s11) - (h01 - s01) * (h01 - s01) AS det FROM whole_{k}, part_{k})),
dense_{k + 1} AS (SELECT b0 + e0 AS b0, b1 + e1 AS b1 FROM solved_{k}),
levels_{k + 1} AS (SELECT shop, ridge, beta - (g + a0 * e0 + a1 * e1) / d AS beta FROM each_{k}, solved_{k})""")
    return ",".join(parts)


def fitted_pairs() -> str:
    """The match of SCORED_SQL on the fitted score of the price alone."""
    return EXPERIMENT_SQL + "," + newton() + """,
scored AS (
  SELECT user_id, CASE WHEN variant_conf = 'treatment' THEN 1 ELSE 0 END AS treated,
         1 / (1 + EXP(-(b0 + b1 * x))) AS p, b0 + b1 * x AS logit, pre_value,
         CAST(CASE WHEN device = '1-URGENT' THEN 1 ELSE 0 END AS DOUBLE) AS urgent, revenue,
         CAST(converted AS DOUBLE) AS converted
  FROM (SELECT *, (pre_value - AVG(pre_value) OVER ()) / STDDEV_POP(pre_value) OVER () AS x FROM experiment), model),
bounds AS (""" + SCORED_SQL.split("bounds AS (")[1]


def clip_logit(p: str) -> str:
    clipped = f"LEAST(GREATEST({p}, CAST(1e-6 AS DOUBLE)), CAST(1 - 1e-6 AS DOUBLE))"
    return f"LN({clipped} / (1 - {clipped}))"


#: Columns of the experiment, and whether they are numeric.
PROFILED = {"user_id": True, "variant": False, "variant_conf": False, "pre_value": True,
            "device": False, "converted": True, "revenue": True, "basket": True}


def profile_rows() -> str:
    rows = []
    for i, (name, is_number) in enumerate(PROFILED.items()):
        outcome = f"MIN({name}) = 0 AND MAX({name}) = 1" if is_number else "FALSE"
        rows.append(f"""
  SELECT {i} AS position, '{name}' AS "column", {str(is_number).upper()} AS is_numeric,
         COUNT(DISTINCT {name}) = 2 AND NOT ({outcome}) AS is_binary_candidate,
         CAST(MIN({name}) AS VARCHAR) AS low, CAST(MAX({name}) AS VARCHAR) AS high,
         1 - COUNT({name}) / CAST(COUNT(*) AS DOUBLE) AS missing_frac
  FROM experiment""")
    return "profile AS (" + " UNION ALL ".join(rows) + ")"


def name_class() -> str:
    prefixed = " OR ".join(f"STARTS_WITH(LOWER(\"column\"), '{p}')" for p in COVARIATE_PREFIXES)
    tokened = " OR ".join(f"CONTAINS(LOWER(\"column\"), '{t}')" for t in OUTCOME_TOKENS)
    return (f"CASE WHEN \"column\" = 'user_id' THEN 'id' WHEN {prefixed} THEN 'covariate' "
            f"WHEN {tokened} THEN 'outcome' ELSE 'unknown' END")


def column_shares(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT(*) AS n, COUNT({c}) AS filled, "
        f"COUNT(*) FILTER (WHERE {number(c)}) AS numeric FROM {table}" for c in columns)


def number(column: str) -> str:
    return (rf"REGEXP_FULL_MATCH({column}, '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*')")


def one_hot(column: str, levels: list[str]) -> str:
    return ", ".join(f"CAST(CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS "
                     f"\"{column.removeprefix('o.')}_{v}\"" for v in levels)


def resample_weight() -> str:
    # Cumulative Poisson(1) probabilities of 0 to 12, in units of 2^-32.
    limits, below = [], 0.0
    for k in range(13):
        below += math.exp(-1) / math.prod(range(1, k + 1))
        limits.append(int(below * 2**32))
    word = "CAST('0x' || SUBSTR(MD5(user_id || '-' || b || '-7'), 1, 8) AS BIGINT)"
    cases = " ".join(f"WHEN word < {limit} THEN {k}" for k, limit in enumerate(limits))
    return f"""
draws AS (
  SELECT b, d_revenue, d_converted, {word} AS word
  FROM pairs, (SELECT UNNEST(RANGE(0, 20)) AS b)),
weights AS (SELECT *, CAST(CASE {cases} ELSE 13 END AS DOUBLE) AS w FROM draws),
resampled AS (
  SELECT 'revenue' AS metric, b, SUM(w * d_revenue) / SUM(w) AS att FROM weights GROUP BY b
  UNION ALL
  SELECT 'converted', b, SUM(w * d_converted) / SUM(w) FROM weights GROUP BY b),
estimates AS (
  SELECT 'revenue' AS metric, AVG(d_revenue) AS psm_att FROM pairs
  UNION ALL SELECT 'converted', AVG(d_converted) FROM pairs)"""


LOW_C, HIGH_C = wilson("s_c", "n_c")
LOW_T, HIGH_T = wilson("s_t", "n_t")
LOW, HIGH = wilson("s", "n")
P_C, P_T = "(s_c / CAST(n_c AS DOUBLE))", "(s_t / CAST(n_t AS DOUBLE))"
CHI2 = ("((n_c + n_t) * POWER(s_t * (n_c - s_c) - CAST(s_c AS DOUBLE) * (n_t - s_t), 2) / "
        "(CAST(n_c AS DOUBLE) * n_t * (s_c + s_t) * (n_c + n_t - s_c - s_t)))")
UPLIFT_RANKED = UPLIFT_SQL + """,
values_long AS (
  SELECT 'f0' AS metric, f0 AS value, treatment = 1 AS hit FROM uplift WHERE treatment IN (0, 1)
  UNION ALL SELECT 'f1', f1, treatment = 1 FROM uplift WHERE treatment IN (0, 1)
  UNION ALL SELECT 'f9', f9, treatment = 1 FROM uplift WHERE treatment IN (0, 1)),"""
SIGNED = SCORED_SQL + """,
signed AS (
  SELECT 'revenue' AS metric, ABS(d_revenue) AS size, d_revenue > 0 AS up FROM pairs WHERE d_revenue <> 0
  UNION ALL
  SELECT 'converted', ABS(d_converted), d_converted > 0 FROM pairs WHERE d_converted <> 0),"""


def u_z() -> str:
    n_c, u = "(n - n_t)", "(rank_sum - n_t * (n_t + 1) / 2)"
    return (f"((GREATEST({u}, {n_c} * n_t - {u}) - {n_c} * n_t / 2 - CAST(0.5 AS DOUBLE)) / "
            f"SQRT({n_c} * n_t / 12 * (n + 1 - tie_sum / (n * (n - 1)))))")


ORACLES: dict[str, str] = {
    "a1_csv_scan": f"WITH {KEPT_LINES_SQL} SELECT * FROM kept",
    "a2_malformed_count": f"""WITH {KEPT_LINES_SQL}
        SELECT (SELECT COUNT(*) FROM kept) AS parsed,
               (SELECT COUNT(*) FROM orders) - (SELECT COUNT(*) FROM kept) AS malformed""",
    "a3_na_tokens": f"WITH {RAW_EVENTS_SQL} SELECT event_id, signal, gap, suffixed FROM raw_events",
    "a4_sinks": """
        SELECT format, o_orderpriority AS level, COUNT(*) AS observed
        FROM orders, (VALUES ('parquet'), ('json'), ('csv')) AS f(format) GROUP BY 1, 2""",
    "b1_identifier": f"""WITH {DOUBLE_LOGGED_SQL}
        SELECT 'orders' AS source,
               CASE WHEN COUNT(DISTINCT o_orderkey) > 0.5 * COUNT(*) THEN 'user_id' END AS identifier,
               COUNT(*) - COUNT(DISTINCT o_orderkey) AS repeats FROM orders
        UNION ALL
        SELECT 'double_logged', CASE WHEN COUNT(DISTINCT user_id) > 0.5 * COUNT(*) THEN 'user_id' END,
               COUNT(*) - COUNT(DISTINCT user_id) FROM raw
        UNION ALL
        SELECT 'events', CASE WHEN COUNT(DISTINCT user_id) > 0.5 * COUNT(*) THEN 'user_id'
                              WHEN COUNT(DISTINCT event_id) > 0.5 * COUNT(*) THEN 'event_id' END,
               CASE WHEN COUNT(DISTINCT user_id) > 0.5 * COUNT(*)
                    THEN COUNT(*) - COUNT(DISTINCT user_id)
                    ELSE COUNT(*) - COUNT(DISTINCT event_id) END FROM events""",
    "b2_dedupe": f"WITH {DOUBLE_LOGGED_SQL} SELECT user_id, variant, pre_value, row_id FROM deduplicated",
    "b3_all_null": f"""WITH {RAW_EVENTS_SQL}, shares AS (
        {column_shares('raw_events', ['signal', 'gap', 'suffixed', 'never'])})
        SELECT "column" AS dropped FROM shares WHERE filled = 0""",
    "b4_coerce": f"""WITH {RAW_EVENTS_SQL}, shares AS (
        {column_shares('raw_events', ['signal', 'gap', 'suffixed'])}),
        totals AS (
          SELECT 'signal' AS "column", SUM(TRY_CAST(signal AS DOUBLE)) FILTER (WHERE {number('signal')}) AS total
          FROM raw_events
          UNION ALL SELECT 'gap', SUM(TRY_CAST(gap AS DOUBLE)) FILTER (WHERE {number('gap')}) FROM raw_events
          UNION ALL SELECT 'suffixed', SUM(TRY_CAST(suffixed AS DOUBLE)) FILTER (WHERE {number('suffixed')})
          FROM raw_events)
        SELECT "column", filled, numeric, numeric >= 0.8 * filled AS coerced,
               CASE WHEN numeric >= 0.8 * filled THEN {r('total', 2)} END AS total
        FROM shares JOIN totals USING ("column")""",
    "b5_missingness": f"""WITH {RAW_EVENTS_SQL}, shares AS (
        {column_shares('raw_events', ['signal', 'gap', 'suffixed', 'never'])})
        SELECT "column", {r('1 - filled / CAST(n AS DOUBLE)', 8)} AS share FROM shares WHERE filled < n""",
    "b6_quality": f"""WITH {DOUBLE_LOGGED_SQL}, shares AS (
          SELECT 'pre_value' AS "column", COUNT(*) AS n,
                 COUNT(*) FILTER (WHERE {number('pre_value')}) AS ok,
                 COUNT(*) FILTER (WHERE {number('pre_value')}) < COUNT(pre_value)
                 AND COUNT(*) FILTER (WHERE {number('pre_value')}) >= 0.8 * COUNT(pre_value) AS coerced
          FROM deduplicated
          UNION ALL SELECT 'device', COUNT(*), COUNT(device), FALSE FROM deduplicated)
        SELECT (SELECT COUNT(*) FROM raw) AS rows_in_file, ANY_VALUE(n) AS rows_loaded,
               CAST(0 AS BIGINT) AS malformed, (SELECT COUNT(*) FROM raw) - ANY_VALUE(n) AS duplicates,
               'notes' AS dropped,
               COALESCE(STRING_AGG("column", ',') FILTER (WHERE coerced), '') AS coerced,
               STRING_AGG("column", ',' ORDER BY 1 - ok / CAST(n AS DOUBLE) DESC)
                 FILTER (WHERE ok < n) AS missing_columns,
               {r('SUM(1 - ok / CAST(n AS DOUBLE))', 8)} AS missing_total, TRUE AS has_issues
        FROM shares""",
    "b7_profile": f"""WITH {EXPERIMENT_SQL}, {profile_rows()}
        SELECT "column", is_numeric, is_binary_candidate,
               CASE WHEN is_binary_candidate THEN low || ',' || high ELSE '' END AS levels,
               {r('missing_frac', 8)} AS missing_frac FROM profile""",
    "b7_merged": f"""WITH {EXPERIMENT_SQL}, facts AS ({' UNION ALL '.join(f"""
          SELECT '{c}' AS "column", {str(number).upper()} AS is_numeric, COUNT(*) AS n_rows, COUNT({c}) AS filled,
                 {f'CAST(MIN({c}) AS DOUBLE)' if number else 'CAST(NULL AS DOUBLE)'} AS lowest,
                 {f'CAST(MAX({c}) AS DOUBLE)' if number else 'CAST(NULL AS DOUBLE)'} AS highest FROM experiment"""
          for c, number in PROFILED.items())})
        SELECT "column", is_numeric, n_rows, filled, {r('1 - filled / CAST(n_rows AS DOUBLE)', 8)} AS missing_frac,
               {r('lowest', 4)} AS low, {r('highest', 4)} AS high FROM facts""",
    "b8_roles": f"""WITH {EXPERIMENT_SQL}, {profile_rows()}, named AS (
          SELECT *, {name_class()} AS name_class,
                 ROW_NUMBER() OVER (ORDER BY is_binary_candidate DESC, LOWER("column") NOT IN
                   ('variant', 'group', 'arm', 'treatment', 'bucket'), position) AS choice
          FROM profile)
        SELECT "column", name_class,
               CASE WHEN choice = 1 AND is_binary_candidate THEN 'variant'
                    WHEN name_class = 'outcome' AND is_numeric THEN 'metric'
                    WHEN name_class = 'id' THEN 'identifier' ELSE 'covariate' END AS role
        FROM named""",
    "c1_arm_filter": f"""WITH {EXPERIMENT_SQL}, long AS (
          SELECT device, variant_conf, 'basket' AS metric, basket AS value FROM experiment
          UNION ALL SELECT device, variant_conf, 'converted', converted FROM experiment),
        cells AS (
          SELECT device, metric, COUNT(value) FILTER (WHERE variant_conf = 'control') AS n_control,
                 COUNT(value) FILTER (WHERE variant_conf = 'treatment') AS n_treatment,
                 SUM(value) FILTER (WHERE variant_conf = 'control') AS s_c,
                 SUM(value) FILTER (WHERE variant_conf = 'treatment') AS s_t
          FROM long GROUP BY 1, 2)
        SELECT device, metric, n_control, n_treatment,
               n_control >= 30 AND n_treatment >= 30 AND (metric = 'basket' OR
                 LEAST(s_c, n_control - s_c, s_t, n_treatment - s_t) >= 5) AS testable
        FROM cells""",
    "c2_complete_cases": f"""WITH {EXPERIMENT_SQL}
        SELECT user_id, variant, basket FROM experiment WHERE basket IS NOT NULL""",
    "c3_design_matrix": f"""
        SELECT o_orderkey AS user_id, o_totalprice AS pre_value,
          {one_hot('o_orderpriority', ['2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'])
              .replace('"o_orderpriority_', '"device_')},
          {one_hot('o_orderstatus', ['O', 'P'])}
        FROM orders""",
    "c3_wide": f"""WITH {EXPERIMENT_SQL}, placed AS (
          SELECT user_id, pre_value, DENSE_RANK() OVER (ORDER BY CAST(o_custkey AS VARCHAR) || '/' || device) - 1 AS k
          FROM experiment)
        SELECT user_id, CAST(CASE WHEN k > 0 THEN 2 ELSE 1 END AS INTEGER) AS cells,
               CASE WHEN k > 0 THEN k END AS level_index, pre_value,
               CASE WHEN k > 0 THEN CAST(1 AS DOUBLE) END AS level_value FROM placed""",
    "c4_cuped_column": f"""WITH {EXPERIMENT_SQL}, stats AS (
          SELECT COVAR_SAMP(revenue, pre_value) / VAR_SAMP(pre_value) AS theta,
                 AVG(pre_value) AS mean FROM experiment)
        SELECT user_id, {r('revenue - theta * (pre_value - mean)', 2)} AS revenue__cuped
        FROM experiment, stats""",
    "c6_sample": f"""WITH {UPLIFT_SQL},
        sizes AS (SELECT CASE WHEN treatment = 1 THEN 1 ELSE 0 END AS arm, COUNT(*) AS n FROM uplift GROUP BY 1),
        shares AS (SELECT arm, n, SUM(n) OVER () AS total,
                     CASE WHEN SUM(n) OVER () > 20000 THEN 20000 ELSE SUM(n) OVER () END AS sample FROM sizes),
        parts AS (SELECT *, sample * n // total AS base, sample * n % total AS rest FROM shares),
        filled AS (SELECT arm, base + CASE WHEN ROW_NUMBER() OVER (ORDER BY rest DESC, arm)
                     <= sample - SUM(base) OVER () THEN 1 ELSE 0 END AS n FROM parts)
        SELECT 'stratified' AS mode, arm, CAST(n AS BIGINT) AS n FROM filled
        UNION ALL SELECT 'plain', NULL, CAST(LEAST(20000, SUM(n)) AS BIGINT) FROM sizes""",
    "c5_adapt": f"""WITH {UPLIFT_SQL}
        SELECT CASE WHEN treatment = 1 THEN 'treatment' ELSE 'control' END AS variant,
               CAST(conversion AS DOUBLE) AS conversion, CAST(visit AS DOUBLE) AS visit,
               COUNT(*) AS n, {', '.join(f"{r(f'SUM(f{i})', 2)} AS f{i}" for i in range(12))}
        FROM uplift GROUP BY 1, 2, 3""",
    "c7_significance": f"""WITH {NATION_SRM}
        SELECT n_name, p_value < 0.05 AS raw, bh < 0.05 AS significant FROM stepped""",
    "d1_srm": f"""WITH {EXPERIMENT_SQL}, {planned_srm('device', 0.38, 0.62)}, tested AS (
          SELECT *, 2 * {normal_tail('SQRT(chi2)')} AS p FROM srm)
        SELECT device, CAST(n AS BIGINT) AS n, k, {r('chi2', 6)} AS chi2, {r('p', 8)} AS p_value,
               p < 0.001 AS srm_detected FROM tested""",
    "d1_srm_uniform": f"""WITH {NATION_SRM}
        SELECT r_name, n_name, n, k, k - 1 AS df, {r('chi2', 6)} AS chi2,
               {r('p_value', 8)} AS p_value, p_value < 0.001 AS srm_detected FROM tests""",
    "d1_srm_many_arms": f"""WITH arms AS (
          SELECT CASE WHEN l_linenumber = 1 THEN 'first' ELSE CAST(l_partkey AS VARCHAR) END AS arm,
                 COUNT(*) AS o FROM lineitem GROUP BY 1),
        totals AS (SELECT SUM(o) AS n, COUNT(*) AS k, SUM(POWER(o, 2)) / AVG(o) - SUM(o) AS chi2 FROM arms)
        SELECT CAST(n AS BIGINT) AS n, k, k - 1 AS df, {r('chi2', 4)} AS chi2, CAST(0 AS DOUBLE) AS p_value,
               chi2 > (k - 1) + 40 * SQRT(2 * (k - 1)) AS srm_detected FROM totals""",
    "d1_srm_plans": f"""WITH cells AS (
          SELECT n_name, n_nationkey, o_orderpriority AS level, COUNT(*) AS o,
                 CAST(SUM(COUNT(*)) OVER (PARTITION BY n_name) AS DOUBLE) AS n
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3),
        tested AS (
          SELECT n_name, n_nationkey = 7 AS has_issue, CAST(ANY_VALUE(n) AS BIGINT) AS n, COUNT(*) AS k,
                 SUM(POWER(o - n * share, 2) / (n * share)) AS x
          FROM (SELECT *, CAST(0.2 AS DOUBLE) + (CAST(SUBSTR(level, 1, 1) AS INTEGER) - 3) * (n_nationkey % 5) / CAST(500 AS DOUBLE)
                  AS share FROM cells) GROUP BY 1, 2)
        SELECT n_name, n, k, has_issue, CASE WHEN NOT has_issue THEN {r('x', 6)} END AS chi2,
               CASE WHEN NOT has_issue THEN {r('EXP(-x / 2) * (1 + x / 2)', 8)} END AS p_value,
               CASE WHEN NOT has_issue THEN EXP(-x / 2) * (1 + x / 2) < 0.001 END AS srm_detected FROM tested""",
    "d1_srm_levels": f"""WITH {EXPERIMENT_SQL}
        SELECT variant_conf AS level, COUNT(*) AS observed,
               CAST(CASE variant_conf WHEN 'control' THEN 0.38 ELSE 0.62 END AS DOUBLE) AS expected_ratio,
               {r('COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE)', 8)} AS observed_ratio
        FROM experiment GROUP BY variant_conf""",
    "d2_kind": f"""WITH lines AS (
          SELECT CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS arm, l_quantity AS f0,
                 l_discount AS f2, l_linenumber AS f4,
                 CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS conversion,
                 CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS exposure FROM lineitem)
        {' UNION ALL '.join(f'''
        SELECT '{m}' AS metric,
               CASE WHEN COUNT(DISTINCT {m}) = 2 AND MIN({m}) = 0 AND MAX({m}) = 1
                    THEN 'binary' ELSE 'continuous' END AS kind,
               COUNT({m}) FILTER (WHERE arm = 0) AS n_control,
               COUNT({m}) FILTER (WHERE arm = 1) AS n_treatment FROM lines'''
        for m in ('conversion', 'f0', 'f2', 'f4', 'exposure'))}""",
    "d3_chi_square": f"""WITH {EXPERIMENT_SQL}, {arms('device', 'converted')}
        SELECT device, n_c AS n_control, n_t AS n_treatment, {r('m_c', 8)} AS control_mean,
               {r('m_t', 8)} AS treatment_mean, {r(CHI2, 6)} AS chi2,
               {r('2 * ' + normal_tail(f'SQRT({CHI2})'), 8)} AS p_value FROM arms""",
    "d4_wilson": f"""WITH {EXPERIMENT_SQL}, cells AS (
          SELECT device, variant_conf AS arm, COUNT(*) AS n, SUM(converted) AS s
          FROM experiment GROUP BY 1, 2)
        SELECT device, arm, n, {r(LOW, 8)} AS low, {r(HIGH, 8)} AS high FROM cells""",
    "d5_newcombe": f"""WITH {EXPERIMENT_SQL}, {arms('device', 'converted')}
        SELECT device,
          {r(f'{P_T} - {P_C} - SQRT(POWER({P_C} - {LOW_C}, 2) + POWER({HIGH_T} - {P_T}, 2))', 8)} AS ci_low,
          {r(f'{P_T} - {P_C} + SQRT(POWER({P_T} - {LOW_T}, 2) + POWER({HIGH_C} - {P_C}, 2))', 8)} AS ci_high
        FROM arms""",
    "d6_effect_size": f"""WITH {EXPERIMENT_SQL}, {arms('device', 'converted')}
        SELECT device, {r('2 * (ASIN(SQRT(m_t)) - ASIN(SQRT(m_c)))', 8)} AS cohens_h,
               {r('(m_t - m_c) / m_c', 8)} AS relative_lift FROM arms""",
    "d7_welch": f"""WITH {EXPERIMENT_SQL}, {arms('device', 'revenue')}, {WELCH}
        SELECT device, {r('t', 6)} AS t, {r('df', 3)} AS t_df, {r(t_two_sided('t', 'df'), 8)} AS p_value,
               {r(f"m_t - m_c - {t_975('df')} * se", 3)} AS ci_low,
               {r(f"m_t - m_c + {t_975('df')} * se", 3)} AS ci_high,
               {r('(m_t - m_c) / sd', 8)} AS cohens_d, {r('(m_t - m_c) / m_c', 8)} AS relative_diff
        FROM welch""",
    "d8_cuped": f"""WITH {EXPERIMENT_SQL}, both_filled AS (
          SELECT device, basket AS y, pre_value AS x FROM experiment WHERE basket IS NOT NULL)
        SELECT device, COUNT(*) AS n, {r('COVAR_SAMP(y, x) / VAR_SAMP(x)', 8)} AS theta,
               {r('AVG(x)', 4)} AS covariate_mean, {r('POWER(CORR(y, x), 2)', 8)} AS variance_reduction
        FROM both_filled GROUP BY device""",
    "d9_mann_whitney": f"""WITH {UPLIFT_RANKED} {rank_sums('values_long', 'value', 'hit', 'metric')}
        SELECT metric, {r('rank_sum - n_t * (n_t + 1) / 2', 1)} AS u, {r(u_z(), 6)} AS u_z,
               {r(f'LEAST(2 * CASE WHEN {u_z()} < 0 THEN 1 ELSE {normal_tail(u_z())} END, 1)', 8)} AS u_p
        FROM ranks""",
    "d10_balance": f"""WITH {SCORED_SQL}
        {' UNION ALL '.join(f'''
        SELECT '{c}' AS covariate, {r(smd(c, c, 'FILTER (WHERE treated = 1)',
                                          'FILTER (WHERE treated = 0)'), 8)} AS smd FROM scored'''
        for c in ('pre_value', 'urgent'))}""",
    "d11_naive": f"""WITH {SCORED_SQL}
        {' UNION ALL '.join(f'''
        SELECT '{m}' AS metric, {r(f"AVG({m}) FILTER (WHERE treated = 1) - AVG({m}) FILTER (WHERE treated = 0)", 4)}
               AS naive_effect FROM scored''' for m in ('revenue', 'converted'))}""",
    "d12_att": f"""WITH {SCORED_SQL}, naive AS (
          {' UNION ALL '.join(f'''
          SELECT '{m}' AS metric, AVG({m}) FILTER (WHERE treated = 1)
                 - AVG({m}) FILTER (WHERE treated = 0) AS effect FROM scored'''
          for m in ('revenue', 'converted'))}),
        found AS (
          {' UNION ALL '.join(f'''
          SELECT '{m}' AS metric, COUNT(*) AS n, AVG(d_{m}) AS att, STDDEV_SAMP(d_{m}) AS sd FROM pairs'''
          for m in ('revenue', 'converted'))})
        SELECT metric, n AS n_matched_pairs, {r('att', 4)} AS psm_att,
               {r('sd / SQRT(n)', 4)} AS psm_se_paired_t, {r('ABS(att) / ABS(effect)', 6)} AS att_ratio
        FROM found JOIN naive USING (metric)""",
    "d13_adapt_stats": f"""WITH {UPLIFT_SQL}
        SELECT COUNT(*) AS raw_rows,
               COUNT(*) FILTER (WHERE treatment IS NULL OR treatment NOT IN (0, 1)) AS invalid_treatment_rows,
               COUNT(*) AS rows_written,
               ROUND(COUNT(*) FILTER (WHERE treatment = 1) / CAST(COUNT(*) AS DOUBLE), 4) AS treatment_share,
               ROUND(COUNT(*) FILTER (WHERE treatment IS NULL OR treatment <> 1)
                     / CAST(COUNT(*) AS DOUBLE), 4) AS control_share,
               ROUND(AVG(conversion), 5) AS conversion_rate, ROUND(AVG(visit), 5) AS visit_rate
        FROM uplift""",
    "e1_midrank": """
        SELECT DISTINCT event_type, value, COUNT(*) OVER (PARTITION BY event_type, value) AS n,
               RANK() OVER (PARTITION BY event_type ORDER BY value)
               + (COUNT(*) OVER (PARTITION BY event_type, value) - 1) / CAST(2 AS DOUBLE) AS midrank
        FROM events WHERE value IS NOT NULL""",
    "e2_bh": f"""WITH {NATION_SRM}
        SELECT r_name, n_name, {r('p_value', 8)} AS p_value, {r('bh', 8)} AS adjusted_p_value,
               'Benjamini-Hochberg FDR' AS adjustment_method FROM stepped""",
    "e2_bh_fleet": f"""WITH cells AS (
          SELECT l_partkey, l_orderkey % 3 AS arm, COUNT(*) AS o FROM lineitem GROUP BY 1, 2),
        tests AS (
          SELECT l_partkey, EXP(-0.5 * (SUM(POWER(o, 2)) / AVG(o) - SUM(o))) AS p FROM cells
          GROUP BY 1 HAVING COUNT(*) = 3 AND AVG(o) >= 5),
        ranked AS (SELECT *, p * COUNT(*) OVER () / COUNT(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS scaled
                   FROM tests)
        SELECT l_partkey, {r('p', 8)} AS p_value,
               {r('LEAST(1, MIN(scaled) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING))', 8)} AS adjusted_p_value
        FROM ranked""",
    "e3_bonferroni": f"""WITH {NATION_SRM}
        SELECT 'bonferroni' AS method, n_name,
               {r('LEAST(p_value * COUNT(*) OVER (), 1)', 8)} AS adjusted_p_value FROM tests
        UNION ALL SELECT 'none', n_name, CAST(NULL AS DOUBLE) FROM tests""",
    "f1_standardise": f"""WITH wide AS (
          SELECT o_orderkey AS user_id, o_totalprice AS pre_value, {one_hot('o_orderstatus', ['O', 'P'])}
          FROM orders)
        SELECT user_id, {', '.join(
            f"{r(f'({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER ()', 6)} AS {c}"
            for c in ('pre_value', '"o_orderstatus_O"', '"o_orderstatus_P"'))} FROM wide""",
    "f2_propensity_model": f"""WITH {EXPERIMENT_SQL}, {newton()}
        SELECT 'intercept' AS term, {r('b0', 5)} AS weight FROM model
        UNION ALL SELECT 'pre_value', {r('b1', 5)} FROM model""",
    "f2_by_device": f"""WITH {EXPERIMENT_SQL}, {newton_by('device')}
        SELECT device, n, {r('b0', 5)} AS intercept, {r('b1', 5)} AS weight FROM model""",
    "f2_wide": f"""WITH {EXPERIMENT_SQL}, {newton_levels(14)}
        SELECT COUNT(beta) AS levels, {r('SUM(beta)', 4)} AS total, {r('SUM(beta * beta)', 4)} AS squares,
               {r('MIN(beta)', 4)} AS least, {r('MAX(beta)', 4)} AS most,
               {r('ANY_VALUE(b0)', 4)} AS intercept, {r('ANY_VALUE(b1)', 4)} AS weight FROM levels_14, dense_14""",
    "f3_logit": f"""WITH {EXPERIMENT_SQL}, {newton()}, scores AS (
          SELECT device, 1 / (1 + EXP(-(b0 + b1 * x))) AS p,
                 1 / (1 + EXP(-(pre_value - 250000) / 15000)) AS steep FROM design, model),
        logits AS (SELECT device, p, {clip_logit('p')} AS l, {clip_logit('steep')} AS s FROM scores)
        SELECT device, {r('AVG(p)', 4)} AS mean_p, {r('AVG(l)', 4)} AS mean_logit,
               {r('STDDEV_SAMP(l)', 4)} AS sd_logit, {r('AVG(s)', 4)} AS mean_clipped,
               {r('MAX(s)', 4)} AS max_clipped, {r('MIN(s)', 4)} AS min_clipped
        FROM logits GROUP BY device""",
    "f4_support": f"""WITH {SCORED_SQL}
        SELECT {r('ANY_VALUE(low)', 8)} AS low, {r('ANY_VALUE(high)', 8)} AS high,
               COUNT(*) FILTER (WHERE treated = 1 AND p BETWEEN low AND high) AS treated,
               COUNT(*) FILTER (WHERE treated = 0 AND p BETWEEN low AND high) AS control,
               COUNT(*) FILTER (WHERE treated = 1 AND NOT p BETWEEN low AND high) AS trimmed_treated,
               COUNT(*) FILTER (WHERE treated = 0 AND NOT p BETWEEN low AND high) AS trimmed_control
        FROM scored, bounds""",
    "f5_caliper": f"WITH {SCORED_SQL} SELECT {r('width', 8)} AS caliper FROM caliper",
    "f6_match": f"""WITH {SCORED_SQL}
        SELECT user_id AS treated_id, control_id, {r('gap', 6)} AS gap, {r('d_revenue', 4)} AS d_revenue,
               d_converted FROM pairs""",
    "f7_bootstrap": f"""WITH {SCORED_SQL}, {resample_weight()}
        SELECT metric, COUNT(*) AS resamples, {r('STDDEV_SAMP(att)', 4)} AS se,
               {r('QUANTILE_CONT(att, 0.025)', 4)} AS ci_low, {r('QUANTILE_CONT(att, 0.975)', 4)} AS ci_high,
               {r('''LEAST(1, 2 * CASE WHEN ANY_VALUE(psm_att) > 0
                     THEN AVG(CASE WHEN att <= 0 THEN 1 ELSE 0 END)
                     ELSE AVG(CASE WHEN att >= 0 THEN 1 ELSE 0 END) END)''', 6)} AS p_value
        FROM resampled JOIN estimates USING (metric) GROUP BY metric""",
    "f9_psm_numeric": f"""WITH {fitted_pairs()},
        sizes AS (SELECT COUNT(*) FILTER (WHERE treated = 1) AS t, COUNT(*) FILTER (WHERE treated = 0) AS c,
                    AVG(revenue) FILTER (WHERE treated = 1) - AVG(revenue) FILTER (WHERE treated = 0) AS naive_revenue,
                    AVG(converted) FILTER (WHERE treated = 1) - AVG(converted) FILTER (WHERE treated = 0)
                      AS naive_converted FROM scored),
        kept AS (SELECT COUNT(*) FILTER (WHERE treated = 1) AS t, COUNT(*) FILTER (WHERE treated = 0) AS c FROM inside),
        found AS (SELECT COUNT(*) AS n FROM pairs),
        long AS (SELECT 'revenue' AS metric, d_revenue AS d FROM pairs
                 UNION ALL SELECT 'converted', d_converted FROM pairs),
        effects AS (SELECT metric, AVG(d) AS att, STDDEV_SAMP(d) / SQRT(COUNT(*)) AS se FROM long GROUP BY 1)
        SELECT metric, sizes.t AS n_treated, sizes.c AS n_control_pool, n AS n_matched_pairs,
               kept.t - n AS discarded_treated, sizes.t - kept.t AS trimmed_treated, sizes.c - kept.c AS trimmed_control,
               CAST(500 AS BIGINT) AS bootstrap_resamples, {r('width', 5)} AS caliper,
               {r("CASE metric WHEN 'revenue' THEN naive_revenue ELSE naive_converted END", 4)} AS naive_effect,
               {r('att', 4)} AS psm_att, {r('se', 4)} AS se
        FROM effects, sizes, kept, found, caliper""",
    # Of two metrics the first is significant if its p is at most a half of 0.05, or both are at most 0.05.
    "g3_numeric": f"""WITH {fitted_pairs()}, units AS (
          SELECT 'revenue' AS metric, variant_conf, CAST(revenue AS DOUBLE) AS y FROM experiment
          UNION ALL SELECT 'converted', variant_conf, CAST(converted AS DOUBLE) FROM experiment),
        {arms('metric', 'y', 'variant_conf', 'units')}, {WELCH},
        tested AS (
          SELECT metric, n_c, n_t, m_t - m_c AS naive,
                 CASE metric WHEN 'revenue' THEN ABS(t)
                   ELSE SQRT((n_c + n_t) * POWER(s_t * (n_c - s_c) - s_c * (n_t - s_t), 2)
                             / (CAST(n_c AS DOUBLE) * n_t * (s_c + s_t) * (n_c + n_t - s_c - s_t))) END AS z FROM welch),
        judged AS (SELECT *, 2 * {normal_tail('z')} AS p FROM tested),
        facts AS (
          SELECT a.*, a.p <= 0.025 OR GREATEST(a.p, b.p) <= 0.05 AS hit,
                 POWER(a.n_c - 0.38 * (a.n_c + a.n_t), 2) / (0.38 * (a.n_c + a.n_t))
                 + POWER(a.n_t - 0.62 * (a.n_c + a.n_t), 2) / (0.62 * (a.n_c + a.n_t)) AS chi2
          FROM judged a, judged b WHERE a.metric = 'revenue' AND b.metric = 'converted'),
        effect AS (SELECT COUNT(*) AS n, AVG(d_revenue) AS att, STDDEV_SAMP(d_revenue) / SQRT(COUNT(*)) AS se FROM pairs),
        ruled AS (
          SELECT *, chi2 > 10.827566170662733 AS off, CASE WHEN chi2 > 10.827566170662733 THEN 1
            WHEN hit AND naive * att < 0 AND ABS(naive) > 1e-9 THEN 2
            WHEN hit AND ABS(naive) > 1e-9 AND ABS(att) < 0.5 * ABS(naive) AND ABS(att) <= 1.96 * se THEN 3
            WHEN hit THEN 4 ELSE 5 END AS rule FROM facts, effect)
        SELECT CASE WHEN rule <= 3 THEN 'EXPERIMENT COMPROMISED' WHEN rule = 4 THEN 'SAFE TO ROLL OUT'
                 ELSE 'NO SIGNIFICANT EFFECT' END AS verdict, rule, 1 AS n_reasons, {r('chi2', 6)} AS chi2,
               off AS srm_detected, n AS n_matched_pairs, {r('naive', 4)} AS naive_effect, {r('att', 4)} AS psm_att
        FROM ruled""",
    "f8_rosenbaum": f"""WITH {SIGNED} {rank_sums('signed', 'size', 'up', 'metric')}, curve AS (
          SELECT metric, gamma, LEAST(
            (rank_sum - g * n * (n + 1) / 2) / SQRT(g * (1 - g) * rank_sq_sum),
            (rank_sum - (1 - g) * n * (n + 1) / 2) / SQRT(g * (1 - g) * rank_sq_sum)) AS z
          FROM (SELECT *, gamma / (1 + gamma) AS g FROM ranks, (
            SELECT UNNEST([1, 1.25, 1.5, 1.75, 2, 2.5, 3, 4, 5]::DOUBLE[]) AS gamma) WHERE n >= 5))
        SELECT metric, gamma, {r('z', 6)} AS z,
               {r(f"LEAST(1, 2 * CASE WHEN z < 0 THEN 1 ELSE {normal_tail('z')} END)", 8)} AS upper_p
        FROM curve""",
    "g1_verdict": f"""WITH {SCENARIOS_SQL}, {arms('scenario', 'outcome', 'variant', 'scenarios')}, {WELCH},
        plan AS (
          SELECT *, CASE WHEN scenario IN ('d', 'e') THEN 0.38 ELSE 0.5 END AS share FROM welch),
        strata AS (
          SELECT scenario, FLOOR(pre_value / 10000) AS stratum,
                 COUNT(*) FILTER (WHERE variant = 'treatment') AS nt,
                 COUNT(*) FILTER (WHERE variant = 'control') AS nc,
                 AVG(outcome) FILTER (WHERE variant = 'treatment') AS mt,
                 AVG(outcome) FILTER (WHERE variant = 'control') AS mc,
                 VAR_SAMP(outcome) FILTER (WHERE variant = 'treatment') AS vt,
                 VAR_SAMP(outcome) FILTER (WHERE variant = 'control') AS vc
          FROM scenarios GROUP BY 1, 2 HAVING nt > 1 AND nc > 1),
        adjusted AS (
          SELECT scenario, SUM(nt * (mt - mc)) / SUM(nt) AS att,
                 SQRT(SUM(CAST(nt AS DOUBLE) * nt * (vt / nt + vc / nc))) / SUM(nt) AS se_att
          FROM strata GROUP BY 1),
        facts AS (
          SELECT scenario, att, m_t - m_c AS naive, ABS(t) > {t_975('df')} AS hit,
                 att - 1.96 * se_att <= 0 AND att + 1.96 * se_att >= 0 AS covers,
                 POWER(n_c - share * (n_c + n_t), 2) / (share * (n_c + n_t))
                 + POWER(n_t - (1 - share) * (n_c + n_t), 2) / ((1 - share) * (n_c + n_t)) AS chi2
          FROM plan JOIN adjusted USING (scenario)),
        ruled AS (
          SELECT scenario, CASE WHEN chi2 > 10.827566170662733 THEN 1
            WHEN hit AND naive * att < 0 AND ABS(naive) > 1e-9 THEN 2
            WHEN hit AND ABS(naive) > 1e-9 AND ABS(att) < 0.5 * ABS(naive) AND covers THEN 3
            WHEN hit THEN 4 ELSE 5 END AS rule FROM facts)
        SELECT scenario, CASE WHEN rule <= 3 THEN 'EXPERIMENT COMPROMISED'
                 WHEN rule = 4 THEN 'SAFE TO ROLL OUT' ELSE 'NO SIGNIFICANT EFFECT' END AS verdict,
               rule, 1 AS n_reasons FROM ruled""",
    "g2_balance_table": f"""WITH {SCORED_SQL}, before AS (
          {' UNION ALL '.join(f'''
          SELECT '{c}' AS covariate, {smd(c, c, 'FILTER (WHERE treated = 1)',
                                          'FILTER (WHERE treated = 0)')} AS smd FROM scored'''
          for c in ('pre_value', 'urgent'))}),
        after AS (
          SELECT 'pre_value' AS covariate, {smd('t_pre', 'c_pre')} AS smd FROM pairs
          UNION ALL SELECT 'urgent', {smd('t_urgent', 'c_urgent')} FROM pairs)
        SELECT covariate, {r('before.smd', 8)} AS smd_before, {r('after.smd', 8)} AS smd_after
        FROM before JOIN after USING (covariate)""",
}
