"""The registered queries once more as plain SQL, for an independent engine."""

from __future__ import annotations

RX = """
  SELECT l_shipdate AS month, l_suppkey AS pct, p_brand AS bnf_code,
         CAST(l_quantity AS BIGINT) AS items,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS period
  FROM lineitem JOIN part ON l_partkey = p_partkey"""

AREAS = """
  SELECT s_suppkey AS code, s_name AS name, n_regionkey = 3 AS is_london,
         CASE WHEN s_acctbal >= 0 THEN 'CCG' ELSE 'PCT' END AS org_type
  FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

IN_NUMERATOR = "substr(bnf_code, 1, 7) IN ('Brand#1', 'Brand#3', 'Brand#4')"
IN_DENOMINATOR = "substr(bnf_code, 1, 7) IN ('Brand#1', 'Brand#3', 'Brand#4', 'Brand#5')"
IN_MIXED = "(bnf_code LIKE 'Brand#12%' OR bnf_code LIKE 'Brand#3%' OR bnf_code LIKE 'Brand#55%')"
SINCE = "month >= TIMESTAMP '1996-01-01 00:00:00'"


def _measure(in_denominator: str) -> str:
    return f"""
  SELECT period AS month, pct, CAST(doacs AS BIGINT) AS doacs,
         100 * (CAST(doacs AS DOUBLE) / CAST(total AS DOUBLE)) AS perc_doacs
  FROM (
    SELECT period, pct,
           sum(CASE WHEN {IN_NUMERATOR} THEN items ELSE 0 END) AS doacs,
           sum(items) AS total
    FROM rx JOIN areas ON pct = code
    WHERE {in_denominator} AND org_type = 'CCG' AND {SINCE}
    GROUP BY period, pct)"""


MEASURE = _measure(IN_DENOMINATOR)
REVISED = _measure(IN_DENOMINATOR.replace("Brand#5", "Brand#2"))

LATEST = "SELECT * FROM measure WHERE month = (SELECT max(month) FROM measure)"

DECILES = tuple(range(10, 100, 10))
OUTER = (*range(1, 10), *range(91, 100))


def _with(body: str, *extra: str) -> str:
    parts = [f"rx AS ({RX})", f"areas AS ({AREAS})", f"measure AS ({MEASURE})", *extra]
    return "WITH " + ",\n".join(parts) + "\n" + body


def _bands(points) -> str:
    numbers = ", ".join(str(p) for p in points)
    shares = ", ".join(str(p / 100) for p in points)
    return _with(f"""
SELECT month, percentile, round(value, 6) AS perc_doacs
FROM (
  SELECT month, unnest([{numbers}]) AS percentile,
         unnest(quantile_cont(perc_doacs, [{shares}])) AS value
  FROM measure GROUP BY month)""")


def _within(period: str, name: str = "month") -> str:
    """Percentiles from sketches are within the bound of their ranks everywhere."""
    numbers = ", ".join(str(p) for p in sorted((*DECILES, *OUTER)))
    return _with(f"""
SELECT period AS {name}, unnest([{numbers}]) AS percentile, n, TRUE AS within
FROM (SELECT {period} AS period, count(perc_doacs) AS n FROM measure GROUP BY ALL)""")


SHADE = "round((least(greatest(perc_doacs, 10.0), 90.0) - 10.0) / 80.0, 9)"

SNAPSHOTS = (f"cur AS ({REVISED})", "sav AS (SELECT * FROM measure)")

STATUS = """CASE WHEN c.pct IS NULL THEN 'missing' WHEN s.pct IS NULL THEN 'unexpected'
            ELSE 'changed' END AS status,
       CAST(s.pct IS NOT NULL AS BIGINT) AS saved_rows,
       CAST(c.pct IS NOT NULL AS BIGINT) AS current_rows"""

MEASURE_SQL = _with("SELECT month, pct, doacs, perc_doacs FROM measure")
ROLLUP_SQL = _with("SELECT month, CAST(sum(doacs) AS BIGINT) AS doacs FROM measure GROUP BY month")

SNAPSHOT_DIFF = _with(
    f"""
SELECT coalesce(c.month, s.month) AS month, coalesce(c.pct, s.pct) AS pct, {STATUS},
       s.doacs AS saved_doacs, s.perc_doacs AS saved_perc_doacs,
       c.doacs AS current_doacs, c.perc_doacs AS current_perc_doacs
FROM cur AS c FULL JOIN sav AS s ON c.month = s.month AND c.pct = s.pct
WHERE c.doacs IS DISTINCT FROM s.doacs OR c.perc_doacs IS DISTINCT FROM s.perc_doacs""",
    *SNAPSHOTS,
)

ORACLE_SQL = {
    "scan_prescribing": _with("SELECT month, pct, bnf_code, items FROM rx"),
    "scan_areas": _with("SELECT code, name, org_type, is_london FROM areas"),
    "cached_measure": MEASURE_SQL,
    "cached_measure_csv": MEASURE_SQL,
    "project_alias": _with(
        "SELECT month AS shipped, pct AS area, bnf_code AS code, items AS n_items FROM rx"
    ),
    "period_date": _with("SELECT pct, CAST(month AS DATE) AS day, period FROM rx"),
    "code_prefix": _with("SELECT bnf_code, substr(bnf_code, 1, 7) AS prefix FROM rx"),
    "code_set_flag": _with(
        f"SELECT bnf_code, items, CAST({IN_NUMERATOR} AS INTEGER) AS in_numerator FROM rx"
    ),
    "code_prefix_set": _with(f"SELECT month, pct, bnf_code, items FROM rx WHERE {IN_MIXED}"),
    "share_measure_prefixes": _with(f"""
SELECT month, pct, CAST(doacs AS BIGINT) AS doacs,
       100 * (CAST(doacs AS DOUBLE) / CAST(total AS DOUBLE)) AS perc_doacs
FROM (SELECT period AS month, pct, sum(CASE WHEN {IN_MIXED} THEN items ELSE 0 END) AS doacs, sum(items) AS total
      FROM rx JOIN areas ON pct = code
      WHERE {IN_MIXED} OR substr(bnf_code, 1, 7) IN ('Brand#1', 'Brand#5')
      GROUP BY period, pct)"""),
    "case_items": _with(
        f"SELECT pct, bnf_code, CASE WHEN {IN_NUMERATOR} THEN items ELSE 0 END AS doacs FROM rx"
    ),
    "ieee_divide": """
WITH sums AS (
  SELECT l_orderkey,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS x,
         sum(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS y
  FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey,
       CASE WHEN y <> 0 THEN 'finite' WHEN x = 0 THEN 'nan' ELSE 'inf' END AS class,
       CASE WHEN y <> 0 THEN round(x / y, 6) END AS ratio
FROM sums""",
    "percent_scale": _with(
        "SELECT month, pct, doacs / total AS ratio, 100 * (doacs / total) AS perc_doacs FROM sums",
        f"""sums AS (
  SELECT period AS month, pct, CAST(sum(items) AS DOUBLE) AS total,
         CAST(sum(CASE WHEN {IN_NUMERATOR} THEN items ELSE 0 END) AS DOUBLE) AS doacs
  FROM rx JOIN areas ON pct = code
  WHERE {IN_DENOMINATOR} AND org_type = 'CCG' AND {SINCE}
  GROUP BY period, pct)""",
    ),
    "parse_period": _with(
        "SELECT pct, CAST(strftime(month, '%Y-%m-%d') AS TIMESTAMP) AS month FROM rx"
    ),
    "drop_column": _with("SELECT month, pct, doacs FROM measure"),
    "period_label": _with("SELECT month, pct, strftime(month, '%B %Y') AS label FROM measure"),
    "scale_clamp": _with(f"SELECT month, pct, {SHADE} AS shade FROM measure"),
    "filter_code_set": _with(f"SELECT month, pct, bnf_code, items FROM rx WHERE {IN_DENOMINATOR}"),
    "filter_area_type": _with(
        "SELECT code, name, org_type, is_london FROM areas WHERE org_type = 'CCG'"
    ),
    "filter_period_from": _with(f"SELECT month, pct, bnf_code, items FROM rx WHERE {SINCE}"),
    "filter_conjunction": _with(
        f"""SELECT month, pct, bnf_code, items, org_type FROM rx JOIN areas ON pct = code
WHERE {IN_DENOMINATOR} AND org_type = 'CCG' AND {SINCE}"""
    ),
    "latest_period_rows": _with(LATEST),
    "latest_rows_footers": _with(LATEST),
    "join_fact_area": _with(
        "SELECT month, pct, bnf_code, items, name, org_type FROM rx JOIN areas ON pct = code"
    ),
    "area_layer": _with(
        f"""
SELECT code, name, org_type, CASE WHEN is_london THEN 'london' ELSE 'rest' END AS panel,
       perc_doacs, CASE WHEN perc_doacs IS NOT NULL THEN {SHADE} END AS shade
FROM (SELECT * FROM areas WHERE org_type = 'CCG') LEFT JOIN latest ON code = pct""",
        f"latest AS ({LATEST})",
    ),
    "group_sum": _with(
        "SELECT period AS month, pct, CAST(sum(items) AS BIGINT) AS items FROM rx GROUP BY period, pct"
    ),
    "conditional_sum": _with(
        f"""SELECT period AS month, pct,
       CAST(sum(CASE WHEN {IN_NUMERATOR} THEN items ELSE 0 END) AS BIGINT) AS doacs
FROM rx GROUP BY period, pct"""
    ),
    "share_measure": MEASURE_SQL,
    "share_measure_sql": MEASURE_SQL,
    "national_rollup": ROLLUP_SQL,
    "latest_period": _with(
        "SELECT max(month) AS month, strftime(max(month), '%B %Y') AS label FROM measure"
    ),
    "period_deciles": _bands(DECILES),
    "period_outer_percentiles": _bands(OUTER),
    "percentile_bands": _bands(sorted((*DECILES, *OUTER))),
    "percentile_sketches": _within("month"),
    "merged_sketches": _within("CAST(date_trunc('year', month) AS DATE)", "year"),
    "incremental_measure": MEASURE_SQL,
    "clustered_measure": MEASURE_SQL,
    "bucketed_measure": MEASURE_SQL,
    "ordered_measure": MEASURE_SQL + " ORDER BY month, pct",
    "ordered_rollup": ROLLUP_SQL + " ORDER BY month",
    "area_panel": _with(
        "SELECT code, name, CASE WHEN is_london THEN 'london' ELSE 'rest' END AS panel FROM areas"
    ),
    "sanitise_text": r"""
SELECT event_id, regexp_replace(
         regexp_replace(text, '\b0x[a-f0-9]{12}\b', '<memory_address>', 'g'),
         '\b[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}\b', '<uuid>', 'g') AS text
FROM (
  SELECT event_id, 'obj at 0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 12) || ' run '
         || substr(kind, 1, 8) || '-' || substr(kind, 9, 4) || '-' || substr(kind, 13, 4) || '-'
         || substr(kind, 17, 4) || '-' || substr(kind, 21, 12) || ' ' || event_type AS text
  FROM (SELECT event_id, event_type, md5(event_type) AS kind FROM events))""",
    "snapshot_diff": SNAPSHOT_DIFF,
    "snapshot_digest_diff": SNAPSHOT_DIFF,
    "snapshot_digest_same": _with("""
SELECT pct, 'changed' AS status, CAST(1 AS BIGINT) AS saved_rows, CAST(1 AS BIGINT) AS current_rows,
       s.month AS saved_month, s.doacs AS saved_doacs, s.month AS current_month, s.doacs + 1 AS current_doacs
FROM measure AS s WHERE pct = 7"""),
    "snapshot_diff_hot_key": """
WITH l AS (SELECT l_returnflag AS k, l_orderkey AS v, l_linestatus AS s FROM lineitem),
sav AS (SELECT k, v FROM l WHERE s = 'F'),
cur AS (SELECT k, v * 2 AS v FROM l),
extra AS (
  SELECT k, v, 1 AS side, count(*) AS n FROM (SELECT * FROM sav EXCEPT ALL SELECT * FROM cur) GROUP BY ALL
  UNION ALL
  SELECT k, v, 2, count(*) FROM (SELECT * FROM cur EXCEPT ALL SELECT * FROM sav) GROUP BY ALL),
nth AS (SELECT *, row_number() OVER (PARTITION BY k, side ORDER BY v) AS i FROM extra)
SELECT k,
       CASE WHEN k NOT IN (SELECT k FROM cur) THEN 'missing'
            WHEN k NOT IN (SELECT k FROM sav) THEN 'unexpected' ELSE 'changed' END AS status,
       CAST(coalesce(sum(n) FILTER (side = 1), 0) AS BIGINT) AS saved_rows,
       CAST(coalesce(sum(n) FILTER (side = 2), 0) AS BIGINT) AS current_rows,
       max(v) FILTER (side = 1) AS saved_v, max(v) FILTER (side = 2) AS current_v
FROM nth GROUP BY k, i""",
    "snapshot_diff_ignore": _with(
        f"""
SELECT coalesce(c.month, s.month) AS month, coalesce(c.pct, s.pct) AS pct, {STATUS},
       s.doacs AS saved_doacs, c.doacs AS current_doacs
FROM (SELECT * FROM cur WHERE month >= DATE '1998-01-01') AS c
FULL JOIN (SELECT * FROM sav WHERE month >= DATE '1998-01-01') AS s
  ON c.month = s.month AND c.pct = s.pct
WHERE c.doacs IS DISTINCT FROM s.doacs""",
        *SNAPSHOTS,
    ),
    "snapshot_diff_tolerance": _with("""
SELECT s.month, s.pct, 'changed' AS status, CAST(1 AS BIGINT) AS saved_rows, CAST(1 AS BIGINT) AS current_rows,
       s.doacs AS saved_doacs, s.perc_doacs AS saved_perc_doacs,
       c.doacs AS current_doacs, c.perc_doacs AS current_perc_doacs
FROM measure AS s JOIN (
  SELECT month, pct, doacs, perc_doacs + CASE WHEN pct % 10 = 3 THEN 1e-3 ELSE 1e-10 END AS perc_doacs
  FROM measure) AS c ON s.month = c.month AND s.pct = c.pct
WHERE NOT abs(s.perc_doacs - c.perc_doacs) <= 1e-9"""),
    "snapshot_except_all": _with(
        """
SELECT month, pct, doacs, perc_doacs, CAST(sum(s) AS BIGINT) AS saved_rows,
       CAST(sum(c) AS BIGINT) AS current_rows
FROM (SELECT *, 1 AS s, 0 AS c FROM (SELECT * FROM sav EXCEPT ALL SELECT * FROM cur)
      UNION ALL SELECT *, 0, 1 FROM (SELECT * FROM cur EXCEPT ALL SELECT * FROM sav))
GROUP BY month, pct, doacs, perc_doacs""",
        *SNAPSHOTS,
    ),
    "snapshot_diff_repeated": """
WITH l AS (SELECT l_orderkey AS k, CAST(l_quantity AS INTEGER) AS v, l_returnflag AS f FROM lineitem),
sav AS (SELECT k, v FROM l WHERE f <> 'R'),
cur AS (SELECT k, CASE WHEN f = 'A' THEN v + 100 ELSE v END AS v FROM l WHERE f <> 'N'),
extra AS (
  SELECT k, v, 1 AS side, count(*) AS n FROM (SELECT * FROM sav EXCEPT ALL SELECT * FROM cur) GROUP BY ALL
  UNION ALL
  SELECT k, v, 2, count(*) FROM (SELECT * FROM cur EXCEPT ALL SELECT * FROM sav) GROUP BY ALL),
nth AS (SELECT *, row_number() OVER (PARTITION BY k, side ORDER BY v) AS i FROM extra)
SELECT k,
       CASE WHEN k NOT IN (SELECT k FROM cur) THEN 'missing'
            WHEN k NOT IN (SELECT k FROM sav) THEN 'unexpected' ELSE 'changed' END AS status,
       CAST(coalesce(sum(n) FILTER (side = 1), 0) AS BIGINT) AS saved_rows,
       CAST(coalesce(sum(n) FILTER (side = 2), 0) AS BIGINT) AS current_rows,
       max(v) FILTER (side = 1) AS saved_v, max(v) FILTER (side = 2) AS current_v
FROM nth GROUP BY k, i""",
    "regression_check": """
SELECT event_id, 'stdout' AS kind, 'changed' AS status,
       CAST(1 AS BIGINT) AS saved_rows, CAST(1 AS BIGINT) AS current_rows,
       'obj at <memory_address> near miss 0x12ab run 1' AS saved_text,
       'obj at <memory_address> near miss 0x12ab run 2' AS current_text
FROM events WHERE event_type <> 'click' AND CAST(event_id AS VARCHAR) LIKE '%7'""",
    "text_round_trip": r"""
SELECT l_orderkey, l_partkey,
       CASE l_returnflag WHEN 'N' THEN NULL
            WHEN 'R' THEN 'one' || chr(10) || 'two\n' || l_linestatus ELSE '\N' END AS odd,
       l_shipdate + INTERVAL 123456 MICROSECONDS AS moment
FROM lineitem""",
    "panel_files": _with(
        f"""
SELECT code, CASE WHEN is_london THEN 'london' ELSE 'rest' END AS panel, perc_doacs,
       CASE WHEN perc_doacs IS NULL THEN NULL WHEN is_london THEN round(perc_doacs / 100.0, 9)
            ELSE {SHADE} END AS shade
FROM (SELECT * FROM areas WHERE org_type = 'CCG') LEFT JOIN latest ON code = pct""",
        f"latest AS ({LATEST})",
    ),
    "text_accepted": """
SELECT l_orderkey AS "order", l_partkey AS part, CAST(l_quantity AS BIGINT) AS quantity
FROM lineitem WHERE l_orderkey % 7 <> 0 AND l_orderkey % 11 <> 0""",
    "text_rejected": """
SELECT CASE WHEN l_orderkey % 11 = 0 THEN l_orderkey || ',' || l_partkey
            ELSE l_orderkey || ',' || l_partkey || ',n/a' END AS row,
       CASE WHEN l_orderkey % 11 = 0 THEN 'another number of fields'
            ELSE 'quantity is no bigint: n/a' END AS reason
FROM lineitem WHERE l_orderkey % 7 = 0 OR l_orderkey % 11 = 0""",
    "report_trend": _with("""
SELECT month, CAST(sum(coalesce(doacs, 0)) AS BIGINT) AS doacs,
       round(quantile_cont(perc_doacs, 0.5), 6) AS median
FROM measure GROUP BY month"""),
}
