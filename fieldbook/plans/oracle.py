"""SQL fragments shared by oracle queries."""

from __future__ import annotations

from fieldbook import dims


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def rx(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)}, 'i')"


def category(text: str, op: str, act: str) -> str:
    comb = f"trim(concat_ws(' ', {text}, {op}, {act}))"
    pairs = [(f"{comb} = ''", "'other_npt'")]
    for name, pats in dims.CATEGORY_PATTERNS:
        pairs.append((rx(comb, "|".join(f"(?:{p})" for p in pats)), q(name)))
    for k, v in dims.OP_CODE_CATEGORY.items():
        pairs.append((f"upper(trim({op})) = {q(k)}", q(v)))
    return case(pairs, "'other_npt'")


def narrative(text: str, op: str, act: str, code: str) -> str:
    t = dims.TROUBLE_PATTERNS
    comb = f"trim(concat_ws(' ', {text}, {op}, {act}, {code}))"
    codes = f"trim(concat_ws(' ', {op}, {act}))"
    return case([
        (f"{comb} = ''", "'productive'"),
        (f"upper(trim({code})) IN ('T','NPT','DOWN','DOWNTIME')", category(text, op, act)),
        (rx(codes, t["repair_code"]), "'equipment'"),
        (rx(comb, t["wait_repairs"]), "'equipment'"),
        (rx(comb, t["breakdown"]), "'equipment'"),
        (rx(comb, t["downhole"]), "'downhole_tools'"),
        (rx(comb, t["wellbore"]), "'wellbore_condition'"),
        (rx(comb, t["fishing"]), "'fishing'"),
        (rx(comb, t["waiting"]), "'waiting_logistics'"),
        (rx(comb, t["explicit"]), "'other_npt'"),
    ], "'productive'")


def label(col: str) -> str:
    return case([(f"{col} = {q(k)}", q(v)) for k, v in dims.CATEGORY_LABELS.items()], col)


def subtype(col: str) -> str:
    return case([(rx(col, p), q(n)) for n, p in dims.EQUIPMENT_SUBTYPES], "'Unspecified'")


HOUR = lambda c: f"((CAST(split_part({c}, ':', 1) AS DOUBLE) + CAST(split_part({c}, ':', 2) AS DOUBLE) / 60.0 - 6 + 24) % 24)"

# Classified operation rows: wells W0 and W1 are read from their text.
ENR = f"""{{ops}},
enr0 AS MATERIALIZED (SELECT * EXCLUDE (is_npt), is_npt AS flag, well_id IN ('W0','W1') AS m,
  CASE WHEN well_id IN ('W0','W1') THEN {narrative('operation_text','op_code','activity_code','pt_x')}
       WHEN NOT is_npt THEN 'productive' ELSE {category('operation_text','op_code','activity_code')} END AS npt_category,
  {HOUR('start_time')} AS report_hour FROM ops),
enr AS (SELECT * EXCLUDE (m, flag), CASE WHEN m THEN npt_category <> 'productive' ELSE flag END AS is_npt,
  {label('npt_category')} AS npt_cat_label FROM enr0)"""

BLOCKS = ENR + f""",
b0 AS (SELECT *, CASE WHEN lag(phase) OVER w = phase AND lag(op_code) OVER w = op_code THEN 0 ELSE 1 END AS nw
  FROM enr WINDOW w AS (PARTITION BY well_id, report_date ORDER BY report_hour, seq)),
b1 AS (SELECT *, sum(nw) OVER (PARTITION BY well_id, report_date ORDER BY report_hour, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM b0),
bc AS (SELECT well_id, report_date, block, npt_category, sum(duration_hr) AS h FROM b1 WHERE is_npt GROUP BY ALL),
bd AS (SELECT well_id, report_date, block, npt_category FROM bc QUALIFY row_number() OVER (PARTITION BY well_id, report_date, block ORDER BY h DESC, npt_category) = 1),
bt AS (SELECT well_id, report_date, block, operation_text AS description FROM b1 QUALIFY row_number() OVER (PARTITION BY well_id, report_date, block ORDER BY length(operation_text) DESC, report_hour, seq) = 1),
ba AS (SELECT well_id, report_date, block, min(phase) AS phase, min(op_code) AS op_code, sum(duration_hr) AS total_h,
  sum(CASE WHEN is_npt THEN duration_hr ELSE 0 END) AS npt_h, count(*) AS n_ops FROM b1 GROUP BY 1, 2, 3),
steps AS (SELECT ba.*, coalesce(bd.npt_category, '') AS npt_category, bt.description,
  CASE WHEN total_h > 0 THEN 100.0 * npt_h / total_h ELSE 0 END AS npt_pct,
  row_number() OVER (PARTITION BY ba.well_id ORDER BY ba.report_date, ba.block) AS step
  FROM ba LEFT JOIN bd USING (well_id, report_date, block) LEFT JOIN bt USING (well_id, report_date, block))"""

TH = """{headers},
th AS (SELECT *, TRY_CAST(regexp_replace(split_part(daily_cost, ' ', 1), '[^0-9.]', '', 'g') AS DOUBLE) AS daily_cost_num,
  TRY_CAST(regexp_replace(split_part(cumulative_cost, ' ', 1), '[^0-9.]', '', 'g') AS DOUBLE) AS cum_cost_num,
  TRY_CAST(regexp_replace(split_part(end_depth_md_ft, ' ', 1), '[^0-9.]', '', 'g') AS DOUBLE) AS end_depth_num FROM headers)"""

DAILY = """,
daily AS (SELECT well_id, report_date, sum(duration_hr) AS total_h, sum(CASE WHEN is_npt THEN duration_hr ELSE 0 END) AS npt_h FROM enr GROUP BY 1, 2),
dnpt AS (SELECT *, npt_h / CASE WHEN total_h = 0 THEN 1 ELSE total_h END * 100 AS npt_pct FROM daily)"""

DEPTH = """,
dd AS (SELECT well_id, report_date, max(end_depth_num) AS depth_ft, arg_max(report_type, report_no) AS report_type FROM th WHERE end_depth_num > 0 GROUP BY 1, 2)"""

FLAT = DEPTH + """,
fl0 AS (SELECT *, abs(depth_ft - lag(depth_ft) OVER (PARTITION BY well_id ORDER BY report_date)) AS depth_delta FROM dd),
fl AS (SELECT f.*, n.npt_pct FROM (SELECT * FROM fl0 WHERE depth_delta < 1) f LEFT JOIN dnpt n USING (well_id, report_date))"""
