"""Input views over the given tables.

The tables hold no field reports, so each operator's input shape is derived
from them. Every view is one SELECT in SQL that Spark and DuckDB both accept;
the same text feeds the Spark operators and, as a CTE, their oracle queries.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from fieldbook.operators import ordered

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

# Operation rows, one per event.
VIEWS["ops"] = """
SELECT event_id AS seq,
  'W' || CAST(user_id % 4 AS STRING) AS well_id,
  'W' || CAST(user_id % 4 AS STRING) || '-DDR-' || lpad(CAST(day(ts) AS STRING), 3, '0') || '-' || CAST(CAST(ts AS DATE) AS STRING) AS doc_id,
  CAST(ts AS DATE) AS report_date,
  CAST(1 + event_id % 3 AS INT) AS page,
  lpad(CAST(hour(ts) AS STRING), 2, '0') || ':' || lpad(CAST(minute(ts) AS STRING), 2, '0') AS start_time,
  lpad(CAST((hour(ts) + 1 + event_id % 5) % 24 AS STRING), 2, '0') || ':' || lpad(CAST(minute(ts) AS STRING), 2, '0') AS end_time,
  value / 100 AS duration_hr,
  'P' || CAST(CAST(1 + floor((day(ts) - 1) / 5) AS BIGINT) AS STRING) AS phase,
  CASE event_type WHEN 'view' THEN 'Trips' WHEN 'click' THEN 'Drilling' WHEN 'purchase' THEN 'Run Csg & Cement'
    WHEN 'signup' THEN 'Cond Mud & Circ' ELSE (CASE WHEN event_id % 5 = 0 THEN 'Repair Rig' WHEN event_id % 5 = 1 THEN '' ELSE 'Other' END) END AS op_code,
  CASE event_id % 6 WHEN 0 THEN 'TRIP' WHEN 1 THEN 'POOH' WHEN 2 THEN 'SFTY' WHEN 3 THEN 'DRLG' WHEN 4 THEN 'RIH' ELSE 'CIRC' END AS activity_code,
  CASE WHEN event_type = 'error' THEN 'T' ELSE 'P' END AS pt_x,
  event_type = 'error' AS is_npt,
  CASE event_id % 12
    WHEN 0 THEN 'Good returns throughout job. No losses.'
    WHEN 1 THEN 'Drill ahead ' || CAST(CAST(floor(value) AS BIGINT) AS STRING) || ' ft. Mud fluids seepage losses in six hours ' || CAST(event_id % 97 AS STRING) || ' bbls.'
    WHEN 2 THEN 'Mud pump number one went down; bearing broke. Frontier Rig on NPT ' || CAST(event_id % 97 AS STRING) || ' minutes.'
    WHEN 3 THEN 'Attempted multiple times to set packers. Ball did not seat and packers did not set.'
    WHEN 4 THEN 'Hydraulic line failed on grabber box. Replace line.'
    WHEN 5 THEN 'Waited on weather, wave height ' || CAST(event_id % 23 AS STRING) || ' ft. Crane operations restricted by swell.'
    WHEN 6 THEN 'POOH with BHA. Stuck pipe at ' || CAST(CAST(floor(value) AS BIGINT) * 10 AS STRING) || ' ft, worked string with ' || CAST(event_id % 97 AS STRING) || ' klbs overpull.'
    WHEN 7 THEN 'Wait on parts from vendor. Decision made to continue drilling ahead with spare motor. Agreed to review mud program.'
    WHEN 8 THEN 'Fishing for junk with magnet run number ' || CAST(event_id % 97 AS STRING) || '.'
    WHEN 9 THEN 'RIH with bit to ' || CAST(CAST(floor(value) AS BIGINT) * 10 AS STRING) || ' ft. Circulate bottoms up; performed flow check.'
    WHEN 10 THEN 'Repair top drive brake. Delayed ' || CAST(event_id % 97 AS STRING) || ' minutes; customs clearance for valve.'
    ELSE 'Held safety meeting. Cycled FIA tool, BOP test fail on annular.'
  END AS operation_text
FROM events"""

# One header per well and report date; text columns as a report prints them.
VIEWS["headers"] = """
SELECT well_id, doc_id, report_date, CAST(day(report_date) AS INT) AS report_no,
  CAST(1000 + CAST(floor(day(report_date) / 3) AS BIGINT) * 50 AS STRING) || ' ft' AS end_depth_md_ft,
  CASE WHEN n % 7 = 0 THEN '' ELSE CAST(CAST(floor(v * 1000) AS BIGINT) * (CASE WHEN day(report_date) % 9 = 4 THEN 5 ELSE 1 END) AS STRING) || ' USD' END AS daily_cost,
  CAST(CAST(floor(v * 1000) AS BIGINT) * day(report_date) AS STRING) AS cumulative_cost,
  'Rig ' || CAST(n % 3 AS STRING) AS rig_name,
  CAST(n AS STRING) AS head_count,
  CASE WHEN n % 5 = 0 THEN 'Morning' ELSE 'Daily' END AS report_type
FROM (SELECT 'W' || CAST(user_id % 4 AS STRING) AS well_id,
        'W' || CAST(user_id % 4 AS STRING) || '-DDR-' || lpad(CAST(day(ts) AS STRING), 3, '0') || '-' || CAST(CAST(ts AS DATE) AS STRING) AS doc_id,
        CAST(ts AS DATE) AS report_date, max(value) AS v, count(*) AS n
      FROM events GROUP BY 1, 2, 3) h"""

# Daily weather over the whole field.
VIEWS["weather"] = """
SELECT CAST(ts AS DATE) AS report_date,
  CAST(sum(event_id) % 37 AS DOUBLE) + avg(value) / 100 AS wind_speed_kn,
  CAST(sum(event_id) % 360 AS DOUBLE) AS wind_direction_deg,
  CAST(sum(event_id) % 353 AS DOUBLE) AS vessel_heading_deg,
  CAST(sum(event_id) % 29 AS DOUBLE) / 2 + avg(value) / 100 AS wave_height_ft,
  avg(value) / 8 + CAST(count(*) % 5 AS DOUBLE) AS swell_height_ft,
  CAST(count(*) % 9 AS DOUBLE) AS wave_period_s
FROM events GROUP BY 1"""

# Sentences in report language, one per line item.
VIEWS["narr"] = """
SELECT l_orderkey * 8 + l_linenumber AS seq,
  'D' || CAST(l_orderkey % 500 AS STRING) AS doc_id,
  CAST(l_shipdate AS DATE) AS report_date,
  CASE WHEN l_returnflag = 'A' THEN 'COND1' WHEN l_returnflag = 'R' THEN 'PROD1' ELSE 'COMPZN' END AS phase,
  CAST(l_linenumber AS INT) AS page,
  l_quantity / 10 AS duration_hr,
  l_linestatus = 'F' AS is_npt,
  CASE (l_orderkey + l_linenumber) % 21
    WHEN 0 THEN CAST(CAST(l_quantity AS BIGINT) AS STRING) || 'klbs restriction at ' || CAST(1000 + l_partkey % 9000 AS STRING) || 'ft in open hole'
    WHEN 1 THEN 'Confirmed latched with 5klbs overpull. Continue RIH to ' || CAST(1000 + l_partkey % 9000 AS STRING) || ' ft.'
    WHEN 2 THEN 'Observed 12-' || CAST(CAST(l_quantity AS BIGINT) + 12 AS STRING) || 'klbs overpull at ' || CAST(1000 + l_partkey % 9000 AS STRING) || 'ft while pulling out'
    WHEN 3 THEN 'Loss rate of ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || ' bbls/hr while drilling ahead'
    WHEN 4 THEN 'No losses observed during circulation'
    WHEN 5 THEN 'Full losses, pumped LCM pill, total loss of ' || CAST(CAST(l_quantity AS BIGINT) * 3 AS STRING) || ' bbls'
    WHEN 6 THEN 'Drilled ahead with ECD ' || CAST(9 + l_suppkey % 7 AS STRING) || '.' || CAST(l_partkey % 9 AS STRING) || '5 ppge and ballooning observed'
    WHEN 7 THEN 'Performed FIT to 14.' || CAST(l_partkey % 9 AS STRING) || ' ppge, good FIT at casing shoe ' || CAST(1000 + l_partkey % 9000 AS STRING) || 'ft'
    WHEN 8 THEN 'Performed LOT to 15.' || CAST(l_partkey % 9 AS STRING) || ' ppge until divergence'
    WHEN 9 THEN 'Drilled with average ROP ' || CAST(CAST(l_quantity AS BIGINT) + 20 AS STRING) || ' ft/hr, instantaneous ROP of ' || CAST(CAST(l_quantity AS BIGINT) + 60 AS STRING) || ' ft/hr'
    WHEN 10 THEN 'Drilled from ' || CAST(1000 + l_partkey % 9000 AS STRING) || ' ft to ' || CAST(1100 + l_partkey % 9000 AS STRING) || ' ft with WOB ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || ' klbs and flow rate ' || CAST(400 + l_suppkey % 300 AS STRING) || ' gpm'
    WHEN 11 THEN 'RIH from ' || CAST(1000 + l_partkey % 9000 AS STRING) || ' ft to ' || CAST(1500 + l_partkey % 9000 AS STRING) || ' ft at ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || ' ft/min in cased hole'
    WHEN 12 THEN 'Sleeve #' || CAST(1 + l_suppkey % 18 AS STRING) || ' opened at ' || CAST(3000 + l_partkey % 2000 AS STRING) || ' psi'
    WHEN 13 THEN 'Ran 7 inch casing at running speed ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || ' ft/min, tagged bottom at ' || CAST(1000 + l_partkey % 9000 AS STRING) || 'ft with 25klbs'
    WHEN 14 THEN 'Gas influx noted, wellbore instability, packoff at ' || CAST(1000 + l_partkey % 9000 AS STRING) || 'ft'
    WHEN 15 THEN 'Tight spot at ' || CAST(1000 + l_partkey % 9000 AS STRING) || ' ft and packoff at ' || CAST(1500 + l_partkey % 9000 AS STRING) || ' ft with 15 klbs'
    WHEN 16 THEN 'Static loss rate of ' || CAST(1 + l_suppkey % 9 AS STRING) || ' gpm while tripping at ' || CAST(60 + l_suppkey % 60 AS STRING) || ' ft/min in open hole, differential sticking at ' || CAST(1000 + l_partkey % 9000 AS STRING) || ' ft'
    WHEN 17 THEN 'Pumped LCM sweep with returns to surface'
    WHEN 18 THEN CAST(CAST(l_quantity AS BIGINT) AS STRING) || ' bbls losses while cementing at ' || CAST(1000 + l_partkey % 9000 AS STRING) || ' ft'
    WHEN 19 THEN 'ROP ' || CAST(CAST(l_quantity AS BIGINT) + 10 AS STRING) || ' ft/hr, running ' || CAST(1 + l_suppkey % 20 AS STRING) || ' joints/hr, evacuate gas from well'
    ELSE 'Recommend review of mud programme before next run. Lesson learned on hole cleaning; prevent repeat.'
  END AS operation_text
FROM lineitem"""

# Report file names with planted gaps, copies and malformed names.
VIEWS["filenames"] = """
SELECT CASE o_orderkey % 23
    WHEN 5 THEN 'scan_' || CAST(o_orderkey AS STRING) || '.pdf'
    WHEN 6 THEN 'notes ' || CAST(o_orderkey AS STRING) || '.txt'
    WHEN 7 THEN 'North_Site_SITE_16A_(78)-32_Drilling-C_' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || CAST(year(o_orderdate) AS STRING) || '_' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || CAST(year(o_orderdate) AS STRING) || '_' || CAST(o_orderkey % 90 + 1 AS STRING) || '_1_reporttmp' || CASE WHEN o_orderkey % 2 = 0 THEN ' 2' ELSE '' END || '.pdf'
    WHEN 8 THEN 'RigAlpha DDR ' || CAST(CAST(o_orderkey AS BIGINT) AS STRING) || 'FLDX R' || CAST(o_custkey % 5 AS STRING) || ' ' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '.' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '.' || CAST(year(o_orderdate) AS STRING) || '..pdf'
    ELSE 'Rig' || CASE WHEN o_custkey % 2 = 0 THEN 'Alpha' ELSE 'Beta' END || ' DDR ' || CAST(o_orderkey AS STRING) || ' FLDX R' || CAST(o_custkey % 5 AS STRING) || ' ' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '.' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '.' || CAST(year(o_orderdate) AS STRING) || '.pdf'
  END AS source_filename,
  CAST(o_orderkey AS BIGINT) AS seq,
  CASE WHEN o_orderkey % 41 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(o_totalprice) AS BIGINT) END AS file_size_bytes
FROM orders"""

# Pages of text: every document text is one page of its source.
VIEWS["docpages"] = """
SELECT source || '-' || CAST(CAST(floor(doc_id / 20) AS BIGINT) AS STRING) AS doc_id, doc_id AS rec_id,
  CAST(1 + doc_id % 20 AS INT) AS page, lang, text AS clean_text
FROM documents"""

# Table rows: an order is a table, its line items the rows, plus a header and totals.
VIEWS["trows"] = """
SELECT l_orderkey AS doc_id, CAST(1 + l_orderkey % 4 AS INT) AS page, CAST(0 AS INT) AS table_no, CAST(l_linenumber AS INT) AS row_no,
  'Item ' || CAST(l_partkey AS STRING) || ' ' || l_returnflag AS c0,
  CASE WHEN l_linenumber % 5 = 0 THEN '(' || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) || ')' ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) END AS c1,
  CAST(CAST(round(l_discount * 100) AS BIGINT) AS STRING) || '.5%' AS c2,
  CASE WHEN l_linenumber % 4 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) || ',' || lpad(CAST(l_suppkey % 1000 AS STRING), 3, '0') END AS c3
FROM lineitem"""

# Cells of operation tables: two tables on each of three pages of a document, with titles, shift headers, column headers
# in two layouts, continuation rows, totals and broken cells. Null row numbers never occur.
VIEWS["opcells"] = """
SELECT 'R' || CAST(CAST(floor(l_orderkey / 6) AS BIGINT) AS STRING) AS doc_id, CAST(1 + floor((l_orderkey % 6) / 2) AS INT) AS page, CAST(l_orderkey % 2 AS INT) AS table_no, CAST(row_no AS INT) AS row_no,
  CASE WHEN kind = 'text' THEN st WHEN l_orderkey % 4 < 2 THEN st ELSE ph END AS c0, CASE WHEN l_orderkey % 4 < 2 THEN en ELSE st END AS c1,
  CASE WHEN l_orderkey % 4 < 2 THEN du ELSE du END AS c2, CASE WHEN l_orderkey % 4 < 2 THEN ph ELSE en END AS c3,
  CASE WHEN l_orderkey % 4 < 2 THEN oc ELSE ac END AS c4, CASE WHEN l_orderkey % 4 < 2 THEN ac ELSE oc END AS c5,
  CASE WHEN l_orderkey % 4 < 2 THEN pt ELSE op END AS c6, CASE WHEN l_orderkey % 4 < 2 THEN op ELSE pt END AS c7
FROM (
  SELECT o_orderkey AS l_orderkey, 1 AS row_no, 'text' AS kind, 'Operation  Summary' AS st, '' AS en, '' AS du, '' AS ph, '' AS oc, '' AS ac, '' AS pt, '' AS op FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT o_orderkey, 2, 'text', CASE WHEN o_orderkey % 9 < 4 THEN '06:00-12:00' ELSE '18:00-00:00 night' END, NULL, '', '', '', '', '', '' FROM orders WHERE o_orderkey % 7 < 3
  UNION ALL SELECT o_orderkey, 3, 'head', 'Start  Time', 'End Time', CASE WHEN o_orderkey % 2 = 0 THEN 'Dur (hr)' ELSE 'Dur(hr)' END, 'Phase', 'Op Code', 'Activity Code', 'P-T-X', CASE WHEN o_orderkey % 3 = 0 THEN 'Operation' ELSE 'Operation Details' END FROM orders WHERE o_orderkey % 11 <> 3
  UNION ALL SELECT o_orderkey, 39, 'text', '12:00-18:00', '', '', '', '', '', '', '' FROM orders WHERE o_orderkey % 4 = 1
  UNION ALL SELECT o_orderkey, 40, 'head', 'Start Time', 'End Time', 'Dur (hr)', 'Phase', 'Op Code', 'Activity Code', 'P-T-X', 'Operation' FROM orders WHERE o_orderkey % 8 = 1
  UNION ALL SELECT l_orderkey, 10 * n + 1, 'row',
    CASE (l_partkey + n) % 9 WHEN 0 THEN '' WHEN 1 THEN '24' WHEN 2 THEN 'Total Hrs' WHEN 4 THEN NULL WHEN 5 THEN 'it''s' ELSE CAST(l_suppkey % 24 AS STRING) || ':' || lpad(CAST(l_partkey % 60 AS STRING), 2, '0') END,
    CASE WHEN (l_partkey + n) % 9 IN (0, 2, 4) THEN '' ELSE CAST(l_partkey % 24 AS STRING) || ':00' END,
    CASE (l_partkey + n) % 9 WHEN 0 THEN '' WHEN 2 THEN '' WHEN 3 THEN 'x.5h' WHEN 4 THEN '' ELSE CAST(CAST(floor(l_quantity / 4) AS BIGINT) AS STRING) || '.5' END,
    CASE WHEN (l_partkey + n) % 9 IN (0, 4) THEN '' ELSE 'Phase ' || l_returnflag END, CASE WHEN l_partkey % 9 = 8 THEN NULL WHEN (l_partkey + n) % 9 = 0 THEN '' ELSE 'Drilling' END, CASE WHEN (l_partkey + n) % 9 = 0 THEN 'cont' ELSE 'RIH' END,
    CASE WHEN (l_partkey + n) % 9 = 0 THEN NULL WHEN l_suppkey % 3 = 0 THEN 't' ELSE 'P' END,
    CASE (l_partkey + n) % 9 WHEN 4 THEN '' WHEN 0 THEN 'and went on ' || CAST(l_suppkey AS STRING) ELSE 'Worked  item ' || CAST(l_partkey AS STRING) || ' for ' || CAST(l_suppkey AS STRING) END
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem) l
) r"""

# Fixed-size word chunks come from operators; questions from the benchmark.
VIEWS["questions"] = """
SELECT item_id AS query_id, text AS question FROM benchmark"""

# Events with their date.
VIEWS["events_meta"] = """
SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS d FROM events"""


def expand(sql: str) -> str:
    """Replace every ``{view}`` by ``view AS (...)`` text."""
    return re.sub(r"\{(\w+)\}", lambda m: f"{m.group(1)} AS ({VIEWS[m.group(1)]})" if m.group(1) in VIEWS else m.group(0), sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """The view as a DataFrame over the parquet tables in ``sf_dir``; ``spread`` deals their rows out to all cores first."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sql = VIEWS[name]
    for t in TABLES:
        if spread and re.search(rf"\bFROM {t}\b", sql):
            ordered.spread(table(spark, sf_dir, t)).createOrReplaceTempView(f"spread_{t}")
            sql = re.sub(rf"(\bFROM ){t}\b", rf"\1spread_{t}", sql)
        sql = re.sub(rf"(\bFROM ){t}\b", rf"\1parquet.`{sf_dir}/{t}.parquet`", sql)
    return spark.sql(sql)
