"""Views of the driver's tables in the shapes that audits read; the same SQL runs on Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

EXAMS = """
SELECT o.o_orderkey AS series_submitter_id, o.o_custkey AS patient_id,
 CASE WHEN o.o_custkey % 20 < 11 THEN 'Female' ELSE 'Male' END AS sex,
 CASE WHEN c.c_nationkey <= 14 THEN 'White' WHEN c.c_nationkey <= 21 THEN 'Black or African American'
      WHEN c.c_nationkey = 22 THEN 'Asian' WHEN c.c_nationkey = 23 THEN 'Other' ELSE 'Not Reported' END AS race,
 CASE c.c_mktsegment WHEN 'FURNITURE' THEN 'Hispanic or Latino' WHEN 'MACHINERY' THEN 'Not Reported'
      ELSE 'Not Hispanic or Latino' END AS ethnicity,
 CASE WHEN c.c_acctbal > 9500 THEN NULL
      ELSE CAST(floor(18 + (c.c_acctbal + 1000) / 150) AS DOUBLE) END AS age_at_imaging,
 CASE o.o_orderstatus WHEN 'F' THEN 'GE MEDICAL SYSTEMS' WHEN 'O' THEN 'Siemens' ELSE 'SIEMENS' END AS manufacturer,
 CASE WHEN o.o_orderpriority < '3' THEN CAST(3.0 AS DOUBLE) ELSE CAST(1.5 AS DOUBLE) END AS magnetic_field_strength,
 CASE WHEN o.o_custkey % 5 < 2 THEN 'gold' ELSE 'silver' END AS annotation_quality
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""

SCORES = """
SELECT series_submitter_id, ruler,
 CASE WHEN series_submitter_id % 97 = 0 THEN CAST('NaN' AS DOUBLE) ELSE round(1 - k * (1 - dvb), 6) END AS dice_vb,
 CASE WHEN series_submitter_id % 83 = 0 THEN NULL ELSE round(1 - k * (1 - ddisc), 6) END AS dice_disc,
 CASE WHEN series_submitter_id % 89 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE round(k * hvb, 6) END AS hd95_vb,
 round(k * hdisc, 6) AS hd95_disc
FROM (SELECT l_orderkey AS series_submitter_id, 1 - 2.5 * avg(l_discount) AS dvb, 1 - 4 * avg(l_tax) AS ddisc,
             avg(l_quantity) / 6 AS hvb, min(l_quantity) / 2 AS hdisc FROM lineitem GROUP BY l_orderkey) s
CROSS JOIN (SELECT 'gold' AS ruler, CAST(1.0 AS DOUBLE) AS k
            UNION ALL SELECT 'silver', CAST(0.25 AS DOUBLE)) r
"""

VOXELS = """
SELECT case_id, x, y, z, min(ref) AS ref, min(pred) AS pred FROM (
 SELECT l_suppkey AS case_id, CAST(l_quantity AS INT) AS x, CAST(l_orderkey % 20 AS INT) AS y, l_linenumber AS z,
  CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END AS ref,
  CASE WHEN l_partkey % 9 = 0 THEN 0 WHEN l_partkey % 11 = 0 THEN 1 WHEN l_partkey % 13 = 0 THEN 2
       WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 2 ELSE 0 END AS pred
 FROM lineitem) t GROUP BY case_id, x, y, z
"""

VOLUMES = """
SELECT s_suppkey AS case_id, 50 AS nx, 20 AS ny, 7 AS nz, CAST(0.5 AS DOUBLE) AS sx, CAST(0.5 AS DOUBLE) AS sy, CAST(4.0 AS DOUBLE) AS sz
FROM supplier
"""

#: Grids of cases as far as their voxels reach.
GRIDS = """
SELECT l_suppkey AS case_id, CAST(max(l_quantity) AS INT) AS nx, CAST(count(DISTINCT l_orderkey % 20) AS INT) AS ny, max(l_linenumber) AS nz,
 CAST(0.25 AS DOUBLE) * (1 + l_suppkey % 3) AS sx, CAST(0.5 AS DOUBLE) AS sy, CAST(4.0 AS DOUBLE) AS sz
FROM lineitem GROUP BY l_suppkey
"""

#: Grids and exams that break their specification.
BAD_VOLUMES = """
SELECT CASE WHEN p_partkey % 7 = 0 THEN p_partkey - 1 ELSE p_partkey END AS case_id, CAST(p_size - 1 AS INT) AS nx, CAST(20 AS INT) AS ny, CAST(7 AS INT) AS nz,
 CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(0.5 AS DOUBLE) END AS sx, CAST(0.5 AS DOUBLE) AS sy, CASE WHEN p_partkey % 13 = 0 THEN CAST(-4.0 AS DOUBLE) ELSE CAST(4.0 AS DOUBLE) END AS sz
FROM part
"""
BAD_EXAMS = """
SELECT CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS series_submitter_id, o_custkey AS patient_id,
 CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_custkey % 20 < 11 THEN 'Female' WHEN o_custkey % 20 < 19 THEN 'Male' ELSE 'male' END AS sex,
 CASE WHEN o_custkey % 23 = 0 THEN 'Martian' ELSE 'White' END AS race, CASE WHEN o_custkey % 29 = 0 THEN NULL ELSE 'Not Reported' END AS ethnicity,
 CAST(40.0 AS DOUBLE) AS age_at_imaging, CASE WHEN o_orderstatus = 'O' THEN 'Siemens' ELSE 'SIEMENS' END AS manufacturer, CAST(3.0 AS DOUBLE) AS magnetic_field_strength
FROM orders
"""

#: Patients' labelled texts: a binary outcome by group.
OUTCOMES = "SELECT d.doc_id, d.lang AS grp, l.quality, l.toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id"

VIEWS = {"exams": EXAMS, "scores": SCORES, "voxels": VOXELS, "volumes": VOLUMES, "outcomes": OUTCOMES, "grids": GRIDS, "bad_volumes": BAD_VOLUMES, "bad_exams": BAD_EXAMS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's DataFrame over the tables of ``sf_dir``."""
    text = re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in TABLES else m[0], VIEWS[name])
    used = {t for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names as common table expressions."""
    used = [f"{n} AS ({v})" for n, v in VIEWS.items() if re.search(rf"\b(FROM|JOIN) {n}\b", sql)]
    body = sql.strip()
    if body.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join([*used, body[15:]])
    if not used:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(used) + ",\n" + body[5:]
    return "WITH " + ",\n".join(used) + "\n" + body
