"""Form-record inputs (profiles, letter requests, users, uploads) derived from
the driver tables.

Each view is one SQL text with dialect slots; Spark runs it through
``spark.sql`` with the source DataFrames passed as named arguments, DuckDB
runs it as a CTE of the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rolefit.sources.tables import read_table

SPARK_SLOTS = {"str": "STRING"}
DUCK_SLOTS = {"str": "VARCHAR"}

PROFILES_SQL = """SELECT c_custkey AS profile_id,
  CASE WHEN c_custkey % 10 = 9 THEN '' ELSE c_name END AS name,
  concat('c', CAST(c_custkey AS {str}), '@example.com') AS email,
  concat('212-555-', lpad(CAST(c_custkey % 10000 AS {str}), 4, '0')) AS phone,
  concat(CAST(c_custkey % 100 AS {str}), ' Main St, City', CAST(c_nationkey AS {str}), ', ST ',
         lpad(CAST(c_custkey % 1000 AS {str}), 5, '0')) AS location,
  '' AS linkedin,
  concat(CASE c_custkey % 4 WHEN 0 THEN 'Dedicated ' WHEN 1 THEN 'results-driven ' WHEN 2 THEN 'Senior ' ELSE '' END,
         lower(c_mktsegment), ' analyst') AS job_title,
  CAST(c_custkey % 12 AS INT) AS experience_years,
  concat(lower(c_mktsegment), ', sql, ,', CASE WHEN c_custkey % 2 = 0 THEN ' python' ELSE '' END) AS skills_csv,
  CASE c_custkey % 3 WHEN 0 THEN 'Analyst - Acme'
       WHEN 1 THEN concat('Analyst - Acme - 2019-2021', chr(10), chr(10), 'Clerk - Shop - 2017-2019')
       ELSE concat('Analyst - Acme - 2019-2021 - Led team;;Built reports', chr(10),
                   CASE WHEN c_custkey % 5 = 0 THEN 'Clerk - Shop - 2017-2019 - ' ELSE 'Clerk - Shop - 2017-2019 - Sold goods' END)
  END AS experience,
  concat('State University - 2013-2017 - BSc', CASE WHEN c_custkey % 2 = 0 THEN ' - Honors' ELSE '' END,
         chr(10), chr(10), 'High School') AS education,
  concat('Tracker - Python - Tracks orders', chr(10), chr(10), 'Site - HTML - Web page - http://example.com/',
         CAST(c_custkey AS {str})) AS projects,
  concat('Cert A - p1;p2', chr(10), 'Cert B') AS certifications,
  '' AS achievements, '' AS hobbies,
  CASE WHEN c_custkey % 2 = 0 THEN '' ELSE concat('Analyst in ', lower(c_mktsegment), '.') END AS summary
FROM {t_customer}"""

LETTERS_SQL = """SELECT c_custkey AS request_id, c_name AS applicant_name,
  concat(CAST(c_custkey % 100 AS {str}), ' Main St',
         CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ', Springfield' ELSE ', Springfield, IL 62701' END) AS address,
  concat('212-555-', lpad(CAST(c_custkey % 10000 AS {str}), 4, '0')) AS phone,
  concat('c', CAST(c_custkey AS {str}), '@example.com') AS email,
  CASE WHEN c_custkey % 11 = 10 THEN '' ELSE concat(lower(c_mktsegment), ' analyst') END AS job_title,
  concat(n_name, ' Corp') AS company,
  CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '   ' ELSE concat('Jane ', n_name) END AS recruiter,
  concat('1 ', n_name, ' Plaza') AS company_address,
  concat(CAST(c_custkey % 12 AS {str}), ' years in ', lower(c_mktsegment)) AS experience,
  'sql, python' AS skills,
  CASE c_custkey % 4 WHEN 0 THEN 'Minimal' WHEN 1 THEN 'Formal' WHEN 2 THEN 'Modern' ELSE 'Fancy' END AS template_choice
FROM {t_customer} JOIN {t_nation} ON n_nationkey = c_nationkey"""

USERS_SQL = """SELECT c_custkey AS id, c_name AS name,
  concat('c', CAST(c_custkey % 1000 AS {str}), '@example.com') AS email FROM {t_customer}"""

UPLOADS_SQL = """SELECT o_orderkey AS request_id, 'resume' AS role,
  concat('cv_', CAST(o_orderkey AS {str}), CASE o_orderkey % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.PDF'
         WHEN 3 THEN '.txt' ELSE '.pdf' END) AS filename FROM {t_orders}
UNION ALL
SELECT o_orderkey AS request_id, 'jd' AS role,
  concat('jd_', CAST(o_orderkey AS {str}), CASE o_orderkey % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.docx' WHEN 2 THEN '.pdf'
         ELSE '.rtf' END) AS filename FROM {t_orders} WHERE o_orderkey % 7 <> 0"""

VIEWS = {"profiles": (PROFILES_SQL, ("customer",)),
         "letter_requests": (LETTERS_SQL, ("customer", "nation")),
         "users": (USERS_SQL, ("customer",)),
         "uploads": (UPLOADS_SQL, ("orders",))}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, tables = VIEWS[name]
    text = sql.format(**SPARK_SLOTS, **{f"t_{t}": "{" + t + "}" for t in tables})
    return spark.sql(text, **{t: read_table(spark, sf_dir, t) for t in tables})


def duck_view(name: str) -> str:
    sql, tables = VIEWS[name]
    return sql.format(**DUCK_SLOTS, **{f"t_{t}": t for t in tables})
