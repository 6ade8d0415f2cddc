"""Input views built from the driver tables (see FIXTURES.md).

Each view exists twice: as a DataFrame plan for Spark, and as a SQL text with
dialect slots, used as a CTE at the head of the DuckDB oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.functions.joins import broadcast_if_small, materialize, unshipped
from rolefit.sources.tables import read_table

NL = "\n"

# The fixture views stand in for input tables: each is built once per session
# and sf folder and written as Parquet into the shared folder.
_VIEWS: dict = {}


def _view(spark: SparkSession, sf_dir: str, name: str, key: str, build) -> DataFrame:
    k = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if k not in _VIEWS:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        _VIEWS[k] = materialize(build().repartition(n, key), name)
    return _VIEWS[k]


def _skills_agg(c: str = "p_name"):
    return F.array_join(F.sort_array(F.collect_set(c)), NL)


def skill_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "skill_fx", "skill_id", lambda: _skill_fx(spark, sf_dir))


def _skill_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part").select("p_name").distinct()
    w1 = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    w2 = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    return p.select(
        F.col("p_name").alias("skill_id"),
        F.col("p_name").alias("skill_name"),
        F.array(F.replace("p_name", F.lit(" "), F.lit("-")), F.concat(w2, F.lit(" "), w1)).alias("low_surface_forms"),
        w1.isin("red", "hot").alias("match_on_tokens"))


def resume_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "resume_fx", "resume_id", lambda: _resume_fx(spark, sf_dir))


def _resume_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment").distinct()
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    # narrow rows are grouped by customer key first: names and segments do not move with the order lines
    j = li.join(broadcast_if_small(o), li.l_orderkey == o.o_orderkey).join(broadcast_if_small(p), p.p_partkey == li.l_partkey)
    g = j.groupBy("o_custkey").agg(_skills_agg().alias("skills"), F.min(F.year("o_orderdate")).alias("y0"),
                                   F.max(F.year("o_orderdate")).alias("y1"))
    r = c.join(unshipped(g), g.o_custkey == c.c_custkey).select(
        F.col("c_custkey").alias("resume_id"), F.col("c_nationkey").alias("nationkey"), "c_name",
        F.col("c_mktsegment").alias("seg"), "skills", "y0", "y1")
    rid = F.col("resume_id")
    s = F.col("y0") + rid % 4
    s_txt = s.cast("string")
    text = F.concat(
        F.col("c_name"), F.lit(NL),
        F.lit("Email: c"), rid.cast("string"), F.lit("@example.com | 212.555."),
        F.lpad((rid % 10000).cast("string"), 4, "0"), F.lit(NL),
        F.lit("Summary" + NL), (F.col("y1") - F.col("y0")).cast("string"), F.lit(" years in "),
        F.lower("seg"), F.lit(NL),
        F.lit("Skills" + NL), F.col("skills"), F.lit(NL),
        F.lit("Experience" + NL), F.lit("Operator - Acme - "), s_txt, F.lit("-"),
        F.greatest(s, F.col("y1") - rid % 3).cast("string"), F.lit(NL),
        F.lit("Education" + NL), F.lit("Course "), (rid % 7).cast("string"))
    return r.select("resume_id", "nationkey", text.alias("text"))


def _jd_key(supplier: str):
    """One JD per supplier and quarter of the order date."""
    d = F.col("o_orderdate")
    return F.col(supplier).cast("long") * 1000 + (F.year(d) - 1990) * 4 + F.quarter(d)


def jd_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "jd_fx", "jd_id", lambda: _jd_fx(spark, sf_dir))


def _jd_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    j = (li.join(broadcast_if_small(s), li.l_suppkey == s.s_suppkey).join(broadcast_if_small(o), o.o_orderkey == li.l_orderkey)
         .join(broadcast_if_small(p), p.p_partkey == li.l_partkey))
    g = (j.groupBy(_jd_key("s_suppkey").alias("jd_id"), F.col("s_nationkey").alias("nationkey"))
         .agg(F.min(F.lower("p_type")).alias("title"), _skills_agg().alias("skills")))
    jid = F.col("jd_id")
    text = F.concat(
        F.lit("Job title: "), F.col("title"), F.lit(" operator" + NL),
        F.lit("Requirements" + NL), F.col("skills"), F.lit(NL),
        F.lit("Benefits" + NL), F.lit("Period "), (1990 + jid % 8).cast("string"), F.lit("-"),
        (1991 + jid % 8).cast("string"))
    return g.select("jd_id", "nationkey", text.alias("text"))


def pairs_fx(spark: SparkSession, sf_dir: str, resumes: DataFrame | None = None,
             jds: DataFrame | None = None) -> DataFrame:
    """The pairs to score (built once per session): a customer's résumé and each JD that its order lines name."""
    return _view(spark, sf_dir, "pairs_fx", "resume_id", lambda: _pairs(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey")
    p = read_table(spark, sf_dir, "part").select("p_partkey")
    # customers, suppliers and parts only have to be there: the rows are made distinct
    o = o.join(broadcast_if_small(c), o.o_custkey == c.c_custkey, "left_semi")
    j = (li.join(broadcast_if_small(s), s.s_suppkey == li.l_suppkey, "left_semi")
         .join(broadcast_if_small(p), p.p_partkey == li.l_partkey, "left_semi"))
    j = j.join(unshipped(o), j.l_orderkey == o.o_orderkey)
    return j.select(F.col("o_custkey").alias("resume_id"), _jd_key("l_suppkey").alias("jd_id")).distinct()


# --------------------------------------------------------------------------
# SQL texts (DuckDB dialect) for the oracles.
# --------------------------------------------------------------------------

_DUCK = {"arr": "list_value", "str": "VARCHAR",
         "agg_sk": "string_agg(DISTINCT p_name, chr(10) ORDER BY p_name)"}

SKILL_FX_SQL = """SELECT p_name AS skill_id, p_name AS skill_name,
       {arr}(replace(p_name, ' ', '-'), concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1))) AS low_surface_forms,
       split_part(p_name, ' ', 1) IN ('red', 'hot') AS match_on_tokens
FROM (SELECT DISTINCT p_name FROM part)"""

RESUME_FX_SQL = """SELECT resume_id, nationkey, concat(c_name, chr(10),
  'Email: c', CAST(resume_id AS {str}), '@example.com | 212.555.', lpad(CAST(resume_id % 10000 AS {str}), 4, '0'), chr(10),
  'Summary', chr(10), CAST(y1 - y0 AS {str}), ' years in ', lower(seg), chr(10),
  'Skills', chr(10), skills, chr(10),
  'Experience', chr(10), 'Operator - Acme - ', CAST(s AS {str}), '-', CAST(greatest(s, y1 - resume_id % 3) AS {str}), chr(10),
  'Education', chr(10), 'Course ', CAST(resume_id % 7 AS {str})) AS text
FROM (SELECT c_custkey AS resume_id, c_nationkey AS nationkey, c_name, c_mktsegment AS seg,
        {agg_sk} AS skills, min(year(o_orderdate)) AS y0, max(year(o_orderdate)) AS y1,
        min(year(o_orderdate)) + c_custkey % 4 AS s
      FROM customer JOIN orders ON o_custkey = c_custkey
      JOIN lineitem ON l_orderkey = o_orderkey
      JOIN part ON p_partkey = l_partkey GROUP BY c_custkey, c_nationkey, c_name, c_mktsegment) AS r"""

JD_KEY_SQL = "CAST({s} AS BIGINT) * 1000 + (year(o_orderdate) - 1990) * 4 + quarter(o_orderdate)"

JD_FX_SQL = """SELECT jd_id, nationkey, concat('Job title: ', title, ' operator', chr(10), 'Requirements', chr(10), skills, chr(10),
  'Benefits', chr(10), 'Period ', CAST(1990 + jd_id % 8 AS {str}), '-', CAST(1991 + jd_id % 8 AS {str})) AS text
FROM (SELECT """ + JD_KEY_SQL.format(s="s_suppkey") + """ AS jd_id, s_nationkey AS nationkey, min(lower(p_type)) AS title, {agg_sk} AS skills
      FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey
      JOIN part ON p_partkey = l_partkey GROUP BY 1, s_nationkey) AS j"""

PAIRS_FX_SQL = "SELECT DISTINCT c_custkey AS resume_id, " + JD_KEY_SQL.format(s="s_suppkey") + """ AS jd_id
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey"""

FIXTURE_SQL = {"skill_fx": SKILL_FX_SQL, "resume_fx": RESUME_FX_SQL, "jd_fx": JD_FX_SQL,
               "pairs_fx": PAIRS_FX_SQL}


def duck_ctes(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` head for a DuckDB oracle."""
    from rolefit.sources.forms import VIEWS, duck_view
    parts = [f"{n} AS ({duck_view(n) if n in VIEWS else FIXTURE_SQL[n].format(**_DUCK)})" for n in names]
    return "WITH " + ",\n".join(parts) + "\n"


# --------------------------------------------------------------------------
# Layout and file facts (FIXTURES.md §1)
# --------------------------------------------------------------------------
def layout_chars_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    font = (F.when(F.col("l_returnflag") == "A", "arial").when(F.col("l_returnflag") == "N", "arialmt")
            .when(F.col("l_returnflag") == "R", "courier"))
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"),
                     font.alias("fontname"), (8 + F.col("l_quantity") / 10).alias("size"))


def layout_pages_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no")).agg(
        F.max((F.col("l_discount") > 0.08).cast("int")).alias("n_tables"),
        F.max((F.col("l_tax") > 0.06).cast("int")).alias("n_images"),
        F.bool_and(F.col("l_returnflag") == "R").alias("all_r"))
    return g.select("doc_id", "page_no",
                    F.when(F.col("doc_id") % 3 == 0, 612.0).otherwise(72.0).alias("width"),
                    "n_tables", "n_images",
                    F.when(F.col("all_r"), "").otherwise(F.concat(F.lit("page "), F.col("page_no").cast("string")))
                    .alias("text"))


def files_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    ext = F.element_at(F.array(*[F.lit(e) for e in (".pdf", ".docx", ".txt", ".PDF")]), (k % 4 + 1).cast("int"))
    ver = F.element_at(F.array(F.lit("1.3"), F.lit(None).cast("string"), F.lit("1.7"), F.lit("2.0"), F.lit("x")),
                       (k % 5 + 1).cast("int"))
    enc = F.element_at(F.array(F.lit("UTF-8"), F.lit(None).cast("string"), F.lit("LATIN1")), (k % 3 + 1).cast("int"))
    return o.select(k.alias("doc_id"), F.concat(F.lit("resume_"), k.cast("string"), ext).alias("path"),
                    ver.alias("pdf_version"), enc.alias("encoding"))


LAYOUT_CHARS_SQL = """SELECT l_orderkey AS doc_id, l_linenumber AS page_no,
  CASE l_returnflag WHEN 'A' THEN 'arial' WHEN 'N' THEN 'arialmt' WHEN 'R' THEN 'courier' END AS fontname,
  8 + l_quantity / 10 AS size FROM lineitem"""

LAYOUT_PAGES_SQL = """SELECT doc_id, page_no, CASE WHEN doc_id % 3 = 0 THEN 612.0 ELSE 72.0 END AS width,
  n_tables, n_images, CASE WHEN all_r THEN '' ELSE concat('page ', CAST(page_no AS {str})) END AS text
FROM (SELECT l_orderkey AS doc_id, l_linenumber AS page_no, max(CAST(l_discount > 0.08 AS INT)) AS n_tables,
        max(CAST(l_tax > 0.06 AS INT)) AS n_images, bool_and(l_returnflag = 'R') AS all_r
      FROM lineitem GROUP BY l_orderkey, l_linenumber) AS g"""

FILES_SQL = """SELECT o_orderkey AS doc_id,
  concat('resume_', CAST(o_orderkey AS {str}), CASE o_orderkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.txt' ELSE '.PDF' END) AS path,
  CASE o_orderkey % 5 WHEN 0 THEN '1.3' WHEN 2 THEN '1.7' WHEN 3 THEN '2.0' WHEN 4 THEN 'x' END AS pdf_version,
  CASE o_orderkey % 3 WHEN 0 THEN 'UTF-8' WHEN 2 THEN 'LATIN1' END AS encoding FROM orders"""

FIXTURE_SQL.update({"layout_chars": LAYOUT_CHARS_SQL, "layout_pages": LAYOUT_PAGES_SQL, "files": FILES_SQL})
