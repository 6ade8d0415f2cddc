"""Intake operators (S1–S5): upload routing, text scans, page assembly,
dictionary load and unique-key registration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolefit import constants as K
from rolefit.functions.text import U, py_strip

RESUME_EXT = (".pdf", ".docx")
JD_EXT = (".pdf", ".docx", ".txt")


def _ends(c, exts) -> F.Column:
    out = None
    for e in exts:
        t = c.endswith(e)
        out = t if out is None else out | t
    return out


def intake_routing(uploads: DataFrame) -> DataFrame:
    """Pair the résumé and JD upload of each request (full outer join on
    request_id), check presence and case-sensitive extensions, and name the
    parser each file goes to."""
    r = uploads.filter(F.col("role") == "resume").select("request_id", F.col("filename").alias("resume_file"))
    j = uploads.filter(F.col("role") == "jd").select("request_id", F.col("filename").alias("jd_file"))
    x = r.join(j, "request_id", "full")
    rf, jf = F.col("resume_file"), F.col("jd_file")
    both = rf.isNotNull() & jf.isNotNull()
    ok_ext = _ends(rf, RESUME_EXT) & _ends(jf, JD_EXT)
    reason = (F.when(~both, F.lit(K.MSG_UPLOAD_BOTH)).when(~ok_ext, F.lit(K.MSG_UPLOAD_FORMAT)))
    parser = (lambda c: F.when(c.endswith(".docx"), "docx").when(c.endswith(".pdf"), "pdf")
              .when(c.endswith(".txt"), "txt"))
    return x.select("request_id", "resume_file", "jd_file", reason.isNull().alias("accepted"),
                    reason.alias("reject_reason"),
                    F.when(reason.isNull(), parser(rf)).alias("resume_format"),
                    F.when(reason.isNull(), parser(jf)).alias("jd_format"))


def text_scan(spark: SparkSession, path: str, record_sep: str | None = None) -> DataFrame:
    """One row per UTF-8 text file, or with ``record_sep`` one per record of files that hold many: (path, text)."""
    df = spark.read.text(path, wholetext=True) if record_sep is None else spark.read.text(path, lineSep=record_sep)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def doc_pages(documents: DataFrame) -> DataFrame:
    """Page table of the driver's documents: one page per line, and an empty (scanned) page after every four."""
    lines = F.split("text", "\n", -1)
    e = documents.select("doc_id", F.posexplode(lines).alias("pos", "page_text"))
    full = e.select("doc_id", (F.col("pos") + F.floor(F.col("pos") / 4)).cast("int").alias("page_no"), "page_text")
    fours = F.floor(F.size(lines) / 4).cast("int")
    blank = documents.select("doc_id", F.explode(F.when(fours > 0, F.sequence(F.lit(0), fours - 1))).alias("k"))
    return full.unionByName(blank.select("doc_id", (F.col("k") * 5 + 4).cast("int").alias("page_no"), F.lit("").alias("page_text")))


def _ordered_pages(pages: DataFrame) -> DataFrame:
    g = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "page_text"))).alias("_p"))
    return g.select("doc_id", F.transform("_p", lambda x: F.coalesce(x["page_text"], F.lit(""))).alias("_t"))


def page_assembly(pages: DataFrame, sep: str = "\n", skip_empty: bool = True) -> DataFrame:
    """S3a (skip empty pages, join by ``\\n``) and S3c (``sep=''``, keep all)."""
    p = _ordered_pages(pages)
    t = F.filter("_t", lambda x: x != "") if skip_empty else F.col("_t")
    return p.select("doc_id", F.array_join(t, sep).alias("text"))


def page_assembly_ocr_flag(pages: DataFrame) -> DataFrame:
    """Every page + ``\\n``, blank runs collapsed, stripped; empty ⇒ needs OCR."""
    p = _ordered_pages(pages)
    raw = F.array_join(F.transform("_t", lambda x: F.concat(x, F.lit("\n"))), "")
    text = py_strip(F.regexp_replace(raw, U + r"\n\s*\n+", "\n"))
    return p.select("doc_id", text.alias("text")).withColumn("needs_ocr", F.col("text") == "")


SKILL_ENTRY = T.StructType([T.StructField("skill_name", T.StringType()),
                            T.StructField("low_surface_forms", T.ArrayType(T.StringType())),
                            T.StructField("match_on_tokens", T.BooleanType())])


def _skill_rows(m: DataFrame) -> DataFrame:
    """skill_db rows of (skill_id, e); absent lists and flags take their defaults."""
    return m.select("skill_id", F.col("e.skill_name").alias("skill_name"),
                    F.coalesce(F.col("e.low_surface_forms"), F.array().cast("array<string>")).alias("low_surface_forms"),
                    F.coalesce(F.col("e.match_on_tokens"), F.lit(False)).alias("match_on_tokens"))


def skill_dict_load(spark: SparkSession, path: str) -> DataFrame:
    """Files of :func:`write_skill_dict` → skill_db rows.  A line is a JSON object keyed by id, so a file is read
    by as many tasks as it has splits."""
    lines = spark.read.text(path)
    return _skill_rows(lines.select(F.explode(F.from_json("value", T.MapType(T.StringType(), SKILL_ENTRY))).alias("skill_id", "e")))


def skill_object_load(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """Files that are one JSON object keyed by id each, however large and however laid out → skill_db rows."""
    from rolefit.sources.json_object import RANGE_BYTES, json_object_members
    m = json_object_members(spark, path, range_bytes or RANGE_BYTES)
    return _skill_rows(m.select(F.col("key").alias("skill_id"), F.from_json("value", SKILL_ENTRY).alias("e")))


def _entries(skill_db: DataFrame) -> DataFrame:
    return skill_db.select("skill_id", F.struct("skill_name", "low_surface_forms", "match_on_tokens").alias("e"))


def write_skill_dict(skill_db: DataFrame, path: str) -> None:
    """skill_db as JSON objects keyed by id, an entry a line, a file a task."""
    _entries(skill_db).select(F.to_json(F.create_map("skill_id", "e")).alias("value")).write.mode("overwrite").text(path)


def write_skill_object(skill_db: DataFrame, path: str) -> None:
    """skill_db as one JSON object in one file: an entry a line, written by one task as the rows pass."""
    line = F.regexp_replace(F.to_json(F.create_map("skill_id", "e")), r"^\{|\}$", "")
    rows = _entries(skill_db).select(F.lit(1).alias("part"), "skill_id", line.alias("line"))
    ends = skill_db.sparkSession.createDataFrame([(0, "", "{"), (2, "", "}")], "part int, skill_id string, line string")
    first = rows.agg(F.min("skill_id").alias("first"))
    rows = rows.join(first, F.col("skill_id") == F.col("first"), "left")
    rows = rows.select("part", "skill_id", F.when(F.col("first").isNull(), F.concat(F.lit(","), "line")).otherwise(F.col("line")).alias("line"))
    rows.unionByName(ends).orderBy("part", "skill_id").coalesce(1).select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def unique_key_append(batch: DataFrame, existing: DataFrame, key: str = "email",
                      order: str = "id") -> DataFrame:
    """Registrations in ``order``; the first row of each key is accepted
    unless the key already exists; every other row is rejected, and so is a
    row without key.

    The first id per key comes from a grouped aggregate (partial aggregation
    absorbs hot keys), not from a window over a possibly huge key group."""
    first = batch.groupBy(key).agg(F.min(order).alias("_first"))
    taken = existing.select(key).distinct().withColumn("_taken", F.lit(True))
    x = batch.join(first, key, "left").join(taken, key, "left")
    ok = F.coalesce((F.col(order) == F.col("_first")) & F.col("_taken").isNull(), F.lit(False))
    reason = F.when(F.col(key).isNull(), F.lit(K.MSG_EMAIL_MISSING)).when(~ok, F.lit(K.MSG_EMAIL_TAKEN))
    return x.select(*batch.columns, ok.alias("accepted"), reason.alias("reject_reason"))
