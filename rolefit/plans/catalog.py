"""Registry of named queries: each takes (spark, sf_dir) and returns a DataFrame.

Single operators read the raw fixture texts so that their oracles stay short;
only ``ats_report`` chains the operators over formatted text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.functions.arrays import inline_rows, packed, unpacked
from rolefit.operators import skills as sk
from rolefit.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ----------------------------------------------------------------- skills
_DICTIONARIES: dict = {}


def _dictionary(spark, sf, fuzzy: bool):
    """Tables of the fixture dictionary, built once per session and sf folder."""
    from rolefit.plans.report import dictionary_tables
    k = (spark.sparkContext.applicationId, sf.rstrip("/"), fuzzy)
    if k not in _DICTIONARIES:
        _DICTIONARIES[k] = dictionary_tables(fx.skill_fx(spark, sf), fuzzy)
    return _DICTIONARIES[k]


def _forms(spark, sf):
    return _dictionary(spark, sf, False)[0]


@query("skill_extract")
def q_skill_extract(spark, sf):
    db, forms = fx.skill_fx(spark, sf), _forms(spark, sf)
    r = sk.extract_skills(fx.resume_fx(spark, sf), db, "resume_id", forms=forms)
    j = sk.extract_skills(fx.jd_fx(spark, sf), db, "jd_id", forms=forms)
    return (r.select(F.lit("resume").alias("side"), F.col("resume_id").alias("doc_id"), "skill_name")
            .unionByName(j.select(F.lit("jd").alias("side"), F.col("jd_id").alias("doc_id"), "skill_name")))


@query("skill_gap_arrays")
def q_skill_gap_arrays(spark, sf):
    db, forms = fx.skill_fx(spark, sf), _forms(spark, sf)
    resumes, jds = fx.resume_fx(spark, sf), fx.jd_fx(spark, sf)
    rs = sk.skill_sets(resumes, db, "resume_id", "resume_skills", forms=forms)
    js = sk.skill_sets(jds, db, "jd_id", "jd_skills", forms=forms)
    return sk.skill_gap_arrays(fx.pairs_fx(spark, sf, resumes, jds), rs, js)


# ----------------------------------------------------------------- report
def _report(spark, sf, **kw):
    from rolefit.plans.report import build_report
    resumes, jds = fx.resume_fx(spark, sf), fx.jd_fx(spark, sf)
    kw.setdefault("dictionary", _dictionary(spark, sf, kw.get("fuzzy_skills", True)))
    return build_report(fx.pairs_fx(spark, sf, resumes, jds), resumes, jds, fx.skill_fx(spark, sf),
                        fx.layout_chars_fx(spark, sf), fx.layout_pages_fx(spark, sf), fx.files_fx(spark, sf), **kw)


@query("ats_report")
def q_ats_report(spark, sf):
    return _report(spark, sf)


#: The report by rules that SQL can express: raw texts, equal token-sort keys, section names as substrings.
EXACT = {"text_mode": "raw", "fuzzy_skills": False, "fuzzy_sections": False}


@query("ats_report_exact")
def q_ats_report_exact(spark, sf):
    return _report(spark, sf, **EXACT)


@query("total_score")
def q_total_score(spark, sf):
    """C3 before rounding, with its seven parts."""
    from rolefit.plans.report import SCORE_COLS
    return _report(spark, sf, **EXACT, rounded=False).select("resume_id", "jd_id", *SCORE_COLS)


@query("recommendations")
def q_recommendations(spark, sf):
    return _report(spark, sf, **EXACT).select("resume_id", "jd_id", "recommendations")


from rolefit.plans import catalog_ops  # noqa: E402,F401  (registers the operator queries)


# ----------------------------------------------------------------- G3, G5–G8
def _skill_pairs(spark, sf, fuzzy: bool):
    from rolefit.functions.joins import fits, materialize, pair_rows
    from rolefit.plans import report as rp
    forms, syn = _dictionary(spark, sf, fuzzy)
    codes = rp.skill_vocabulary(forms, syn)
    rf = rp.doc_skill_features(fx.resume_fx(spark, sf), "resume_id", "text", forms, syn, codes).select("resume_id", "exp")
    jf = rp.doc_skill_features(fx.jd_fx(spark, sf), "jd_id", "text", forms, syn, codes)
    # both sets of a JD move with every pair: as codes, or as one text each
    move, back = (F.col, F.col) if codes else (packed, unpacked)
    jf = materialize(jf.select("jd_id", move("exp").alias("wanted"), move("exp_hits").alias("hits")), "jd-skills")
    x = pair_rows(fx.pairs_fx(spark, sf), rf, jf, fits(jf))
    x = x.select("resume_id", "jd_id", "exp", back("wanted").alias("wanted"), back("hits").alias("hits"))
    return rp.add_skill_match(x, "exp", "wanted", "hits", codes).select("resume_id", "jd_id", "matched_skills", "missing_skills", "skill_match_score")


@query("skill_gap_long")
def q_skill_gap_long(spark, sf):
    g = q_skill_gap_arrays(spark, sf)
    # both lists of a pair in one pass over the pairs
    rows = F.concat(*[F.transform(c, lambda x: F.struct(x.alias("skill_name"), F.lit(status).alias("status")))
                      for c, status in (("missing_skills", "missing"), ("matched_skills", "matched"))])
    return inline_rows(g, ["resume_id", "jd_id"], rows, "skill_name")


@query("skill_expand")
def q_skill_expand(spark, sf):
    from rolefit.plans import report as rp
    f = rp.doc_skill_features(fx.resume_fx(spark, sf), "resume_id", "text", *_dictionary(spark, sf, False))
    return f.select("resume_id", F.col("exp").alias("expanded"))


@query("skill_score")
def q_skill_score(spark, sf):
    return _skill_pairs(spark, sf, fuzzy=False)


@query("skill_fuzzy_match")
def q_skill_fuzzy_match(spark, sf):
    return _skill_pairs(spark, sf, fuzzy=True).select("resume_id", "jd_id", "matched_skills")


@query("skill_missing_fuzzy")
def q_skill_missing_fuzzy(spark, sf):
    return _skill_pairs(spark, sf, fuzzy=True).select("resume_id", "jd_id", "missing_skills", "skill_match_score")
