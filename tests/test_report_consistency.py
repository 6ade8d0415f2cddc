"""The flagship report, run on raw texts with the exact rules, agrees with the
oracle-checked single operators on every component it combines."""

from rolefit.plans.catalog import QUERIES, _report
from tests.conftest import SF_SMALL


def _by_pair(df, col):
    return {(r.resume_id, r.jd_id): r[col] for r in df.select("resume_id", "jd_id", col).collect()}


def test_report_components_match_single_operators(spark):
    rep = _report(spark, SF_SMALL, text_mode="raw", fuzzy_skills=False, fuzzy_sections=False).cache()
    checks = [("skill_score", "skill_match_score", "skill_match_score"),
              ("experience_score", "experience_score", "experience_score"),
              ("job_title_score", "job_title_score", "job_title_score"),
              ("keyword_density", "keyword_density_score", "keyword_density_score")]
    for q, qcol, rcol in checks:
        single = _by_pair(QUERIES[q](spark, SF_SMALL), qcol)
        got = _by_pair(rep, rcol)
        assert set(single) == set(got)
        for k, v in single.items():
            assert got[k] == round(v, 2), (q, k)
    mk = _by_pair(QUERIES["missing_keywords"](spark, SF_SMALL), "missing_keywords")
    assert all(list(v) == list(mk[k]) for k, v in _by_pair(rep, "missing_keywords").items())
    wk = _by_pair(QUERIES["matched_keywords"](spark, SF_SMALL), "matched_keywords")
    assert all(list(v) == list(wk[k]) for k, v in _by_pair(rep, "matched_keywords").items())
    sec = {r.resume_id: r.section_score for r in QUERIES["section_presence"](spark, SF_SMALL).collect()}
    fmt = {r.doc_id: r.formatting_score for r in QUERIES["formatting_score"](spark, SF_SMALL).collect()}
    ff = {r.doc_id: r.file_format_score for r in QUERIES["file_format_score"](spark, SF_SMALL).collect()}
    for r in rep.collect():
        assert r.section_score == sec[r.resume_id]
        assert r.formatting_score == fmt[r.resume_id]
        assert r.file_format_score == ff[r.resume_id]
        assert r.total_score <= 100


def test_role_threshold_reaches_the_experience_score(spark):
    def scores(threshold):
        rep = _report(spark, SF_SMALL, text_mode="raw", fuzzy_skills=False, fuzzy_sections=False, role_threshold=threshold)
        return _by_pair(rep, "experience_score")

    low, high = scores(-1.0), scores(2.0)
    assert set(low) == set(high)
    assert low != high
