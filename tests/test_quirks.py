"""Hand-written rows, one per quirk, against expected values."""

import pytest
from pyspark.sql import functions as F

from rolefit import constants as K
from rolefit.operators import experience as ex
from rolefit.operators import keywords as kw
from rolefit.operators import records as rc
from rolefit.operators import scoring as sc
from rolefit.operators import sections as se
from rolefit.operators import skills as sk
from rolefit.operators import suggestions as sg
from rolefit.operators import text as tx
from rolefit.functions.text import py_round2

DB = [
    {"skill_id": "1", "skill_name": "C++", "low_surface_forms": ["cpp"], "match_on_tokens": False},
    {"skill_id": "2", "skill_name": "C#", "low_surface_forms": ["csharp"], "match_on_tokens": True},
    {"skill_id": "3", "skill_name": ".NET", "low_surface_forms": [".net framework"], "match_on_tokens": False},
    {"skill_id": "4", "skill_name": "CI/CD", "low_surface_forms": ["Continuous Delivery"], "match_on_tokens": False},
    {"skill_id": "5", "skill_name": "Python", "low_surface_forms": ["py"], "match_on_tokens": False},
    {"skill_id": "6", "skill_name": "Python", "low_surface_forms": ["python3"], "match_on_tokens": False},
    {"skill_id": "7", "skill_name": "machine learning", "low_surface_forms": ["ml"], "match_on_tokens": False},
    {"skill_id": "8", "skill_name": "++", "low_surface_forms": [], "match_on_tokens": False},
]
TEXTS = [
    "Expert in C++ and c#, also asp.net and .net.",
    "c++x and c#y; ci/cd pipelines; CONTINUOUS DELIVERY",
    "python3, py and Python\nmachine\nlearning",
    "a++b and x ++ y",
    "",
    "Deep   machine learning with ML",
]


SKILLS_FOUND = [['.NET'], ['++', 'C#', 'C++', 'CI/CD'], ['Python', 'machine learning'], ['++'], [], ['machine learning']]


def _db(spark):
    return spark.createDataFrame(DB, "skill_id string, skill_name string, low_surface_forms array<string>, "
                                     "match_on_tokens boolean")


def test_skill_extraction_matches_python_regex(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {(r.doc_id, r.skill_name) for r in sk.extract_skills(docs, _db(spark), "doc_id").collect()}
    want = {(i, s) for i, skills in enumerate(SKILLS_FOUND) for s in skills}
    assert got == want


SECTION_TEXTS = [
    "John\nSkills\npython\nSkills   \nsql\nEDUCATION\nBSc",
    "no header at all\njust lines",
    "Summary\n\nExperience\nProfessional Experience\nOps - Acme - 2019-2021",
    "Skills",
    "  \n\nProjects\nX\nprojects\nY\nSummary\nZ",
]


SECTIONS_FOUND = [[('header', ['John']), ('skills', ['sql']), ('education', ['BSc'])],
 [('header', ['no header at all', 'just lines'])],
 [('header', []), ('summary', []), ('experience', ['Professional Experience', 'Ops - Acme - 2019-2021'])],
 [('header', []), ('skills', [])],
 [('header', []), ('projects', ['Y']), ('summary', ['Z'])]]
SECTIONS_FORMATTED = ['Header\n------\n\nJohn\n\n\nSkills\n------\n\nsql\n\n\nEducation\n---------\n\nBSc',
 'Header\n------\n\nno header at all\njust lines',
 'Experience\n----------\n\nProfessional Experience\nOps - Acme - 2019-2021',
 '',
 'Projects\n--------\n\nY\n\n\nSummary\n-------\n\nZ']


def test_section_parse_and_format(spark):
    docs = spark.createDataFrame(list(enumerate(SECTION_TEXTS)), "doc_id long, text string")
    out = docs.select("doc_id", se.sections_col("text", K.RESUME_HEADERS).alias("s"),
                      se.format_sections_col(se.sections_col("text", K.RESUME_HEADERS)).alias("f")).collect()
    for r in out:
        assert [(x.section, list(x.lines)) for x in r.s] == SECTIONS_FOUND[r.doc_id]
        assert r.f == SECTIONS_FORMATTED[r.doc_id]


DATE_TEXTS = ["2019-2021", "2019–2021", "2019 - 2021", "05/2019", "jan 05/2019", "555-123-4567",
              "2021-2019", "2030-2031", "worked 2015-2018 and 2018-2020", "jan  05/2019", "2019/2021"]


RANGES_TO_2025 = [[(2019, 2021)],
 [(2019, 2021)],
 [],
 [(5, 2019)],
 [],
 [(55, 123)],
 [],
 [],
 [(2015, 2018), (2018, 2020)],
 [(5, 2019)],
 [(19, 2021)]]


def test_year_ranges(spark):
    docs = spark.createDataFrame(list(enumerate(DATE_TEXTS)), "doc_id long, text string")
    out = docs.select("doc_id", ex.year_ranges_col("text", 2025).alias("r")).collect()
    for r in out:
        assert [(x.start_year, x.end_year) for x in r.r] == RANGES_TO_2025[r.doc_id]


KW_PAIRS = [
    ("data science team lead " * 3, "Data science and team lead. data science again"),
    ("", "some words here here"),
    ("one two three four five six seven eight nine ten " * 10 + "uniquephrase", "uniquephrase"),
    ("Café résumé naïve façade", "café résumé"),
    ("odd count words", "odd count words odd count"),
]


#: density, score, missing keywords
DENSITIES = [(16.666666666666664, 30, []),
 (0, 60, []),
 (0.9900990099009901, 100, []),
 (25.0, 30, []),
 (33.33333333333333, 30, [])]


def test_keyword_density(spark):
    rows = [(i, r, j) for i, (r, j) in enumerate(KW_PAIRS)]
    df = spark.createDataFrame(rows, "id long, r string, j string")
    jp = kw.jd_keyword_profile(df.select(F.col("id").alias("jd_id"), F.col("j").alias("text")))
    x = df.select("id", F.array_distinct(kw.phrases_col("r")).alias("ps"), kw.word_count_col("r").alias("w")) \
        .join(jp.withColumnRenamed("jd_id", "id"), "id", "left")
    d, s = kw.density_cols(*kw.split_profile_cols(F.col("kw")), F.col("ps"), F.col("w"))
    out = x.select("id", d.alias("d"), s.alias("s"), kw.missing_keywords_col(F.col("kw_rep"), F.col("ps")).alias("m")).collect()
    for r in out:
        want = DENSITIES[r.id]
        assert r.d == pytest.approx(want[0]) and r.s == want[1] and list(r.m) == want[2]


PRESENCE = ["Skills\nExperience\nEducation\nCertifications", "Certifications\nEducation\nExperience\nSkills",
            "my skills and experience", "------", "", "Work history\nEducation only"]


PRESENCE_SCORES = [100, 100, 90, 100, 0, 20]


def test_section_presence_exact(spark):
    df = spark.createDataFrame(list(enumerate(PRESENCE)), "id long, text string")
    score, _ = se.section_score_cols(se.first_hits_exact(se.presence_lines("text"), rules=True))
    for r in df.select("id", score.alias("s")).collect():
        assert r.s == PRESENCE_SCORES[r.id]


def test_python_rounding(spark):
    vals = [2.675, 0.125, 1.005, 43.885, 99.995, -30.0, 41.0, 0.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert [r.y for r in df.select(py_round2("x").alias("y")).collect()] == [round(v, 2) for v in vals]


def test_file_format_rules(spark):
    rows = [(1, "a.pdf", "1.3", None), (2, "b.pdf", None, None), (3, "c.pdf", "x", "UTF-8"),
            (4, "d.docx", "2.0", "LATIN1"), (5, "e.PDF", None, None), (6, "f.pdf", "1.7", "LATIN1")]
    df = spark.createDataFrame(rows, "doc_id long, path string, pdf_version string, encoding string")
    got = {r.doc_id: (r.file_format_score, list(r.file_format_issues)) for r in sc.file_format_scores(df).collect()}
    assert got[1] == (80.0, [K.MSG_PDF_VERSION])
    assert got[2] == (100.0, [])
    assert got[3] == (0.0, [K.MSG_FILE_ERROR])
    assert got[4] == (80.0, [K.MSG_DOCX])
    assert got[5] == (20.0, [K.MSG_OTHER_FORMAT])
    assert got[6] == (80.0, [K.MSG_ENCODING])


def test_formatting_all_issues_and_no_pages(spark):
    chars = spark.createDataFrame([(1, 0, "courier", 14.0)], "doc_id long, page_no int, fontname string, size double")
    pages = spark.createDataFrame([(1, 0, 612.0, 1, 1, ""), (2, 0, 72.0, 0, 0, "text")],
                                  "doc_id long, page_no int, width double, n_tables int, n_images int, text string")
    got = {r.doc_id: (r.formatting_score, list(r.formatting_issues))
           for r in sc.formatting_scores(chars, pages).collect()}
    assert got[1][0] == -30.0 and len(got[1][1]) == 6
    # no characters: no friendly font (-30); 11pt default; width 72 → margin 1.0 passes
    assert got[2] == (70.0, [K.MSG_FONT])


def test_entity_extract(spark):
    t = "John Smith\nEmail: js@x.io phone 555-123-4567\nWork Experience\nData Engineer at X\n5 years\nSkills: a, b,, c"
    r = spark.createDataFrame([(t,)], "text string").select(*tx.entity_cols("text")).first()
    assert (r.name, r.email, r.phone, r.job_title, r.experience_years) == (
        "John Smith", "js@x.io", "555-123-4567", "Data Engineer", 5)
    import re
    m = re.search(r"(?:Skills|Technical Skills)[\s\S]*?((?:[A-Za-z\s,]+))", t)
    assert list(r.skills) == [s.strip() for s in m.group(1).split(",")]


def test_mail_merge_styles(spark):
    rows = [("Minimal",), ("Formal",), ("Modern",), ("Fancy",)]
    df = spark.createDataFrame(rows, "style string")
    m = tx.mail_merge_col("style", F.lit("BODY"), F.lit("Ann Lee"), F.lit("1 Main St, Springfield, IL 62701"),
                          F.lit("555"), F.lit("a@b.c"), F.lit("   "), F.lit("Acme"), F.lit("1 Plaza"),
                          F.lit("analyst"), "2025-01-15")
    out = {r.style: r.m for r in df.select("style", m.alias("m")).collect()}
    assert out["Fancy"] == "BODY"
    assert out["Minimal"].startswith("ANN LEE\n1 Main St, Springfield, IL 62701 | 555 | a@b.c\n\n15 January 2025")
    assert out["Formal"].startswith("ANN LEE" + " " * 40 + "Springfield, IL 62701\n" + " " * 45 + "555 | a@b.c\n" + "-" * 60)
    assert "Dear Hiring Manager,\n\nBODY" in out["Modern"] and "_" * 54 in out["Modern"]


def test_records_and_chat(spark):
    df = spark.createDataFrame([(1, "Dev - Co - 2020-2022 - Built;;Led \n\nSolo - Co2", "P1 - Py - D\n\nP2 - Go - D2 - http://x")],
                               "id long, experience string, projects string")
    ex_rows = [(r.pos, r.title, r.ach_pos, r.achievement) for r in rc.explode_experience(df, "id").collect()]
    assert ex_rows == [(0, "Dev", 0, "Built"), (0, "Dev", 1, "Led"), (2, "Solo", None, None)]
    pr = [(r.name, r.link, r.href) for r in rc.explode_projects(df, "id").collect()]
    assert pr == [("P1", K.NO_LINK, K.NO_LINK_HREF), ("P2", "http://x", "http://x")]
    conv = spark.createDataFrame([(1, 1, "assistant", "hi"), (1, 0, "system", "be nice"), (1, 2, "tool", "x"),
                                  (2, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.rendered for r in rc.chat_render(conv, add_generation_prompt=True).collect()}
    assert got[1] == "<|system|>\nbe nice</s>\n<|assistant|>\nhi</s>\n<|assistant|>\n"
    assert got[2] == "<|user|>\nq</s>\n<|assistant|>\n"


def test_profile_validation(spark):
    rows = [("n", "e", "p", "t", 0, ["s"], ""), ("n", "e", "p", "t", 3, ["s"], "A - B"),
            ("n", "e", "p", "t", 3, ["s"], "A - B - C - "), ("n", "e", "p", "t", 3, ["s"], "A - B - C\n\n"),
            ("n", "e", "p", "t", 3, [], "A - B - C")]
    df = spark.createDataFrame(rows, "name string, email string, phone string, job_title string, "
                                     "experience_years int, skills array<string>, experience string")
    r = tx.profile_reject_col("name", "email", "phone", "job_title", "experience_years", "skills", "experience")
    got = [x.r for x in df.select(r.alias("r")).collect()]
    assert got == [K.MSG_PROFILE_REQUIRED, K.MSG_PROFILE_EXPERIENCE_PARTS, K.MSG_PROFILE_ACHIEVEMENTS, None,
                   K.MSG_PROFILE_REQUIRED]


def test_jd_title_inline_and_section_fallback(spark):
    rows = [(1, "Job title: Data Engineer\nRequirements\nsql"), (2, "Job Title\nML Engineer\nSkills\npy"),
            (3, "Requirements\nsql"), (4, "JOB TITLE:   \nNext line")]
    df = spark.createDataFrame(rows, "id long, text string")
    formatted = se.format_sections_col(se.sections_col("text", K.JD_HEADERS))
    x = df.select("id", "text", formatted.alias("t"))
    out = {r.id: (r.a, r.b) for r in x.select(
        "id", tx.jd_title_col("t").alias("a"),
        tx.jd_title_fallback_col("t", se.sections_col("text", K.JD_HEADERS)).alias("b")).collect()}
    assert out[1] == ("Data Engineer", "Data Engineer")
    # a title in its own section loses its colon after formatting: default, unless fallback
    assert out[2] == (K.DEFAULT_JD_TITLE, "ML Engineer")
    assert out[3] == (K.DEFAULT_JD_TITLE, K.DEFAULT_JD_TITLE)
    # `\s*` crosses the line end, as in the original
    assert out[4][0] == "Next line"


def test_dash_rule_only_in_formatted_texts(spark):
    df = spark.createDataFrame([("------",)], "text string")
    score = lambda rules: se.section_score_cols(se.first_hits_exact(se.presence_lines("text"), rules))[0]
    assert [tuple(r) for r in df.select(score(True), score(False)).collect()] == [(100.0, 0.0)]


def test_years_in_other_digits(spark):
    df = spark.createDataFrame([("Experience\nOps - ٢٠١٥-٢٠١٨ and 2019-2020",)], "text string")
    out = df.select(sg.total_years_col(se.sections_col("text", K.RESUME_HEADERS)).alias("y"), ex.year_ranges_col("text").alias("r")).first()
    assert out.y == 4 and [(x.start_year, x.end_year) for x in out.r] == [(2015, 2018), (2019, 2020)]


def test_registrations_without_key_are_rejected(spark):
    from rolefit.sources.intake import unique_key_append
    batch = spark.createDataFrame([(1, None), (2, "a@x"), (3, "a@x"), (4, None)], "id long, email string")
    out = {r.id: (r.accepted, r.reject_reason) for r in unique_key_append(batch, spark.createDataFrame([("b@x",)], "email string")).collect()}
    assert out == {1: (False, K.MSG_EMAIL_MISSING), 2: (True, None), 3: (False, K.MSG_EMAIL_TAKEN), 4: (False, K.MSG_EMAIL_MISSING)}


def test_text_scan_reads_one_row_per_file(spark, tmp_path):
    from rolefit.sources.intake import text_scan
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text(f"line\n{i}\n")
    assert {r.text for r in text_scan(spark, str(tmp_path)).collect()} == {f"line\n{i}\n" for i in range(3)}
