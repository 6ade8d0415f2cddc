"""Scalar text operators (P1–P16) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolefit import constants as K
from rolefit.functions.text import U, blank_line_collapse, col, py_strip, ws_normalise  # noqa: F401

JD_TITLE_RE = r"(?i)job title:\s*([^\n]+)"


def text_preview_col(text, n: int = 500) -> Column:
    """First ``n`` characters + '...' when longer."""
    t = col(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def jd_title_col(text, default: str = K.DEFAULT_JD_TITLE) -> Column:
    """P5: first ``job title: X`` (any case), stripped; default otherwise."""
    t = col(text)
    rx = U + JD_TITLE_RE
    return F.when(t.rlike(rx), py_strip(F.regexp_extract(t, rx, 1))).otherwise(F.lit(default))


def jd_title_fallback_col(text, sections, default: str = K.DEFAULT_JD_TITLE) -> Column:
    """P5 with ``section_fallback``: an inline ``job title:`` line wins; else
    the first line of a ``job title`` section; else the default."""
    from rolefit.operators.sections import section_lines
    t = col(text)
    rx = U + JD_TITLE_RE
    first = F.get(section_lines(sections, "job title"), 0)
    return F.when(t.rlike(rx), py_strip(F.regexp_extract(t, rx, 1))).otherwise(F.coalesce(first, F.lit(default)))


def head_lines_col(text, n: int = 5) -> Column:
    """The first ``n`` physical lines joined by a space."""
    return F.array_join(F.slice(F.split(col(text), "\n", -1), 1, n), " ")


# ------------------------------------------------------------------ P7

def entity_cols(text) -> list[Column]:
    """Name, email, phone, job_title, experience_years, skills (first match each)."""
    t = col(text)
    years = F.regexp_extract(t, U + K.YEARS_RE, 1)
    skills = F.regexp_extract(t, U + K.SKILLS_AFTER_RE, 1)
    return [py_strip(F.regexp_extract(t, "(?mdU)" + K.NAME_RE, 0)).alias("name"),
            F.regexp_extract(t, K.EMAIL_RE, 0).alias("email"),
            F.regexp_extract(t, U + K.PHONE_RE, 0).alias("phone"),
            py_strip(F.regexp_extract(t, U + K.TITLE_AFTER_RE, 1)).alias("job_title"),
            F.when(years == "", F.lit(0)).otherwise(years.try_cast("bigint")).alias("experience_years"),
            F.when(skills == "", F.array().cast("array<string>"))
            .otherwise(F.transform(F.split(skills, ",", -1), lambda s: py_strip(s))).alias("skills")]


# ------------------------------------------------------------------ P8, P9
def title_cleanup_col(title) -> Column:
    return py_strip(F.regexp_replace(col(title), "(?iU)" + K.TITLE_ADJECTIVES_RE, ""))


def summary_prompt_col(title, years, skills) -> Column:
    """The summary prompt for a profile (title cleaned first)."""
    return F.concat(F.lit(K.SUMMARY_PROMPT_HEAD), title_cleanup_col(title), F.lit(K.SUMMARY_PROMPT_MID1),
                    col(years).cast("string"), F.lit(K.SUMMARY_PROMPT_MID2), F.array_join(col(skills), ", "),
                    F.lit(K.SUMMARY_PROMPT_TAIL))


def letter_prompt_col(job_title, company, applicant_name, experience, skills) -> Column:
    """Six labelled lines ending in ``Cover Letter:``."""
    vals = [job_title, company, applicant_name, experience, skills]
    parts = []
    for label, v in zip(K.LETTER_PROMPT_LABELS[:-1], vals):
        parts += [F.lit(label), col(v), F.lit("\n")]
    return F.concat(*parts, F.lit(K.LETTER_PROMPT_LABELS[-1]))


# ------------------------------------------------------------------ P10, P11
def generated_cleanup_col(generated, prompt, skills) -> Column:
    """P10: drop the echoed prompt, the response marker, keep the first
    paragraph, restore the casing of each skill in order."""
    s = py_strip(F.substring(col(generated), F.length(col(prompt)) + 1, 1 << 30))
    s = py_strip(F.regexp_replace(s, "(?iU)" + K.RESPONSE_MARKER_RE, ""))
    s = py_strip(F.get(F.split(s, "\n\n", -1), 0))
    return F.aggregate(col(skills), s, lambda acc, k: F.replace(acc, F.lower(k), k))


def letter_body_col(generated) -> Column:
    """Text after the last ``Cover Letter:``, stripped (whole text if absent)."""
    return py_strip(F.substring_index(col(generated), K.LETTER_MARKER, -1))


# ------------------------------------------------------------------ P12
def mail_merge_col(style, body, applicant_name, address, phone, email, recruiter, company, company_address,
                   job_title, as_of: str) -> Column:
    """Three letter layouts; an unknown style yields the body alone.
    ``as_of`` (yyyy-MM-dd) replaces the original's ``today()``."""
    today = F.date_format(F.to_date(F.lit(as_of)), "dd MMMM yyyy")
    name_u = F.upper(col(applicant_name))
    tail = [F.lit("\n\n"), today, F.lit("\n\n"), col(recruiter), F.lit("\n"), col(company), F.lit("\n"),
            col(company_address), F.lit("\n\n")]
    minimal = F.concat(name_u, F.lit("\n"), col(address), F.lit(" | "), col(phone), F.lit(" | "), col(email),
                       *tail, col(body))
    parts = F.split(col(address), ",", -1)
    city = F.when(F.size(parts) > 1, py_strip(F.get(parts, 1))).otherwise(F.lit(""))
    state_zip = F.when(F.size(parts) > 2, py_strip(F.get(parts, 2))).otherwise(F.lit(""))
    formal = F.concat(name_u, F.lit(" " * K.FORMAL_NAME_GAP), city, F.lit(", "), state_zip, F.lit("\n"),
                      F.lit(" " * K.FORMAL_CONTACT_INDENT), col(phone), F.lit(" | "), col(email), F.lit("\n"),
                      F.lit(K.FORMAL_RULE), *tail, col(body))
    first_word = F.get(F.split(py_strip(col(recruiter)), "(?U)\\s+", -1), 0)
    greet = F.when(py_strip(col(recruiter)) == "", F.lit(K.DEFAULT_GREETING_NAME)).otherwise(first_word)
    modern = F.concat(name_u, F.lit("\n"), F.upper(col(job_title)), F.lit("\n\n"), col(address), F.lit(" | "),
                      col(phone), F.lit(" | "), col(email), F.lit("\n" + K.MODERN_RULE), *tail,
                      F.lit("Dear "), greet, F.lit(",\n\n"), col(body))
    s = col(style)
    return (F.when(s == "Minimal", minimal).when(s == "Formal", formal).when(s == "Modern", modern)
            .otherwise(col(body)))


# ------------------------------------------------------------------ P13–P16
def csv_list_col(c) -> Column:
    """Comma list → trimmed, non-empty items."""
    return F.filter(F.transform(F.split(col(c), ",", -1), lambda x: py_strip(x)), lambda x: x != "")


def profile_reject_col(name, email, phone, job_title, years, skills, experience) -> Column:
    """First failing rule's message, NULL when the profile is valid."""
    required = ((col(name) != "") & (col(email) != "") & (col(phone) != "") & (col(job_title) != "")
                & (F.coalesce(col(years), F.lit(0)) != 0) & (F.size(col(skills)) > 0))
    lines = F.filter(F.split(col(experience), "\n", -1), lambda x: py_strip(x) != "")
    codes = F.transform(lines, lambda x: F.when(F.size(F.split(x, " - ", -1)) < 3, F.lit(1))
                        .when((F.size(F.split(x, " - ", -1)) >= 4) & (py_strip(F.get(F.split(x, " - ", -1), 3)) == ""),
                              F.lit(2)).otherwise(F.lit(0)))
    first = F.get(F.filter(codes, lambda c: c > 0), 0)
    return (F.when(~required, F.lit(K.MSG_PROFILE_REQUIRED))
            .when(first == 1, F.lit(K.MSG_PROFILE_EXPERIENCE_PARTS))
            .when(first == 2, F.lit(K.MSG_PROFILE_ACHIEVEMENTS)))


def letter_reject_col(applicant_name, job_title, company, experience, style) -> Column:
    """Required fields first, then the style."""
    req = (col(applicant_name) != "") & (col(job_title) != "") & (col(company) != "") & (col(experience) != "")
    return (F.when(~req, F.lit(K.MSG_LETTER_REQUIRED))
            .when(~col(style).isin(*K.LETTER_STYLES), F.lit(K.MSG_LETTER_STYLE)))
