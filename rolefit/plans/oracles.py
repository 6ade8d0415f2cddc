"""DuckDB oracles: for each query, an independent brute-force SQL text.

The fixture views come first as CTEs (only the driver tables are registered).
Skill oracles compare every document with every dictionary form by regex.
"""

from __future__ import annotations

from rolefit.sources.fixtures import duck_ctes

NORM = "trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"

FORMS = """forms AS (SELECT DISTINCT skill_name, f AS form
  FROM (SELECT skill_name, unnest(list_prepend(lower(skill_name), coalesce(low_surface_forms, []::VARCHAR[]))) AS f FROM skill_fx)
  WHERE f IS NOT NULL)"""

DOC_SKILLS = """{name} AS (SELECT {id} AS doc_id, skill_name FROM {src}, forms
  WHERE regexp_matches(""" + NORM.format(x="text") + """, '\\b' || regexp_escape(form) || '\\b')
  GROUP BY ALL)"""

ORACLES: dict[str, str] = {}

ORACLES["skill_extract"] = (
    duck_ctes("skill_fx", "resume_fx", "jd_fx") + ", " + FORMS + ",\n"
    + DOC_SKILLS.format(name="rsk", id="resume_id", src="resume_fx") + ",\n"
    + DOC_SKILLS.format(name="jsk", id="jd_id", src="jd_fx") + "\n"
    + "SELECT 'resume' AS side, doc_id, skill_name FROM rsk UNION ALL SELECT 'jd', doc_id, skill_name FROM jsk")

ORACLES["skill_gap_arrays"] = (
    duck_ctes("skill_fx", "resume_fx", "jd_fx", "pairs_fx") + ", " + FORMS + ",\n"
    + DOC_SKILLS.format(name="rsk", id="resume_id", src="resume_fx") + ",\n"
    + DOC_SKILLS.format(name="jsk", id="jd_id", src="jd_fx") + """,
rs AS (SELECT doc_id AS resume_id, list_sort(list(skill_name)) AS s FROM rsk GROUP BY 1),
js AS (SELECT doc_id AS jd_id, list_sort(list(skill_name)) AS s FROM jsk GROUP BY 1),
pj AS (SELECT p.resume_id, p.jd_id, coalesce(rs.s, []::VARCHAR[]) AS r, coalesce(js.s, []::VARCHAR[]) AS j
       FROM pairs_fx p LEFT JOIN rs USING (resume_id) LEFT JOIN js USING (jd_id))
SELECT resume_id, jd_id,
  list_filter(j, lambda x: NOT list_contains(r, x)) AS missing_skills,
  list_filter(r, lambda x: list_contains(j, x)) AS matched_skills,
  r AS all_resume_skills, j AS all_jd_skills
FROM pj""")

# ===================================================================== helpers
from rolefit import constants as K  # noqa: E402

WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"


def STRIP(x: str) -> str:
    return f"trim({x}, {WS})"


def NORMX(x: str) -> str:
    return NORM.format(x=x)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def CSV_LIST(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, ','), lambda s: {STRIP('s')}), lambda s: s <> '')"


PROFILES_X = f"profiles_x AS (SELECT *, {CSV_LIST('skills_csv')} AS skills FROM profiles)"


def with_(*ctes: str, fixtures=()) -> str:
    head = duck_ctes(*fixtures) if fixtures else "WITH "
    sep = ", " if fixtures else ""
    return head + sep + ",\n".join(ctes) + "\n"


# ===================================================================== P1–P7
ORACLES["blank_line_collapse"] = (
    f"SELECT doc_id, {STRIP(chr(32) + 'regexp_replace(text, ' + lit(chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n+') + ', chr(10), ' + lit('g') + ')')} AS text FROM documents")
ORACLES["ws_normalise"] = f"SELECT doc_id, {NORMX('text')} AS norm FROM documents"
ORACLES["text_preview"] = ("SELECT doc_id, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' "
                           "ELSE text END AS preview FROM documents")
_JT = r"(?i)job title:\s*([^\n]+)"
ORACLES["jd_title"] = (duck_ctes("jd_fx") + f"SELECT jd_id, CASE WHEN regexp_matches(text, {lit(_JT)}) THEN "
                       f"{STRIP('regexp_extract(text, ' + lit(_JT) + ', 1)')} ELSE {lit(K.DEFAULT_JD_TITLE)} END "
                       "AS jd_title FROM jd_fx")
ORACLES["head_lines"] = (duck_ctes("resume_fx") + "SELECT resume_id, array_to_string(string_split(text, chr(10))[1:5], ' ') "
                         "AS head FROM resume_fx")
ORACLES["entity_extract"] = duck_ctes("resume_fx") + f"""SELECT resume_id,
  {STRIP("regexp_extract(text, '(?m)^([A-Za-z\\s]+)\\n', 1)")} AS name,
  regexp_extract(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}') AS email,
  regexp_extract(text, '\\b\\d{{3}}[-.]?\\d{{3}}[-.]?\\d{{4}}\\b') AS phone,
  {STRIP("regexp_extract(text, '(?:Professional Experience|Work Experience)[\\s\\S]*?(\\w+\\s+\\w+)', 1)")} AS job_title,
  CASE WHEN regexp_extract(text, '(\\d+)\\s*(?:year|yrs|years)', 1) = '' THEN 0
       ELSE TRY_CAST(regexp_extract(text, '(\\d+)\\s*(?:year|yrs|years)', 1) AS BIGINT) END AS experience_years,
  CASE WHEN regexp_extract(text, '(?:Skills|Technical Skills)[\\s\\S]*?((?:[A-Za-z\\s,]+))', 1) = '' THEN []::VARCHAR[]
       ELSE list_transform(string_split(regexp_extract(text, '(?:Skills|Technical Skills)[\\s\\S]*?((?:[A-Za-z\\s,]+))', 1), ','),
                           lambda s: {STRIP('s')}) END AS skills
FROM resume_fx"""

# ===================================================================== P8–P16
_ADJ = "(?i)" + K.TITLE_ADJECTIVES_RE


def CLEAN_TITLE(x):
    return STRIP(f"regexp_replace({x}, {lit(_ADJ)}, '', 'g')")


def SUMMARY_PROMPT(title, years, skills):
    return (f"concat({lit(K.SUMMARY_PROMPT_HEAD)}, {CLEAN_TITLE(title)}, {lit(K.SUMMARY_PROMPT_MID1)}, "
            f"CAST({years} AS VARCHAR), {lit(K.SUMMARY_PROMPT_MID2)}, array_to_string({skills}, ', '), "
            f"{lit(K.SUMMARY_PROMPT_TAIL)})")


LETTER_PROMPT = ("concat(" + ", ".join(
    f"{lit(lab)}, {v}, chr(10)" for lab, v in zip(K.LETTER_PROMPT_LABELS[:-1],
                                                  ["job_title", "company", "applicant_name", "experience", "skills"]))
    + f", {lit(K.LETTER_PROMPT_LABELS[-1])})")

GEN_LETTERS = f"""gen AS (SELECT *, CASE request_id % 3
    WHEN 0 THEN concat({LETTER_PROMPT}, 'Dear team, I apply.')
    WHEN 1 THEN concat({LETTER_PROMPT}, 'Draft', chr(10), 'Cover Letter: Final letter for ', company, '.  ')
    ELSE concat('Dear team,', chr(10), 'I apply for ', job_title, '.') END AS generated FROM letter_requests)"""

LETTER_BODY = STRIP("string_split(generated, " + lit(K.LETTER_MARKER) + ")[-1]")

ORACLES["title_cleanup"] = duck_ctes("profiles") + f"SELECT profile_id, {CLEAN_TITLE('job_title')} AS clean_title FROM profiles"
ORACLES["prompt_build"] = (with_(PROFILES_X, fixtures=("profiles",))
                           + f"SELECT profile_id, {SUMMARY_PROMPT('job_title', 'experience_years', 'skills')} AS prompt FROM profiles_x")
ORACLES["letter_prompt_build"] = duck_ctes("letter_requests") + f"SELECT request_id, {LETTER_PROMPT} AS prompt FROM letter_requests"
ORACLES["generated_cleanup"] = with_(
    PROFILES_X,
    f"""g AS (SELECT profile_id, skills, {SUMMARY_PROMPT('job_title', 'experience_years', 'skills')} AS prompt FROM profiles_x)""",
    f"""g2 AS (SELECT profile_id, skills, prompt, concat(prompt, ' ### Response: Experienced ', lower(array_to_string(skills, ', ')),
        ' specialist.', chr(10), chr(10), 'Second paragraph.') AS generated FROM g)""",
    f"""g3 AS (SELECT profile_id, skills, {STRIP("substring(generated, length(prompt) + 1)")} AS s1 FROM g2)""",
    f"""g4 AS (SELECT profile_id, skills, {STRIP("regexp_replace(s1, '(?i)###\\s*Response:?\\s*', '', 'g')")} AS s2 FROM g3)""",
    f"""g5 AS (SELECT profile_id, skills, {STRIP("string_split(s2, chr(10) || chr(10))[1]")} AS s3 FROM g4)""",
    fixtures=("profiles",)) + "SELECT profile_id, list_reduce(skills, lambda acc, k: replace(acc, lower(k), k), s3) AS summary FROM g5"
ORACLES["letter_body"] = with_(GEN_LETTERS, fixtures=("letter_requests",)) + f"SELECT request_id, {LETTER_BODY} AS letter_body FROM gen"

_TODAY = "strftime(DATE '2025-01-15', '%d %B %Y')"
_TAIL = f"chr(10), chr(10), {_TODAY}, chr(10), chr(10), recruiter, chr(10), company, chr(10), company_address, chr(10), chr(10)"
_PARTS = "string_split(address, ',')"
ORACLES["mail_merge"] = with_(GEN_LETTERS, f"b AS (SELECT *, {LETTER_BODY} AS body FROM gen)",
                              fixtures=("letter_requests",)) + f"""SELECT request_id, CASE template_choice
  WHEN 'Minimal' THEN concat(upper(applicant_name), chr(10), address, ' | ', phone, ' | ', email, {_TAIL}, body)
  WHEN 'Formal' THEN concat(upper(applicant_name), {lit(' ' * K.FORMAL_NAME_GAP)},
       CASE WHEN len({_PARTS}) > 1 THEN {STRIP(_PARTS + '[2]')} ELSE '' END, ', ',
       CASE WHEN len({_PARTS}) > 2 THEN {STRIP(_PARTS + '[3]')} ELSE '' END, chr(10),
       {lit(' ' * K.FORMAL_CONTACT_INDENT)}, phone, ' | ', email, chr(10), {lit(K.FORMAL_RULE)}, {_TAIL}, body)
  WHEN 'Modern' THEN concat(upper(applicant_name), chr(10), upper(job_title), chr(10), chr(10), address, ' | ', phone, ' | ',
       email, chr(10), {lit(K.MODERN_RULE)}, {_TAIL}, 'Dear ',
       CASE WHEN {STRIP('recruiter')} = '' THEN {lit(K.DEFAULT_GREETING_NAME)}
            ELSE regexp_split_to_array({STRIP('recruiter')}, '\\s+')[1] END, ',', chr(10), chr(10), body)
  ELSE body END AS letter FROM b"""

_SPLIT = "string_split(x, ' - ')"
ORACLES["profile_validation"] = with_(PROFILES_X, f"""v AS (SELECT profile_id,
  (name <> '' AND email <> '' AND phone <> '' AND job_title <> '' AND coalesce(experience_years, 0) <> 0 AND len(skills) > 0) AS req,
  list_filter(list_transform(list_filter(string_split(experience, chr(10)), lambda x: {STRIP('x')} <> ''),
     lambda x: CASE WHEN len({_SPLIT}) < 3 THEN 1 WHEN len({_SPLIT}) >= 4 AND {STRIP(_SPLIT + '[4]')} = '' THEN 2 ELSE 0 END),
     lambda c: c > 0)[1] AS first FROM profiles_x)""",
    f"""w AS (SELECT profile_id, CASE WHEN NOT req THEN {lit(K.MSG_PROFILE_REQUIRED)}
       WHEN first = 1 THEN {lit(K.MSG_PROFILE_EXPERIENCE_PARTS)} WHEN first = 2 THEN {lit(K.MSG_PROFILE_ACHIEVEMENTS)} END AS reject_reason FROM v)""",
    fixtures=("profiles",)) + "SELECT profile_id, reject_reason IS NULL AS valid, reject_reason FROM w"
ORACLES["letter_validation"] = duck_ctes("letter_requests") + f"""SELECT request_id, reject_reason IS NULL AS valid, reject_reason FROM (
  SELECT request_id, CASE WHEN NOT (applicant_name <> '' AND job_title <> '' AND company <> '' AND experience <> '')
    THEN {lit(K.MSG_LETTER_REQUIRED)} WHEN template_choice NOT IN ('Minimal', 'Formal', 'Modern')
    THEN {lit(K.MSG_LETTER_STYLE)} END AS reject_reason FROM letter_requests) AS t"""
ORACLES["csv_skills"] = with_(PROFILES_X, fixtures=("profiles",)) + "SELECT profile_id, skills FROM profiles_x"
ORACLES["letter_defaults"] = with_(PROFILES_X, fixtures=("letter_requests", "profiles")) + """SELECT l.request_id,
  CASE WHEN l.applicant_name = '' THEN coalesce(p.name, '') ELSE l.applicant_name END AS applicant_name,
  CASE WHEN l.address = '' THEN coalesce(p.location, '') ELSE l.address END AS address,
  CASE WHEN l.phone = '' THEN coalesce(p.phone, '') ELSE l.phone END AS phone,
  CASE WHEN l.email = '' THEN coalesce(p.email, '') ELSE l.email END AS email,
  CASE WHEN l.job_title = '' THEN coalesce(p.job_title, '') ELSE l.job_title END AS job_title,
  l.company, l.recruiter, l.company_address, l.experience,
  CASE WHEN l.skills = '' THEN coalesce(array_to_string(p.skills, ', '), '') ELSE l.skills END AS skills,
  CASE WHEN l.template_choice = '' THEN 'Minimal' ELSE l.template_choice END AS template_choice
FROM letter_requests l LEFT JOIN profiles_x p ON p.profile_id = l.request_id"""


# ===================================================================== X1–X6
def ENTRIES(field, sep="chr(10)"):
    return f"""e AS (SELECT profile_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS entry
  FROM (SELECT profile_id, string_split({field}, {sep}) AS l FROM profiles_x) AS s),
ep AS (SELECT profile_id, pos, string_split(entry, ' - ') AS p FROM e WHERE {STRIP('entry')} <> '')"""


def PART(i, default="''"):
    return f"CASE WHEN len(p) > {i} THEN p[{i + 1}] ELSE {default} END"


def POINTS(x):
    return f"list_filter(list_transform(string_split({x}, ';'), lambda a: {STRIP('a')}), lambda a: a <> '')"


def OUTER(arr, val, pos):
    return (f"unnest(CASE WHEN len({arr}) = 0 THEN [NULL::INTEGER] ELSE list_transform(range(len({arr})), "
            f"lambda i: CAST(i AS INTEGER)) END) AS {pos}, "
            f"unnest(CASE WHEN len({arr}) = 0 THEN [NULL::VARCHAR] ELSE {arr} END) AS {val}")


ORACLES["explode_education"] = with_(PROFILES_X, ENTRIES("education"), fixtures=("profiles",)) + (
    f"SELECT profile_id, pos, p[1] AS name, {PART(1)} AS dates, {PART(2)} AS degree, {PART(3)} AS detail FROM ep")
ORACLES["explode_experience"] = with_(PROFILES_X, ENTRIES("experience"), f"""x AS (SELECT *, CASE WHEN len(p) > 3
  THEN {POINTS('p[4]')} ELSE []::VARCHAR[] END AS ach FROM ep)""", fixtures=("profiles",)) + (
    f"SELECT profile_id, pos, p[1] AS title, {PART(1)} AS company, {PART(2)} AS dates, "
    f"{OUTER('ach', 'achievement', 'ach_pos')} FROM x")
ORACLES["explode_projects"] = with_(PROFILES_X, ENTRIES("projects", "chr(10) || chr(10)"), fixtures=("profiles",)) + (
    f"SELECT profile_id, pos, p[1] AS name, {PART(1)} AS language, {PART(2)} AS description, "
    f"{PART(3, lit(K.NO_LINK))} AS link, {PART(3, lit(K.NO_LINK_HREF))} AS href FROM ep")
ORACLES["explode_certs"] = with_(PROFILES_X, ENTRIES("certifications"), f"""x AS (SELECT *, CASE WHEN len(p) > 1
  THEN {POINTS('p[2]')} ELSE []::VARCHAR[] END AS pts FROM ep)""", fixtures=("profiles",)) + (
    f"SELECT profile_id, pos, p[1] AS name, {OUTER('pts', 'point', 'point_pos')} FROM x")
ORACLES["default_summary"] = duck_ctes("profiles") + (
    f"SELECT profile_id, CASE WHEN coalesce(summary, '') = '' THEN concat({lit(K.DEFAULT_SUMMARY_HEAD)}, "
    f"CAST(coalesce(experience_years, 0) AS VARCHAR), {lit(K.DEFAULT_SUMMARY_TAIL)}) ELSE summary END AS summary FROM profiles")
ORACLES["chat_render"] = (
    "SELECT conv_id, string_agg(CASE WHEN role IN ('user', 'system', 'assistant') THEN concat('<|', role, '|>', chr(10), "
    f"coalesce(text, ''), {lit(K.EOS_TOKEN)}, chr(10)) ELSE '' END, '' ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id")


# ===================================================================== T1–T4, T6
def SECTIONS(src, idc, vocab):
    words = "|".join(w.lower() for w in vocab)
    return f"""raw AS (SELECT id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS line
  FROM (SELECT {idc} AS id, string_split(text, chr(10)) AS l FROM {src}) AS s),
ln AS (SELECT id, pos, {STRIP('line')} AS line FROM raw WHERE {STRIP('line')} <> ''),
hd AS (SELECT id, pos, line, CASE WHEN regexp_full_match(line, '(?i)({words})') THEN lower(line) END AS hkey FROM ln),
inst AS (SELECT *, sum(CASE WHEN hkey IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS k,
  coalesce(last_value(hkey IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'header') AS section
  FROM hd),
keys AS (SELECT {idc} AS id, 'header' AS section, -1 AS first_pos, 0 AS last_k FROM {src}
  UNION ALL SELECT id, hkey, min(pos), max(k) FROM inst WHERE hkey IS NOT NULL GROUP BY id, hkey),
content AS (SELECT i.id, i.section, list(i.line ORDER BY i.pos) AS lines FROM inst i
  JOIN keys k ON k.id = i.id AND k.section = i.section AND i.k = k.last_k WHERE i.hkey IS NULL GROUP BY i.id, i.section),
secs AS (SELECT k.id, CAST(row_number() OVER (PARTITION BY k.id ORDER BY k.first_pos) - 1 AS INTEGER) AS section_pos,
  k.section, coalesce(c.lines, []::VARCHAR[]) AS lines FROM keys k LEFT JOIN content c ON c.id = k.id AND c.section = k.section)"""


ORACLES["resume_sections"] = with_(SECTIONS("resume_fx", "resume_id", K.RESUME_HEADERS), fixtures=("resume_fx",)) + (
    "SELECT id AS resume_id, section_pos, section, lines FROM secs")
ORACLES["jd_sections"] = with_(SECTIONS("jd_fx", "jd_id", K.JD_HEADERS), fixtures=("jd_fx",)) + (
    "SELECT id AS jd_id, section_pos, section, lines FROM secs")
_TITLE = "array_to_string(list_transform(string_split(section, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
ORACLES["format_sections"] = with_(SECTIONS("resume_fx", "resume_id", K.RESUME_HEADERS), fixtures=("resume_fx",)) + f"""
SELECT r.resume_id, coalesce({STRIP("string_agg(concat(" + _TITLE + ", chr(10), repeat('-', length(section)), chr(10), chr(10), array_to_string(lines, chr(10)), chr(10), chr(10)), chr(10) ORDER BY section_pos)")}, '') AS formatted
FROM resume_fx r LEFT JOIN secs s ON s.id = r.resume_id AND len(s.lines) > 0 GROUP BY r.resume_id"""

_HIT = "contains(line, '{s}')"
ORACLES["section_presence"] = duck_ctes("resume_fx") + ", " + f"""raw AS (SELECT id, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT resume_id AS id, string_split(text, chr(10)) AS l FROM resume_fx) AS s),
nl AS (SELECT id, pos, {NORMX('line')} AS line FROM raw),
h AS (SELECT id, """ + ", ".join(
    f"CAST(coalesce(min(CASE WHEN {_HIT.format(s=s)} THEN pos + 1 END), 0) AS INTEGER) AS {s}_line"
    for s, _ in K.SECTION_WEIGHTS) + """ FROM nl GROUP BY id),
sc AS (SELECT *, (CASE WHEN skills_line > 0 THEN 40 ELSE 0 END + CASE WHEN experience_line > 0 THEN 30 ELSE 0 END
    + CASE WHEN education_line > 0 THEN 20 ELSE 0 END + CASE WHEN certifications_line > 0 THEN 10 ELSE 0 END) AS ws,
  CASE WHEN skills_line = 0 THEN 0 WHEN experience_line = 0 OR experience_line < skills_line THEN 1
       WHEN education_line = 0 OR education_line < experience_line THEN 2
       WHEN certifications_line = 0 OR certifications_line < education_line THEN 3 ELSE 4 END AS prefix FROM h)
SELECT id AS resume_id, CAST(least(ws + least(prefix * 10, 30), 100) AS DOUBLE) AS section_score,
  list_filter([CASE WHEN skills_line = 0 THEN 'skills' END, CASE WHEN experience_line = 0 THEN 'experience' END,
               CASE WHEN education_line = 0 THEN 'education' END], lambda x: x IS NOT NULL) AS missing_sections,
  skills_line, experience_line, education_line, certifications_line FROM sc"""

ORACLES["total_years"] = with_(SECTIONS("resume_fx", "resume_id", K.RESUME_HEADERS), fixtures=("resume_fx",)) + """
SELECT id AS resume_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(lower(array_to_string(lines, chr(10))), '\\d{4}[-–]\\d{4}'),
  lambda m: CAST(m[-4:] AS INTEGER) - CAST(m[1:4] AS INTEGER))), 0) AS INTEGER) AS total_years
FROM secs WHERE section = 'experience'"""


# ===================================================================== W1–W6, E1–E3, V1–V5
PHRASE_RX = "\\b(?:\\w+\\s+\\w+|\\w{4,})\\b"
TOKEN_RX = "\\w+|[^\\w\\s]"
DATE_RX = K.DATE_RANGE_RE


def TF(src_expr: str, idc: str, src: str, name: str) -> str:
    """Long term-frequency table ."""
    return f"""{name} AS (SELECT id, t AS term, count(*) AS tf FROM (
  SELECT {idc} AS id, unnest(regexp_extract_all(lower({src_expr}), {lit(TOKEN_RX)})) AS t FROM {src}) AS x GROUP BY id, t)"""


def COS(a: str, b: str, pairs: str, out: str) -> str:
    """Exact integer dot product and norms; cosine = dot / sqrt(|a|²·|b|²)."""
    return f"""{out} AS (SELECT p.resume_id, p.jd_id,
  CASE WHEN coalesce(na.n, 0) = 0 OR coalesce(nb.n, 0) = 0 THEN 0.0
       ELSE CAST(coalesce(d.dot, 0) AS DOUBLE) / sqrt(CAST(na.n * nb.n AS DOUBLE)) END AS cos
  FROM {pairs} p
  LEFT JOIN (SELECT id, sum(tf * tf) AS n FROM {a} GROUP BY id) na ON na.id = p.resume_id
  LEFT JOIN (SELECT id, sum(tf * tf) AS n FROM {b} GROUP BY id) nb ON nb.id = p.jd_id
  LEFT JOIN (SELECT pp.resume_id, pp.jd_id, sum(x.tf * y.tf) AS dot FROM {pairs} pp
             JOIN {a} x ON x.id = pp.resume_id JOIN {b} y ON y.id = pp.jd_id AND y.term = x.term
             GROUP BY pp.resume_id, pp.jd_id) d ON d.resume_id = p.resume_id AND d.jd_id = p.jd_id)"""


def HEAD(x: str) -> str:
    return f"array_to_string(string_split({x}, chr(10))[1:5], ' ')"


JD_TITLE_X = (f"CASE WHEN regexp_matches(text, {lit(_JT)}) THEN {STRIP('regexp_extract(text, ' + lit(_JT) + ', 1)')} "
              f"ELSE {lit(K.DEFAULT_JD_TITLE)} END")

ORACLES["phrase_extract"] = duck_ctes("resume_fx") + f"""SELECT resume_id, CAST(unnest(range(len(ps))) AS INTEGER) AS pos, unnest(ps) AS phrase
FROM (SELECT resume_id, regexp_extract_all({NORMX('text')}, {lit(PHRASE_RX)}) AS ps FROM resume_fx) AS x"""

JD_PHRASES = f"""jp AS (SELECT jd_id, phrase, count(*) AS cnt, CAST(min(pos) AS INTEGER) AS first_pos FROM (
  SELECT jd_id, unnest(range(len(ps))) AS pos, unnest(ps) AS phrase
  FROM (SELECT jd_id, regexp_extract_all({NORMX('text')}, {lit(PHRASE_RX)}) AS ps FROM jd_fx) AS a) AS b GROUP BY jd_id, phrase)"""
RES_PHRASES = f"""rp AS (SELECT DISTINCT resume_id, unnest(regexp_extract_all({NORMX('text')}, {lit(PHRASE_RX)})) AS phrase FROM resume_fx)"""
RES_WORDS = f"""rw AS (SELECT resume_id, CASE WHEN {NORMX('text')} = '' THEN 0 ELSE len(string_split({NORMX('text')}, ' ')) END AS words FROM resume_fx)"""

ORACLES["phrase_counts"] = with_(JD_PHRASES, fixtures=("jd_fx",)) + "SELECT jd_id, phrase, cnt, first_pos FROM jp"
ORACLES["keyword_density"] = with_(JD_PHRASES, RES_PHRASES, RES_WORDS, """num AS (SELECT p.resume_id, p.jd_id, sum(jp.cnt) AS n
  FROM pairs_fx p JOIN jp ON jp.jd_id = p.jd_id JOIN rp ON rp.resume_id = p.resume_id AND rp.phrase = jp.phrase
  GROUP BY p.resume_id, p.jd_id)""", """d AS (SELECT p.resume_id, p.jd_id, CASE WHEN rw.words > 0
  THEN CAST(coalesce(num.n, 0) AS DOUBLE) / rw.words * 100.0 ELSE 0.0 END AS keyword_density
  FROM pairs_fx p JOIN rw ON rw.resume_id = p.resume_id
  LEFT JOIN num ON num.resume_id = p.resume_id AND num.jd_id = p.jd_id)""",
    fixtures=("resume_fx", "jd_fx", "pairs_fx")) + """SELECT resume_id, jd_id, keyword_density,
  CASE WHEN keyword_density >= 0.5 AND keyword_density <= 1.5 THEN 100.0 WHEN keyword_density < 0.5 THEN 60.0 ELSE 30.0 END
  AS keyword_density_score FROM d"""
ORACLES["missing_keywords"] = with_(JD_PHRASES, RES_PHRASES, """m AS (SELECT p.resume_id, p.jd_id,
  list(jp.phrase ORDER BY jp.first_pos)[1:5] AS mk FROM pairs_fx p JOIN jp ON jp.jd_id = p.jd_id AND jp.cnt > 1
  WHERE NOT EXISTS (SELECT 1 FROM rp WHERE rp.resume_id = p.resume_id AND rp.phrase = jp.phrase)
  GROUP BY p.resume_id, p.jd_id)""", fixtures=("resume_fx", "jd_fx", "pairs_fx")) + """SELECT p.resume_id, p.jd_id,
  coalesce(m.mk, []::VARCHAR[]) AS missing_keywords FROM pairs_fx p LEFT JOIN m ON m.resume_id = p.resume_id AND m.jd_id = p.jd_id"""
ORACLES["matched_keywords"] = with_(
    f"r6 AS (SELECT DISTINCT resume_id, unnest(regexp_extract_all(lower(text), {lit(PHRASE_RX)})) AS phrase FROM resume_fx)",
    f"j6 AS (SELECT DISTINCT jd_id, unnest(regexp_extract_all(lower(text), {lit(PHRASE_RX)})) AS phrase FROM jd_fx)",
    """m AS (SELECT p.resume_id, p.jd_id, list_sort(list(j6.phrase))[1:10] AS mk FROM pairs_fx p
  JOIN j6 ON j6.jd_id = p.jd_id JOIN r6 ON r6.resume_id = p.resume_id AND r6.phrase = j6.phrase GROUP BY p.resume_id, p.jd_id)""",
    fixtures=("resume_fx", "jd_fx", "pairs_fx")) + """SELECT p.resume_id, p.jd_id, coalesce(m.mk, []::VARCHAR[]) AS matched_keywords
FROM pairs_fx p LEFT JOIN m ON m.resume_id = p.resume_id AND m.jd_id = p.jd_id"""

RANGES = f"""mt AS (SELECT side, doc_id, unnest(range(len(ms))) AS mpos, unnest(ms) AS m FROM (
  SELECT 'resume' AS side, resume_id AS doc_id, regexp_extract_all(lower(text), {lit(DATE_RX)}) AS ms FROM resume_fx
  UNION ALL SELECT 'jd', jd_id, regexp_extract_all(lower(text), {lit(DATE_RX)}) FROM jd_fx) AS a),
pt AS (SELECT side, doc_id, mpos, regexp_split_to_array(replace(m, '–', '-'), '[-/]') AS parts FROM mt),
yr AS (SELECT side, doc_id, mpos, len(parts) AS n, TRY_CAST({STRIP("parts[1][-4:]")} AS INTEGER) AS start_year,
  TRY_CAST({STRIP("parts[2][-4:]")} AS INTEGER) AS end_year FROM pt),
rg AS (SELECT side, doc_id, CAST(row_number() OVER (PARTITION BY side, doc_id ORDER BY mpos) - 1 AS INTEGER) AS pos,
  start_year, end_year FROM yr WHERE n = 2 AND start_year <= end_year AND end_year <= 2025)"""
OVERLAP = """ov AS (SELECT p.resume_id, p.jd_id, EXISTS (SELECT 1 FROM rg r JOIN rg j ON j.side = 'jd' AND j.doc_id = p.jd_id
  AND r.end_year >= j.start_year AND r.start_year <= j.end_year WHERE r.side = 'resume' AND r.doc_id = p.resume_id) AS overlap
  FROM pairs_fx p)"""
ORACLES["year_ranges"] = with_(RANGES, fixtures=("resume_fx", "jd_fx")) + "SELECT side, doc_id, pos, start_year, end_year FROM rg"
ORACLES["experience_overlap"] = with_(RANGES, OVERLAP, fixtures=("resume_fx", "jd_fx", "pairs_fx")) + \
    "SELECT resume_id, jd_id, overlap FROM ov"
HEAD_TFS = [TF(HEAD("text"), "resume_id", "resume_fx", "rt"), TF(HEAD("text"), "jd_id", "jd_fx", "jt"),
            COS("rt", "jt", "pairs_fx", "rs")]
ORACLES["experience_score"] = with_(RANGES, OVERLAP, *HEAD_TFS, fixtures=("resume_fx", "jd_fx", "pairs_fx")) + """
SELECT ov.resume_id, ov.jd_id, ov.overlap, rs.cos AS role_similarity,
  CASE WHEN ov.overlap AND rs.cos > 0.7 THEN 100.0 WHEN ov.overlap OR rs.cos > 0.7 THEN 70.0 ELSE 40.0 END AS experience_score
FROM ov JOIN rs ON rs.resume_id = ov.resume_id AND rs.jd_id = ov.jd_id"""
ORACLES["role_similarity"] = with_(*HEAD_TFS, fixtures=("resume_fx", "jd_fx", "pairs_fx")) + \
    "SELECT resume_id, jd_id, cos AS role_similarity FROM rs"
ORACLES["job_title_score"] = with_(TF(HEAD("text"), "resume_id", "resume_fx", "rt"),
                                   TF("lower(" + JD_TITLE_X + ")", "jd_id", "jd_fx", "tt"),
                                   COS("rt", "tt", "pairs_fx", "ts"), fixtures=("resume_fx", "jd_fx", "pairs_fx")) + \
    "SELECT resume_id, jd_id, least(cos * 100.0, 100.0) AS job_title_score FROM ts"
ORACLES["tf_vectors"] = with_(TF("text", "resume_id", "resume_fx", "rt"), fixtures=("resume_fx",)) + \
    "SELECT id AS resume_id, term, tf FROM rt"
CENTROID = """ce AS (SELECT label, list(x ORDER BY pos) AS centroid FROM (
  SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM (
    SELECT label, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, unnest(embedding) AS x FROM embeddings) a
  GROUP BY label, pos) b GROUP BY label)"""
ORACLES["centroid"] = with_(CENTROID) + "SELECT label, centroid FROM ce"
ORACLES["cosine_pairs"] = with_(CENTROID) + """SELECT e.vec_id, CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE dot / (sqrt(na) * sqrt(nb)) END AS cosine
FROM (SELECT e.vec_id,
  list_reduce(list_transform(list_zip(e.embedding, c.centroid), lambda z: CAST(z[1] AS DOUBLE) * z[2]), lambda a, b: a + b, 0.0) AS dot,
  list_reduce(list_transform(e.embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)), lambda a, b: a + b, 0.0) AS na,
  list_reduce(list_transform(c.centroid, lambda v: v * v), lambda a, b: a + b, 0.0) AS nb
  FROM embeddings e JOIN ce c ON c.label = e.label) e"""



def DENSE(a: str, b: str) -> str:
    dot, na, nb = (f"list_sum(list_transform(list_zip({x}, {y}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))" for x, y in ((a, b), (a, a), (b, b)))
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {na} = 0 OR {nb} = 0 THEN 0.0 ELSE {dot} / (sqrt({na}) * sqrt({nb})) END"


ORACLES["dense_similarity"] = duck_ctes("resume_fx", "jd_fx", "pairs_fx") + f""", n AS (SELECT count(*) AS n FROM embeddings),
r AS (SELECT resume_id, embedding AS head FROM resume_fx, n LEFT JOIN embeddings ON vec_id = resume_id % n),
j AS (SELECT jd_id, h.embedding AS head, t.embedding AS title FROM jd_fx, n LEFT JOIN embeddings h ON h.vec_id = jd_id % n
  LEFT JOIN embeddings t ON t.vec_id = (jd_id * 7 + 1) % n)
SELECT resume_id, jd_id, round({DENSE('r.head', 'j.head')}, 9) AS role_similarity,
  round(least({DENSE('r.head', 'j.title')} * 100.0, 100.0), 7) AS job_title_score
FROM pairs_fx LEFT JOIN r USING (resume_id) LEFT JOIN j USING (jd_id)"""


# ===================================================================== C1, C2
_FONTS = ", ".join(lit(f) for f in K.ATS_FONTS)
ORACLES["formatting_score"] = duck_ctes("layout_chars", "layout_pages", "files") + f""",
c AS (SELECT doc_id, bool_or(list_bool_or(list_transform([{_FONTS}], lambda a: contains(a, lower(fontname))))) AS friendly,
  avg(CAST(size AS DOUBLE)) AS avg_size FROM layout_chars GROUP BY doc_id),
p AS (SELECT doc_id, bool_or(n_tables > 0) AS tables, bool_or(n_images > 0) AS images, arg_min(width, page_no) AS first_width,
  bool_and(coalesce(text, '') = '') AS all_empty FROM layout_pages GROUP BY doc_id),
d AS (SELECT coalesce(c.doc_id, p.doc_id) AS doc_id, coalesce(friendly, false) AS friendly, coalesce(avg_size, 11.0) AS size,
  coalesce(tables, false) AS tables, coalesce(images, false) AS images, coalesce(first_width / 72.0, 1.0) AS margin,
  coalesce(all_empty, true) AS scanned FROM c FULL OUTER JOIN p ON p.doc_id = c.doc_id),
s AS (SELECT doc_id, least(100.0 - CASE WHEN NOT friendly THEN 30 ELSE 0 END - CASE WHEN NOT (size >= 10 AND size <= 12) THEN 20 ELSE 0 END
    - CASE WHEN tables THEN 20 ELSE 0 END - CASE WHEN images THEN 20 ELSE 0 END
    - CASE WHEN NOT (margin >= 0.8 AND margin <= 1.2) THEN 10 ELSE 0 END - CASE WHEN scanned THEN 30 ELSE 0 END, 100.0) AS sc,
  list_filter([CASE WHEN NOT friendly THEN {lit(K.MSG_FONT)} END, CASE WHEN NOT (size >= 10 AND size <= 12) THEN {lit(K.MSG_FONT_SIZE)} END,
    CASE WHEN tables THEN {lit(K.MSG_TABLES)} END, CASE WHEN images THEN {lit(K.MSG_IMAGES)} END,
    CASE WHEN NOT (margin >= 0.8 AND margin <= 1.2) THEN {lit(K.MSG_MARGINS)} END, CASE WHEN scanned THEN {lit(K.MSG_SCANNED)} END],
    lambda x: x IS NOT NULL) AS iss FROM d)
SELECT f.doc_id, CASE WHEN s.doc_id IS NULL OR ends_with(f.path, '.docx') THEN 0.0 ELSE CAST(s.sc AS DOUBLE) END AS formatting_score,
  CASE WHEN s.doc_id IS NULL OR ends_with(f.path, '.docx') THEN [{lit(K.MSG_FORMAT_ERROR)}] ELSE s.iss END AS formatting_issues
FROM files f LEFT JOIN s ON s.doc_id = f.doc_id"""
ORACLES["file_format_score"] = duck_ctes("files") + f""", v AS (SELECT doc_id, path,
  TRY_CAST(coalesce(pdf_version, '1.4') AS DOUBLE) AS ver, coalesce(encoding, 'UTF-8') AS enc FROM files)
SELECT doc_id,
  CASE WHEN ends_with(path, '.pdf') AND ver IS NULL THEN 0.0
       WHEN ends_with(path, '.pdf') THEN 100.0 - CASE WHEN NOT (ver >= 1.4 AND ver <= 1.7) THEN 20 ELSE 0 END
            - CASE WHEN enc NOT IN ('UTF-8', 'ASCII') THEN 20 ELSE 0 END
       WHEN ends_with(path, '.docx') THEN 80.0 ELSE 20.0 END AS file_format_score,
  CASE WHEN ends_with(path, '.pdf') AND ver IS NULL THEN [{lit(K.MSG_FILE_ERROR)}]
       WHEN ends_with(path, '.pdf') THEN list_filter([CASE WHEN NOT (ver >= 1.4 AND ver <= 1.7) THEN {lit(K.MSG_PDF_VERSION)} END,
            CASE WHEN enc NOT IN ('UTF-8', 'ASCII') THEN {lit(K.MSG_ENCODING)} END], lambda x: x IS NOT NULL)
       WHEN ends_with(path, '.docx') THEN [{lit(K.MSG_DOCX)}] ELSE [{lit(K.MSG_OTHER_FORMAT)}] END AS file_format_issues
FROM v"""


# ===================================================================== G3, G5, G8 (exact rule)
def TSKEY(x: str) -> str:
    return ("array_to_string(list_sort(list_filter(string_split(lower(regexp_replace(regexp_replace("
            f"{x}, '[^\\x00-\\x7F]', '', 'g'), '[^a-zA-Z0-9_]', ' ', 'g')), ' '), lambda w: w <> '')), ' ')")


DICT_ROWS = f"""drows AS (SELECT lower({STRIP('skill_name')}) AS name_l,
  list_transform(coalesce(low_surface_forms, []::VARCHAR[]), lambda f: lower({STRIP('f')})) AS forms_l FROM skill_fx)"""
EXPANDED = """ex AS (SELECT DISTINCT d.side, d.doc_id, unnest(list_prepend(r.name_l, r.forms_l)) AS s
  FROM (SELECT 'resume' AS side, doc_id, lower(""" + STRIP("skill_name") + """) AS key FROM rsk
        UNION ALL SELECT 'jd', doc_id, lower(""" + STRIP("skill_name") + """) FROM jsk) d
  JOIN drows r ON d.key = r.name_l OR list_contains(r.forms_l, d.key)),
exn AS (SELECT ex.*, """ + TSKEY("s") + """ AS k, s IN (SELECT name_l FROM drows) AS n FROM ex)"""

SKILL_HEAD = (duck_ctes("skill_fx", "resume_fx", "jd_fx", "pairs_fx") + ", " + FORMS + ",\n"
              + DOC_SKILLS.format(name="rsk", id="resume_id", src="resume_fx") + ",\n"
              + DOC_SKILLS.format(name="jsk", id="jd_id", src="jd_fx") + ",\n" + DICT_ROWS + ",\n" + EXPANDED)

ORACLES["skill_gap_long"] = ORACLES["skill_gap_arrays"].replace(
    "SELECT resume_id, jd_id,\n  list_filter(j", "g AS (SELECT resume_id, jd_id,\n  list_filter(j", 1).replace(
    "r AS all_resume_skills, j AS all_jd_skills\nFROM pj",
    "r AS all_resume_skills, j AS all_jd_skills\nFROM pj)\n"
    "SELECT resume_id, jd_id, unnest(missing_skills) AS skill_name, 'missing' AS status FROM g\n"
    "UNION ALL SELECT resume_id, jd_id, unnest(matched_skills), 'matched' FROM g").replace(
    "pj AS (SELECT", "pj AS (SELECT", 1)
ORACLES["skill_gap_long"] = ORACLES["skill_gap_long"].replace("FROM pairs_fx p LEFT JOIN rs USING (resume_id) LEFT JOIN js USING (jd_id))",
                                                              "FROM pairs_fx p LEFT JOIN rs USING (resume_id) LEFT JOIN js USING (jd_id)),", 1)
ORACLES["skill_expand"] = SKILL_HEAD + """
SELECT doc_id AS resume_id, list_sort(list(s)) AS expanded FROM exn WHERE side = 'resume' GROUP BY doc_id"""
ORACLES["skill_score"] = SKILL_HEAD + """,
m AS (SELECT p.resume_id, p.jd_id, r.s FROM pairs_fx p JOIN exn r ON r.side = 'resume' AND r.doc_id = p.resume_id
  WHERE EXISTS (SELECT 1 FROM exn j WHERE j.side = 'jd' AND j.doc_id = p.jd_id AND j.k = r.k AND (r.n OR j.n))),
ms AS (SELECT resume_id, jd_id, list_sort(list(s)) AS matched FROM m GROUP BY resume_id, jd_id),
js AS (SELECT doc_id AS jd_id, list_sort(list(s)) AS jall FROM exn WHERE side = 'jd' GROUP BY doc_id),
x AS (SELECT p.resume_id, p.jd_id, coalesce(ms.matched, []::VARCHAR[]) AS matched, coalesce(js.jall, []::VARCHAR[]) AS jall
  FROM pairs_fx p LEFT JOIN ms ON ms.resume_id = p.resume_id AND ms.jd_id = p.jd_id LEFT JOIN js ON js.jd_id = p.jd_id)
SELECT resume_id, jd_id, matched AS matched_skills, list_filter(jall, lambda z: NOT list_contains(matched, z)) AS missing_skills,
  CASE WHEN len(jall) = 0 THEN 0.0 ELSE least(CAST(len(matched) AS DOUBLE) / len(jall) * 100.0, 100.0) END AS skill_match_score
FROM x"""


# ===================================================================== S1, S3, S5
ORACLES["intake_routing"] = duck_ctes("uploads") + f""", x AS (SELECT coalesce(r.request_id, j.request_id) AS request_id,
  r.filename AS resume_file, j.filename AS jd_file
  FROM (SELECT * FROM uploads WHERE role = 'resume') r FULL OUTER JOIN (SELECT * FROM uploads WHERE role = 'jd') j
  ON j.request_id = r.request_id),
y AS (SELECT *, CASE WHEN resume_file IS NULL OR jd_file IS NULL THEN {lit(K.MSG_UPLOAD_BOTH)}
  WHEN NOT ((ends_with(resume_file, '.pdf') OR ends_with(resume_file, '.docx'))
        AND (ends_with(jd_file, '.pdf') OR ends_with(jd_file, '.docx') OR ends_with(jd_file, '.txt')))
  THEN {lit(K.MSG_UPLOAD_FORMAT)} END AS reject_reason FROM x)
SELECT request_id, resume_file, jd_file, reject_reason IS NULL AS accepted, reject_reason,
  CASE WHEN reject_reason IS NULL THEN CASE WHEN ends_with(resume_file, '.docx') THEN 'docx' WHEN ends_with(resume_file, '.pdf') THEN 'pdf'
       WHEN ends_with(resume_file, '.txt') THEN 'txt' END END AS resume_format,
  CASE WHEN reject_reason IS NULL THEN CASE WHEN ends_with(jd_file, '.docx') THEN 'docx' WHEN ends_with(jd_file, '.pdf') THEN 'pdf'
       WHEN ends_with(jd_file, '.txt') THEN 'txt' END END AS jd_format
FROM y"""

DOC_PAGES = """pg AS (SELECT doc_id, pos + pos // 4 AS page_no, page_text FROM (
  SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS page_text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) a) b
  UNION ALL SELECT doc_id, 5 * CAST(unnest(range(len(string_split(text, chr(10))) // 4)) AS INTEGER) + 4, '' FROM documents)"""
ORACLES["page_assembly"] = with_(DOC_PAGES) + """SELECT d.doc_id, coalesce(string_agg(pg.page_text, chr(10) ORDER BY pg.page_no)
  FILTER (WHERE pg.page_text <> ''), '') AS text FROM (SELECT DISTINCT doc_id FROM pg) d JOIN pg ON pg.doc_id = d.doc_id GROUP BY d.doc_id"""
ORACLES["page_concat"] = with_(DOC_PAGES) + "SELECT doc_id, string_agg(page_text, '' ORDER BY page_no) AS text FROM pg GROUP BY doc_id"
ORACLES["page_assembly_ocr_flag"] = with_(DOC_PAGES, f"""t AS (SELECT doc_id, {STRIP("regexp_replace(string_agg(page_text || chr(10), '' ORDER BY page_no), '" + chr(92) + "n" + chr(92) + "s*" + chr(92) + "n+', chr(10), 'g')")} AS text
  FROM pg GROUP BY doc_id)""") + "SELECT doc_id, text, text = '' AS needs_ocr FROM t"
ORACLES["unique_key_append"] = duck_ctes("users") + f""", f AS (SELECT email, min(id) AS first_id FROM users GROUP BY email),
ex AS (SELECT DISTINCT concat('c', CAST(s_suppkey % 1000 AS VARCHAR), '@example.com') AS email FROM supplier)
SELECT u.id, u.name, u.email, (u.id = f.first_id AND ex.email IS NULL) AS accepted,
  CASE WHEN u.id = f.first_id AND ex.email IS NULL THEN NULL ELSE {lit(K.MSG_EMAIL_TAKEN)} END AS reject_reason
FROM users u JOIN f ON f.email = u.email LEFT JOIN ex ON ex.email = u.email"""
ORACLES["jd_text_scan"] = duck_ctes("jd_fx") + "SELECT jd_id, text FROM jd_fx"
ORACLES["skill_dict_load"] = duck_ctes("skill_fx") + "SELECT skill_id, skill_name, low_surface_forms, match_on_tokens FROM skill_fx"


# ===================================================================== C3–C7 (exact rules, raw texts)
# Every part is a query with its own oracle above; a pair whose résumé has no facts takes the defaults.
_PARTS = ",\n".join(f"q_{n} AS ({ORACLES[n]})" for n in (
    "skill_score", "experience_score", "job_title_score", "keyword_density", "missing_keywords", "matched_keywords",
    "section_presence", "formatting_score", "file_format_score", "jd_title"))
_SCORES = [n for n, _ in K.TOTAL_WEIGHTS]
_MSG_SK = "concat('Add missing skills: ', array_to_string(missing_skills[1:5], ', '), '. Consider online courses.')"
_MSG_SEC = (f"CASE WHEN len(missing_sections) > 0 THEN concat('Add missing sections: ', array_to_string(missing_sections, ', '), '.') "
            f"ELSE {lit(K.MSG_SECTIONS_LABELED)} END")
_MSG_TITLE = "concat('Include ''', jd_title, ''' in your summary or title.')"
_MSG_KW = "concat('Optimize keywords: ', array_to_string(missing_keywords, ', '), ' to 0.5–1.5% density.')"


def ONE(cond: str, msg: str) -> str:
    return f"CASE WHEN {cond} THEN [{msg}] ELSE []::VARCHAR[] END"


def CONCAT(*lists: str) -> str:
    out = lists[0]
    for x in lists[1:]:
        out = f"list_concat({out}, {x})"
    return out


_ALL_RECOMMENDATIONS = CONCAT(
    ONE("skill_match_score < 80", _MSG_SK), ONE("experience_score < 70", lit(K.MSG_EXPERIENCE)), ONE("section_score < 70", _MSG_SEC),
    "formatting_issues", ONE("job_title_score < 70", _MSG_TITLE), ONE("keyword_density_score < 70", _MSG_KW), "file_format_issues")
_TOTAL = " + ".join(f"CAST({w} AS DOUBLE) * {n}" for n, w in K.TOTAL_WEIGHTS)
_LISTS = ("matched_keywords", "missing_keywords", "matched_skills", "missing_skills")
REPORT = duck_ctes("resume_fx", "jd_fx") + f""", {_PARTS},
parts AS (SELECT p.resume_id, p.jd_id, p.skill_match_score, p.matched_skills, p.missing_skills, e.experience_score, t.job_title_score,
  k.keyword_density_score, mk.missing_keywords, wk.matched_keywords, coalesce(s.section_score, 0.0) AS section_score,
  coalesce(s.missing_sections, ['skills', 'experience', 'education']) AS missing_sections,
  coalesce(f.formatting_score, 0.0) AS formatting_score, coalesce(f.formatting_issues, [{lit(K.MSG_FORMAT_ERROR)}]) AS formatting_issues,
  coalesce(ff.file_format_score, 0.0) AS file_format_score, coalesce(ff.file_format_issues, [{lit(K.MSG_FILE_ERROR)}]) AS file_format_issues,
  jt.jd_title, {STRIP('r.text')} = '' OR {STRIP('j.text')} = '' AS blank
  FROM q_skill_score p JOIN q_experience_score e USING (resume_id, jd_id) JOIN q_job_title_score t USING (resume_id, jd_id)
  JOIN q_keyword_density k USING (resume_id, jd_id) JOIN q_missing_keywords mk USING (resume_id, jd_id)
  JOIN q_matched_keywords wk USING (resume_id, jd_id) JOIN q_jd_title jt USING (jd_id)
  JOIN resume_fx r USING (resume_id) JOIN jd_fx j USING (jd_id) LEFT JOIN q_section_presence s USING (resume_id)
  LEFT JOIN q_formatting_score f ON f.doc_id = p.resume_id LEFT JOIN q_file_format_score ff ON ff.doc_id = p.resume_id),
report AS (SELECT resume_id, jd_id, CASE WHEN blank THEN 0.0 ELSE least({_TOTAL}, 100.0) END AS total_score,
  {", ".join(f"CASE WHEN blank THEN 0.0 ELSE {n} END AS {n}" for n in _SCORES)},
  {", ".join(f"CASE WHEN blank THEN []::VARCHAR[] ELSE {n} END AS {n}" for n in _LISTS)},
  CASE WHEN blank THEN [{lit(K.MSG_EMPTY_INPUT)}] ELSE {_ALL_RECOMMENDATIONS} END AS recommendations
  FROM parts)
"""
ORACLES["total_score"] = REPORT + f"SELECT resume_id, jd_id, total_score, {', '.join(_SCORES)} FROM report"
ORACLES["recommendations"] = REPORT + "SELECT resume_id, jd_id, recommendations FROM report"
ORACLES["ats_report_exact"] = REPORT + f"""SELECT resume_id, jd_id,
  {", ".join(f"CAST(printf('%.2f', {n}) AS DOUBLE) AS {n}" for n in ("total_score", *_SCORES))},
  {", ".join(_LISTS)}, recommendations FROM report"""
ORACLES["skill_object_load"] = ORACLES["skill_dict_load"]
ORACLES["stream_intake"] = ORACLES["ats_report_exact"]  # the stream scores what a batch would

# ===================================================================== T5, T8, T9
from rolefit.operators.suggestions import PAGE_SECTION_HEADERS, PAGE_TITLE_SECTIONS  # noqa: E402

_RAW_PHRASES = f"regexp_extract_all(lower(text), {lit(PHRASE_RX)})"


def _lines(name: str) -> str:
    """Lines of a résumé's section; null without the section."""
    return f"any_value(CASE WHEN section = {lit(name)} THEN lines END)"


PAIR_SECTIONS = (duck_ctes("resume_fx", "jd_fx") + f", gaps AS ({ORACLES['skill_gap_arrays']}),\n"
                 + f"kws AS ({ORACLES['missing_keywords']}),\n" + SECTIONS("resume_fx", "resume_id", K.RESUME_HEADERS))
ORACLES["section_summaries"] = PAIR_SECTIONS + f""",
rs AS (SELECT id AS resume_id, {_lines('skills')} AS skills, {_lines('experience')} AS experience, {_lines('education')} AS education,
  {_lines('certifications')} AS certifications, bool_or(section = 'professional summary') AS professional FROM secs GROUP BY id),
ty AS ({ORACLES["total_years"]}),
x AS (SELECT g.*, rs.* EXCLUDE (resume_id), ty.total_years, CASE WHEN len(g.matched_skills) > 0 THEN g.matched_skills[1:5] ELSE rs.skills[1:5] END AS pick,
  CASE WHEN len(g.matched_skills) > 0 THEN g.matched_skills[1:3] ELSE g.all_jd_skills[1:3] END AS prof,
  j.phrases, lower(array_to_string(rs.experience, chr(10))) AS exp_text FROM gaps g JOIN rs USING (resume_id) LEFT JOIN ty USING (resume_id)
  JOIN (SELECT jd_id, {_RAW_PHRASES} AS phrases FROM jd_fx) j USING (jd_id)),
y AS (SELECT x.*, list_filter(x.phrases, lambda p: contains(exp_text, p))[1:2] AS roles FROM x)
SELECT resume_id, jd_id, 'skills' AS section, CASE WHEN len(pick) > 0 THEN concat({lit(K.SUM_SKILLS[0])}, array_to_string(pick, ', '), {lit(K.SUM_SKILLS[1])})
  ELSE {lit(K.SUM_NO_SKILLS)} END AS summary FROM y WHERE skills IS NOT NULL
UNION ALL SELECT resume_id, jd_id, 'experience', concat(CAST(total_years AS VARCHAR), {lit(K.SUM_EXPERIENCE[0])},
  CASE WHEN len(roles) > 0 THEN concat({lit(K.SUM_FOCUS)}, array_to_string(roles, ', ')) ELSE {lit(K.SUM_RELEVANT)} END, {lit(K.SUM_EXPERIENCE[1])})
  FROM y WHERE experience IS NOT NULL
UNION ALL SELECT resume_id, jd_id, 'education', CASE WHEN len(education) > 0 THEN concat({lit(K.SUM_EDUCATION[0])}, education[1], {lit(K.SUM_EDUCATION[1])})
  ELSE {lit(K.SUM_NO_EDUCATION)} END FROM y WHERE education IS NOT NULL
UNION ALL SELECT resume_id, jd_id, 'certifications', CASE WHEN len(certifications) > 0
  THEN concat({lit(K.SUM_CERTS[0])}, array_to_string(certifications[1:2], ', '), {lit(K.SUM_CERTS[1])}) ELSE {lit(K.SUM_NO_CERTS)} END
  FROM y WHERE certifications IS NOT NULL
UNION ALL SELECT resume_id, jd_id, 'professional summary', concat({lit(K.SUM_PROFESSIONAL[0])}, array_to_string(prof, ', '), {lit(K.SUM_PROFESSIONAL[1])})
  FROM y WHERE professional OR len(matched_skills) > 0 OR len(all_jd_skills) > 0"""

_WRAP = f"CASE WHEN starts_with(l, '[SUGGESTED:') THEN concat({lit(K.SUGGESTION_SPAN[0])}, l, {lit(K.SUGGESTION_SPAN[1])}) ELSE l END"
_BLOCK = ("concat(" + _TITLE + ", chr(10), repeat('-', length(section)), chr(10), chr(10), array_to_string(list_transform(ls, lambda l: "
          + _WRAP + "), chr(10)), chr(10), chr(10))")


def _suggest(terms: str, ends: tuple) -> str:
    return f"concat({lit(ends[0])}, array_to_string({terms}[1:3], ', '), {lit(ends[1])})"


_NEW_LINES = CONCAT("secs.lines", ONE("add_sk AND section = 'skills'", _suggest("ms", K.SUGGEST_SKILLS)),
                    ONE("add_kw AND section = target", _suggest("mk", K.SUGGEST_KEYWORDS)))
_KW_NOTE = (f"concat({_suggest('mk', K.SUGGEST_KEYWORDS_NOTE[:2])}, CASE target WHEN 'header' THEN 'Header' ELSE 'Professional Summary' END, "
            f"{lit(K.SUGGEST_KEYWORDS_NOTE[2])})")
ORACLES["resume_optimise"] = PAIR_SECTIONS + f""",
ps AS (SELECT id, bool_or(section = 'skills') AS has_sk, bool_or(section = 'professional summary') AS has_ps, bool_or(section = 'header') AS has_hd FROM secs GROUP BY id),
x AS (SELECT g.resume_id, g.jd_id, g.missing_skills AS ms, k.missing_keywords AS mk, has_sk AND len(g.missing_skills) > 0 AS add_sk,
  (has_ps OR has_hd) AND len(k.missing_keywords) > 0 AS add_kw, CASE WHEN has_ps THEN 'professional summary' ELSE 'header' END AS target
  FROM gaps g JOIN kws k USING (resume_id, jd_id) JOIN ps ON ps.id = g.resume_id),
l AS (SELECT x.resume_id, x.jd_id, secs.section_pos, secs.section, {_NEW_LINES} AS ls FROM x JOIN secs ON secs.id = x.resume_id),
o AS (SELECT resume_id, jd_id, {STRIP("string_agg(" + _BLOCK + ", chr(10) ORDER BY section_pos)")} AS optimized_text
  FROM l WHERE len(ls) > 0 GROUP BY resume_id, jd_id)
SELECT x.resume_id, x.jd_id, coalesce(o.optimized_text, '') AS optimized_text,
  {CONCAT(ONE("add_sk", _suggest("ms", K.SUGGEST_SKILLS_NOTE)), ONE("add_kw", _KW_NOTE))} AS suggestions
FROM x LEFT JOIN o ON o.resume_id = x.resume_id AND o.jd_id = x.jd_id"""

_HEADERS, _TITLES = (", ".join(lit(h) for h in hs) for hs in (PAGE_SECTION_HEADERS, PAGE_TITLE_SECTIONS))
_TITLE_WORDS = ", ".join(lit(t) for t in K.TITLE_KEYWORDS)
ORACLES["line_gaps"] = duck_ctes("resume_fx", "jd_fx") + f""", gaps AS ({ORACLES['skill_gap_arrays']}),
kws AS ({ORACLES['missing_keywords']}), fm AS ({ORACLES['format_sections']}),
pl AS (SELECT resume_id, CAST(unnest(range(len(ls))) AS INTEGER) AS line_pos, unnest(ls) AS line
  FROM (SELECT resume_id, string_split(formatted, chr(10)) AS ls FROM fm)),
lw AS (SELECT *, {STRIP("replace(lower(line), '  ', ' ')")} AS low FROM pl),
cu AS (SELECT *, last_value(CASE WHEN low IN ({_HEADERS}) THEN low END IGNORE NULLS) OVER (PARTITION BY resume_id ORDER BY line_pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur FROM lw),
x AS (SELECT g.resume_id, g.jd_id, g.missing_skills AS ms, k.missing_keywords AS mk FROM gaps g JOIN kws k USING (resume_id, jd_id))
SELECT x.resume_id, x.jd_id, cu.line_pos, cu.line, CASE WHEN coalesce(cur IN ({_TITLES}), false)
  THEN list_filter(mk, lambda k: lower(k) IN ({_TITLE_WORDS}) AND NOT contains(low, lower(k)))
  ELSE list_concat(list_filter(ms, lambda s: NOT contains(low, lower(s))),
                   list_filter(mk, lambda k: NOT (lower(k) IN ({_TITLE_WORDS})) AND NOT contains(low, lower(k)))) END AS missing_terms
FROM x JOIN cu USING (resume_id) WHERE {STRIP('line')} <> ''"""
