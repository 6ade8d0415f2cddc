"""``ats_report`` (C6): one scored, explained row per (résumé, JD) pair.

Plan shape: documents are parsed once into per-document feature rows (one
row per résumé, one per JD); the pair table is joined to each feature table
on its key, and every per-pair quantity (set differences, keyword density,
interval overlap, cosines, scores, recommendations) is computed row-wise on
arrays.  Pairs are never exploded into (pair × term) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit import constants as K
from rolefit.functions.codes import Vocabulary, vocabulary
from rolefit.functions.fuzzy import partial_ratio_udf, token_sort_key_col
from rolefit.functions.joins import broadcast_if_small, fits, materialize, pair_rows, unshipped
from rolefit.functions.text import WORD_OR_SYMBOL, blank_line_collapse, py_strip
from rolefit.operators import experience as ex
from rolefit.operators import keywords as kw
from rolefit.operators import scoring as sc
from rolefit.operators import sections as se
from rolefit.operators import skills as sk
from rolefit.operators import text as tx
from rolefit.operators import vectors as ve

SCORE_COLS = ("total_score", "skill_match_score", "experience_score", "section_score", "formatting_score",
              "job_title_score", "keyword_density_score", "file_format_score")


# ------------------------------------------------------------- dictionary side
def synonym_table(skill_db: DataFrame, fuzzy: bool = True, tsr_threshold: int = 90,
                  cos_threshold: float = 0.80) -> DataFrame:
    """G5 and G6 on the dictionary: key (lowered name or form) → ``vals``, every
    lowered form and name of every row the key belongs to, and ``hits``, every
    dictionary string on the résumé side that one of ``vals`` on the JD side matches.

    r matches j if their token-sort keys are equal or within the threshold and
    one of them is a dictionary name, or if their cosine is above its threshold
    and one is a name of a row without ``match_on_tokens``.  All of it depends on
    the dictionary alone, so that a pair needs set algebra only."""
    db = sk.normalise_skill_db(skill_db)
    rows = db.select(F.lower(py_strip("skill_name")).alias("name_l"),
                     F.transform("low_surface_forms", lambda f: F.lower(py_strip(f))).alias("forms_l"),
                     "match_on_tokens")
    grp = rows.select(F.array_distinct(F.concat(F.array("name_l"), "forms_l")).alias("g"))
    names = rows.groupBy(F.col("name_l").alias("s")).agg(F.bool_or(~F.col("match_on_tokens")).alias("nonmot"))
    members = grp.select(F.explode("g").alias("key"), "g")
    per_key = materialize(members.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("g"))).alias("vals")), "synonyms")
    strings = materialize(per_key.select(F.explode("vals").alias("s")).distinct().join(unshipped(names), "s", "left")
                          .select("s", token_sort_key_col(F.col("s")).alias("k"), F.col("nonmot").isNotNull().alias("n"),
                                  F.coalesce("nonmot", F.lit(False)).alias("nonmot")), "strings")
    # per token-sort key of a JD string: the résumé strings with that key or a near one, and the names among them
    same = strings.select(F.col("k").alias("rk"), F.col("k").alias("jk")).distinct()
    links = same.unionByName(sk.near_key_pairs(strings.select("k"), tsr_threshold).toDF("rk", "jk")) if fuzzy else same
    of_key = strings.groupBy(F.col("k").alias("rk")).agg(F.collect_list("s").alias("every"),
                                                          F.collect_list(F.when(F.col("n"), F.col("s"))).alias("names"))
    of_key = links.join(unshipped(of_key), "rk").groupBy(F.col("jk").alias("k")).agg(
        F.flatten(F.collect_list("every")).alias("every"), F.flatten(F.collect_list("names")).alias("names"))
    vals = per_key.select("key", F.explode("vals").alias("s")).join(unshipped(strings), "s")
    by_key = vals.groupBy("key", "k").agg(F.bool_or("n").alias("n")).join(unshipped(of_key), "k")
    hits = by_key.select("key", F.when(F.col("n"), F.col("every")).otherwise(F.col("names")).alias("h"))
    if fuzzy:
        cos = sk.cosine_string_pairs(strings.select("s"), cos_threshold)
        flags = strings.select("s", "nonmot")
        cos = (cos.join(unshipped(flags.select(F.col("s").alias("x"), F.col("nonmot").alias("nx"))), "x")
               .join(unshipped(flags.select(F.col("s").alias("y"), F.col("nonmot").alias("ny"))), "y")
               .filter(F.col("nx") | F.col("ny")).groupBy(F.col("y").alias("s")).agg(F.collect_set("x").alias("h")))
        hits = hits.unionByName(vals.select("key", "s").join(unshipped(cos), "s").select("key", "h"))
    hits = hits.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("h"))).alias("hits"))
    return per_key.join(unshipped(hits), "key", "left").select("key", "vals", F.coalesce("hits", sk.empty_str_array()).alias("hits"))


# ------------------------------------------------------------- document side
def formatted_resume_text(raw) -> Column:
    return blank_line_collapse(se.format_sections_col(se.sections_col(raw, K.RESUME_HEADERS)))


def formatted_jd_text(raw) -> Column:
    return se.format_sections_col(se.sections_col(raw, K.JD_HEADERS))


def skill_vocabulary(forms: DataFrame, syn: DataFrame) -> Vocabulary | None:
    """Every string that an expanded set can hold (the two tables of :func:`dictionary_tables`), if they are few."""
    names = forms.select(F.array(F.lower(py_strip("skill_name"))).alias("strings"))
    return vocabulary(syn.select(F.concat("vals", "hits").alias("strings")).unionByName(names), "strings")


def doc_skill_features(docs: DataFrame, id_col: str, text_col: str, forms: DataFrame, syn: DataFrame,
                       codes: Vocabulary | None = None) -> DataFrame:
    """Per document: found skill names (G1), the expanded set (G5), and the résumé strings that it matches (G6), all sorted.
    With ``codes`` (of :func:`skill_vocabulary`) the two sets hold codes, which are those of the dictionary's rows."""
    found = sk.found_skills(docs, id_col, forms, text_col).withColumn("key", F.lower(py_strip("skill_name")))
    own, none = F.array("key"), sk.empty_str_array()
    if codes:
        syn = syn.select("key", codes.coded("vals").alias("vals"), codes.coded("hits").alias("hits"))
        own, none = F.array(codes.code(F.col("key"))), _empty(codes.type)
    j = found.join(broadcast_if_small(syn), "key", "left")
    g = j.groupBy(id_col).agg(F.collect_set("skill_name").alias("skills"),
                              F.array_distinct(F.flatten(F.collect_set(F.coalesce("vals", own)))).alias("exp"),
                              F.array_distinct(F.flatten(F.collect_set(F.coalesce("hits", none)))).alias("exp_hits"))
    return g.select(id_col, F.sort_array("skills").alias("skills"), F.sort_array("exp").alias("exp"),
                    (F.sort_array("exp_hits") if codes else F.col("exp_hits")).alias("exp_hits"))


def _chars_in(a: Column, b: Column) -> Column:
    """Number of character positions of ``a`` whose character occurs in ``b``."""
    return F.size(F.filter(F.split(a, "", -1), lambda c: (c != "") & (F.instr(b, c) > 0)))


def may_exceed_partial(tok: Column, name: str, threshold: int) -> Column:
    """Necessary condition for ``partial_ratio(name, tok) > threshold``.

    At most M characters match, the positions of the shorter string whose
    character occurs in the longer.  The window of the longer string may be cut
    at its end, but holds the matched characters, so the ratio is at most
    2M / (shorter + M)."""
    s = F.lit(name)
    need = (threshold + 0.5) / 100.0
    short = F.least(F.length(tok), F.lit(len(name)))
    m = F.when(F.length(tok) <= len(name), _chars_in(tok, s)).otherwise(_chars_in(s, tok))
    return 2 * m >= (short + m) * need


def fuzzy_section_hits(docs: DataFrame, id_col: str, text_col: str = "text", threshold: int = 85) -> DataFrame:
    """T4 token rule: first line per section holding a token whose
    ``partial_ratio`` with the section name exceeds ``threshold``.

    Substring tokens (ratio 100) are decided natively.  The remaining tokens
    pass an exact native prefilter; only the survivors go, once per distinct
    token, through the pandas UDF, and the few hits are joined back."""
    names = [s for s, _ in K.SECTION_WEIGHTS]
    lines = docs.select(id_col, F.posexplode(se.presence_lines(text_col)).alias("li", "line"))
    toks = lines.select(id_col, "li", F.explode(F.array_distinct(
        F.regexp_extract_all("line", F.lit(WORD_OR_SYMBOL), 0))).alias("tok"))
    tok = F.col("tok")
    native = {s: (F.instr(F.lit(s), tok) > 0) | (F.instr(tok, F.lit(s)) > 0) for s in names}
    maybe = {s: ~native[s] & may_exceed_partial(tok, s, threshold) for s in names}
    t2 = toks.select(id_col, "li", "tok", *[native[s].alias("n_" + s) for s in names],
                     *[maybe[s].alias("m_" + s) for s in names])
    t2 = t2.filter(F.greatest(*[F.col("n_" + s) for s in names] + [F.col("m_" + s) for s in names]))
    cand = t2.filter(F.greatest(*[F.col("m_" + s) for s in names])).select("tok").distinct()
    scored = cand.select("tok", *[(partial_ratio_udf(F.lit(s), F.col("tok")) > threshold).alias("u_" + s)
                                  for s in names])
    # The scored table is small in practice but has no proven bound: AQE picks
    # a broadcast at run time when it is small.
    j = t2.join(scored, "tok", "left")
    hit = {s: F.col("n_" + s) | (F.col("m_" + s) & F.coalesce(F.col("u_" + s), F.lit(False))) for s in names}
    return j.groupBy(id_col).agg(*[F.min(F.when(hit[s], F.col("li") + 1)).alias("f_" + s) for s in names])


def resume_features(resumes: DataFrame, layout_chars: DataFrame, layout_pages: DataFrame,
                    files: DataFrame, forms: DataFrame, syn: DataFrame, text_mode: str = "formatted",
                    compat_sections: bool = False, fuzzy_sections: bool = True,
                    current_year: int | None = None, skill_codes: Vocabulary | None = None) -> DataFrame:
    raw = F.col("text")
    used = formatted_resume_text(raw) if text_mode == "formatted" else raw
    base = resumes.select("resume_id", raw.alias("raw"), used.alias("t"))
    pres_src = "t" if compat_sections else "raw"
    # presence lines are read once per section check: stage them as a column
    base = base.withColumn("_plines", se.presence_lines(pres_src))
    f = base.select(
        "resume_id", "t",
        (py_strip("t") == "").alias("blank"),
        F.array_distinct(kw.phrases_col("t")).alias("phrase_set"),
        kw.word_count_col("t").alias("words"),
        F.array_distinct(kw.phrases_col("t", normalise=False)).alias("w6_set"),
        ex.year_set_col(ex.year_ranges_col("t", current_year)).alias("years"),
        ve.tf_vector_col(tx.head_lines_col("t")).alias("head_tf"),
        se.first_hits_exact(F.col("_plines"), rules=compat_sections).alias("hits0"),
        F.col(pres_src).alias("pres_text"))
    skills = doc_skill_features(base.select("resume_id", "t"), "resume_id", "t", forms, syn, skill_codes).drop("exp_hits")
    f = f.join(unshipped(skills), "resume_id", "left")
    if fuzzy_sections:
        fz = fuzzy_section_hits(base.select("resume_id", F.col(pres_src).alias("pt")), "resume_id", "pt")
        f = f.join(unshipped(fz), "resume_id", "left")
        names = [s for s, _ in K.SECTION_WEIGHTS]

        def comb(s):
            a, b = F.col("hits0")[s], F.col("f_" + s)
            return F.when(b.isNull(), a).when(a == 0, b).otherwise(F.least(a, b)).alias(s)

        f = f.withColumn("hits", F.struct(*[comb(s) for s in names]))
    else:
        f = f.withColumn("hits", F.col("hits0"))
    # section presence depends on the résumé alone: score it once per document
    sec_score, missing_sections = se.section_score_cols(F.col("hits"))
    f = f.withColumn("section_score", sec_score).withColumn("missing_sections", missing_sections)
    f = f.select("*", *ve.split_vector_cols(F.col("head_tf"), "rh"))
    # layout and file facts only for the résumés being scored (a stream batch
    # must not re-aggregate the whole layout history)
    ids = broadcast_if_small(resumes.select(F.col("resume_id").alias("doc_id")))
    lc = layout_chars.join(ids, "doc_id", "left_semi")
    lp = layout_pages.join(ids, "doc_id", "left_semi")
    fl = files.join(ids, "doc_id", "left_semi")
    fmt = sc.formatting_scores(lc, lp, fl).withColumnRenamed("doc_id", "resume_id")
    ff = sc.file_format_scores(fl).withColumnRenamed("doc_id", "resume_id")
    return f.join(unshipped(fmt), "resume_id", "left").join(unshipped(ff), "resume_id", "left")


def jd_features(jds: DataFrame, forms: DataFrame, syn: DataFrame,
                text_mode: str = "formatted", section_fallback: bool = False,
                current_year: int | None = None, skill_codes: Vocabulary | None = None) -> DataFrame:
    raw = F.col("text")
    used = formatted_jd_text(raw) if text_mode == "formatted" else raw
    base = jds.select("jd_id", used.alias("t"), raw.alias("_raw"))
    title = (tx.jd_title_fallback_col("t", se.sections_col("_raw", K.JD_HEADERS)) if section_fallback
             else tx.jd_title_col("t"))
    f = base.select(
        "jd_id", (py_strip("t") == "").alias("blank"),
        title.alias("jd_title"),
        F.array_sort(F.array_distinct(kw.phrases_col("t", normalise=False))).alias("w6_sorted"),
        ex.year_set_col(ex.year_ranges_col("t", current_year)).alias("years"),
        ve.tf_vector_col(tx.head_lines_col("t")).alias("head_tf"))
    f = f.withColumn("title_tf", ve.tf_vector_col(F.lower("jd_title")))
    f = f.select("*", *ve.split_vector_cols(F.col("head_tf"), "jh"), *ve.split_vector_cols(F.col("title_tf"), "jt"))
    kwp = kw.jd_keyword_profile(base, "jd_id", "t")
    kwp = kwp.select("*", *kw.split_profile_cols(F.col("kw")))
    skills = doc_skill_features(base, "jd_id", "t", forms, syn, skill_codes)
    return f.join(unshipped(kwp), "jd_id", "left").join(unshipped(skills), "jd_id", "left")


# ------------------------------------------------------------------ pair side
def _empty(t: str) -> Column:
    return F.array().cast(f"array<{t}>")


def add_skill_match(x: DataFrame, own: str = "r.exp", wanted: str = "j.exp", hits: str = "j.exp_hits",
                    codes: Vocabulary | None = None) -> DataFrame:
    """G6 / G7 / G8 per pair: the résumé strings that the JD matches, the JD
    strings that are not among them, and the score; set algebra on the documents'
    sets, whose links were followed once per document.  With ``codes`` the sets are coded."""
    own, wanted, hits = (F.coalesce(F.col(c), _empty(codes.type if codes else "string")) for c in (own, wanted, hits))
    m = x.withColumn("_matched", F.array_intersect(own, hits))
    score = F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(
        F.least(F.size("_matched").cast("double") / F.size(wanted) * 100.0, F.lit(100.0)))
    read = codes.strings if codes else F.col
    m = m.withColumn("_missing", F.array_except(wanted, F.col("_matched"))).withColumn("skill_match_score", score)
    return m.withColumn("matched_skills", read("_matched")).withColumn("missing_skills", read("_missing")).drop("_matched", "_missing")


#: Phrases and terms of a JD that move with its pairs, and of a résumé that they meet: strings, and structs by their string.
JD_LISTS = ("kw_phrases", "kw_rep", "w6_sorted", "jh_terms", "jh_often", "jt_terms", "jt_often")
JD_ITEMS = {"kw_more": ("phrase", "cnt"), "jh_more": ("term", "tf"), "jt_more": ("term", "tf")}
RESUME_LISTS = ("phrase_set", "w6_set", "rh_terms", "rh_often")


def coded_jds(jf: DataFrame, codes: Vocabulary) -> DataFrame:
    """JD features with codes for their phrases and terms."""
    return jf.withColumns({**{c: codes.coded(c) for c in JD_LISTS}, **{c: codes.known_items(c, *f) for c, f in JD_ITEMS.items()}})


def coded_resumes(rf: DataFrame, codes: Vocabulary) -> DataFrame:
    """Résumé features with codes for those phrases and terms that a JD can have."""
    return rf.withColumns({**{c: codes.known(c) for c in RESUME_LISTS}, "rh_more": codes.known_items("rh_more", "term", "tf")})


def ats_report(pairs: DataFrame, rf: DataFrame, jf: DataFrame, role_threshold: float = 0.7, rounded: bool = True,
               cosines: DataFrame | None = None, jd_small: bool | None = None, codes: Vocabulary | None = None,
               skill_codes: Vocabulary | None = None) -> DataFrame:
    """Per pair, in stages so that every metric is computed once: raw metrics
    (set algebra, cosines, density, overlap) → component scores → total and
    recommendations.  Scores have two decimals unless ``rounded`` is false.
    ``cosines`` (of :func:`rolefit.operators.vectors.pair_cosines`) take the place of those of term frequencies.
    ``jd_small``: whether ``jf`` (a written table) may be broadcast; measured unless given.
    ``codes``, ``skill_codes``: of both sides, by :func:`coded_jds` and :func:`coded_resumes`, and of the expanded sets; what
    a pair returns is read back."""
    p = pairs.select("resume_id", "jd_id")
    kind, read = (codes.type, codes.strings) if codes else ("string", lambda c: c)
    role_sim, title_cos = ve.split_cosine_col("r.rh", "j.jh", kind), ve.split_cosine_col("r.rh", "j.jt", kind)
    if cosines is not None:
        p = p.join(cosines, ["resume_id", "jd_id"], "left")
        role_sim, title_cos = (F.coalesce(c, F.lit(0.0)) for c in ("role_sim", "title_cos"))
    x = add_skill_match(pair_rows(p, rf.alias("r"), jf.alias("j"), fits(jf) if jd_small is None else jd_small), codes=skill_codes)
    es, none = _empty("string"), _empty(kind)
    # the résumé's phrase set is hashed once a pair: density and missing keywords go by the shared phrases
    x = x.withColumn("shared_phrases", kw.shared_phrases_col(F.col("j.kw_phrases"), F.coalesce("r.phrase_set", none), kind))
    density = kw.density_of(F.size("shared_phrases"), F.col("j.kw_more"), F.col("shared_phrases"), F.coalesce("r.words", F.lit(0)))
    fmt_default, fmt_issue_default = sc.formatting_default()
    ff_default, ff_issue_default = sc.file_format_default()
    m = x.select(
        "resume_id", "jd_id", "skill_match_score", "matched_skills", "missing_skills",
        (F.coalesce("r.blank", F.lit(True)) | F.coalesce("j.blank", F.lit(True))).alias("blank"),
        F.coalesce("j.jd_title", F.lit(K.DEFAULT_JD_TITLE)).alias("jd_title"),
        ex.overlap_col("r.years", "j.years").alias("overlap"),
        role_sim.alias("role_sim"), title_cos.alias("title_cos"),
        density.alias("density"),
        F.coalesce("r.section_score", se.section_score_cols(F.struct(*[F.lit(0).alias(n) for n, _ in K.SECTION_WEIGHTS]))[0])
        .alias("section_score"),
        F.coalesce("r.missing_sections", F.array(*[F.lit(n) for n, _ in K.SECTION_WEIGHTS[:3]])).alias("missing_sections"),
        F.coalesce("r.formatting_score", fmt_default).alias("formatting_score"),
        F.coalesce("r.formatting_issues", fmt_issue_default).alias("formatting_issues"),
        F.coalesce("r.file_format_score", ff_default).alias("file_format_score"),
        F.coalesce("r.file_format_issues", ff_issue_default).alias("file_format_issues"),
        read(kw.missing_keywords_col(F.col("j.kw_rep"), F.col("shared_phrases"), kind=kind)).alias("missing_keywords"),
        read(kw.matched_keywords_col(F.coalesce("j.w6_sorted", none), F.coalesce("r.w6_set", none))).alias("matched_keywords"))
    y = m.select(
        "*",
        ex.experience_score_col(F.col("overlap"), F.col("role_sim"), role_threshold).alias("experience_score"),
        F.least(F.col("title_cos") * 100.0, F.lit(100.0)).alias("job_title_score"),
        kw.density_score_col(F.col("density")).alias("keyword_density_score"))
    total = sc.total_score_col({n: n for n in SCORE_COLS if n != "total_score"})
    recs = sc.recommendations_col(
        F.col("skill_match_score"), F.col("experience_score"), F.col("section_score"), F.col("job_title_score"),
        F.col("keyword_density_score"), F.col("missing_skills"), F.col("missing_sections"),
        F.col("formatting_issues"), F.col("file_format_issues"), F.col("jd_title"), F.col("missing_keywords"))
    blank = F.col("blank")

    def z(c, v=F.lit(0.0)):
        return F.when(blank, v).otherwise(c)

    out = y.select(
        "resume_id", "jd_id",
        z(F.least(total, F.lit(100.0))).alias("total_score"),
        *[z(F.col(n)).alias(n) for n in SCORE_COLS if n != "total_score"],
        z(F.col("matched_keywords"), es).alias("matched_keywords"),
        z(F.col("missing_keywords"), es).alias("missing_keywords"),
        z(F.col("matched_skills"), es).alias("matched_skills"),
        z(F.col("missing_skills"), es).alias("missing_skills"),
        z(recs, F.array(F.lit(K.MSG_EMPTY_INPUT))).alias("recommendations"))
    return sc.round_scores(out, SCORE_COLS) if rounded else out


def dictionary_tables(skill_db: DataFrame, fuzzy_skills: bool = True, tsr_threshold: int = 90,
                      cos_threshold: float = 0.80) -> tuple[DataFrame, DataFrame]:
    """(forms, syn): the surface-form anchors and the synonym/fuzzy link
    table.  Both depend on the dictionary and the thresholds alone; a caller
    with several reports over one dictionary builds them once and passes them on."""
    return (materialize(sk.surface_forms(skill_db), "forms"),
            materialize(synonym_table(skill_db, fuzzy_skills, tsr_threshold, cos_threshold), "links"))


def prepare_context(skill_db: DataFrame, jds: DataFrame, text_mode: str = "formatted",
                    fuzzy_skills: bool = True, dictionary: tuple[DataFrame, DataFrame] | None = None,
                    section_fallback: bool = False, current_year: int | None = None, tsr_threshold: int = 90,
                    cos_threshold: float = 0.80, role_threshold: float = 0.7) -> dict:
    """Dictionary- and JD-side tables, computed once and checkpointed: the
    surface-form anchors, the synonym/fuzzy link table and the JD features.
    A stream of résumés is scored against this context batch after batch.
    ``dictionary``: tables of :func:`dictionary_tables`, which then fix the two
    skill thresholds."""
    forms, syn = dictionary or dictionary_tables(skill_db, fuzzy_skills, tsr_threshold, cos_threshold)
    # One row per JD: broadcast to the pair join if its rows in memory allow it; else its lists move with the pairs, coded
    skill_codes = skill_vocabulary(forms, syn)
    jf = jd_features(jds, forms, syn, text_mode, section_fallback, current_year, skill_codes).drop("skills", "kw", "head_tf", "title_tf")
    jf = materialize(jf, "jd-features")
    small = fits(jf)
    codes = None if small else vocabulary(jf, *JD_LISTS)
    return {"forms": forms, "syn": syn, "jf": coded_jds(jf, codes) if codes else jf, "jd_small": small, "codes": codes,
            "skill_codes": skill_codes, "text_mode": text_mode, "current_year": current_year, "role_threshold": role_threshold}


def score_pairs(ctx: dict, pairs: DataFrame, resumes: DataFrame, layout_chars: DataFrame,
                layout_pages: DataFrame, files: DataFrame, fuzzy_sections: bool = True,
                compat_sections: bool = False, rounded: bool = True,
                vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``vectors``: résumé and JD vectors of the caller, as :func:`rolefit.operators.vectors.pair_cosines` takes them."""
    rf = resume_features(resumes, layout_chars, layout_pages, files, ctx["forms"], ctx["syn"],
                         ctx["text_mode"], compat_sections, fuzzy_sections, ctx["current_year"], ctx["skill_codes"])
    codes = ctx["codes"]
    cosines = ve.pair_cosines(pairs, *vectors) if vectors else None
    return ats_report(pairs, coded_resumes(rf, codes) if codes else rf, ctx["jf"], ctx["role_threshold"], rounded, cosines,
                      ctx["jd_small"], codes, ctx["skill_codes"])


def build_report(pairs, resumes, jds, skill_db, layout_chars, layout_pages, files, text_mode="formatted",
                 fuzzy_sections=True, compat_sections=False, fuzzy_skills=True, dictionary=None,
                 section_fallback=False, current_year=None, tsr_threshold=90, cos_threshold=0.80, role_threshold=0.7,
                 rounded=True, vectors=None) -> DataFrame:
    """``current_year``: date ranges that end later are ignored; the year of the run unless given.
    ``vectors``: see :func:`score_pairs`."""
    ctx = prepare_context(skill_db, jds, text_mode, fuzzy_skills, dictionary, section_fallback, current_year,
                          tsr_threshold, cos_threshold, role_threshold)
    return score_pairs(ctx, pairs, resumes, layout_chars, layout_pages, files, fuzzy_sections, compat_sections, rounded, vectors)


def write_report(report: DataFrame, path: str, partition_by: tuple = (), mode: str = "overwrite") -> None:
    """K1: the report table as parquet, optionally partitioned by caller columns."""
    w = report.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_partitions(report: DataFrame, path: str, partition_by: tuple, batch: str) -> None:
    """K1 for repeated batches: the report replaces just the partitions that it has rows for.

    Which rows a batch committed is written to a manifest beside the table (one row per
    partition, after its data): a batch without its manifest rows is to be repeated, and
    repeating it replaces its own partitions and manifest rows."""
    rows = materialize(report, "sink")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    done = rows.groupBy(*partition_by).agg(F.count(F.lit(1)).alias("rows"))
    done.withColumn("batch", F.lit(batch)).withColumn("committed", F.current_timestamp()).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path.rstrip('/')}/_manifest")


def read_manifest(spark, path: str, partition_by: tuple) -> DataFrame:
    """For each partition of the table its last commit: rows, batch, committed."""
    m = spark.read.parquet(f"{path.rstrip('/')}/_manifest")
    last = F.max_by(F.struct("rows", "batch", "committed"), "committed").alias("last")
    return m.groupBy(*partition_by).agg(last).select(*partition_by, "last.*")
