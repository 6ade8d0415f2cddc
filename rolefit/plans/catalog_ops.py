"""Per-operator queries over the fixture views (raw texts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolefit import constants as K
from rolefit.functions.arrays import inline_rows, packed, unpacked
from rolefit.functions.text import blank_line_collapse, ws_normalise
from rolefit.operators import experience as ex
from rolefit.operators import keywords as kw
from rolefit.operators import records as rc
from rolefit.operators import scoring as sc
from rolefit.operators import sections as se
from rolefit.operators import suggestions as sg
from rolefit.operators import text as tx
from rolefit.operators import vectors as ve
from rolefit.plans.catalog import query
from rolefit.sources import fixtures as fx
from rolefit.sources.forms import spark_view
from rolefit.sources.tables import read_table

AS_OF = "2025-01-15"


def _docs(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", "text")


# ------------------------------------------------------------------ P1–P6
@query("blank_line_collapse")
def q_blank_line_collapse(spark, sf):
    return _docs(spark, sf).select("doc_id", blank_line_collapse("text").alias("text"))


@query("ws_normalise")
def q_ws_normalise(spark, sf):
    return _docs(spark, sf).select("doc_id", ws_normalise("text").alias("norm"))


@query("text_preview")
def q_text_preview(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.text_preview_col("text").alias("preview"))


@query("jd_title")
def q_jd_title(spark, sf):
    return fx.jd_fx(spark, sf).select("jd_id", tx.jd_title_col("text").alias("jd_title"))


@query("head_lines")
def q_head_lines(spark, sf):
    return fx.resume_fx(spark, sf).select("resume_id", tx.head_lines_col("text").alias("head"))


@query("entity_extract")
def q_entity_extract(spark, sf):
    return fx.resume_fx(spark, sf).select("resume_id", *tx.entity_cols("text"))


# ------------------------------------------------------------------ P8–P16
def _profiles(spark, sf):
    p = spark_view(spark, sf, "profiles")
    return p.withColumn("skills", tx.csv_list_col("skills_csv"))


def _letters(spark, sf):
    return spark_view(spark, sf, "letter_requests")


def _generated_letters(spark, sf):
    lr = _letters(spark, sf)
    prompt = tx.letter_prompt_col("job_title", "company", "applicant_name", "experience", "skills")
    rid = F.col("request_id")
    gen = (F.when(rid % 3 == 0, F.concat(prompt, F.lit("Dear team, I apply.")))
           .when(rid % 3 == 1, F.concat(prompt, F.lit("Draft\nCover Letter: Final letter for "),
                                        F.col("company"), F.lit(".  ")))
           .otherwise(F.concat(F.lit("Dear team,\nI apply for "), F.col("job_title"), F.lit("."))))
    return lr.withColumn("generated", gen)


@query("title_cleanup")
def q_title_cleanup(spark, sf):
    return _profiles(spark, sf).select("profile_id", tx.title_cleanup_col("job_title").alias("clean_title"))


@query("prompt_build")
def q_prompt_build(spark, sf):
    p = _profiles(spark, sf)
    return p.select("profile_id", tx.summary_prompt_col("job_title", "experience_years", "skills").alias("prompt"))


@query("letter_prompt_build")
def q_letter_prompt_build(spark, sf):
    lr = _letters(spark, sf)
    return lr.select("request_id", tx.letter_prompt_col("job_title", "company", "applicant_name", "experience",
                                                        "skills").alias("prompt"))


@query("generated_cleanup")
def q_generated_cleanup(spark, sf):
    p = _profiles(spark, sf)
    prompt = tx.summary_prompt_col("job_title", "experience_years", "skills")
    gen = F.concat(prompt, F.lit(" ### Response: Experienced "), F.lower(F.array_join("skills", ", ")),
                   F.lit(" specialist.\n\nSecond paragraph."))
    p = p.select("profile_id", "skills", prompt.alias("prompt"), gen.alias("generated"))
    return p.select("profile_id", tx.generated_cleanup_col("generated", "prompt", "skills").alias("summary"))


@query("letter_body")
def q_letter_body(spark, sf):
    g = _generated_letters(spark, sf)
    return g.select("request_id", tx.letter_body_col("generated").alias("letter_body"))


@query("mail_merge")
def q_mail_merge(spark, sf):
    g = _generated_letters(spark, sf).withColumn("body", tx.letter_body_col("generated"))
    return g.select("request_id", tx.mail_merge_col("template_choice", "body", "applicant_name", "address", "phone",
                                                    "email", "recruiter", "company", "company_address",
                                                    "job_title", AS_OF).alias("letter"))


@query("profile_validation")
def q_profile_validation(spark, sf):
    p = _profiles(spark, sf)
    r = tx.profile_reject_col("name", "email", "phone", "job_title", "experience_years", "skills", "experience")
    return p.select("profile_id", r.isNull().alias("valid"), r.alias("reject_reason"))


@query("letter_validation")
def q_letter_validation(spark, sf):
    lr = _letters(spark, sf)
    r = tx.letter_reject_col("applicant_name", "job_title", "company", "experience", "template_choice")
    return lr.select("request_id", r.isNull().alias("valid"), r.alias("reject_reason"))


@query("csv_skills")
def q_csv_skills(spark, sf):
    return _profiles(spark, sf).select("profile_id", "skills")


@query("letter_defaults")
def q_letter_defaults(spark, sf):
    lr = _letters(spark, sf)
    p = _profiles(spark, sf).select(F.col("profile_id").alias("request_id"), F.col("name").alias("p_name"),
                                    F.col("location").alias("p_address"), F.col("phone").alias("p_phone"),
                                    F.col("email").alias("p_email"), F.col("job_title").alias("p_job_title"),
                                    F.array_join("skills", ", ").alias("p_skills"))
    j = lr.join(p, "request_id", "left")

    def fill(c, d):
        return F.when(F.col(c) == "", F.coalesce(F.col(d), F.lit(""))).otherwise(F.col(c)).alias(c)

    return j.select("request_id", fill("applicant_name", "p_name"), fill("address", "p_address"),
                    fill("phone", "p_phone"), fill("email", "p_email"), fill("job_title", "p_job_title"),
                    "company", "recruiter", "company_address", "experience", fill("skills", "p_skills"),
                    F.when(F.col("template_choice") == "", F.lit("Minimal")).otherwise(F.col("template_choice"))
                    .alias("template_choice"))


# ------------------------------------------------------------------ X1–X6
@query("explode_education")
def q_explode_education(spark, sf):
    return rc.explode_education(_profiles(spark, sf), "profile_id")


@query("explode_experience")
def q_explode_experience(spark, sf):
    return rc.explode_experience(_profiles(spark, sf), "profile_id")


@query("explode_projects")
def q_explode_projects(spark, sf):
    return rc.explode_projects(_profiles(spark, sf), "profile_id")


@query("explode_certs")
def q_explode_certs(spark, sf):
    return rc.explode_certs(_profiles(spark, sf), "profile_id")


@query("default_summary")
def q_default_summary(spark, sf):
    p = _profiles(spark, sf)
    return p.select("profile_id", rc.default_summary_col("summary", "experience_years").alias("summary"))


@query("chat_render")
def q_chat_render(spark, sf):
    return rc.chat_render(read_table(spark, sf, "conversations"))


# ------------------------------------------------------------------ T1–T4, T6
@query("resume_sections")
def q_resume_sections(spark, sf):
    return se.sections_long(se.parse_sections(fx.resume_fx(spark, sf), "resume_id"), "resume_id")


@query("jd_sections")
def q_jd_sections(spark, sf):
    return se.sections_long(se.parse_sections(fx.jd_fx(spark, sf), "jd_id", vocabulary=K.JD_HEADERS), "jd_id")


@query("format_sections")
def q_format_sections(spark, sf):
    r = fx.resume_fx(spark, sf)
    return r.select("resume_id", se.format_sections_col(se.sections_col("text", K.RESUME_HEADERS)).alias("formatted"))


@query("section_presence")
def q_section_presence(spark, sf):
    r = fx.resume_fx(spark, sf).select("resume_id", se.presence_lines("text").alias("pl"))
    r = r.select("resume_id", se.first_hits_exact(F.col("pl")).alias("h"))
    score, missing = se.section_score_cols(F.col("h"))
    return r.select("resume_id", score.alias("section_score"), missing.alias("missing_sections"),
                    *[F.col("h")[s].alias(s + "_line") for s, _ in K.SECTION_WEIGHTS])


@query("section_presence_fuzzy")
def q_section_presence_fuzzy(spark, sf):
    from rolefit.plans.report import fuzzy_section_hits
    r = fx.resume_fx(spark, sf)
    base = r.select("resume_id", "text", se.presence_lines("text").alias("pl"))
    base = base.select("resume_id", "text", se.first_hits_exact(F.col("pl")).alias("h0"))
    fz = fuzzy_section_hits(r, "resume_id")
    j = base.join(fz, "resume_id", "left")
    names = [s for s, _ in K.SECTION_WEIGHTS]
    h = F.struct(*[F.when(F.col("f_" + s).isNull(), F.col("h0")[s]).when(F.col("h0")[s] == 0, F.col("f_" + s))
                   .otherwise(F.least(F.col("h0")[s], F.col("f_" + s))).alias(s) for s in names])
    j = j.select("resume_id", h.alias("h"))
    score, missing = se.section_score_cols(F.col("h"))
    return j.select("resume_id", score.alias("section_score"), missing.alias("missing_sections"),
                    *[F.col("h")[s].alias(s + "_line") for s in names])


@query("total_years")
def q_total_years(spark, sf):
    p = se.parse_sections(fx.resume_fx(spark, sf), "resume_id")
    p = p.filter(se.has_section("sections", "experience"))
    return p.select("resume_id", sg.total_years_col("sections").alias("total_years"))


# ------------------------------------------------------------------ W1–W6
@query("phrase_extract")
def q_phrase_extract(spark, sf):
    r = fx.resume_fx(spark, sf)
    return r.select("resume_id", F.posexplode(kw.phrases_col("text")).alias("pos", "phrase"))


@query("phrase_counts")
def q_phrase_counts(spark, sf):
    return kw.phrase_counts(fx.jd_fx(spark, sf), "jd_id")


def _pair_text_features(spark, sf):
    resumes, jds = fx.resume_fx(spark, sf), fx.jd_fx(spark, sf)
    pairs = fx.pairs_fx(spark, sf, resumes, jds)
    rf = resumes.select("resume_id", F.array_distinct(kw.phrases_col("text")).alias("phrase_set"),
                        kw.word_count_col("text").alias("words"),
                        F.array_distinct(kw.phrases_col("text", normalise=False)).alias("w6_set"),
                        ex.year_set_col(ex.year_ranges_col("text")).alias("years"),
                        ve.tf_vector_col(tx.head_lines_col("text")).alias("head_tf"))
    rf = rf.select("*", *ve.split_vector_cols(F.col("head_tf"), "rh"))
    jf = jds.select("jd_id", F.array_sort(F.array_distinct(kw.phrases_col("text", normalise=False))).alias("w6_sorted"),
                    ex.year_set_col(ex.year_ranges_col("text")).alias("j_years"),
                    ve.tf_vector_col(tx.head_lines_col("text")).alias("j_head_tf"),
                    ve.tf_vector_col(F.lower(tx.jd_title_col("text"))).alias("title_tf"))
    jf = jf.select("*", *ve.split_vector_cols(F.col("j_head_tf"), "jh"), *ve.split_vector_cols(F.col("title_tf"), "jt"))
    jk = kw.jd_keyword_profile(jds)
    jk = jk.select("*", *kw.split_profile_cols(F.col("kw")))
    # a query computes the columns it needs only
    from rolefit.functions.joins import pair_rows, texts_fit, unshipped
    jf = jf.join(unshipped(jk), "jd_id", "left")
    # phrases of a JD move with every pair: as one text each list
    lists = ("w6_sorted", "kw_phrases", "kw_rep")
    x = pair_rows(pairs, rf, jf.withColumns({c: packed(c) for c in lists}), texts_fit(jds), "inner")
    return x.withColumns({c: unpacked(c) for c in lists})


@query("keyword_density")
def q_keyword_density(spark, sf):
    x = _pair_text_features(spark, sf)
    d, _ = kw.density_cols(F.col("kw_phrases"), F.col("kw_more"), F.col("phrase_set"), F.col("words"))
    x = x.select("resume_id", "jd_id", d.alias("keyword_density"))
    return x.select("*", kw.density_score_col(F.col("keyword_density")).alias("keyword_density_score"))


@query("missing_keywords")
def q_missing_keywords(spark, sf):
    x = _pair_text_features(spark, sf)
    return x.select("resume_id", "jd_id", kw.missing_keywords_col(F.col("kw_rep"), F.col("phrase_set"))
                    .alias("missing_keywords"))


@query("matched_keywords")
def q_matched_keywords(spark, sf):
    x = _pair_text_features(spark, sf)
    return x.select("resume_id", "jd_id", kw.matched_keywords_col(F.col("w6_sorted"), F.col("w6_set"))
                    .alias("matched_keywords"))


# ------------------------------------------------------------------ E1–E3
@query("year_ranges")
def q_year_ranges(spark, sf):
    r = fx.resume_fx(spark, sf).select(F.lit("resume").alias("side"), F.col("resume_id").alias("doc_id"), "text")
    j = fx.jd_fx(spark, sf).select(F.lit("jd").alias("side"), F.col("jd_id").alias("doc_id"), "text")
    d = r.unionByName(j)
    e = d.select("side", "doc_id", F.posexplode(ex.year_ranges_col("text")).alias("pos", "r"))
    return e.select("side", "doc_id", "pos", F.col("r.start_year").alias("start_year"),
                    F.col("r.end_year").alias("end_year"))


@query("experience_overlap")
def q_experience_overlap(spark, sf):
    x = _pair_text_features(spark, sf)
    return x.select("resume_id", "jd_id", ex.overlap_col("years", "j_years").alias("overlap"))


@query("experience_score")
def q_experience_score(spark, sf):
    x = _pair_text_features(spark, sf)
    x = x.select("resume_id", "jd_id", ex.overlap_col("years", "j_years").alias("overlap"),
                 ve.split_cosine_col("rh", "jh").alias("role_similarity"))
    return x.select("*", ex.experience_score_col(F.col("overlap"), F.col("role_similarity")).alias("experience_score"))


# ------------------------------------------------------------------ V1–V5
@query("tf_vectors")
def q_tf_vectors(spark, sf):
    r = fx.resume_fx(spark, sf).select("resume_id", F.explode(ve.tf_vector_col("text")).alias("v"))
    return r.select("resume_id", F.col("v.term").alias("term"), F.col("v.tf").alias("tf"))


@query("centroid")
def q_centroid(spark, sf):
    return ve.centroids(read_table(spark, sf, "embeddings"), "label")


@query("cosine_pairs")
def q_cosine_pairs(spark, sf):
    e = read_table(spark, sf, "embeddings")
    from rolefit.functions.joins import broadcast_if_small
    c = ve.centroids(e, "label")
    j = e.join(broadcast_if_small(c), "label")
    return j.select("vec_id", ve.dense_cosine_col(F.col("embedding"), F.col("centroid")).alias("cosine"))


def fixture_vectors(spark, sf):
    """Vectors of the résumés and JDs, taken from the embeddings by remainder."""
    e = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = F.lit(e.count())

    def vectors(docs, key, **cols):
        out = docs.select(key)
        for name, place in cols.items():
            own = e.select(F.col("vec_id").alias("_at"), F.col("embedding").alias(name))
            out = out.withColumn("_at", place % n).join(own, "_at", "left").drop("_at")
        return out

    return (vectors(fx.resume_fx(spark, sf), "resume_id", head=F.col("resume_id")),
            vectors(fx.jd_fx(spark, sf), "jd_id", head=F.col("jd_id"), title=F.col("jd_id") * 7 + 1))


@query("dense_similarity")
def q_dense_similarity(spark, sf):
    """V4 and V5 on given vectors, to nine digits (sums of other orders differ in the last ones)."""
    c = ve.pair_cosines(fx.pairs_fx(spark, sf), *fixture_vectors(spark, sf))
    return c.select("resume_id", "jd_id", F.round("role_sim", 9).alias("role_similarity"),
                    F.round(F.least(F.col("title_cos") * 100.0, F.lit(100.0)), 7).alias("job_title_score"))


@query("role_similarity")
def q_role_similarity(spark, sf):
    x = _pair_text_features(spark, sf)
    return x.select("resume_id", "jd_id", ve.split_cosine_col("rh", "jh").alias("role_similarity"))


@query("job_title_score")
def q_job_title_score(spark, sf):
    x = _pair_text_features(spark, sf)
    s = F.least(ve.split_cosine_col("rh", "jt") * 100.0, F.lit(100.0))
    return x.select("resume_id", "jd_id", s.alias("job_title_score"))


# ------------------------------------------------------------------ C1, C2
@query("formatting_score")
def q_formatting_score(spark, sf):
    files = fx.files_fx(spark, sf)
    f = sc.formatting_scores(fx.layout_chars_fx(spark, sf), fx.layout_pages_fx(spark, sf), files)
    d_score, d_issues = sc.formatting_default()
    j = files.select("doc_id").join(f, "doc_id", "left")
    return j.select("doc_id", F.coalesce("formatting_score", d_score).alias("formatting_score"),
                    F.coalesce("formatting_issues", d_issues).alias("formatting_issues"))


@query("file_format_score")
def q_file_format_score(spark, sf):
    return sc.file_format_scores(fx.files_fx(spark, sf))


# ------------------------------------------------------------------ T5, T8, T9
def _pair_section_inputs(spark, sf, *needs: str):
    """Pairs with what depends on the résumé alone, the skill gaps, and of the JDs ``jd_phrases`` or the missing keywords
    (``mk``), as ``needs`` says.  What a query needs of a JD is written once: it decides how the sides meet, and whether
    the lists move as codes."""
    from rolefit.functions.codes import vocabulary
    from rolefit.functions.joins import materialize, pair_rows, texts_fit, unshipped
    from rolefit.operators import skills as sk
    from rolefit.plans.catalog import _forms
    db, forms = fx.skill_fx(spark, sf), _forms(spark, sf)
    resumes, jds = fx.resume_fx(spark, sf), fx.jd_fx(spark, sf)
    rs = sk.skill_sets(resumes, db, "resume_id", "resume_skills", forms=forms)
    js = sk.skill_sets(jds, db, "jd_id", "jd_skills", forms=forms)
    r = resumes.select("resume_id", se.sections_col("text", K.RESUME_HEADERS).alias("sections"),
                       F.array_distinct(kw.phrases_col("text")).alias("phrase_set"))
    # what depends on the résumé alone is computed per résumé, before the pairs
    r = r.withColumn("facts", sg.section_facts_col("sections"))
    r = sg.with_page_lines(r.withColumn("formatted", se.format_sections_col("sections")), "formatted")
    r = r.join(unshipped(rs), "resume_id", "left")
    j = jds.select("jd_id", *([kw.phrases_col("text", normalise=False).alias("jd_phrases")] if "jd_phrases" in needs else []))
    if "mk" in needs:
        j = j.join(unshipped(kw.jd_keyword_profile(jds).select("jd_id", "kw_rep")), "jd_id", "left")
    j = j.join(unshipped(js), "jd_id", "left")
    small, codes, kind = texts_fit(jds), None, "string"
    if not small:
        j = materialize(j, "jd-lists")
        codes = vocabulary(j, *j.columns[1:])
    if codes:
        kind = codes.type
        j = j.select("jd_id", *[codes.coded(c).alias(c) for c in j.columns[1:]])
        r = r.withColumns({"own_skills": codes.known("resume_skills"), "phrase_set": codes.known("phrase_set")})
    x = pair_rows(fx.pairs_fx(spark, sf, resumes, jds), r, j, small, "inner")
    lists = {"jd_phrases": F.col("jd_phrases"), "mk": kw.missing_keywords_col(F.col("kw_rep"), F.col("phrase_set"), kind=kind)}
    return x.select("resume_id", "jd_id", "sections", "facts", "page_lines", "page_lines_low", *sk.gap_cols(codes),
                    *[(codes.strings(lists[n]) if codes else lists[n]).alias(n) for n in needs])


@query("section_summaries")
def q_section_summaries(spark, sf):
    x = _pair_section_inputs(spark, sf, "jd_phrases")
    s = sg.section_summaries_col("facts", F.col("matched_skills"), F.col("all_jd_skills"), F.col("jd_phrases"))
    return inline_rows(x, ["resume_id", "jd_id"], s, "section")


@query("resume_optimise")
def q_resume_optimise(spark, sf):
    from rolefit.operators.suggestions import optimise
    x = _pair_section_inputs(spark, sf, "mk")
    return optimise(x, "sections", "missing_skills", "mk").select("resume_id", "jd_id", "optimized_text", "suggestions")


@query("line_gaps")
def q_line_gaps(spark, sf):
    x = _pair_section_inputs(spark, sf, "mk")
    # staged: the terms' lambda must not search for the missing keywords or join the lines once an element
    x = x.select("resume_id", "jd_id", "missing_skills", "mk", "page_lines", "page_lines_low")
    terms = sg.gap_terms_cols(F.col("missing_skills"), F.col("mk"), F.col("page_lines_low"))
    return sg.with_line_gaps(x.select("resume_id", "jd_id", "page_lines", *terms), "page_lines", ["resume_id", "jd_id"])


# ------------------------------------------------------------------ S1–S5
@query("intake_routing")
def q_intake_routing(spark, sf):
    from rolefit.sources.intake import intake_routing
    return intake_routing(spark_view(spark, sf, "uploads"))


@query("page_assembly")
def q_page_assembly(spark, sf):
    from rolefit.sources.intake import doc_pages, page_assembly
    return page_assembly(doc_pages(_docs(spark, sf)))


@query("page_assembly_ocr_flag")
def q_page_assembly_ocr_flag(spark, sf):
    from rolefit.sources.intake import doc_pages, page_assembly_ocr_flag
    return page_assembly_ocr_flag(doc_pages(_docs(spark, sf)))


@query("page_concat")
def q_page_concat(spark, sf):
    from rolefit.sources.intake import doc_pages, page_assembly
    return page_assembly(doc_pages(_docs(spark, sf)), sep="", skip_empty=False)


@query("unique_key_append")
def q_unique_key_append(spark, sf):
    from rolefit.sources.intake import unique_key_append
    batch = spark_view(spark, sf, "users")
    s = read_table(spark, sf, "supplier")
    existing = s.select(F.concat(F.lit("c"), (F.col("s_suppkey") % 1000).cast("string"), F.lit("@example.com"))
                        .alias("email"))
    return unique_key_append(batch, existing)


def _scratch(spark, name):
    from rolefit.session import ensure_checkpoint_dir
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/rolefit-{name}-{uuid.uuid4().hex[:8]}"


@query("jd_text_scan")
def q_jd_text_scan(spark, sf):
    """Write the JDs as text records (the id in the first line), many to a file, and scan them back."""
    from rolefit.sources.intake import text_scan
    path, sep = _scratch(spark, "jd-text"), "\u001e"
    records = fx.jd_fx(spark, sf).select(F.concat_ws("\n", F.col("jd_id").cast("string"), "text").alias("value"))
    records.write.option("lineSep", sep).text(path)
    s = text_scan(spark, path, sep)
    return s.select(F.substring_index("text", "\n", 1).cast("long").alias("jd_id"), F.substr("text", F.instr("text", "\n") + 1).alias("text"))


@query("skill_dict_load")
def q_skill_dict_load(spark, sf):
    """Write the dictionary as JSON objects keyed by id, an entry a line, load it back."""
    from rolefit.sources.intake import skill_dict_load, write_skill_dict
    path = _scratch(spark, "skill-db")
    write_skill_dict(fx.skill_fx(spark, sf), path)
    return skill_dict_load(spark, path)


@query("skill_object_load")
def q_skill_object_load(spark, sf):
    """Write the dictionary as one JSON object, load it back by ranges (small ones, so that there are several)."""
    from rolefit.sources.intake import skill_object_load, write_skill_object
    path = _scratch(spark, "skill-object")
    write_skill_object(fx.skill_fx(spark, sf), path)
    return skill_object_load(spark, path, range_bytes=1024)


# ------------------------------------------------------------------ S6
def streamed_report(spark, sf, fuzzy: bool):
    """Land the résumés as JSON-lines upload batches, run the intake stream once (availableNow), return what it wrote."""
    from rolefit.plans import report as rp
    from rolefit.plans.catalog import _dictionary
    from rolefit.streaming.intake import start_intake
    base = _scratch(spark, "stream")
    resumes, jds = fx.resume_fx(spark, sf), fx.jd_fx(spark, sf)
    resumes.select("resume_id", "text").write.json(f"{base}/inbox")
    ctx = rp.prepare_context(fx.skill_fx(spark, sf), jds, "formatted" if fuzzy else "raw", fuzzy, _dictionary(spark, sf, fuzzy))
    q = start_intake(spark, f"{base}/inbox", f"{base}/sink", f"{base}/checkpoint", ctx,
                     fx.pairs_fx(spark, sf, resumes, jds), fx.layout_chars_fx(spark, sf),
                     fx.layout_pages_fx(spark, sf), fx.files_fx(spark, sf), fuzzy_sections=fuzzy)
    q.awaitTermination()
    return spark.read.parquet(f"{base}/sink").drop("batch_id")


@query("stream_intake")
def q_stream_intake(spark, sf):
    """By the exact rules, as ``ats_report_exact``."""
    return streamed_report(spark, sf, fuzzy=False)
