"""Skill operators: dictionary extraction (G1), gap sets (G3/G4), synonym
expansion (G5), fuzzy match (G6/G7) and the skill score (G8).

Extraction is a *positional phrase join*.  A text becomes an index of its tokens
(word runs and single symbols): one row per token and one per pair of neighbours,
with the position and what stands at either side, and without the text.  A form
of the dictionary is cut the same way; one of one or two tokens is a single key,
a longer one is the chain of its pairs.  Index and forms meet in one equi-join,
and a form is found where all pairs of its chain follow each other.  This equals
the search for the word-bounded form, since a word run of a form that is found is
always a whole token of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolefit.functions.codes import Vocabulary, vocabulary
from rolefit.functions.joins import broadcast_if_small, cell_join, fits, materialize, pair_rows, pieces, unshipped
from rolefit.functions.text import U, ws_normalise

#: A word run or a single symbol, with the space before it.
SPACED_TOKEN = U + r" ?(?:\w+|[^\w ])"
_REST = 1 << 30


def empty_str_array() -> Column:
    return F.array().cast("array<string>")


def normalise_skill_db(skill_db: DataFrame) -> DataFrame:
    """Absent ``low_surface_forms`` / ``match_on_tokens`` default to [] / false."""
    return skill_db.select(
        "skill_id", "skill_name",
        F.coalesce("low_surface_forms", empty_str_array()).alias("low_surface_forms"),
        F.coalesce("match_on_tokens", F.lit(False)).alias("match_on_tokens"))


def _spaced_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SPACED_TOKEN), 0)


def _is_word(token: Column) -> Column:
    """Whether a token (with or without its space) is a word run."""
    return token.rlike(U + r"\w$")


def surface_forms(skill_db: DataFrame) -> DataFrame:
    """The keys of every form: skill_name, form, n_keys (length of its chain), place (in the chain), key, and
    what must stand before the first and after the last key (``w``: a word directly, ``w `` / `` w``: a
    word and a space; null: anything).

    Forms are the lower-cased name and the forms as written (an upper-case form can
    never match the lower-cased text).  A form that no normalised text can hold
    (two spaces in a row) has no row; one without a token has place and key null."""
    db = normalise_skill_db(skill_db)
    forms = (db.select("skill_name", F.explode(F.concat(F.array(F.lower("skill_name")), "low_surface_forms")).alias("form"))
             .filter(F.col("form").isNotNull()).distinct())
    # a space at either end of a form only says what stands beside its tokens
    forms = forms.withColumn("core", F.regexp_replace("form", "^ | $", "")).withColumn("t", _spaced_tokens(F.col("core")))
    t, n = F.col("t"), F.size("t")
    forms = forms.filter((F.array_join("t", "") == F.col("core")) & ~F.col("core").startswith(" "))
    first, last = F.get(t, 0), F.get(t, n - 1)
    forms = forms.select(
        "skill_name", "form",
        F.when(F.col("form").startswith(" "), "w ").when(~_is_word(first), "w").alias("before"),
        F.when(F.col("form").endswith(" "), " w").when(~_is_word(last), "w").alias("after"),
        F.when(n == 1, F.array(first)).when(n > 1, F.zip_with(F.slice(t, 1, F.greatest(n - 1, F.lit(0))), F.slice(t, 2, _REST),
                                                               lambda a, b: F.concat(F.ltrim(a), b))).alias("keys"))
    rows = forms.select("skill_name", "form", "before", "after", F.coalesce(F.size("keys"), F.lit(0)).alias("n_keys"),
                        F.posexplode_outer("keys").alias("place", "key"))
    ends = F.col("place") == F.col("n_keys") - 1
    return rows.select("skill_name", "form", "n_keys", "place", "key", F.when(F.col("place") == 0, F.col("before")).alias("before"),
                       F.when(ends, F.col("after")).alias("after"))


def token_index(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """The positional index: doc, pos, key (a token, or it and the next), and what stands at both sides as in :func:`surface_forms`."""
    t = F.col("t")
    d = docs.select(F.col(id_col).alias("doc"), _spaced_tokens(ws_normalise(text_col)).alias("t"))
    shifted = F.arrays_zip(t.alias("now"), F.slice(F.concat(F.array(F.lit(None).cast("string")), t), 1, F.size(t)).alias("before"),
                           F.slice(t, 2, _REST).alias("next"), F.slice(t, 3, _REST).alias("second"))
    e = d.select("doc", F.posexplode(shifted).alias("pos", "x"))
    now, before, nxt, second = (F.col("x")[c] for c in ("now", "before", "next", "second"))

    def right(token: Column) -> Column:
        return F.when(_is_word(token), F.when(token.startswith(" "), " w").otherwise("w"))

    left = F.when(_is_word(before), F.when(now.startswith(" "), "w ").otherwise("w"))
    alone = F.struct(F.ltrim(now).alias("key"), right(nxt).alias("after"))
    pair = F.struct(F.concat(F.ltrim(now), nxt).alias("key"), right(second).alias("after"))
    rows = e.select("doc", "pos", left.alias("before"), F.inline(F.array(alone, pair)))
    return rows.filter(F.col("key").isNotNull())


def found_skills(docs: DataFrame, id_col: str, forms: DataFrame, text_col: str = "text") -> DataFrame:
    """(id_col, skill_name), a skill once or more often; ``forms``: a table of :func:`surface_forms`.

    The rows are dealt once, by document and into bounded partitions; what groups them by document (and more) finds
    them in place."""
    keys = forms.filter(F.col("key").isNotNull()).select(
        "skill_name", "form", "n_keys", "place", "key", F.col("before").alias("need_before"), F.col("after").alias("need_after"))
    sides = [F.col(f"need_{s}").isNull() | F.coalesce(F.col(f"need_{s}") == F.col(s), F.lit(False)) for s in ("before", "after")]
    met = token_index(docs, id_col, text_col).join(broadcast_if_small(keys), "key").filter(sides[0] & sides[1])
    chain = F.col("n_keys") > 1
    met = met.select("doc", "skill_name", "n_keys", F.when(chain, F.col("form")).alias("form"),
                     F.when(chain, F.col("pos") - F.col("place")).alias("start"))
    # forms without a token: empty (a word boundary anywhere) or one space (between two words)
    blank = forms.filter(F.col("key").isNull()).select("skill_name", F.col("form").alias("kind"))
    norm = ws_normalise(text_col)
    kinds = F.filter(F.array(F.when(norm.rlike(U + r"\w"), ""), F.when(norm.rlike(U + r"\w \w"), " ")), lambda x: x.isNotNull())
    blanks = docs.select(F.col(id_col).alias("doc"), F.explode(kinds).alias("kind")).join(broadcast_if_small(blank), "kind")
    blanks = blanks.select("doc", "skill_name", F.lit(1).alias("n_keys"), F.lit(None).cast("string").alias("form"),
                           F.lit(None).cast("int").alias("start"))
    rows = met.unionByName(blanks).repartition(pieces(docs.select(id_col, text_col)), "doc")
    starts = rows.groupBy("doc", "skill_name", "form", "start").agg(F.count(F.lit(1)).alias("n"), F.max("n_keys").alias("n_keys"))
    return starts.filter((F.col("n_keys") == 1) | (F.col("n") == F.col("n_keys"))).select(F.col("doc").alias(id_col), "skill_name")


def extract_skills(docs: DataFrame, skill_db: DataFrame, id_col: str, text_col: str = "text",
                   forms: DataFrame | None = None) -> DataFrame:
    """G1: distinct (id_col, skill_name) found in whitespace-normalised lower-cased text."""
    forms = forms if forms is not None else materialize(surface_forms(skill_db), "forms")
    return found_skills(docs, id_col, forms, text_col).distinct()


def skill_sets(docs: DataFrame, skill_db: DataFrame, id_col: str, out_col: str,
               text_col: str = "text", forms: DataFrame | None = None) -> DataFrame:
    """G4 per document: sorted (code-point order) array of found skill names."""
    forms = forms if forms is not None else materialize(surface_forms(skill_db), "forms")
    found = found_skills(docs, id_col, forms, text_col)
    return found.groupBy(id_col).agg(F.sort_array(F.collect_set("skill_name")).alias(out_col))


def skill_gap_arrays(pairs: DataFrame, resume_sets: DataFrame, jd_sets: DataFrame) -> DataFrame:
    """G3/G4 per pair: missing = JD − résumé, matched = résumé ∩ JD, all sorted.

    One row per document on each side, so the two joins are key lookups.  The JD
    sets are written first: what they hold decides how the sides meet, and whether a set moves as codes."""
    js = materialize(jd_sets, "jd-sets")
    small = fits(js)
    codes = None if small else vocabulary(js, "jd_skills")
    if codes:
        js = js.select("jd_id", codes.coded("jd_skills").alias("jd_skills"))
        resume_sets = resume_sets.withColumn("own_skills", codes.known("resume_skills"))
    return pair_rows(pairs, resume_sets, js, small).select("resume_id", "jd_id", *gap_cols(codes))


def gap_cols(codes: Vocabulary | None = None) -> list[Column]:
    """G3/G4 on ``resume_skills`` and ``jd_skills``: row-wise on hash sets (``array_except``/``array_intersect``
    keep the sorted order of their first argument).  With ``codes``, ``jd_skills`` are coded, and so are those of the
    résumé that a JD can have (``own_skills``)."""
    r = F.coalesce("resume_skills", empty_str_array())
    if codes is None:
        j = F.coalesce("jd_skills", empty_str_array())
        return [F.array_except(j, r).alias("missing_skills"), F.array_intersect(r, j).alias("matched_skills"),
                r.alias("all_resume_skills"), j.alias("all_jd_skills")]
    j, own = (F.coalesce(c, F.array().cast(f"array<{codes.type}>")) for c in ("jd_skills", "own_skills"))
    return [codes.strings(F.array_except(j, own)).alias("missing_skills"), codes.strings(F.array_intersect(own, j)).alias("matched_skills"),
            r.alias("all_resume_skills"), codes.strings(j).alias("all_jd_skills")]


# --------------------------------------------------------------------------
# Fuzzy links over the dictionary vocabulary
# --------------------------------------------------------------------------
def _kmax(total: Column, sim: float) -> Column:
    """Largest indel distance compatible with ratio > sim for total length ``total``:
    ratio = 2M/T > sim needs T - 2·LCS < (1 - sim)·T, and T - 2·LCS is even just if T is."""
    most = (F.ceil(total * (1.0 - sim)) - 1).cast("int")
    return most - F.pmod(total - most, F.lit(2)).cast("int")


def near_key_pairs(keys: DataFrame, threshold: int = 90, q: int = 2) -> DataFrame:
    """Ordered pairs (a, b), a ≠ b, of token-sort keys with ``ratio(a, b) > threshold``
    (80 or more: below, strings may share no q-gram).  The ratio depends on the
    order of its arguments, so both orders of a candidate are scored.

    Exact blocking: ratio > s implies indel distance k < (1-s)(|a|+|b|) and the
    length bound; strings within edit distance k share at least
    max(|a|,|b|) - q + 1 - k·q q-grams (occurrence-numbered), so with grams in
    one global rarity order their prefixes of |G| - τ + 1 grams intersect.  At the
    first gram that two prefixes share, at places i and j, at most
    1 + min(|G| - i, |H| - j) grams can be shared (position filter).  The rows of
    a gram that many prefixes hold meet in cells of bounded size.
    Only candidates from the prefix join reach the exact ratio (pandas UDF)."""
    from rolefit.functions.fuzzy import ratio_udf
    if threshold < 80:
        raise ValueError("the blocking is complete for thresholds of 80 and more")
    sim = (threshold + 0.5) / 100.0
    lo_f, hi_f = sim / (2 - sim), (2 - sim) / sim
    n = F.length("s")
    # two different strings of T characters together reach (T - 1) / T at most
    k = keys.select(F.col("k").alias("s")).filter(n + F.floor(n * hi_f) >= 1.0 / (1.0 - sim)).distinct()
    grams = k.select("s", F.posexplode(F.transform(F.sequence(F.lit(1), n - q + 1),
                                                   lambda i: F.substring("s", i, q))).alias("pos", "g"))
    occ = F.row_number().over(Window.partitionBy("s", "g").orderBy("pos"))
    grams = grams.select("s", F.concat(F.col("g"), F.lit("#"), occ.cast("string")).alias("gid"))
    freq = grams.groupBy("gid").agg(F.count(F.lit(1)).alias("df"))
    ranked = grams.join(unshipped(freq), "gid").withColumn(
        "rk", F.row_number().over(Window.partitionBy("s").orderBy("df", "gid")))
    lens = F.sequence(F.ceil(n * lo_f).cast("int"), F.floor(n * hi_f).cast("int"))
    tau = F.aggregate(lens, F.lit(1 << 30), lambda acc, L: F.least(
        acc, F.greatest(n, L) - q + 1 - q * _kmax(n + L, sim)))
    pref = ranked.withColumn("p", F.when(tau <= 0, n).otherwise(n - q + 1 - tau + 1)).filter(F.col("rk") <= F.col("p"))
    pref = materialize(pref.select("s", "gid", "rk"), "grams")
    a = pref.select(F.col("s").alias("a"), "gid", F.col("rk").alias("ra"))
    b = pref.select(F.col("s").alias("b"), "gid", F.col("rk").alias("rb"))
    la, lb = F.length("a"), F.length("b")
    shared = F.greatest(la, lb) - q + 1 - q * _kmax(la + lb, sim)
    room = 1 + F.least(la - q + 1 - F.col("ra"), lb - q + 1 - F.col("rb"))
    once = (la < lb) | ((la == lb) & (F.col("a") < F.col("b")))
    cand = cell_join(a, b, "gid").filter(once & (lb - la <= _kmax(la + lb, sim)) & (room >= shared)).select("a", "b").distinct()
    both = cand.unionByName(cand.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.filter(ratio_udf(F.col("a"), F.col("b")) > threshold)


def cosine_string_pairs(strings: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Ordered pairs (x, y), x ≠ y, whose term-frequency cosine exceeds ``threshold``.

    Exact prefix filter: with tokens in ascending document frequency, a vector
    whose suffix norm is at most ``threshold`` shares a prefix token with every
    partner above the threshold; prefix tokens are joined to all tokens, those of
    a frequent term in cells of bounded size."""
    from rolefit.operators.vectors import sparse_cosine_col, tf_vector_col
    v = strings.select("s", tf_vector_col(F.col("s")).alias("v")).filter(F.size("v") > 0)
    toks = v.select("s", F.explode("v").alias("e")).select("s", F.col("e.term").alias("term"), F.col("e.tf").alias("tf"))
    dfreq = toks.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    t = toks.join(unshipped(dfreq), "term")
    w = Window.partitionBy("s").orderBy("df", "term")
    tail = Window.partitionBy("s").orderBy("df", "term").rowsBetween(1, Window.unboundedFollowing)
    t = (t.withColumn("norm2", F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy("s")))
         .withColumn("suffix2", F.coalesce(F.sum(F.col("tf") * F.col("tf")).over(tail), F.lit(0)))
         .withColumn("rk", F.row_number().over(w)))
    # keep token i while the norm of the tokens after the previous one exceeds threshold
    prev_suffix = F.col("suffix2") + F.col("tf") * F.col("tf")
    pref = t.filter(prev_suffix > threshold * threshold * F.col("norm2")).select(F.col("s").alias("x"), "term")
    allt = toks.select(F.col("s").alias("y"), "term")
    cand = cell_join(materialize(pref, "terms"), allt, "term").filter(F.col("x") != F.col("y")).select("x", "y").distinct()
    vx = v.select(F.col("s").alias("x"), F.col("v").alias("vx"))
    vy = v.select(F.col("s").alias("y"), F.col("v").alias("vy"))
    c = cand.join(unshipped(vx), "x").join(unshipped(vy), "y")
    hit = c.filter(sparse_cosine_col(F.col("vx"), F.col("vy")) > threshold).select("x", "y")
    return hit.unionByName(hit.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
