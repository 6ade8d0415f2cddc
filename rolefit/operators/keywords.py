"""Keyword operators.

Per document: the phrase list (W1) of the whitespace-normalised lower-cased
text; the JD side is counted (W2) by a grouped aggregate, the résumé side only
needs its distinct phrase set.  Per pair everything is row-wise on arrays:
hash-set intersections plus one linear merge, never a per-pair explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.functions.arrays import sum_shared
from rolefit.functions.text import PHRASE, col, ws_normalise


def phrases_col(text, normalise: bool = True) -> Column:
    """``re.findall(r'\\b(?:\\w+\\s+\\w+|\\w{4,})\\b', text)`` (left to right, non-overlapping)."""
    t = ws_normalise(text) if normalise else F.lower(col(text))
    return F.regexp_extract_all(t, F.lit(PHRASE), 0)


def word_count_col(text) -> Column:
    """``len(normalised_text.split())``."""
    n = ws_normalise(text)
    return F.when(n == "", F.lit(0)).otherwise(F.size(F.split(n, " ", -1)))


def phrase_counts(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, phrase, cnt, first_pos), counted by a grouped aggregate
    (partial aggregation runs before the shuffle)."""
    e = docs.select(id_col, F.posexplode(phrases_col(text_col)).alias("pos", "phrase"))
    return e.groupBy(id_col, "phrase").agg(F.count(F.lit(1)).alias("cnt"), F.min("pos").alias("first_pos"))


def jd_keyword_profile(docs: DataFrame, id_col: str = "jd_id", text_col: str = "text") -> DataFrame:
    """Per JD: ``kw`` = phrase counts sorted by phrase, ``kw_rep`` = phrases
    counted more than once in first-occurrence order."""
    pc = phrase_counts(docs, id_col, text_col)
    g = pc.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("phrase", "cnt"))).alias("kw"),
        F.array_sort(F.collect_list(F.when(F.col("cnt") > 1, F.struct("first_pos", "phrase")))).alias("_rep"))
    return g.select(id_col, "kw", F.transform("_rep", lambda x: x["phrase"]).alias("kw_rep"))


def split_profile_cols(kw: Column) -> list[Column]:
    """Per JD, for :func:`density_cols`: the phrases, and the repeated ones with their further occurrences."""
    return [F.transform(kw, lambda x: x["phrase"]).alias("kw_phrases"),
            F.transform(F.filter(kw, lambda x: x["cnt"] > 1),
                        lambda x: F.struct(x["phrase"].alias("phrase"), (x["cnt"] - 1).alias("cnt"))).alias("kw_more")]


def shared_phrases_col(phrases: Column, phrase_set: Column, kind: str = "string") -> Column:
    """The JD's phrases (of type ``kind``: strings or codes) that the résumé holds."""
    return F.array_intersect(F.coalesce(phrases, F.array().cast(f"array<{kind}>")), phrase_set)


def density_cols(phrases: Column, more: Column, phrase_set: Column, words: Column):
    """(keyword_density, density_score) on the columns of :func:`split_profile_cols`.

    Every shared phrase counts once by the size of a hash intersection; only repeated phrases are walked."""
    d = density_of(F.size(shared_phrases_col(phrases, phrase_set)), more, phrase_set, words)
    return d, density_score_col(d)


def density_of(shared: Column, more: Column, held: Column, words: Column) -> Column:
    """W3 from the number of shared phrases; ``held``: the résumé's phrases, or a staged column of the shared ones."""
    total = shared + sum_shared(more, held, "phrase", "cnt")
    return F.when(words > 0, total.cast("double") / words * 100.0).otherwise(F.lit(0.0))


def density_score_col(d: Column) -> Column:
    """W4."""
    return F.when((d >= 0.5) & (d <= 1.5), 100.0).when(d < 0.5, 60.0).otherwise(30.0)


def missing_keywords_col(kw_rep: Column, phrase_set: Column, k: int = 5, kind: str = "string") -> Column:
    """First k repeated JD phrases (of type ``kind``: strings or codes) absent from the résumé."""
    none = F.array().cast(f"array<{kind}>")
    missing = F.slice(F.array_except(F.coalesce(kw_rep, none), phrase_set), 1, k)
    # the résumé's phrases are hashed only if the JD repeats one
    return F.when((F.size(kw_rep) > 0) | phrase_set.isNull(), missing).otherwise(none)


def matched_keywords_col(jd_set_sorted: Column, resume_set: Column, k: int = 10) -> Column:
    """Phrases of both lower-cased texts, first k in code-point order."""
    return F.slice(F.array_intersect(jd_set_sorted, resume_set), 1, k)
