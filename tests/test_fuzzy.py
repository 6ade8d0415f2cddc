"""Fuzzy skill matching: the blockers and prefilters lose no pair."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rolefit.functions import joins
from rolefit.functions.fuzzy import partial_ratio, ratio, token_sort_key, token_sort_key_col
from rolefit.operators import skills as sk
from rolefit.plans import catalog_ops
from rolefit.plans.catalog import QUERIES
from rolefit.plans.report import may_exceed_partial
from rolefit.sources import fixtures as fx
from tests.conftest import SF_SMALL


def _tf(s):
    toks = re.findall(r"\w+|[^\w\s]", s.lower())
    return Counter(toks)


def _cos(a, b):
    va, vb = _tf(a), _tf(b)
    na, nb = sum(v * v for v in va.values()), sum(v * v for v in vb.values())
    if na == 0 or nb == 0:
        return 0.0
    return sum(va[t] * vb[t] for t in va) / math.sqrt(na * nb)


def test_fuzzy_match_keeps_the_exact_matches(spark):
    gaps = {(r.resume_id, r.jd_id): r for r in QUERIES["skill_gap_arrays"](spark, SF_SMALL).collect()}
    got = {(r.resume_id, r.jd_id): r for r in QUERIES["skill_missing_fuzzy"](spark, SF_SMALL).collect()}
    assert set(got) == set(gaps)
    for key, g in gaps.items():
        exact = {s.lower() for s in set(g.all_resume_skills) & set(g.all_jd_skills)}
        assert not exact & set(got[key].missing_skills) and 0 <= got[key].skill_match_score <= 100


#: Pairs whose ratio depends on the order, and short keys near each other at lower thresholds.
SEEDS = ["a bgbg egefha hag", "a bgbg ee fgha hag", "java", "javas", "abc", "abcd", "ab"]


@pytest.mark.parametrize("threshold", [80, 85, 90, 95])
def test_near_key_blocking_is_complete(spark, threshold):
    rnd = random.Random(threshold)
    words = set(SEEDS)
    for w in ["".join(rnd.choice("abcde ") for _ in range(rnd.randint(2, 16))) for _ in range(90)]:
        i = rnd.randrange(len(w))
        words |= {w, w[:i] + w[i + 1:], w[:i] + rnd.choice("abcde") + w[i:]}
    keys = sorted({token_sort_key(w) for w in words} | set(SEEDS) - {""})
    keys = [k for k in keys if k]
    got = {(r.a, r.b) for r in sk.near_key_pairs(spark.createDataFrame([(k,) for k in keys], "k string"), threshold).collect()}
    assert got == {(a, b) for a in keys for b in keys if a != b and ratio(a, b) > threshold}


@pytest.mark.parametrize("threshold", [80, 90, 95])
def test_blocking_with_a_gram_in_every_key(spark, monkeypatch, threshold):
    """Short keys that all hold one gram: its list is dealt to cells, and no pair is lost."""
    monkeypatch.setattr(joins, "CELL", 8)
    rnd = random.Random(threshold)
    keys = sorted({"zz" + "".join(rnd.choice("abz") for _ in range(rnd.randint(0, 6))) for _ in range(150)})
    got = {(r.a, r.b) for r in sk.near_key_pairs(spark.createDataFrame([(k,) for k in keys], "k string"), threshold).collect()}
    assert got == {(a, b) for a in keys for b in keys if a != b and ratio(a, b) > threshold}


def test_cells_of_a_frequent_key(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("l"))
    right = spark.range(600, 1600).select(F.when(F.col("id") < 1100, "hot").otherwise(F.lit("905")).alias("k"), F.col("id").alias("r"))
    got = joins.cell_join(left, right, "k", 50)
    assert got.count() == left.join(right, "k").count() == 900 * 500 + 500
    assert got.distinct().count() == got.count()
    a, b = joins.cells(left, right, "k", 50)
    for side, limit in ((a, 100), (b, 100)):
        assert side.groupBy("k", "_x", "_y").count().agg(F.max("count")).first()[0] <= limit


def test_section_prefilter_loses_no_token(spark):
    rnd = random.Random(2)
    names = ["skills", "experience", "education", "certifications"]
    toks = {"maleducati"}
    for _ in range(400):
        n = rnd.choice(names)
        cut = n[rnd.randint(0, 4): len(n) - rnd.randint(0, 4)]
        toks.add("".join(rnd.choice("aeit") for _ in range(rnd.randint(0, 4))) + cut)
    toks = sorted(t for t in toks if t)
    df = spark.createDataFrame([(t,) for t in toks], "t string")
    for n in names:
        maybe = {r.t for r in df.filter(may_exceed_partial(F.col("t"), n, 85)).collect()}
        assert {t for t in toks if partial_ratio(n, t) > 85} <= maybe


def test_keys_of_other_scripts(spark):
    rows = ["机器 学习", "数据 库", "Питон", "Джава", "بايثون", "Café-bar", "C++ dev"]
    df = spark.createDataFrame([(r,) for r in rows], "s string").select("s", token_sort_key_col(F.col("s")).alias("k"))
    keys = {r.s: r.k for r in df.collect()}
    assert keys == {r: token_sort_key(r) for r in rows} and len(set(keys.values())) == len(rows) and "" not in keys.values()


def test_cosine_pairs_are_complete(spark):
    rnd = random.Random(3)
    vocab = ["data", "science", "big", "ml", "ops", "-", "web", "dev", "c", "#"]
    strings = sorted({" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 4))) for _ in range(150)})
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    got = {(r.x, r.y) for r in sk.cosine_string_pairs(df, 0.8).collect()}
    want = {(a, b) for a in strings for b in strings if a != b and _cos(a, b) > 0.8}
    assert got == want


def test_stream_intake_equals_batch_report(spark):
    batch = QUERIES["ats_report"](spark, SF_SMALL)
    stream = catalog_ops.streamed_report(spark, SF_SMALL, fuzzy=True)
    cols = sorted(batch.columns)
    a = sorted(tuple(str(r[c]) for c in cols) for r in batch.select(*cols).collect())
    b = sorted(tuple(str(r[c]) for c in cols) for r in stream.select(*cols).collect())
    assert a == b and len(a) > 0


def test_report_has_one_row_per_pair(spark):
    rep = QUERIES["ats_report"](spark, SF_SMALL)
    pairs = fx.pairs_fx(spark, SF_SMALL)
    assert rep.count() == pairs.count() == rep.select("resume_id", "jd_id").distinct().count()
    bad = rep.filter((F.col("total_score") > 100) | F.col("recommendations").isNull()).count()
    assert bad == 0
