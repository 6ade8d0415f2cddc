"""The pipeline's stages: each keeps the documents' columns, its decisions take effect, clean documents stay."""
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rolefit.llm.catalog import fold


def _table(spark):
    rng = np.random.default_rng(3)
    voice = {"en": [f"th{a}{b}" for a in "aeiou" for b in "ndrst"], "de": [f"sch{a}{b}" for a in "äöüei" for b in "ndrst"]}
    rows = []
    for i in range(120):
        k = "en" if i % 2 else "de"
        rows.append((i, " ".join(rng.choice(voice[k], 150)), k, f"s{i % 3}"))
    rows += [(200 + i, rows[i][1] + (" " if i % 2 else "\n"), rows[i][2], "s1") for i in range(6)]  # copies
    words = rows[20][1].split()
    rows += [(300, " ".join(["other", *words]), "de", "s2"), (301, None, None, None), (302, "", "en", "s0"), (303, "12 ; 34 " * 20, "en", "s0"), (304, "a b c d e f g h " * 9, "en", "s0")]
    return spark.createDataFrame([(a, t, l, s, None if t is None else len(t)) for a, t, l, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark):
    docs = _table(spark)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)
    q = stages["quality_rules"](spark, docs, "")
    assert q.columns == docs.columns and ids(docs) - ids(q) == {301, 302, 303, 304}
    odd = docs.filter("doc_id in (1, 2, 303)")
    assert ids(stages["language_id"](spark, odd, "")) == {1, 2}
    x = stages["exact_dedup"](spark, q, "")
    assert x.columns == docs.columns
    assert ids(x) == ids(q) - {0, 1, 2, 3, 4, 5}  # of equal texts the longer one stays
    n = stages["simhash_near_dedup"](spark, x, "")
    assert n.columns == docs.columns and 300 not in ids(n) and {20, *range(30, 120)} <= ids(n)
    p = stages["best_fit_packing"](spark, n, "")
    assert ids(p) == ids(n)


def test_run_equals_the_stages(spark, tmp_path):
    docs = _table(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({r.doc_id for r in out}) == 120 and not {300, 301, 302, 303, 304} & {r.doc_id for r in out}


def test_language_without_labels(spark):
    docs = _table(spark).withColumn("lang", F.lit(None).cast("string"))
    out = dict(corpus_pipeline.STAGES)["language_id"](spark, docs, "")
    got = out.collect()
    assert out.columns == docs.columns and all(r.lang is None for r in got)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in got} == {301, 302, 303} and len(got) == docs.count() - 3


def test_repeated_rows_and_null_ids(spark):
    docs = _table(spark)
    one, two = docs.filter("doc_id = 40"), docs.filter("doc_id = 41").withColumn("doc_id", F.lit(None).cast("long"))
    some = one.unionByName(one).unionByName(one).unionByName(two).unionByName(two).unionByName(docs.filter("doc_id between 50 and 59"))
    out = dict(corpus_pipeline.STAGES)["exact_dedup"](spark, some, "")
    got = out.collect()
    assert out.columns == docs.columns and sorted(r.doc_id or -1 for r in got) == [-1, 40, *range(50, 60)]
    assert {r.text for r in got} == {r.text for r in some.collect()}


def test_fold_of_a_null_id(spark):
    assert [r[0] for r in spark.createDataFrame([(None,), (1,)], "doc_id long").select(fold("doc_id", 4, 2)).collect()][0] is False


@pytest.mark.parametrize("k", [0, 1])
def test_a_filter_does_not_run_a_python_function_twice(spark, docs, k):
    plan = corpus_pipeline.STAGES[k][1](spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_stages_with_clashing_columns_and_empty_tables(spark, docs):
    own = docs.withColumns({c: F.lit("clash") for c in ("found", "extra", "other", "text_sha256", "gone_id", "text_key", "component_id", "clean_text")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, "")
        assert out.columns == own.columns, name
        assert all(r["found"] == r["gone_id"] == r["kept"] == "clash" for r in out.collect()), name
        assert stage(spark, own.limit(0), "").collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, own.limit(0), "").collect() == []
