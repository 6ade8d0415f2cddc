"""What a broadcast is bounded by, and how pairs meet documents beyond the bound."""

import pytest
from pyspark.sql import functions as F

from rolefit.functions import joins
from rolefit.functions.joins import broadcast_if_small, fits, held_bytes, materialize, pair_rows, pieces, planned_bytes
from rolefit.operators import keywords as kw
from rolefit.operators import vectors as ve


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def sets(spark):
    """Arrays of few words: their file is many times smaller than their rows."""
    rows = spark.range(4000).select(F.col("id").alias("jd_id"), F.array(*[F.concat(F.lit(f"skill {i} "), F.col("id") % 2) for i in range(20)]).alias("jd_skills"))
    return materialize(rows, "sets")


def test_bound_is_of_rows_not_of_files(spark, sets, monkeypatch):
    assert planned_bytes(sets) * 10 < held_bytes(sets)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", planned_bytes(sets) * 2)
    assert not fits(sets)
    ids = spark.range(4000).select(F.col("id").alias("jd_id"))
    assert "Broadcast" not in _plan(ids.join(broadcast_if_small(sets), "jd_id"))


def test_large_sides_meet_the_jds_first_and_hash_the_resumes(spark, sets):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (5, 2), (7, 9999), (None, 3)], "resume_id long, jd_id long")
    resumes = materialize(spark.createDataFrame([(1, ["a"]), (5, ["b"]), (5, ["c"])], "resume_id long, resume_skills array<string>"), "resumes")
    large = pair_rows(pairs, resumes, sets, small=False)
    p = _plan(large)
    assert "ShuffledHashJoin" in p and "BroadcastHashJoin" not in p and p.index("ShuffledHashJoin") < p.index("SortMergeJoin")
    for how in ("left", "inner"):
        a, b = ([sorted(map(str, pair_rows(pairs, resumes, sets, s, how).select("resume_id", "jd_id", "resume_skills", "jd_skills").collect()))
                 for s in (True, False)])
        assert a == b and a


def test_pieces_grow_with_the_table(spark, sets, monkeypatch):
    few = pieces(sets)
    monkeypatch.setattr(joins, "FULL_PIECE_BYTES", max(planned_bytes(sets) // 50, 1))
    assert few <= 8 and pieces(sets) >= 50


def test_missing_keywords_of_null_phrases(spark):
    rows = spark.createDataFrame([(1, ["a"], ["a"]), (2, ["a", "b"], ["b"]), (3, [], ["b"]), (4, None, ["b"]), (5, [], None), (6, ["a"], None)],
                                 "id int, rep array<string>, have array<string>")
    got = {r.id: r.m for r in rows.select("id", kw.missing_keywords_col(F.col("rep"), F.col("have")).alias("m")).collect()}
    assert got == {1: [], 2: ["a"], 3: [], 4: [], 5: None, 6: None}


def test_split_cosine_walks_repeated_terms(spark):
    rows = spark.createDataFrame([("a a b", "a a c"), ("a a b", "a c"), ("a b", "a a"), ("a a", "b b"), ("", "a"), (None, "a")], "x string, y string")
    v = rows.select("x", "y", ve.tf_vector_col("x").alias("vx"), ve.tf_vector_col("y").alias("vy"))
    s = v.select("*", *ve.split_vector_cols(F.col("vx"), "p"), *ve.split_vector_cols(F.col("vy"), "q"))
    got = [r.c for r in s.select(ve.split_cosine_col("p", "q").alias("c")).collect()]
    want = [4 / 5, 2 / (5 * 2) ** 0.5, 2 / (2 * 4) ** 0.5, 0.0, 0.0, 0.0]
    assert got == pytest.approx(want)


def test_no_join_is_left_to_the_planners_sizes(spark, tmp_path, monkeypatch):
    """Beyond the measured bound nothing is shipped, however small the files or the shuffle blocks."""
    from rolefit.operators import scoring as sc
    from rolefit.plans import report as rp
    from rolefit.sources import fixtures as fx
    day = "timestamp'1995-03-01'"
    rows = {"customer": "1L c_custkey, 2 c_nationkey, 'C' c_name, 'AUTO' c_mktsegment",
            "orders": f"id o_orderkey, 1L o_custkey, {day} o_orderdate", "supplier": "3L s_suppkey, 4 s_nationkey",
            "part": "id p_partkey, 'red ' || id p_name, 'TIN' p_type", "lineitem": "id l_orderkey, id l_partkey, 3L l_suppkey"}
    for name, row in rows.items():
        n = 1 if name == "supplier" else 2 if name == "customer" else 50
        spark.range(n).selectExpr(*row.split(", ")).write.parquet(f"{tmp_path}/{name}.parquet")
    want = [sorted(map(str, f(spark, str(tmp_path)).collect())) for f in (fx._resume_fx, fx._jd_fx, fx._pairs)]
    assert [len(w) for w in want] == [1, 1, 1]
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    plans = [f(spark, str(tmp_path)) for f in (fx._resume_fx, fx._jd_fx, fx._pairs)]
    assert [sorted(map(str, p.collect())) for p in plans] == want
    chars = spark.createDataFrame([(1, "arial", 11.0)], "doc_id long, fontname string, size double")
    pages = spark.createDataFrame([(1, 1, 72.0, 0, 0, "x")], "doc_id long, page_no int, width double, n_tables int, n_images int, text string")
    files = spark.createDataFrame([(1, "a.pdf", "1.4", "UTF-8"), (2, "b.docx", None, None)], "doc_id long, path string, pdf_version string, encoding string")
    plans.append(sc.formatting_scores(chars, pages, files))
    docs = spark.createDataFrame([(1, "Skills\nred bolt")], "resume_id long, text string")
    forms, syn = rp.dictionary_tables(spark.createDataFrame([("s", "red bolt", ["bolt red"], False)], "skill_id string, skill_name string, low_surface_forms array<string>, match_on_tokens boolean"), False)
    plans.append(rp.resume_features(docs, chars, pages, files, forms, syn, "raw", fuzzy_sections=False))
    plans.append(rp.jd_features(docs.withColumnRenamed("resume_id", "jd_id"), forms, syn, "raw"))
    for df in plans:
        df.collect()
        assert "Broadcast" not in _plan(df)


def test_packed_arrays_come_back(spark):
    from rolefit.functions.arrays import packed, unpacked
    rows = [(1, ["a b", "c"]), (2, []), (3, None), (4, [""]), (5, ["a", ""]), (6, ["a\u0000b", "c"]), (7, [None, "a"]), (8, ["é\n"]), (9, ["", ""])]
    df = spark.createDataFrame(rows, "id int, a array<string>").select("id", packed("a").alias("p"))
    got = {r.id: (r.a, r.packed) for r in df.select("id", unpacked("p").alias("a"), F.col("p.raw").isNull().alias("packed")).collect()}
    assert {i: a for i, (a, _) in got.items()} == dict(rows)
    assert [i for i, (_, p) in got.items() if p] == [1, 2, 3, 8]


def test_pair_queries_move_texts_instead_of_arrays(spark, monkeypatch):
    """What goes through the last exchange with every pair has no array of strings of the JD."""
    from rolefit.plans import catalog
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    for name, column in (("matched_keywords", "w6_sorted"), ("skill_score", "wanted"), ("skill_missing_fuzzy", "hits")):
        p = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
        joins_of = [n for n in p.toString().splitlines() if "Join" in n]
        assert joins_of and "raw" in p.toString()
        outer = p
        while "Join" not in outer.nodeName():
            outer = outer.children().head()
        types = {a.name(): a.dataType().simpleString() for a in (outer.output().apply(i) for i in range(outer.output().size()))}
        assert types[column] == "struct<text:string,raw:array<string>>"


def test_no_join_of_the_dictionary_is_left_to_the_planners_sizes(spark, monkeypatch):
    """The tables that the fuzzy links are made of grow with the dictionary: beyond the measured bound none is shipped."""
    from rolefit.operators import skills as sk
    from rolefit.plans import report as rp
    rows = [(n, n, [n.replace(" ", "-")], m) for n, m in (("machine learning ops", False), ("machine learnin ops", False), ("red bolt", True), ("bolt red", False))]
    db = spark.createDataFrame(rows, "skill_id string, skill_name string, low_surface_forms array<string>, match_on_tokens boolean")

    def links():
        return sorted((r.key, sorted(r.vals), sorted(r.hits)) for r in rp.synonym_table(db).collect())

    want, plans = links(), []
    assert ("machine learnin ops", ["machine learnin ops", "machine-learnin-ops"],
            ["machine learnin ops", "machine learning ops", "machine-learnin-ops", "machine-learning-ops"]) in want

    def written(df, name="table"):
        df.collect()
        plans.append(_plan(df))
        return materialize(df, name)

    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    for module in (joins, sk, rp):
        monkeypatch.setattr(module, "materialize", written)
    assert links() == want
    last = rp.synonym_table(db)
    last.collect()
    assert len(plans) >= 5
    for p in [*plans, _plan(last)]:
        assert "Broadcast" not in p
