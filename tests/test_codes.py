"""What moves with a pair when its JD is not shipped: codes, if the JDs' strings are few."""

import pytest
from pyspark.sql import functions as F

from rolefit.functions import joins
from rolefit.functions.codes import UNKNOWN, vocabulary
from rolefit.functions.joins import materialize
from rolefit.operators import skills as sk
from rolefit.plans import catalog
from tests.conftest import SF_SMALL


def _moved(df) -> dict:
    """Columns of the rows that meet the résumés last, by type."""
    p = df._jdf.queryExecution().optimizedPlan()
    while "Join" not in p.nodeName():
        p = p.children().head()
    out = p.children().head().output()
    return {out.apply(i).name(): out.apply(i).dataType().simpleString() for i in range(out.size())}


def test_codes_read_back(spark):
    rows = [(1, ["b", "a", "é \"\\\n"]), (2, []), (3, None), (4, [None, "b", ""]), (5, ["x\u0000y", "😀", "b", "b"])]
    t = materialize(spark.createDataFrame(rows, "id int, a array<string>"))
    v = vocabulary(t, "a")
    got = t.select("id", v.coded("a").alias("c")).select("id", "c", v.strings("c").alias("a"))
    assert got.schema["c"].dataType.simpleString() == "array<smallint>"
    assert {r.id: r.a for r in got.collect()} == dict(rows)
    strange = spark.createDataFrame([(["zz", "b", None, "ab"],)], "a array<string>")
    known = strange.select(v.strings(v.known("a")).alias("s"), v.code(F.lit("zz")).alias("c")).first()
    assert known.s == ["b", None] and known.c == UNKNOWN
    assert v.type == "smallint" and vocabulary(t.filter("id in (2, 3)"), "a").coded is not None


def test_large_vocabularies_are_not_coded(spark, monkeypatch):
    t = materialize(spark.range(3000).select(F.array(F.concat(F.lit("w"), "id")).alias("a")))
    assert vocabulary(t, "a").type == "smallint"
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 64 << 10)
    assert vocabulary(t, "a") is None


def test_gaps_are_the_same_with_codes(spark, monkeypatch):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3), (9, 2), (2, 9), (None, 1)], "resume_id long, jd_id long")
    rs = materialize(spark.createDataFrame([(1, ["a", "c", "only here"]), (2, []), (2, ["b"])], "resume_id long, resume_skills array<string>"))
    js = materialize(spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["c", "d"]), (3, [])], "jd_id long, jd_skills array<string>"))
    want = sorted(map(str, sk.skill_gap_arrays(pairs, rs, js).collect()))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 1 << 20)
    monkeypatch.setattr(sk, "fits", lambda df: False)
    coded = sk.skill_gap_arrays(pairs, rs, js)
    assert _moved(coded)["jd_skills"] == "array<smallint>"
    assert sorted(map(str, coded.collect())) == want and len(want) == 10


@pytest.mark.parametrize("name", ["ats_report_exact", "skill_missing_fuzzy", "section_summaries", "line_gaps", "skill_gap_long"])
def test_pairs_move_codes(spark, monkeypatch, name):
    """Of a JD no list of strings moves with a pair, and the rows are those of shipped JDs."""
    want = catalog.QUERIES[name](spark, SF_SMALL)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 1 << 20)
    monkeypatch.setattr(sk, "fits", lambda df: False)
    got = catalog.QUERIES[name](spark, SF_SMALL)
    moved = _moved(got)
    assert "array<smallint>" in moved.values()
    assert not any("array<string>" in t or "term:string" in t or "phrase:string" in t for t in moved.values())
    a, b = (df.select(F.xxhash64(*df.columns).alias("h")).groupBy().agg(F.count("h"), F.sum(F.col("h").cast("decimal(38)"))).first() for df in (want, got))
    assert a == b and a[0] > 0


def test_line_gaps_make_no_list_of_rows_a_pair(spark):
    """The rows come out of the lines; a pair has lists a line only if a term is somewhere in its résumé."""
    from rolefit.operators import suggestions as sg
    line = "struct<line_pos:int,line:string,low:string,title_sec:boolean>"
    rows = [(1, [(0, "Red Bolt", "red bolt", True), (2, "x", "x", False)], ["red bolt", "Blue"], ["python"]), (2, [(0, "x", "x", False)], ["Blue"], []),
            (3, [], ["Blue"], []), (4, None, ["Blue"], []), (5, [(1, "a", "a", True), (3, "b", "b", False)], ["q"], ["job title"])]
    df = spark.createDataFrame(rows, f"id int, lines array<{line}>, ms array<string>, mk array<string>")
    df = df.withColumn("low", F.array_join(F.transform("lines", lambda r: r["low"]), "\n"))
    terms = sg.gap_terms_cols(F.col("ms"), F.col("mk"), F.col("low"))
    out = sg.with_line_gaps(df.select("id", "lines", *terms), "lines", ["id"])
    got = {(r.id, r.line_pos, r.line): r.missing_terms for r in out.collect()}
    other = sg.K.TITLE_KEYWORDS
    assert "job title" not in other and "python" not in other
    assert got == {(1, 0, "Red Bolt"): [], (1, 2, "x"): ["red bolt", "Blue", "python"], (2, 0, "x"): ["Blue"],
                   (5, 1, "a"): [], (5, 3, "b"): ["q", "job title"]}
    assert "Generate posexplode" in out._jdf.queryExecution().optimizedPlan().toString()
