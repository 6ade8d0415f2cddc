"""The paths taken beyond each broadcast bound give the same rows."""

import contextlib

from pyspark.sql import functions as F

from rolefit.functions import joins
from rolefit.operators import skills as sk
from rolefit.sources import fixtures as fx
from tests.conftest import SF_SMALL


def _rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


@contextlib.contextmanager
def no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        monkeypatch.undo()


def test_skill_extraction_without_broadcast(spark, monkeypatch):
    db = fx.skill_fx(spark, SF_SMALL)
    r = fx.resume_fx(spark, SF_SMALL)
    a = _rows(sk.extract_skills(r, db, "resume_id"))
    with no_broadcast(spark, monkeypatch):
        b = sk.extract_skills(r, db, "resume_id", forms=joins.materialize(sk.surface_forms(db)))
        assert "BroadcastHashJoin" not in b._jdf.queryExecution().executedPlan().toString()
        assert _rows(b) == a


def test_gap_arrays_with_and_without_jd_broadcast(spark, monkeypatch):
    db = fx.skill_fx(spark, SF_SMALL)
    r, j = fx.resume_fx(spark, SF_SMALL), fx.jd_fx(spark, SF_SMALL)
    rs = sk.skill_sets(r, db, "resume_id", "resume_skills")
    js = sk.skill_sets(j, db, "jd_id", "jd_skills")
    p = fx.pairs_fx(spark, SF_SMALL)
    a = _rows(sk.skill_gap_arrays(p, rs, js))
    with no_broadcast(spark, monkeypatch):
        assert _rows(sk.skill_gap_arrays(p, rs, js)) == a


def test_unique_key_append_hot_key(spark):
    from rolefit.sources.intake import unique_key_append
    batch = spark.range(3000).select(F.col("id"), F.lit("n").alias("name"),
                                     F.when(F.col("id") % 3 == 0, F.lit("hot@x")).otherwise(
                                         F.concat(F.lit("u"), F.col("id").cast("string"))).alias("email"))
    existing = spark.createDataFrame([("u1",)], "email string")
    out = unique_key_append(batch, existing)
    acc = {r.id for r in out.filter("accepted").collect()}
    assert 0 in acc and 3 not in acc and 1 not in acc and 2 in acc
    assert out.count() == 3000
