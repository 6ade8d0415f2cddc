"""The intake stream scores every résumé once, however often and late it lands; the sink's repeated batches."""

import json
import os
import time

from pyspark.sql import functions as F

from rolefit.plans import report as rp
from rolefit.plans.catalog import EXACT, _dictionary, _report
from rolefit.sources import fixtures as fx
from rolefit.streaming.intake import start_intake
from tests.conftest import SF_SMALL


def _land(inbox, name, rows, age_days=0):
    path = f"{inbox}/{name}.json"
    with open(path + ".part", "w") as f:
        f.writelines(json.dumps({"resume_id": r.resume_id, "text": r.text}) + "\n" for r in rows)
    when = time.time() - age_days * 86_400
    os.utime(path + ".part", (when, when))
    os.rename(path + ".part", path)


def _rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_relanded_and_late_files(spark, tmp_path):
    inbox, sink = f"{tmp_path}/inbox", f"{tmp_path}/sink"
    os.makedirs(inbox)
    resumes, jds = fx.resume_fx(spark, SF_SMALL), fx.jd_fx(spark, SF_SMALL)
    rows = sorted(resumes.select("resume_id", "text").collect())
    ctx = rp.prepare_context(fx.skill_fx(spark, SF_SMALL), jds, "raw", False, _dictionary(spark, SF_SMALL, False))

    def run():
        q = start_intake(spark, inbox, sink, f"{tmp_path}/checkpoint", ctx, fx.pairs_fx(spark, SF_SMALL),
                         fx.layout_chars_fx(spark, SF_SMALL), fx.layout_pages_fx(spark, SF_SMALL), fx.files_fx(spark, SF_SMALL),
                         clean_source="delete", max_files_per_trigger=1, fuzzy_sections=False)
        q.awaitTermination()
        return [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]

    _land(inbox, "a", rows[:40] + rows[:3])  # three of them twice in one file
    _land(inbox, "b", rows[30:70])
    assert len(run()) == 2  # one file a batch
    _land(inbox, "a-again", rows[:40])
    _land(inbox, "late", rows[60:], age_days=400)
    run()
    got = spark.read.parquet(sink).drop("batch_id")
    assert got.groupBy("resume_id", "jd_id").count().filter("count > 1").count() == 0
    want = _report(spark, SF_SMALL, **EXACT)
    assert _rows(got.select(*want.columns)) == _rows(want)
    _land(inbox, "last", rows[:1])
    run()
    assert not {"a.json", "b.json"} & set(os.listdir(inbox))  # cleaned after a later batch


def test_repeated_batches_replace_their_own_partitions(spark, tmp_path):
    path = f"{tmp_path}/table"
    first = spark.range(100).select(F.col("id"), (F.col("id") % 4).alias("part"), F.lit("first").alias("by"))
    rp.write_partitions(first, path, ("part",), "b1")
    again = spark.range(10).select((F.col("id") * 4 + 1).alias("id"), F.lit(1).cast("long").alias("part"), F.lit("again").alias("by"))
    for _ in range(2):
        rp.write_partitions(again, path, ("part",), "b2")
    got = {(r.part, r.by): r["count"] for r in spark.read.parquet(path).groupBy("part", "by").count().collect()}
    assert got == {(0, "first"): 25, (1, "again"): 10, (2, "first"): 25, (3, "first"): 25}
    manifest = {r.part: (r.batch, r.rows) for r in rp.read_manifest(spark, path, ("part",)).collect()}
    assert manifest == {0: ("b1", 25), 1: ("b2", 10), 2: ("b1", 25), 3: ("b1", 25)}
