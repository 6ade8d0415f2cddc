"""Incremental intake.  Résumé files land in an inbox folder; each
micro-batch is scored against the static JD/dictionary context and written
to the sink under its batch id.

Once per résumé: the stream keeps the ids of landed résumés as state.  The event
time of a row is the time of the batch that reads it, so that no file is too late,
however old it is; an id is forgotten ``keep`` after it landed, which bounds the
state.  A résumé that lands again within that time is not scored again.

Exactly-once output: a retried batch overwrites its own folder
(``batch_id=N``), so executor loss or a restart never duplicates rows; the
stream's progress and state live in a checkpoint folder under the cluster's
shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rolefit.plans import report as rp


INBOX_SCHEMA = "resume_id BIGINT, text STRING"
#: How long a landed résumé's id is kept.
KEEP = "30 days"
#: Older files than this are not read: practically all are.
MAX_FILE_AGE = "10000d"


def resume_stream(spark: SparkSession, inbox: str, layout: str = "jsonl", clean_source: str | None = None,
                  max_files_per_trigger: int | None = None, max_file_age: str = MAX_FILE_AGE) -> DataFrame:
    """Stream of (resume_id, text).

    ``layout='jsonl'``: landed files hold JSON lines ``{resume_id, text}``
    (one upload batch per file).  ``layout='text'``: one document per file,
    the id read from a ``resume_id=N`` folder in its path.
    ``clean_source='delete'`` removes processed files (Spark does it after a
    later batch commits).  ``max_file_age``: files that are older than the newest
    by more than this are not read (the source forgets their names then)."""
    if layout == "jsonl":
        r = spark.readStream.format("json").schema(INBOX_SCHEMA)
    else:
        r = spark.readStream.format("text").option("wholetext", True)
    r = r.option("maxFileAge", max_file_age)
    if clean_source:
        r = r.option("cleanSource", clean_source)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if layout == "jsonl":
        return r.load(inbox)
    src = r.load(inbox.rstrip("/") + "/*/")
    return src.select(F.regexp_extract(F.col("_metadata.file_path"), r"resume_id=(\d+)", 1).cast("long")
                      .alias("resume_id"), F.col("value").alias("text"))


def landed_once(resumes: DataFrame, keep: str = KEEP) -> DataFrame:
    """The stream without the résumés whose id has landed before (or twice in a batch: any one of them stays)."""
    seen = resumes.withColumn("landed", F.current_timestamp()).withWatermark("landed", keep)
    return seen.dropDuplicatesWithinWatermark(["resume_id"]).drop("landed")


def start_intake(spark: SparkSession, inbox: str, sink: str, checkpoint: str, ctx: dict, pairs: DataFrame,
                 layout_chars: DataFrame, layout_pages: DataFrame, files: DataFrame,
                 available_now: bool = True, clean_source: str | None = None,
                 layout: str = "jsonl", max_files_per_trigger: int | None = None, keep: str = KEEP,
                 fuzzy_sections: bool = True) -> StreamingQuery:
    """Start the intake stream; with ``available_now`` it processes what is
    in the inbox and stops.  ``max_files_per_trigger`` bounds a batch."""

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        # several branches read the batch: it is written once, and only the new résumés' pairs are looked at
        new = rp.materialize(batch, "batch")
        own_pairs = pairs.join(new.select("resume_id"), "resume_id", "left_semi")
        rep = rp.score_pairs(ctx, own_pairs, new, layout_chars, layout_pages, files, fuzzy_sections)
        rp.write_report(rep, f"{sink.rstrip('/')}/batch_id={batch_id}")

    stream = landed_once(resume_stream(spark, inbox, layout, clean_source, max_files_per_trigger), keep)
    w = stream.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
