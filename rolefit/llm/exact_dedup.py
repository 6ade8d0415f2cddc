"""Exact dedup: group by a 128-bit content hash and compare bytes inside groups.

Two texts are equal when they are identical after deleting the ASCII white-space
characters.  Of equal texts the row with the most code points in the original
text stays, of these the one with the smallest id.

Grouping by (hash, normalised text) makes Spark compare the bytes of texts whose
hashes are equal, so a collision cannot join two classes; copies are combined on
the map side, so a group of any size sends one row per task.  Classes are joined
back to the rows by the hash and the text's SHA-256; texts move once.

Defined cases: a null text is empty; a null id loses against any other; an id
names one document, so rows that repeat an id and a text share their verdict, and
so do the longest rows of a class whose ids are all null (the pipeline's stage
lets one row of them stay); an empty table returns no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE_SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(text, WHITE_SPACE, "")


def md5_128(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 content_hash: Callable[[Column], Column] = md5_128, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and the ``carry`` columns."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(F.col(doc_id).alias("doc_id"), *carry).alias("own"), normalised(t).alias("norm"),
                       F.length(t).cast("long").alias("chars"))
    rows = rows.withColumns({"hash": content_hash(F.col("norm")), "sha": F.sha2("norm", 256)})
    best = F.struct("chars", (-F.col("own.doc_id")).alias("rank"), F.col("own.doc_id").alias("id"))
    classes = (rows.groupBy("hash", "sha", "norm").agg(F.max(best).alias("best"), F.count("*").alias("group_size"))
               .select("hash", "sha", "best", "group_size"))
    j = rows.select("own", "hash", "sha", "chars").join(classes, ["hash", "sha"])
    kept = F.col("own.doc_id").eqNullSafe(F.col("best.id")) & (F.col("chars") == F.col("best.chars"))
    return j.select("own.*", F.col("best.id").alias("keep_id"), "group_size", kept.alias("kept"),
                    F.col("sha").alias("text_sha256"))
