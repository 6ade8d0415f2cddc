"""Join helpers: broadcast only behind a size in bytes that the planner knows; tables written once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that a side may have in memory to be shipped: the driver holds every broadcast table two or three times.
BROADCAST_BYTES = 32 << 20
#: Bytes of a document table, as planned, that one task of a grouping of its rows takes: at least and at most.
PIECE_BYTES, FULL_PIECE_BYTES = 256 << 10, 4 << 20


def planned_bytes(df: DataFrame) -> int:
    """The planner's size of ``df``: for a written table the bytes of its files; no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def held_bytes(df: DataFrame) -> int:
    """What the rows of ``df`` take in memory, by the length of their JSON texts: strings of arrays are padded to words
    and have an offset each.  The bytes of files say little: a Parquet file holds a repeated string as a few bits."""
    return 3 * (df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0)


def fits(df: DataFrame, max_bytes: int | None = None) -> bool:
    """Whether ``df`` (a written table, or an aggregate of one) may be shipped to every executor: one scan measures it,
    and only if its files are within the bound."""
    most = BROADCAST_BYTES if max_bytes is None else max_bytes
    return planned_bytes(df) <= most and held_bytes(df) <= most


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast if it :func:`fits`; else for a sort-merge join (AQE skew splitting), since the planner by
    itself would broadcast by the bytes of files."""
    return F.broadcast(df) if fits(df, max_bytes) else unshipped(df)


def unshipped(df: DataFrame) -> DataFrame:
    """``df`` as a side that is never shipped.  Without a hint the planner ships by the bytes of files, and AQE by those of
    compressed shuffle blocks, both many times smaller than the rows that the driver then holds."""
    return df.hint("merge")


def texts_fit(texts: DataFrame, text: str = "text", max_bytes: int | None = None) -> bool:
    """Whether features of the documents ``texts`` (a row a document, in proportion to its text) may be shipped: the texts
    have at most a sixteenth of the bound, which one scan of their lengths measures (a phrase of ten bytes takes 32 in an
    array, and there are several arrays)."""
    most = (BROADCAST_BYTES if max_bytes is None else max_bytes) // 16
    return (texts.agg(F.sum(F.octet_length(text))).first()[0] or 0) <= most


def pair_rows(pairs: DataFrame, resumes: DataFrame, jds: DataFrame, small: bool, how: str = "left") -> DataFrame:
    """The pairs with the columns of both documents (``resume_id``, ``jd_id``).

    ``small`` JDs are broadcast to the pairs that have met their résumés.  Else the narrow pairs meet the JDs first:
    what a query needs of a JD is the smaller side, and only that moves with the pairs to the résumés.  Those are a row a
    résumé and are held as a hash table, so that the wide pair rows are not sorted or spilled."""
    if small:
        return pairs.join(unshipped(resumes), "resume_id", how).join(F.broadcast(jds), "jd_id", how)
    return pairs.join(unshipped(jds), "jd_id", how).join(resumes.hint("shuffle_hash"), "resume_id", how)


def pieces(docs: DataFrame) -> int:
    """Partitions for rows made of ``docs``: by their planned bytes, so that a task's rows grow with neither the table nor
    their compression in the shuffle, by which AQE would join partitions."""
    n, held = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), planned_bytes(docs)
    if held >= 1 << 50:  # no size is known
        return n
    return max(min(n, held // PIECE_BYTES + 1), held // FULL_PIECE_BYTES)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet into the shared folder named by ``spark.checkpoint.dir`` and read again.

    It cuts the lineage (a lost executor costs only tasks of later jobs), keeps
    column pruning, and gives the planner the table's size."""
    from rolefit.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/rolefit-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one key that meet in one cell of :func:`cell_join` on either side.
CELL = 4_096


def cells(left: DataFrame, right: DataFrame, key: str, cell: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cell (``_x``, ``_y``) in which their rows meet those of the other side.

    A key with l and r rows has ceil(l / cell) x ceil(r / cell) cells: a left row belongs to one _x
    and goes to all _y, a right row belongs to one _y and goes to all _x.  The sizes of keys
    with more rows than a cell are few (rows / cell at most)."""
    sizes = (left.groupBy(key).agg(F.count(F.lit(1)).alias("_l")).join(unshipped(right.groupBy(key).agg(F.count(F.lit(1)).alias("_r"))), key)
             .filter((F.col("_l") > cell) | (F.col("_r") > cell)))
    sizes = broadcast_if_small(materialize(sizes.select(key, *[F.ceil(F.col(c) / cell).cast("int").alias(c) for c in ("_l", "_r")]), "cells"))

    def dealt(side: DataFrame, own: str, place: str, other: str, all_of: str) -> DataFrame:
        rows = side.join(sizes, key, "left")
        mine = F.pmod(F.xxhash64(*side.columns), F.coalesce(own, F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return rows.select(*side.columns, mine.alias(place), every.alias(all_of))

    return dealt(left, "_l", "_x", "_r", "_y"), dealt(right, "_r", "_y", "_l", "_x")


def cell_join(left: DataFrame, right: DataFrame, key: str, cell: int | None = None) -> DataFrame:
    """Equi-join on ``key`` of sides with otherwise different columns; the rows of a frequent key meet in
    many cells of bounded size instead of one task."""
    a, b = cells(left, right, key, cell or CELL)
    return a.join(unshipped(b), [key, "_x", "_y"]).drop("_x", "_y")
