"""Best-fit packing by patterns: non-negative least squares over few-document patterns.

Documents are tokenised once, long ones are cut into pieces, and the pieces'
lengths are counted.  The histogram has at most ``capacity`` entries whatever the
corpus is, so the plan is made from it alone: every pattern of up to three
lengths that fills a sequence is enumerated, repeat counts are fitted to the
histogram by non-negative least squares, rounded within the counts, and the rest
is packed best-fit, longest first, still count by count.

Each length's pieces are then numbered (over salted groups, so that one length
may hold any share of all pieces), and a piece's number names its pattern, its
sequence and its place.

Defined cases: a null text is empty; every document ends with the end id, so an
empty one is a piece of length 1; repeated rows are packed each; an empty table
returns no row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolefit.llm.shared import written
from rolefit.llm.textbytes import pieces
from rolefit.llm.wordcache import encoder

#: Weight of the residual of lengths below capacity / 4: short pieces left over fill gaps, long ones cost sequences.
SHORT_WEIGHT = 0.1
STEPS = 400


# ---- pieces ---------------------------------------------------------------
def _cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _piece_rows(tokenizer: str, end_id: int, capacity: int, schema: pa.Schema):
    end = np.array([end_id], dtype="<u4").tobytes()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in (part for whole in batches for part in pieces(whole, "text")):
            at, rows = [], []
            for i, ids in enumerate(encode.many([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                for k, (s, n) in enumerate(_cut(len(ids) // 4, capacity)):
                    at.append(i)
                    rows.append((k, s, n, zlib.crc32(ids[4 * s: 4 * (s + n)])))
            cols = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:]))],
                schema=schema)
    return of


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    from pyspark.sql.pandas.types import to_arrow_schema
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("doc_id", own.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
                           *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    return own.mapInArrow(_piece_rows(tokenizer, end_id, capacity, to_arrow_schema(schema)), schema)


# ---- the plan, from the histogram -----------------------------------------
class Plan(NamedTuple):
    """Slots sorted by (length, first): pieces number first.. of that length go to sequence.. at offset."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def few_document_patterns(capacity: int) -> np.ndarray:
    """Every way to fill ``capacity`` with one, two or three lengths (rows a >= b >= c, zeros for none)."""
    out = [np.array([[capacity, 0, 0]])]
    for c in range(0, capacity // 3 + 1):
        b = np.arange(max(c, 1), (capacity - c) // 2 + 1)
        out.append(np.stack([capacity - c - b, b, np.full_like(b, c)], axis=1))
    return np.concatenate(out)


def fitted_repeats(patterns: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Non-negative least squares: x >= 0 with least |weights * (A x - counts)|, A[l, p] the times that p has length l.

    A has three entries a column, so the accelerated projected gradient needs a
    gather and a bincount a step."""
    size = len(counts)
    weight2 = weights**2
    weight2[0] = 0  # the zeros that fill short rows are no length

    def forward(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(patterns[:, k], weights=x, minlength=size) for k in range(3))

    def backward(r: np.ndarray) -> np.ndarray:
        return r[patterns].sum(axis=1)

    v = np.ones(len(patterns))
    for _ in range(20):
        v = backward(weight2 * forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 0.95 / norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(STEPS):
        nxt = np.maximum(0, y - step * backward(weight2 * (forward(y) - counts)))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


def packed_counts(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, number of sequences) that hold ``counts[l]`` pieces of each length l exactly."""
    left = counts.astype(np.int64).copy()
    patterns = few_document_patterns(capacity)
    patterns = patterns[(left[patterns] > 0)[:, 0] & ((left[patterns] > 0) | (patterns == 0)).all(axis=1)]
    out: list[tuple[tuple[int, ...], int]] = []
    if len(patterns):
        weights = np.where(np.arange(capacity + 1) < capacity // 4, SHORT_WEIGHT, 1.0)
        x = fitted_repeats(patterns, left / left.max(), weights) * left.max()
        for p in np.argsort(-x, kind="stable"):
            times = int(x[p] + 0.5)
            if not times:
                break
            lengths = tuple(int(n) for n in patterns[p] if n)
            times = min([times, *(int(left[n]) // lengths.count(n) for n in set(lengths))])
            if times:
                out.append((lengths, times))
                for n in lengths:
                    left[n] -= times
    return out + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: equal sequences are one entry and are filled together."""
    open_by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for n in range(capacity, 0, -1):
        todo = int(left[n])
        while todo:
            gap = min((g for g in open_by_gap if g >= n), default=None)
            if gap is None:
                each = capacity // n
                for per, times in ((each, todo // each), (todo % each, 1)):
                    if per and times:
                        open_by_gap.setdefault(capacity - per * n, []).append(((n,) * per, times))
                break
            lengths, times = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                del open_by_gap[gap]
            take = min(todo, times)
            if take < times:
                open_by_gap.setdefault(gap, []).append((lengths, times - take))
            open_by_gap.setdefault(gap - n, []).append(((*lengths, n), take))
            todo -= take
    return [entry for entries in open_by_gap.values() for entry in entries]


def plan(counts: np.ndarray, capacity: int) -> Plan:
    slots, sequence = [], 0
    numbered = np.zeros(capacity + 1, dtype=np.int64)
    for lengths, times in packed_counts(counts, capacity):
        offset = 0
        for n in lengths:
            slots.append((n, int(numbered[n]), sequence, offset))
            numbered[n] += times
            offset += n
        sequence += times
    slots.sort()
    table = np.array(slots, dtype=np.int64).reshape(-1, 4)
    return Plan(*table.T, sequence)


# ---- placing the pieces ----------------------------------------------------
def numbered_pieces(pieces: DataFrame, salts: int) -> DataFrame:
    """``pieces`` with number: 0, 1, ... within each length, counted in salted groups whose sizes are added up before."""
    order = ["doc_id", "piece", "start", "ids_crc32"]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order))
    rows = salted.withColumn("rank", within).join(bases, ["length", "salt"])
    return rows.select(*pieces.columns, (F.col("base") + F.col("rank") - 1).alias("number"))


def packed(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer, end_id, capacity, doc_id, text), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    made = plan(counts, capacity)
    shift = np.int64(1) << np.int64(44)
    begins = made.length * shift + made.first

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(begins, length.to_numpy() * shift + number.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": made.sequence[at] + number.to_numpy() - made.first[at], "offset": made.offset[at]})

    rows = numbered_pieces(pieces, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    out = rows.withColumn("at", place("length", "number"))
    return out.select(*pieces.columns, "at.sequence_id", "at.offset")
