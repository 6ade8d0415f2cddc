"""Vector operators (V1–V5).

No language model ships with this repository, so the default text encoder is
a sparse term-frequency vector over the tokens of the whole text (lower-cased word
runs and single symbols, as a BERT basic tokenizer splits them).  This is a
deliberate deviation: cosine values are lower than with mean-pooled model
vectors, which is why every threshold is a parameter.  Callers holding real
embeddings hand them to the report, whose two similarities are then those of
:func:`pair_cosines`: Arrow batches of pairs as matrices.

Sparse vectors are ``ARRAY<STRUCT<term STRING, tf BIGINT>>`` sorted by term;
dot products use integer arithmetic, so the cosine is exact and
order-independent: ``dot / sqrt(|a|² · |b|²)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.functions.arrays import run_lengths, sum_shared
from rolefit.functions.joins import broadcast_if_small
from rolefit.functions.text import WORD_OR_SYMBOL, col

def tokens_col(text, max_tokens: int | None = None) -> Column:
    """Tokens of the whole text, or its first ``max_tokens`` if a caller's encoder has such a limit."""
    tokens = F.regexp_extract_all(F.lower(col(text)), F.lit(WORD_OR_SYMBOL), 0)
    return tokens if max_tokens is None else F.slice(tokens, 1, max_tokens)


def tf_vector_col(text, max_tokens: int | None = None) -> Column:
    """V1 (default encoder): sorted (term, tf) of the text's tokens."""
    return run_lengths(F.array_sort(tokens_col(text, max_tokens)))


def _norm2(v: Column) -> Column:
    return F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x["tf"] * x["tf"])


def sparse_dot_col(a: Column, b: Column, kind: str = "string") -> Column:
    """Σ a.tf·b.tf over shared terms (of type ``kind``): one sorted merge of the two vectors."""
    tagged = F.array_sort(F.concat(
        F.transform(a, lambda x: F.struct(x["term"].alias("term"), F.lit(0).alias("side"), x["tf"].alias("tf"))),
        F.transform(b, lambda x: F.struct(x["term"].alias("term"), F.lit(1).alias("side"), x["tf"].alias("tf")))))
    acc0 = F.struct(F.lit(None).cast(kind).alias("t"), F.lit(1).alias("side"),
                    F.lit(0).cast("long").alias("tf"), F.lit(0).cast("long").alias("s"))

    def step(acc, x):
        add = F.when((x["side"] == 1) & (acc["side"] == 0) & (acc["t"] == x["term"]),
                     acc["tf"] * x["tf"]).otherwise(F.lit(0).cast("long"))
        return F.struct(x["term"].alias("t"), x["side"].alias("side"), x["tf"].alias("tf"),
                        (acc["s"] + add).alias("s"))

    return F.aggregate(tagged, acc0, step)["s"]


def sparse_cosine_col(a: Column, b: Column) -> Column:
    """V3 on sparse vectors; a zero vector gives 0."""
    na, nb = _norm2(a), _norm2(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(
        sparse_dot_col(a, b).cast("double") / F.sqrt((na * nb).cast("double")))


def dense_cosine_col(a: Column, b: Column) -> Column:
    """V3 on dense vectors (sequential sums); a zero vector gives 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                      F.lit(0.0), lambda s, v: s + v)
    na = F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    nb = F.aggregate(b, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot / (F.sqrt(na) * F.sqrt(nb)))


def cosine_rows(a: pa.Array, b: pa.Array) -> np.ndarray:
    """V3 of two Arrow list columns, row by row; 0 for a missing or zero vector, and for vectors of different lengths."""
    out = np.zeros(len(a))
    n, m = (np.where(x.is_valid(), np.diff(x.offsets.to_numpy()), -1) for x in (a, b))
    for size in np.unique(n[(n == m) & (n > 0)]).tolist():  # one size as a rule: two matrices
        rows = np.flatnonzero((n == size) & (m == size))
        x, y = (c.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size) for c in (a, b))
        norm = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))
        out[rows] = np.divide((x * y).sum(axis=1), norm, out=np.zeros(len(rows)), where=norm > 0)
    return out


def pair_cosines(pairs: DataFrame, resume_vectors: DataFrame, jd_vectors: DataFrame) -> DataFrame:
    """V4 and V5 on given vectors: (resume_id, jd_id, role_sim, title_cos).

    resume_vectors: resume_id, head; jd_vectors: jd_id, head, title (arrays of numbers).  The pairs move once, with the
    résumé's vector; the JD side is broadcast if its bytes allow it.  A missing vector gives 0."""
    from pyspark.sql.pandas.types import to_arrow_schema
    arrays = "array<float>"
    r = resume_vectors.select("resume_id", F.col("head").cast(arrays).alias("r_head"))
    j = jd_vectors.select("jd_id", F.col("head").cast(arrays).alias("j_head"), F.col("title").cast(arrays).alias("j_title"))
    x = pairs.select("resume_id", "jd_id").join(r, "resume_id", "left").join(broadcast_if_small(j), "jd_id", "left")
    x = x.select("resume_id", "jd_id", "r_head", "j_head", "j_title")
    out = x.select("resume_id", "jd_id", F.lit(0.0).alias("role_sim"), F.lit(0.0).alias("title_cos")).schema
    arrow = to_arrow_schema(out)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, role, title = batch.columns[2:]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cosine_rows(head, role)), pa.array(cosine_rows(head, title))], schema=arrow)

    return x.mapInArrow(of, out)


def centroids(vectors: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """V2: element-wise mean of the vectors of each key (grouped aggregate over
    (key, position); no vector set is collected in one place)."""
    e = vectors.select(key, F.posexplode(vec).alias("pos", "x"))
    m = e.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return (m.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_c"))
            .select(key, F.transform("_c", lambda s: s["x"]).alias("centroid")))


# ---------------------------------------------------------------------------
# Split layout for pair work: per document, the terms, the repeated ones with
# their further occurrences, and the squared norm are stored once; per pair a
# hash intersection counts the shared terms, and only repeated terms are walked.
# ---------------------------------------------------------------------------
def split_vector_cols(vec: Column, prefix: str) -> list[Column]:
    return [F.transform(vec, lambda x: x["term"]).alias(prefix + "_terms"),
            F.transform(F.filter(vec, lambda x: x["tf"] > 1), lambda x: F.struct(x["term"].alias("term"), (x["tf"] - 1).alias("tf")))
            .alias(prefix + "_more"),
            F.transform(F.filter(vec, lambda x: x["tf"] > 1), lambda x: x["term"]).alias(prefix + "_often"),
            _norm2(vec).alias(prefix + "_n2")]


def split_cosine_col(a: str, b: str, kind: str = "string") -> Column:
    """Cosine of two split vectors (columns ``{a,b}_terms/_more/_often/_n2``); equal to
    :func:`sparse_cosine_col` on the same vectors.  ``kind``: type of the terms.

    With counts 1 + x and 1 + y, the products of the shared terms add up to their number, the x, the y and the xy.  Repeated
    terms are walked only if the other vector has one of them, which a hash probe tells."""
    at, am, an = F.col(a + "_terms"), F.col(a + "_more"), F.col(a + "_n2")
    bt, bm, bn = F.col(b + "_terms"), F.col(b + "_more"), F.col(b + "_n2")
    ao, bo = F.col(a + "_often"), F.col(b + "_often")

    def if_met(x, y, products):
        return F.when(F.arrays_overlap(x, y), products).otherwise(F.lit(0).cast("long"))

    dot = (F.size(F.array_intersect(at, bt)) + if_met(ao, bt, sum_shared(am, bt, "term", "tf"))
           + if_met(bo, at, sum_shared(bm, at, "term", "tf")) + if_met(ao, bo, sparse_dot_col(am, bm, kind)))
    zero = F.coalesce(an, F.lit(0)) * F.coalesce(bn, F.lit(0)) == 0
    return (F.when(zero, F.lit(0.0)).otherwise(dot.cast("double") / F.sqrt((an * bn).cast("double"))))
