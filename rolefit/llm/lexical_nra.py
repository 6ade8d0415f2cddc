"""Ranked lexical search by NRA (no random access) over impact-sorted postings.

The queries are read in blocks.  For a block, every document is split into terms
once; the occurrences of the block's terms are written, and the collection's
statistics (documents, terms, documents per term) are added up by Spark.  The
written rows of a partition, in bounded shards, become impact-sorted lists: a
posting's impact is what its term adds to its document's score.

In a shard each query reads its terms' lists from the top, all to the same depth,
which doubles.  A document that was read has a lower bound (the impacts read) and
an upper bound (plus the last impact read of each list in which it has not been
seen); a document not read yet is bounded by the sum of the last impacts.  Reading
ends when no unread document and no document with an open interval can reach the
k-th lower bound: membership, ties and scores are then final.  The k best of a
task's former shards take part in that bound.  The tasks' best are merged by two
ranked windows, salted first.

Work is proportional to documents x queries at most, and nothing else than a
block of queries and its statistics is sent around.

Defined cases: a null or blank text has no term and is no document of the
collection; a null query has no result; repeated rows of either table are each a
document or a query; equal scores rank by ascending id, nulls last; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolefit.llm.shared import written
from rolefit.llm.textbytes import pieces

#: Terms of all queries of a block together (one query at least).
BLOCK_TERMS = 200_000
#: Postings of a shard (one batch at least), and the depth of a query's first read.
SHARD_POSTINGS, FIRST_DEPTH = 3_000_000, 64
SALTS = 32
#: ASCII characters other than letters and digits become spaces, capitals small letters; all other characters belong to terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM_BYTES).split()


class Queries(NamedTuple):
    """A block of queries: ids, numbers, each one's distinct terms by number, and the numbers of the terms (from 1)."""

    ids: list
    first: int
    wanted: list[list[int]]
    vocabulary: dict[bytes, int]


def query_blocks(items: DataFrame, block_terms: int) -> Iterator[Queries]:
    """Items in blocks of at most ``block_terms`` terms, one item at least; partitions come to the driver one by one."""
    block, first, held = Queries([], 0, [], {}), 0, 0
    for row in items.toLocalIterator():
        own = dict.fromkeys(terms(row[1]))
        if block.ids and held + len(own) > block_terms:
            yield block
            first += len(block.ids)
            block, held = Queries([], first, [], {}), 0
        block.ids.append(row[0])
        block.wanted.append([block.vocabulary.setdefault(t, len(block.vocabulary) + 1) for t in own])
        held += len(own)
    if block.ids:
        yield block


# ---- postings ---------------------------------------------------------------------
def postings(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms of the document), terms and tfs (its terms of ``vocabulary``, a broadcast dict); documents with a term."""
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())),
                           T.StructField("tfs", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in batches:
            for part in pieces(batch, "text"):
                at, n, found, tfs = [], [], [], []
                for i, text in enumerate(part.column(1)):
                    own = terms(text.as_py())
                    if own:
                        ids, times = np.unique(np.array(list(filter(None, map(number, own))), np.int32), return_counts=True)
                        at.append(i)
                        n.append(len(own))
                        found.append(ids)
                        tfs.append(times.astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *(
                    pa.array(c, f.type) for c, f in zip((n, found, tfs), list(arrow)[1:]))], schema=arrow)

    return docs.mapInArrow(of, schema)


class Collection(NamedTuple):
    """Statistics: documents, their terms, weight of each term by number."""

    documents: int
    terms: int
    weights: np.ndarray

    def impacts(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a term of this many occurrences adds to the score of a document of ``n`` terms."""
        m = 100 - 90 + (90 * n * self.documents) // self.terms
        return self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def collection(index: DataFrame, size: int) -> Collection:
    """Statistics of written postings; ``size``: terms of the block, which bounds what comes to the driver."""
    whole = index.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    frequency = np.zeros(size + 1, np.int64)
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        frequency[r["term"]] = r["count"]
    weights = np.floor(1000 * np.log((2 * whole["docs"] + 2) / (2 * frequency + 1))).astype(np.int64)
    return Collection(whole["docs"], whole["terms"], weights)


# ---- reading a shard ----------------------------------------------------------------
class Lists(NamedTuple):
    """Impact-sorted lists: the postings of term t are first[t] to first[t + 1]."""

    first: np.ndarray
    doc: np.ndarray
    impact: np.ndarray


def impact_sorted(term: np.ndarray, doc: np.ndarray, impact: np.ndarray, size: int) -> Lists:
    some = impact > 0
    term, doc, impact = term[some], doc[some], impact[some]
    order = np.lexsort((-impact, term))
    return Lists(np.searchsorted(term[order], np.arange(size + 2)), doc[order], impact[order])


def nra(lists: Lists, wanted: list[int], k: int, size: int, former: np.ndarray, depth: int = FIRST_DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Documents (of ``size``) that can be among the k best together with the ``former`` scores, and their final scores.

    All that tie with the k-th are returned."""
    begin, end = lists.first[wanted], lists.first[np.array(wanted, np.int64) + 1]
    begin, end = begin[end > begin], end[end > begin]
    lower = np.zeros(size, np.int64)
    at, read_doc, read_list = begin.copy(), [], []
    while True:
        to = np.minimum(at + depth, end)
        for i in np.flatnonzero(to > at):
            new = slice(at[i], to[i])
            lower[lists.doc[new]] += lists.impact[new]  # a list has a document once
            read_doc.append(lists.doc[new])
            read_list.append(np.full(to[i] - at[i], i))
        at, depth = to, 2 * depth
        last = np.where(at < end, lists.impact[np.maximum(at - 1, 0)], 0) if len(at) else np.zeros(0, np.int64)
        unread = int(last.sum())
        seen = np.flatnonzero(lower)
        scores = np.concatenate([lower[seen], former])
        bar = max(1, int(np.partition(scores, -k)[-k])) if len(scores) >= k else 1
        if unread < bar:
            met = np.zeros(size, np.int64)
            if unread:
                np.add.at(met, np.concatenate(read_doc), last[np.concatenate(read_list)])
            upper = lower[seen] + (unread - met[seen] if unread else 0)
            if not ((upper >= bar) & (upper > lower[seen])).any():
                best = seen[lower[seen] >= bar]
                return best, lower[best]


def _ranked(index: DataFrame, queries: Queries, stats: Collection, k: int) -> DataFrame:
    """q, item_id, doc_id, score: the k best documents of each query in each task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    sent = index.sparkSession.sparkContext.broadcast((queries.wanted, stats))
    schema = T.StructType([T.StructField("q", T.LongType()), index.schema["doc_id"], T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(schema)
    size = len(queries.vocabulary)
    order = [("score", "descending"), ("doc_id", "ascending")]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += len(batch.column(2).flatten())
            if count >= SHARD_POSTINGS:
                yield pa.Table.from_batches(held)
                held, count = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, stats = sent.value
        best = [pa.table({"doc_id": pa.array([], arrow.field("doc_id").type), "score": pa.array([], pa.int64())})] * len(wanted)
        for shard in shards(batches):
            shard = shard.combine_chunks()
            ids, n, found, tfs = (shard.column(c).combine_chunks() if shard.num_rows else pa.array([], f.type)
                                  for c, f in zip(range(4), shard.schema))
            doc = np.repeat(np.arange(shard.num_rows), pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64))
            term, tf = found.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
            lists = impact_sorted(term, doc, stats.impacts(term, tf, n.to_numpy()[doc]), size)
            for q, own in enumerate(wanted):
                got, score = nra(lists, own, k, shard.num_rows, best[q].column("score").to_numpy())
                if len(got):
                    both = pa.concat_tables([best[q], pa.table({"doc_id": ids.take(pa.array(got)), "score": pa.array(score, pa.int64())})])
                    best[q] = both.take(pc.sort_indices(both, order)[:k])
        for q, rows in enumerate(best):
            for batch in rows.to_batches():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, queries_first + q), pa.int64()), *batch.columns], schema=arrow)

    queries_first = queries.first
    return index.mapInArrow(of, schema)


def searched(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
             item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of highest score above 0 of every item."""
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    result = None
    for block in query_blocks(asked, block_terms):
        index = written(postings(own, spark.sparkContext.broadcast(block.vocabulary)), "postings")
        stats = collection(index, len(block.vocabulary))
        names = spark.createDataFrame(
            list(zip(range(block.first, block.first + len(block.ids)), block.ids)),
            T.StructType([T.StructField("q", T.LongType()), asked.schema["item_id"]]))
        best = Window.orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        rows = _ranked(index, block, stats, k).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        rows = rows.withColumn("rank", F.row_number().over(best.partitionBy("q", "salt"))).filter(F.col("rank") <= k)
        rows = rows.withColumn("rank", F.row_number().over(best.partitionBy("q"))).filter(F.col("rank") <= k)
        rows = rows.join(names, "q").select("item_id", "rank", "doc_id", "score")
        result = rows if result is None else result.unionByName(rows)
    if result is None:
        result = asked.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(own.schema["doc_id"].dataType).alias("doc_id"),
                                       F.lit(0).cast("long").alias("score"))
    return result
