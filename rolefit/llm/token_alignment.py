"""Cross-tokenizer alignment by divide and conquer at shared cuts.

A text is encoded by two tokenizers; both sides' tokens are byte ranges of the
same bytes.  An interval of tokens is cut at a common end of both sides: the one
nearest to its middle, looked up by bisection of the other side's ends.  Both
halves are treated alike; an interval without a common end inside is a group, and
all tokens of its two sides are linked.

A space between a character and a visible one always begins a token of either
side, so a text's first cuts are there.  Each distinct chunk between them is
encoded and divided once in a Python worker's memory; the new chunks of a slice of
texts recurse together, so that one call bisects for all intervals of a level.

Corpus-wide counts without a hot key: the documents of a task form blocks of
bounded size, and a block's distinct id pairs are one row each, with the number of
its documents that link them.  Spark adds these up by pair, marks the pairs with
the highest count of their A id, and joins the counts back to the blocks, where
they meet the documents again (grouped by block, hence bounded).  A pair has at
most one row a block, however common it is.

Defined cases: a null or empty text, and one whose tokens do not give back its
bytes on either side, has no tokens; repeated rows are a document each; texts of
any length are aligned whole; an empty table returns no row; other columns are
ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolefit.llm.sentencepiece_unigram import BYTE, MARK, read_pieces
from rolefit.llm.shared import written
from rolefit.llm.textbytes import pieces
from rolefit.llm.wordcache import byte_level_encode, byte_level_tokens

#: Chunks that a Python worker remembers, bytes of text aligned together (one document at least), (document, pair) entries of
#: a block (one document at least), and links of a group from which on its distinct ids are linked with their numbers of times.
REMEMBERED, SLICE_BYTES, BLOCK_ENTRIES, LARGE_GROUP = 400_000, 2 << 20, 2_000_000, 4096


# ---- cuts and groups ---------------------------------------------------------------
# An interval is a row (a0, a1, b0, b1): tokens a0 to a1 of one side and b0 to b1 of the other, over the same bytes.
def spans(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (``length`` of them) of every row, one after the other."""
    return np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """(tokens of A, tokens of B) before the common end inside each interval that is nearest to A's middle token (the
    former of two equally near); -1 where an interval has none.  Each has two tokens of A at least."""
    inner = parts[:, 1] - 1 - parts[:, 0]
    middle = parts[:, 0] + inner // 2

    def met(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(ends_b, ends_a[i])
        return ends_b[k] == ends_a[i], k

    hit, k = met(middle)
    cut = np.where(hit, [middle + 1, k + 1], -1).T
    rest = np.flatnonzero(~hit & (inner > 1))
    i = spans(parts[rest, 0], inner[rest])
    owner = np.repeat(rest, inner[rest])
    hit, k = met(i)
    i, k, owner = i[hit], k[hit], owner[hit]
    far = i - middle[owner]
    order = np.lexsort((np.where(far < 0, -2 * far, 2 * far + 1), owner))
    nearest = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
    cut[owner[nearest]] = np.stack([i[nearest] + 1, k[nearest] + 1], axis=1)
    return cut


def groups(ends_a: np.ndarray, ends_b: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The finest intervals between common ends of all ``parts``, in order.  Ends rise through all parts."""
    done = [parts[:0]]
    while len(parts):
        divisible = (parts[:, 1] - parts[:, 0] > 1) & (parts[:, 3] - parts[:, 2] > 1)
        done.append(parts[~divisible])
        parts = parts[divisible]
        cut = common_ends(ends_a, ends_b, parts)
        found = cut[:, 0] >= 0
        done.append(parts[~found])
        parts, cut = parts[found], cut[found]
        left, right = parts.copy(), parts.copy()
        left[:, [1, 3]] = cut
        right[:, [0, 2]] = cut
        parts = np.concatenate([left, right])
    out = np.concatenate(done)
    return out[np.argsort(out[:, 0], kind="stable")]


def links(ids_a: np.ndarray, ids_b: np.ndarray, found: np.ndarray, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times): every link of the groups ``found``; large groups by their distinct ids."""
    a0, a1, b0, b1 = found.T
    n = (a1 - a0) * (b1 - b0)
    small = np.flatnonzero(n <= LARGE_GROUP)
    group = np.repeat(small, n[small])
    at = spans(np.zeros(len(small), np.int64), n[small])
    width = (b1 - b0)[group]
    pair = ids_a[a0[group] + at // width] * size_b + ids_b[b0[group] + at % width]
    out = [(group, pair, np.ones(len(pair), np.int64))]
    for g in np.flatnonzero(n > LARGE_GROUP):
        (x, m), (y, k) = (np.unique(i, return_counts=True) for i in (ids_a[a0[g]: a1[g]], ids_b[b0[g]: b1[g]]))
        out.append((np.full(len(x) * len(y), g), (x[:, None] * size_b + y).ravel(), (m[:, None] * k).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out))


# ---- the two tokenizers -----------------------------------------------------------
class Side(NamedTuple):
    """A tokenizer: ids of each text of a list, and the bytes of each id."""

    encode: Callable[[list[str]], list[list[int]]]
    token: list[bytes]


def byte_level_side(path: str) -> Side:
    """A byte-level ``tokenizers`` file; special tokens' strings are plain text."""
    encode = byte_level_encode(path)
    return Side(lambda texts: list(map(encode, texts)), byte_level_tokens(path))


def piece_side(path: str) -> Side:
    """A SentencePiece model, which puts a space before each text."""
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        all_pieces = read_pieces(f.read())
    token = [bytes([int(p.text[3:5], 16)]) if p.kind == BYTE else p.text.replace(MARK, " ").encode() for p in all_pieces]
    return Side(lambda texts: model.encode(texts, num_threads=1), token)


#: A space after another character than a space, before a visible character.
_SPACE = re.compile(f"(?<=[^ {MARK}]) (?=[^\\s᠎{MARK}])")
_MEETS = re.compile(f" [\\s᠎]|{MARK}")


def chunks(text: str) -> list[str]:
    """Parts that both sides encode alone as they do in the text, without the space that stands before each."""
    if not text:
        return []
    if text[0] == " " or text[-1] == " " or _MEETS.search(text):
        return _SPACE.split(text)
    return text.split(" ")


class Aligned(NamedTuple):
    """Documents of a slice: measures per document, and (document, pair, times) sorted by document and pair."""

    measures: np.ndarray  # rows n_a, n_b, n_groups, n_links
    digests: list[str]
    document: np.ndarray
    pair: np.ndarray
    times: np.ndarray


class Tokens:
    """Encodes chunks on one side and tells whether their tokens give back their bytes."""

    def __init__(self, side: Side) -> None:
        self.side = side
        self.length = np.array([len(t) for t in side.token], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(side.token), np.uint8)

    def of(self, texts: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts, number of ids of each, and whether they have the bytes ``raw``."""
        found = self.side.encode(texts)
        n = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int64, int(n.sum()))
        owner = np.repeat(np.arange(len(n)), n)
        want = np.fromiter(map(len, raw), np.int64, len(raw))
        same = np.bincount(owner, weights=self.length[ids], minlength=len(n)).astype(np.int64) == want
        own = ids[same[owner]]
        blob = np.frombuffer(b"".join(raw if same.all() else [r for r, ok in zip(raw, same) if ok]), np.uint8)
        wrong = self.bytes[spans(self.start[own], self.length[own])] != blob
        if wrong.any():
            same[np.repeat(np.flatnonzero(same), want[same])[wrong]] = False
        return ids, n, same


class Aligner:
    """Aligns texts chunk by chunk.  A pair is A's id times the size of B's vocabulary plus B's id."""

    def __init__(self, a: Side, b: Side) -> None:
        self.a, self.b = Tokens(a), Tokens(b)
        # what a token shows in the text of the groups, with what follows it: another one, the other side, another group
        self.shown_a = {c: np.array([f"{i}{c}" for i in range(len(a.token))], object) for c in ",|"}
        self.shown_b = {c: np.array([f"{i}{c}" for i in range(len(b.token))], object) for c in ",;"}
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.shown: list[str] = []
        self.valid = bytearray()
        self.measures = array("q")  # n_a, n_b, n_groups, n_links of each chunk
        self.pairs, self.times, self.first = array("q"), array("q"), array("q", [0])

    def add(self, new: list[str]) -> None:
        """Encode and divide new chunks."""
        spaced = [" " + c for c in new]
        raw = [c.encode() for c in spaced]
        (ids_a, n_a, same_a), (ids_b, n_b, same_b) = self.a.of(spaced, raw), self.b.of(new, raw)
        valid = same_a & same_b
        ids_a, ids_b = ids_a[np.repeat(valid, n_a)], ids_b[np.repeat(valid, n_b)]
        n_a, n_b = n_a * valid, n_b * valid
        whole = np.stack([np.cumsum(n_a) - n_a, np.cumsum(n_a), np.cumsum(n_b) - n_b, np.cumsum(n_b)], axis=1)
        found = groups(np.cumsum(self.a.length[ids_a]), np.cumsum(self.b.length[ids_b]), whole[valid])
        owner = np.searchsorted(whole[:, 1], found[:, 0], side="right")
        group, pair, times = links(ids_a, ids_b, found, len(self.b.length))
        order = np.argsort(group, kind="stable")
        linked = owner[group[order]]
        n_links = np.bincount(linked, weights=times[order], minlength=len(new)).astype(np.int64)
        measures = np.stack([n_a, n_b, np.bincount(owner, minlength=len(new)), n_links], axis=1)
        self.number.update(zip(new, range(len(self.shown), len(self.shown) + len(new))))
        self.shown += self._shown(ids_a, ids_b, found, whole)
        self.valid += valid.astype(np.uint8).tobytes()
        self.first.frombytes((self.first[-1] + np.cumsum(np.bincount(linked, minlength=len(new)))).tobytes())
        for kept, values in ((self.measures, measures), (self.pairs, pair[order]), (self.times, times[order])):
            kept.frombytes(np.ascontiguousarray(values, np.int64).tobytes())

    def _shown(self, ids_a: np.ndarray, ids_b: np.ndarray, found: np.ndarray, whole: np.ndarray) -> list[str]:
        a0, a1, b0, b1 = found.T
        shown = np.empty(len(ids_a) + len(ids_b), object)
        place = np.arange(len(ids_a)) + np.repeat(b0, a1 - a0)
        shown[place] = self.shown_a[","][ids_a]
        shown[place[a1 - 1]] = self.shown_a["|"][ids_a[a1 - 1]]
        place = np.arange(len(ids_b)) + np.repeat(a1, b1 - b0)
        shown[place] = self.shown_b[","][ids_b]
        shown[place[b1 - 1]] = self.shown_b[";"][ids_b[b1 - 1]]
        tokens = shown.tolist()
        first, last = whole[:, 0] + whole[:, 2], whole[:, 1] + whole[:, 3]
        return ["".join(tokens[i:j])[:-1] for i, j in zip(first.tolist(), last.tolist())]

    def __call__(self, texts: list[str]) -> Aligned:
        if len(self.number) > REMEMBERED:
            self.forget()
        parts = [chunks(t) for t in texts]
        new = list(set().union(*parts).difference(self.number))
        if new:
            self.add(new)
        codes = [list(map(self.number.__getitem__, p)) for p in parts]
        size = np.fromiter(map(len, codes), np.int64, len(codes))
        code = np.fromiter(chain.from_iterable(codes), np.int64, int(size.sum()))
        document = np.repeat(np.arange(len(texts)), size)
        whole = np.ones(len(texts), bool)
        whole[document[np.frombuffer(bytes(self.valid), np.uint8)[code] == 0]] = False
        digests = [sha256(";".join(map(self.shown.__getitem__, c)).encode()).hexdigest() if c and ok else ""
                   for c, ok in zip(codes, whole.tolist())]
        # distinct chunks of each document with their number of times, then their links
        code, document = code[whole[document]], document[whole[document]]
        key, often = np.unique(document * len(self.shown) + code, return_counts=True)
        document, code = np.divmod(key, max(1, len(self.shown)))
        measures = np.zeros((len(texts), 4), np.int64)
        for k, of_chunk in enumerate(np.array(self.measures, np.int64).reshape(-1, 4).T):
            measures[:, k] = np.bincount(document, weights=of_chunk[code] * often, minlength=len(texts))
        first = np.array(self.first, np.int64)
        n = first[code + 1] - first[code]
        at = spans(first[code], n)
        pair, times = np.array(self.pairs, np.int64)[at], np.array(self.times, np.int64)[at] * np.repeat(often, n)
        pairs = len(self.a.length) * len(self.b.length)
        key, at = np.unique(np.repeat(document, n) * pairs + pair, return_inverse=True)
        document, pair = np.divmod(key, pairs)
        return Aligned(measures, digests, document, pair, np.bincount(at, weights=times, minlength=len(key)).astype(np.int64))


@lru_cache(maxsize=1)
def aligner(byte_level: str, piece_model: str) -> Aligner:
    return Aligner(byte_level_side(byte_level), piece_side(piece_model))


# ---- the operator -------------------------------------------------------------------
_MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def _packed(place: np.ndarray, times: np.ndarray) -> bytes:
    """Places in the block's pairs (ascending, as differences) and numbers of times, compressed."""
    return pa.compress(np.concatenate([np.diff(place, prepend=0), times]).astype("<i8").tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(pa.decompress(raw, decompressed_size=16 * n, codec="zstd", asbytes=True), "<i8")
    return np.cumsum(values[:n]), values[n:]


def block_rows(docs: DataFrame, byte_level: str, piece_model: str) -> DataFrame:
    """Rows of two kinds, by block: documents with their measures and links, and (doc_id null) the block's
    distinct pairs, ascending, with the number of its documents."""
    from pyspark.sql.pandas.types import to_arrow_schema
    long, longs = T.LongType(), T.ArrayType(T.LongType())
    schema = T.StructType([
        T.StructField("block", long), docs.schema["doc_id"], *(T.StructField(c, long) for c in _MEASURES),
        T.StructField("groups_sha256", T.StringType()), T.StructField("n_pairs", long), T.StructField("links", T.BinaryType()),
        T.StructField("pairs", longs), T.StructField("documents", longs)])
    arrow = to_arrow_schema(schema)

    def block(number: int, held: list[tuple[pa.Array, Aligned]]) -> pa.RecordBatch:
        pairs, place, documents = np.unique(np.concatenate([x.pair for _, x in held]), return_inverse=True, return_counts=True)
        sizes = np.concatenate([np.bincount(x.document, minlength=len(x.digests)) for _, x in held]).astype(np.int64)
        ends = np.cumsum(sizes)
        times = np.concatenate([x.times for _, x in held])
        links = [_packed(place[e - n: e], times[e - n: e]) for e, n in zip(ends.tolist(), sizes.tolist())]
        rows = len(sizes)
        measures = np.concatenate([x.measures for _, x in held])

        def column(values, kind, last=None):
            return pa.concat_arrays([pa.array(values, kind) if not isinstance(values, pa.Array) else values, pa.array([last], kind)])

        ids = pa.concat_arrays([i for i, _ in held])
        cols = [column(np.full(rows, number), pa.int64(), number), column(ids, ids.type), *(column(measures[:, k], pa.int64()) for k in range(4)),
                column([d for _, x in held for d in x.digests], pa.string()), column(sizes, pa.int64()), column(links, pa.binary()),
                column([None] * rows, pa.list_(pa.int64()), pairs), column([None] * rows, pa.list_(pa.int64()), documents)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        align = aligner(byte_level, piece_model)
        held, entries, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch, "text", SLICE_BYTES):
                found = align([t or "" for t in part.column(1).to_pylist()])
                held.append((part.column(0), found))
                entries += len(found.pair)
                if entries >= BLOCK_ENTRIES:
                    yield block(number, held)
                    held, entries, number = [], 0, number + 1
        if held:
            yield block(number, held)

    return docs.mapInArrow(of, schema)


def pair_counts(blocks: DataFrame, size_b: int) -> DataFrame:
    """pair, count (documents that link it), best (the highest count of its A id), of every pair of the corpus."""
    counts = blocks.groupBy("pair").agg(F.sum("n").alias("count"))
    top = F.max("count").over(Window.partitionBy(F.expr(f"pair div {size_b}")))  # as many rows as B has ids at most
    return counts.select("pair", "count", (F.col("count") == top).alias("best"))


def aligned(docs: DataFrame, byte_level: str, piece_model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    from pyspark.sql.pandas.types import to_arrow_schema
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = written(block_rows(own, byte_level, piece_model), "alignment")
    own_pairs = rows.filter(F.col("pairs").isNotNull()).select("block", F.explode(F.arrays_zip("pairs", "documents")).alias("p"))
    own_pairs = own_pairs.select("block", F.col("p.pairs").alias("pair"), F.col("p.documents").alias("n"))
    counts = pair_counts(own_pairs, len(piece_side(piece_model).token))
    known = own_pairs.select("block", "pair").join(counts, "pair")
    found = rows.filter(F.col("pairs").isNull()).drop("pairs", "documents").withColumnRenamed("block", "own_block")
    schema = T.StructType([own.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in (*_MEASURES, "n_best", "count_sum")),
                           T.StructField("groups_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def looked_up(documents: pa.Table, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("pair").to_numpy())
        count = table.column("count").to_numpy()[order]
        best = table.column("best").to_numpy()[order]
        sums = []
        for n, raw in zip(documents.column("n_pairs").to_pylist(), documents.column("links")):
            place, times = _unpacked(raw.as_py(), n) if n else (np.zeros(0, np.int64),) * 2
            sums.append((int(times[best[place]].sum()), int(times @ count[place])))
        added = [pa.array(c, pa.int64()) for c in (zip(*sums) if sums else ((), ()))]
        return pa.Table.from_arrays([documents.column("doc_id"), *map(documents.column, _MEASURES), *added,
                                     documents.column("groups_sha256")], schema=arrow)

    return found.groupBy("own_block").cogroup(known.groupBy("block")).applyInArrow(looked_up, schema)
