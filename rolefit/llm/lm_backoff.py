"""LM scoring with a weighted backoff automaton.

The model is an n-gram model of words with Dirichlet smoothing: with context h
and its shorter context h', p(w|h) = (c(hw) + m p(w|h')) / (c(h) + m), down to
the add-one-half unigram.  As an automaton: every seen n-gram below the order is
a state; a seen n-gram hw is an arc from h with weight log10 p(w|h); the failure
arc of h leads to h' with weight log10 m/(c(h)+m); the empty context has an arc
for every word.  A text starts in the state of the text start and ends with an
end token.

The counts of a large corpus fit no single machine, and no text needs more than
its own n-grams of them.  So texts are dealt into blocks of bounded size, and

1. each block sends its distinct n-grams (64-bit keys, sorted, packed by key
   range) with their counts in its training texts,
2. each key range adds the counts up and answers every block, key by key,
3. each block builds the part of the automaton that its texts can reach and runs
   it over them: all texts advance together, one word a step, left to right,
   each carrying its state and its sum.

Nothing is pruned or capped; hot n-grams arrive once per block.

Defined cases: a null or empty text is the end token alone; a null id counts as
training text (its remainder is null); repeated rows count each; an empty table
returns no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolefit.llm.shared import written
from rolefit.llm.textbytes import mix, word_hashes, words

START = np.uint64(0x5374617274000001)
END = np.uint64(0x456E640000000001)
BLOCK_BYTES = 8 << 20


# ---- n-grams of a block ----------------------------------------------------
class Grams(NamedTuple):
    """Start, words and end of every text, one after the other; for each order n >= 1 (index n-1):
    the block's sorted distinct keys, each position's index among them (-1: none ends there), and of each key
    the last position."""

    keys: list[np.ndarray]
    index: list[np.ndarray]
    at: list[np.ndarray]
    first: np.ndarray  # position of each text's start
    row: np.ndarray  # text of each position


def grams(texts: pa.Array, order: int) -> Grams:
    w = words(texts, lower=True)
    sizes = np.diff(w.bounds) + 2
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    total = int(sizes.sum())
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    token = np.empty(total, np.uint64)
    is_word = np.ones(total, dtype=bool)
    is_word[first] = is_word[first + sizes - 1] = False
    token[is_word] = word_hashes(w)
    token[first], token[first + sizes - 1] = START, END
    place = np.arange(total) - first[row] if total else np.zeros(0, np.int64)
    keys, index, at = [], [], []
    gram = token
    for n in range(1, order + 1):
        if n > 1:  # the gram before, and this token
            gram = np.concatenate([gram[:1], mix(gram[:-1] * np.uint64(2 * n + 1) + token[1:])])
        fits = np.flatnonzero(place >= n - 1)
        found, back = np.unique(gram[fits], return_inverse=True)
        idx = np.full(total, -1, np.int32)
        idx[fits] = back
        last = np.zeros(len(found), np.int32)
        last[back] = fits
        keys.append(found)
        index.append(idx)
        at.append(last)
    return Grams(keys, index, at, first, row)


# ---- packing of keys and counts ---------------------------------------------
def _planes(x: np.ndarray) -> bytes:
    """The bytes of fixed-width integers, all lowest bytes first: equal high bytes then compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack_keys(x: np.ndarray) -> bytes:
    return _planes(np.diff(x, prepend=np.uint64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(raw, "<u8"))


def pack_counts(x: np.ndarray) -> bytes:
    return _planes(x.astype("<u8"))


def unpack_counts(raw: bytes) -> np.ndarray:
    return _unplanes(raw, "<u8").astype(np.int64)


def _range_ends(ranges: int) -> np.ndarray:
    """Lowest key of each range but the first."""
    return np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)


# ---- the three steps ---------------------------------------------------------
ASK = "block int, part int, keys binary, counts binary"
REPLY = "block int, part int, totals binary, tokens long, types long"


def _ask(order: int, ranges: int):
    ends = _range_ends(ranges)

    def of(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        g = grams(table.column("text").combine_chunks(), order)
        train = ~table.column("held_out").to_numpy().astype(bool)
        out = []
        for n in range(order):
            fits = g.index[n] >= 0
            counts = np.bincount(g.index[n][fits], weights=train[g.row[fits]], minlength=len(g.keys[n]))
            cut = [0, *np.searchsorted(g.keys[n], ends).tolist(), len(g.keys[n])]
            for r, (i, j) in enumerate(zip(cut, cut[1:])):
                if j > i:
                    out.append((block, n * ranges + r, pack_keys(g.keys[n][i:j]), pack_counts(counts[i:j])))
        block, part, keys, counts = zip(*out)
        return pa.table({"block": pa.array(block, pa.int32()), "part": pa.array(part, pa.int32()),
                         "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})
    return of


def _answer(ranges: int):
    def of(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        asked = [unpack_keys(x.as_py()) for x in table.column("keys")]
        key, back = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.concatenate([unpack_counts(x.as_py()) for x in table.column("counts")])
        total = np.bincount(back, weights=counts, minlength=len(key)).astype(np.int64)
        cut = np.cumsum([len(x) for x in asked])[:-1]
        replies = [pack_counts(total[b]) for b in np.split(back, cut)]
        words = total[key != START] if part < ranges else total[:0]
        tokens, types = [0] * len(asked), [0] * len(asked)
        tokens[0], types[0] = int(words.sum()), int((words > 0).sum())
        return pa.table({"block": table.column("block"), "part": table.column("part"), "totals": pa.array(replies, pa.binary()),
                         "tokens": pa.array(tokens, pa.int64()), "types": pa.array(types, pa.int64())})
    return of


class Automaton(NamedTuple):
    """By order n (index n-1): log10 weight of the arc into each n-gram (nan: unseen), and log10 weight of the
    failure arc that leaves it as a state."""

    arc: list[np.ndarray]
    fail: list[np.ndarray]


def automaton(g: Grams, totals: list[np.ndarray], tokens: int, types: int, strength: float) -> Automaton:
    p = (totals[0] + 0.5) / (tokens + 0.5 * (types + 1))
    arc, fail = [np.log10(p)], []
    for n in range(1, len(totals)):
        context = g.index[n - 1][g.at[n] - 1]  # of each n+1-gram: its context, and the n-gram that it ends with
        seen = totals[n - 1]
        fail.append(np.log10(strength / (seen + strength)))
        shorter = p[g.index[n - 1][g.at[n]]]
        p = (totals[n] + strength * shorter) / (seen[context] + strength)
        arc.append(np.where(totals[n] > 0, np.log10(p), np.nan))
    return Automaton(arc, fail)


def traverse(g: Grams, a: Automaton, totals: list[np.ndarray]) -> np.ndarray:
    """The log10 probability of every text: all texts advance by one token a step.

    A state is (number of context words, last position): its n-gram.  While the state has no arc for the token, the
    failure arc is taken; then the arc, and its n-gram's longest seen suffix below the order is the next state."""
    order = len(a.arc)
    size = np.diff(np.append(g.first, len(g.row)))
    by_size = np.argsort(-size, kind="stable")
    at, rest = g.first[by_size], size[by_size]
    total = np.zeros(len(at))
    depth = np.full(len(at), min(1, order - 1))
    if order > 1:  # no training text: the start is no state
        depth[totals[0][g.index[0][at]] == 0] = 0
    alive = np.searchsorted(-rest, -np.arange(1, rest[0] if len(rest) else 1), side="left")
    for step, n in enumerate(alive, start=1):
        here = at[:n] + step
        d, gain = depth[:n].copy(), np.zeros(n)
        todo = np.arange(n)
        for k in range(order - 1, -1, -1):
            on = todo[d[todo] == k]
            gram = g.index[k][here[on]]
            weight = a.arc[k][gram]
            if k:
                stuck = np.isnan(weight)
                state = g.index[k - 1][here[on] - 1]
                gain[on[stuck]] += a.fail[k - 1][state[stuck]]
                d[on[stuck]] = k - 1
                on, weight = on[~stuck], weight[~stuck]
            gain[on] += weight
        total[:n] += gain
        reached = np.minimum(d + 1, order - 1)
        if order > 1:
            unseen = (d == 0) & (totals[0][g.index[0][here]] == 0)
            reached[unseen] = 0
        depth[:n] = reached
    out = np.empty(len(total))
    out[by_size] = total
    return out


def _score(order: int, strength: float, tokens: int, types: int, schema: pa.Schema):
    def of(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        g = grams(docs.column("text").combine_chunks(), order)
        by_part = sorted(zip(replies.column("part").to_pylist(), replies.column("totals").to_pylist()))
        flat = np.concatenate([unpack_counts(x) for _, x in by_part])
        totals = np.split(flat, np.cumsum([len(k) for k in g.keys])[:-1])
        score = traverse(g, automaton(g, totals, tokens, types, strength), totals)
        is_start = np.zeros(len(g.row), dtype=bool)
        is_start[g.first] = True
        count = totals[0][g.index[0]][~is_start]
        row = g.row[~is_start]
        base = np.log10((count + 0.5) / (tokens + 0.5 * (types + 1)))
        n = docs.num_rows
        cols = [docs.column("doc_id").combine_chunks(), docs.column("held_out").combine_chunks(), pa.array(np.bincount(row, minlength=n)),
                pa.array(np.bincount(row, weights=count > 0, minlength=n).astype(np.int64)), pa.array(np.full(n, tokens, np.int64)),
                pa.array(np.bincount(row, weights=base, minlength=n)), pa.array(score)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)
    return of


def scored(docs: DataFrame, held_out: Column, order: int = 2, strength: float = 200.0, doc_id: str = "doc_id", text: str = "text",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``held_out`` tells the rows that the model does not learn from; ``strength`` is m."""
    from pyspark.sql.pandas.types import to_arrow_schema
    t = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(doc_id).alias("doc_id"), t.alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = own.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 1
    blocks = max(1, -(-size // block_bytes))
    own = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    asked = own.groupBy("block").applyInArrow(_ask(order, blocks), ASK)
    replies = written(asked.groupBy("part").applyInArrow(_answer(blocks), REPLY), "ngrams")
    tokens, types = replies.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    schema = T.StructType([own.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
                           *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
                           *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])
    score = _score(order, strength, tokens, types, to_arrow_schema(schema))
    return own.groupBy("block").cogroup(replies.select("block", "part", "totals").groupBy("block")).applyInArrow(score, schema)
