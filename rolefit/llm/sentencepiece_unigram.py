"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces and their log scores come from a model file.  A text is escaped (a
whitespace marker for each space, and one before the text) and split wherever two
neighbouring characters stand together in no piece.  Every part is segmented by the path of highest score through the
pieces that a walk of the trie finds; a character of no piece costs the unknown
score and becomes byte pieces.  Parts repeat, so each worker remembers theirs.

Decoding joins pieces, turns runs of byte pieces into text (wrong UTF-8 becomes
U+FFFD), markers into spaces, and drops the first one.

Defined cases: a null text is empty and has no piece; a marker in the text itself
decodes to a space, so such a text does not come back; repeated rows return a row
each; an empty table returns no row; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolefit.llm.wordcache import TwoGenerations

MARK = "▁"
#: A character of no piece scores this much less than the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Parts in each of the two generations that a Python worker remembers.
PARTS = 400_000
NORMAL, UNKNOWN, BYTE = 1, 2, 6


# ---- the model file (protocol buffer wire format) ------------------------------
class Piece(NamedTuple):
    text: str
    score: float
    kind: int


def _fields(raw: memoryview) -> Iterator[tuple[int, int, object]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, wire, varint()
            continue
        n = varint() if wire == 2 else 4 if wire == 5 else 8
        yield tag >> 3, wire, raw[at: at + n]
        at += n


def read_pieces(raw: bytes) -> list[Piece]:
    """The pieces of a SentencePiece model, by id."""
    out = []
    for number, _, value in _fields(memoryview(raw)):
        if number == 1:
            piece = {1: b"", 2: np.float32(0), 3: NORMAL}
            for k, wire, v in _fields(value):
                if k in piece:
                    piece[k] = np.frombuffer(v, "<f4")[0] if wire == 5 else v
            out.append(Piece(bytes(piece[1]).decode(), float(piece[2]), int(piece[3])))
    return out


# ---- the double-array trie -------------------------------------------------------
class Trie(NamedTuple):
    """From node s the code c leads to t = base[s] + c if check[t] == s; value[t] is the id of the piece that ends there, or -1.

    Code 0 stands for a character of no piece and leads nowhere.  The arrays reach
    beyond the last node by the largest code, so a step needs no bounds check."""

    base: list[int]
    check: list[int]
    value: list[int]
    code: dict[str, int]


def build_trie(pieces: list[tuple[str, int]]) -> Trie:
    """A double array over characters; pieces: (text, id).  Common characters get low codes, so that it stays short."""
    often = Counter(c for t, _ in pieces for c in t)
    code = {c: i + 1 for i, (c, _) in enumerate(sorted(often.items(), key=lambda x: (-x[1], x[0])))}
    nested: dict = {}
    for text, i in pieces:
        node = nested
        for c in text:
            node = node.setdefault(code[c], {})
        node[0] = i
    reach = len(code) + 2
    used = bytearray(3 * reach)
    base, check, value = {}, {0: -1}, {}  # nothing leads back to the root
    used[0] = 1
    todo = [(0, nested)]
    for s, node in todo:
        if 0 in node:
            value[s] = node[0]
        steps = sorted(c for c in node if c)
        if not steps:
            continue
        at = used.find(0, steps[0] + 1)
        while any(used[at - steps[0] + c] for c in steps[1:]):
            at = used.find(0, at + 1)
        base[s] = b = at - steps[0]
        for c in steps:
            check[b + c] = s
            used[b + c] = 1
        used.extend(bytes(max(0, max(b + steps[-1], at) + 2 * reach - len(used))))
        todo.extend((b + c, node[c]) for c in steps)
    size = max([*check, *base.values()]) + reach
    return Trie([base.get(t, 0) for t in range(size)], [check.get(t, -1) for t in range(size)],
                [value.get(t, -1) for t in range(size)], code)


# ---- encoding and decoding ---------------------------------------------------------
class Unigram:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, pieces: list[Piece]) -> None:
        self.pieces = pieces
        normal = [(p.text, i) for i, p in enumerate(pieces) if p.kind == NORMAL and p.text]
        self.trie = build_trie(normal)
        self.score = [p.score for p in pieces]
        self.unknown = min((pieces[i].score for _, i in normal), default=0.0) - UNKNOWN_PENALTY
        self.unknown_id = next((i for i, p in enumerate(pieces) if p.kind == UNKNOWN), 0)
        self.byte_id = {int(p.text[3:5], 16): i for i, p in enumerate(pieces) if p.kind == BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        #: Neighbouring characters inside some piece: a text can be split wherever its neighbours are none of these.
        self.joins = {t[k: k + 2] for t, _ in normal for k in range(len(t) - 1)}
        spaced = any(MARK in t.lstrip(MARK) for t, _ in normal)
        self.part = re.compile(r".+" if spaced else f"{MARK}*[^{MARK}]+|{MARK}+", re.DOTALL)
        self.gain = [self.score[i] if i >= 0 else float("-inf") for i in self.trie.value]
        self.longest = max((len(t) for t, _ in normal), default=0)
        self.single = {t for t, _ in normal if len(t) == 1}
        self.known = TwoGenerations(self._ids, PARTS)
        self.plain = [p.text.encode() for p in pieces]
        for i, b in self.byte_of.items():
            self.plain[i] = bytes([b])

    def _ids(self, part: str) -> bytes:
        """Ids of a part, which is first cut wherever no piece joins two neighbours."""
        joins = self.joins
        cuts = [k for k, pair in enumerate(map(add, part, part[1:]), 1) if pair not in joins]
        if not cuts:
            return array("I", self.segment(part)).tobytes()
        return b"".join([self.known[part[a:b]] for a, b in zip([0, *cuts], [*cuts, len(part)])])

    def segment(self, text: str) -> list[int]:
        """Ids of the best path through ``text`` (escaped); of equal paths the one whose pieces are found first."""
        base, check, value, code = self.trie
        gain, single, root = self.gain, self.single, base[0]
        n = len(text)
        codes = [code.get(c, 0) for c in text]
        best = [0.0] + [float("-inf")] * n
        back = [(0, -1)] * (n + 1)
        for i in range(n):
            here, step, j = best[i], root, i
            node = 0
            for c in codes[i: i + self.longest]:
                t = step + c
                if check[t] != node:
                    break
                j += 1
                score = here + gain[t]
                if score > best[j]:
                    best[j], back[j] = score, (i, value[t])
                node, step = t, base[t]
            if text[i] not in single and here + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = here + self.unknown, (i, -1)
        out: list[int] = []
        at = n
        while at:
            i, piece = back[at]
            out.extend([piece] if piece >= 0 else self._fallback(text[i:at])[::-1])
            at = i
        return out[::-1]

    def _fallback(self, char: str) -> list[int]:
        return [self.byte_id.get(b, self.unknown_id) for b in char.encode()] if self.byte_id else [self.unknown_id]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        escaped = MARK + text.replace(" ", MARK)
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.part.findall(escaped))), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.plain.__getitem__, ids.tolist())).decode("utf-8", errors="replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_LOADED: dict[int, Unigram] = {}


def _loaded(raw: bytes) -> Unigram:
    """The encoder of a model, built once in a worker."""
    key = zlib.crc32(raw)
    if key not in _LOADED:
        _LOADED[key] = Unigram(read_pieces(raw))
    return _LOADED[key]


def encoded(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32 (little-endian unsigned 32-bit), decoded_equal (decoding returns the text),
    and with_ids: ids.  ``model``: the bytes of a model file (some 0.5 MB; sent with the tasks)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    fields = [own.schema["doc_id"], T.StructField("n_pieces", T.LongType()), T.StructField("n_byte_pieces", T.LongType()),
              T.StructField("ids_crc32", T.LongType()), T.StructField("decoded_equal", T.BooleanType())]
    schema = T.StructType(fields + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))
    arrow = to_arrow_schema(schema)
    sent = own.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(sent.value)
        is_byte = np.zeros(len(coder.pieces) + 1, dtype=bool)
        is_byte[list(coder.byte_of)] = True
        for batch in batches:
            rows, ids = [], []
            for cell in batch.column(1):
                t = cell.as_py()
                x = coder.encode(t)
                rows.append((len(x), int(is_byte[x].sum()), zlib.crc32(x.tobytes()), coder.decode(x) == t))
                if with_ids:
                    ids.append(x.astype(np.int32))
            cols = [batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 4, list(arrow)[1:]))]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, arrow.field("ids").type)] if with_ids else []), schema=arrow)

    return own.mapInArrow(of, schema)
