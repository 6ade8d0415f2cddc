"""Token counts by the whole-token shortcut.

A text is cut into pre-tokens that the tokenizer encodes independently of their
neighbours.  Which vocabulary strings encode alone as one token is proved before
any text is read, by encoding every one of them; a pre-token that is such a
string counts one without being merged.  Only the rest is merged by the
tokenizer's library, each distinct pre-token once per batch, and remembered.

Pre-tokens.  SentencePiece model: a text is cut at each space that follows another
character than a space, which is exact as long as no piece has a space after
another character (checked); the space itself is the mark that the library puts
before a text.  ``tokenizers`` file: the file's own normalizer and pre-tokenizer.
A text that holds an added token's string goes through the library as a whole.

Defined cases: a null text is empty and has no token; a text of any length is
counted whole; repeated rows each return a row; an empty table returns no row;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolefit.llm.sentencepiece_unigram import MARK, _fields, read_pieces
from rolefit.llm.textbytes import pieces, utf8

#: Pre-tokens that a Python worker remembers beside the whole tokens, and the longest of them.
REMEMBERED, LONGEST = 400_000, 64


class PreTokenCounts:
    """Numbers of tokens of texts, from a cut into pre-tokens and a library call for those that are no whole token.

    ``whole``: strings that are proved to be one token; ``merge``: numbers of tokens of a list of pre-tokens."""

    def __init__(self, cut: Callable[[str], list[str]], whole: Iterable[str], merge: Callable[[list[str]], Iterable[int]]) -> None:
        self.cut, self.merge = cut, merge
        self.whole = dict.fromkeys(whole, 1)
        self.known = dict(self.whole)

    def __call__(self, texts: list[str]) -> list[int]:
        if len(self.known) > len(self.whole) + REMEMBERED:
            self.known = dict(self.whole)
        parts = [self.cut(t) for t in texts]
        rest = list(set().union(*parts).difference(self.known))
        self.known.update(zip(rest, self.merge(rest)))
        out = [sum(map(self.known.__getitem__, p)) for p in parts]
        for p in rest:
            if len(p) > LONGEST:
                del self.known[p]
        return out


# ---- SentencePiece models -------------------------------------------------------
#: A space after another character than a space, and not at the end of the text.
_SPACE = re.compile(f"(?<=[^ {MARK}]) (?=[^{MARK}])", re.DOTALL)


def space_parts(text: str) -> list[str]:
    """Pre-tokens without the space that stands before each of them."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return _SPACE.split(text)
    return text.split(" ")


def _plain_normalizer(raw: bytes) -> bool:
    """Whether texts reach the pieces as they are, with one mark before each (normalizer: field 3 of the model file)."""
    spec = {n: v if isinstance(v, int) else bytes(v) for number, _, value in _fields(memoryview(raw)) if number == 3
            for n, _, v in _fields(value)}
    return spec.get(1) == b"identity" and not spec.get(2) and spec.get(3, 1) == 1 and spec.get(4, 1) == 0


def proved_whole(path: str) -> list[str]:
    """Pre-tokens of a SentencePiece model that encode alone as one token."""
    from sentencepiece import SentencePieceProcessor
    with open(path, "rb") as f:
        raw = f.read()
    all_pieces = read_pieces(raw)
    if not _plain_normalizer(raw) or any(MARK in p.text.lstrip(MARK) for p in all_pieces):
        raise ValueError("this model's texts can't be cut at spaces")
    marked = [(p.text[1:].replace(MARK, " "), i) for i, p in enumerate(all_pieces) if p.text.startswith(MARK) and len(p.text) > 1]
    model = SentencePieceProcessor(model_file=path)
    return [s for (s, i), ids in zip(marked, model.encode([s for s, _ in marked], num_threads=1)) if ids == [i]]


def _of_model(path: str) -> PreTokenCounts:
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=path)
    return PreTokenCounts(space_parts, proved_whole(path), lambda rest: map(len, model.encode(rest, num_threads=1)))


# ---- tokenizers files -----------------------------------------------------------
def _of_json(path: str) -> Callable[[list[str]], list[int]]:
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    normalise = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
    split, merge = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None) or ""
    strings = {s for v in tokenizer.get_vocab(with_added_tokens=False) for s in (v, v.removesuffix(suffix)) if s}
    counts = PreTokenCounts(lambda t: [w for w, _ in split(normalise(t))], [s for s in strings if len(merge(s)) == 1],
                            lambda rest: [len(merge(w)) for w in rest])

    def of(texts: list[str]) -> list[int]:
        special = [any(a in t for a in added) for t in texts]
        out = counts(["" if s else t for t, s in zip(texts, special)])
        return [len(tokenizer.encode(t, add_special_tokens=False).ids) if s else n for t, s, n in zip(texts, special, out)]

    return of


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Numbers of tokens of a list of texts, for a ``.model`` or ``.json`` file."""
    return _of_model(path) if path.endswith(".model") else _of_json(path)


# ---- the operator ---------------------------------------------------------------
def counted(docs: DataFrame, tokenizer: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens) of every text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([own.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("over_limit", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            for part in pieces(batch, "text"):
                _, offsets = utf8(part.column(1))
                n = pa.array(count([t or "" for t in part.column(1).to_pylist()]), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(offsets[1:] - offsets[:-1], pa.int64()), n,
                                                  pc.greater(n, limit)], schema=arrow)

    return own.mapInArrow(of, schema)
