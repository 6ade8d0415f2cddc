"""Quality rules: cross-document line frequency.

Every line is normalised and hashed.  A host's line is *boilerplate* when more
distinct documents of that host hold it than a limit allows.  Boilerplate is
removed from all documents but one (the holder), so that no content is lost
whole, and a document that is left with too little text is rejected.

Rows with the same host and text are one document here: a thousand exact copies
count once, and all of them get the same verdict.

Defined cases: a null text is an empty text; a null host is a host of its own;
an empty text has no line and no words and fails the base rules; repeated rows
each return a row; an empty table returns no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.llm.shared import written

WHITE_SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class LineLimits:
    """Limits of the operator.

    A line is boilerplate in a host if more than ``min_documents`` documents of
    the host hold it, whatever the host's size.  A short line (fewer than
    ``min_line_words`` words and ``min_line_chars`` characters), which documents may
    share by chance, must also be in more than ``share`` of the host's
    documents, or in more than ``short_enough`` of them.  A document is depleted if
    lines are removed and less than ``min_rest`` of its words remain.  The base rules
    ask for ``min_words`` words and at most ``repeat_percent`` repeated ones."""

    min_documents: int = 20
    share: float = 0.05
    short_enough: int = 200
    min_line_words: int = 3
    min_line_chars: int = 20
    min_words: int = 20
    min_rest: float = 0.3
    repeat_percent: int = 30


def text_measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    raw = text.encode()
    words = raw.split()
    white = len(raw) - len(raw.translate(None, WHITE_SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE_SPACE)]
    return len(words), len(text) - white, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more.

    Windows are compared exactly: words get codes, then codes of neighbours are
    paired and coded again until a code stands for the whole window."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    width, left = 1, window
    whole, whole_width = None, 0
    while left:
        if left & 1:  # windows of any width are put together from powers of two
            if whole is None:
                whole, whole_width = codes, width
            else:
                whole, whole_width = _joined(whole, codes, whole_width), whole_width + width
        left >>= 1
        if left:
            codes, width = _joined(codes, codes, width), 2 * width
    seen = np.bincount(whole)
    again = seen[whole] > 1
    if not again.any():
        return 0
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    cover[at] += 1
    cover[at + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def _joined(left: np.ndarray, right: np.ndarray, gap: int) -> np.ndarray:
    """Codes of the pairs (left[i], right[i + gap])."""
    b = right[gap:]
    a = left[: len(b)]
    return pd.factorize(a * (int(b.max()) + 1) + b)[0].astype(np.int64)


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in texts:
        yield pd.DataFrame([text_measures(t or "") for t in s], columns=list(_MEASURES), dtype="int64")


def normalised_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def line_hash(norm: Column) -> Column:
    return F.xxhash64(norm)


def _keyed(text: str, host: str) -> list[Column]:
    """hk (64 bits of the host) and k (128 bits of the text): they name a document."""
    return [F.xxhash64(F.col(host)).alias("hk"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("k")]


def document_lines(docs: DataFrame, limits: LineLimits, text: str = "text", host: str = "source") -> DataFrame:
    """One row per document and distinct normalised line: hk, k, h1, h2 (128 bits of the line), whether it is
    short, removed words if the line goes."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    every = docs.select(*_keyed(text, host), F.posexplode(lines).alias("pos", "line"))
    every = every.select("hk", "k", "pos", normalised_line(F.col("line")).alias("norm"))
    words = F.size(F.split("norm", " "))
    every = every.filter(F.col("norm") != "")
    short = (words < limits.min_line_words) & (F.length("norm") < limits.min_line_chars)
    every = every.select("hk", "k", "pos", line_hash(F.col("norm")).alias("h1"),
                         F.xxhash64(F.lit("line"), "norm").alias("h2"), words.alias("n"), short.alias("short"))
    # exact copies collapse on the map side, so a hot group of copies is small after it
    once = every.groupBy("hk", "k", "pos").agg(*[F.first(c).alias(c) for c in ("h1", "h2", "n", "short")])
    return once.groupBy("hk", "k", "h1", "h2").agg(F.first("short").alias("short"), F.sum("n").alias("words"))


def boilerplate_lines(docs: DataFrame, lines: DataFrame, limits: LineLimits, text: str = "text", host: str = "source") -> DataFrame:
    """hk, h1, h2 of each line above the limits, with its number of documents and its holder."""
    sizes = docs.select(*_keyed(text, host)).distinct().groupBy("hk").agg(F.count("*").alias("host_documents"))
    counts = lines.groupBy("hk", "h1", "h2").agg(F.count("*").alias("n_documents"), F.min("k").alias("holder"),
                                                   F.first("short").alias("short"))
    counts = counts.filter(F.col("n_documents") > limits.min_documents)
    share = F.least(limits.share * F.col("host_documents"), F.lit(float(limits.short_enough)))
    return (counts.join(sizes, "hk").filter(~F.col("short") | (F.col("n_documents") > share))
            .select("hk", "h1", "h2", "n_documents", "holder"))


def judged(docs: DataFrame, limits: LineLimits = LineLimits(), doc_id: str = "doc_id", text: str = "text",
           host: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row with its measures and verdict.

    Columns: ``doc_id`` and the ``carry`` columns, the five measures, base_failed,
    removed_words, depleted, kept, and clean_text (the text without boilerplate
    lines).  Texts take part in a shuffle only if clean_text is selected."""
    lines = written(document_lines(docs, limits, text, host), "lines")
    heavy = boilerplate_lines(docs, lines, limits, text, host)
    gone = (lines.join(heavy, ["hk", "h1", "h2"]).filter(F.col("k") != F.col("holder"))
            .groupBy("hk", "k").agg(F.sum("words").alias("gone_words"), F.collect_list("h1").alias("gone_lines")))
    t = F.coalesce(F.col(text), F.lit(""))
    # a filter on the verdict is then not pushed below the call, which would make it twice
    measure = F.pandas_udf(_measure, ", ".join(f"{c} long" for c in _MEASURES)).asNondeterministic()
    base = docs.select(F.struct(doc_id, *carry).alias("own"), t.alias("whole"), *_keyed(text, host),
                       measure(t).alias("m"))
    j = base.join(gone, ["hk", "k"], "left")
    removed = F.coalesce("gone_words", F.lit(0).cast("long"))
    rest = F.col("m.n_words") - removed
    failed = (F.col("m.n_words") < limits.min_words) | (100 * F.col("m.n_repeat_words") > limits.repeat_percent * F.col("m.n_words"))
    depleted = (removed > 0) & (rest < limits.min_rest * F.col("m.n_words"))
    stays = F.filter(F.split("whole", "\n"), lambda x: ~F.array_contains(F.col("gone_lines"), line_hash(normalised_line(x))))
    clean = F.when(F.col("gone_lines").isNull(), F.col("whole")).otherwise(F.array_join(stays, "\n"))
    return j.select("own.*", *[F.col(f"m.{c}") for c in _MEASURES], failed.alias("base_failed"),
                    removed.alias("removed_words"), depleted.alias("depleted"), (~failed & ~depleted).alias("kept"),
                    clean.alias("clean_text"))
