"""String similarity ratios (stdlib ``difflib``) as Arrow-batched pandas UDFs.

These are the only Python hot paths, and they run on *distinct* vocabulary
values after native blocking, never per pair.  Semantics follow the public
behaviour of the common fuzzy-matching ratios with the pure-Python backend:
``ratio = round(100 · SequenceMatcher.ratio())``; ``partial_ratio`` slides the
shorter string over the longer at every matching block; ``token_sort_ratio``
compares the sorted word lists after replacing non-word characters by blanks.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

#: Characters that the key drops: the upper half of Latin-1.
DROPPED = "\u0080-\u00ff"
_NON_WORD = re.compile(r"\W")
_DROP = re.compile(f"[{DROPPED}]")


def _similarity(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def ratio(a: str | None, b: str | None) -> int:
    """100 x the share of matched characters, rounded; 0 if a side is missing or empty (equal sides give 100)."""
    if a is None or b is None or not (a and b):
        return 100 if a is not None and a == b else 0
    return 100 if a == b else round(100 * _similarity(a, b))


def partial_ratio(a: str | None, b: str | None) -> int:
    """The best ratio of the shorter string with a window of the longer one.

    Windows are as long as the shorter string and begin where one of the two
    strings' matching blocks puts its start (at the end of the longer string
    they are cut); more than 0.995 counts as equal."""
    if a is None or b is None or not (a and b):
        return ratio(a, b)
    short, long_ = sorted((a, b), key=len)
    blocks = SequenceMatcher(None, short, long_).get_matching_blocks()
    starts = {max(0, in_long - in_short) for in_short, in_long, _ in blocks}
    best = max(_similarity(short, long_[at: at + len(short)]) for at in starts)
    return 100 if best > 0.995 else round(100 * best)


def token_sort_key(s: str | None) -> str:
    """Words in order: without the dropped characters, non-word characters as blanks, lower case."""
    return " ".join(sorted(_NON_WORD.sub(" ", _DROP.sub("", s or "")).lower().split()))


def token_sort_ratio(a: str, b: str) -> int:
    if a is None or b is None:
        return 0
    return ratio(token_sort_key(a), token_sort_key(b))


def token_sort_key_col(c) -> Column:
    """JVM twin of :func:`token_sort_key`."""
    x = F.regexp_replace(F.regexp_replace(c, f"[{DROPPED}]", ""), r"[^\p{L}\p{N}_]", " ")
    words = F.filter(F.split(F.lower(x), " ", -1), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


@pandas_udf(IntegerType())
def partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x, y) for x, y in zip(a, b)], dtype="int32")


@pandas_udf(IntegerType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="int32")
