"""Column helpers that reproduce Python ``str``/``re`` behaviour with JVM functions.

Java regexes treat ``\\w``, ``\\b`` and ``\\s`` as ASCII unless the ``(?U)`` flag is
set; Python treats them as Unicode.  Every pattern here therefore starts with
``(?U)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolefit.constants import DIGIT_ZEROS

U = "(?U)"
# One token per word run or per single non-space, non-word character.
WORD_OR_SYMBOL = U + r"\w+|[^\w\s]"
# Two whitespace-separated words, else one word of four or more characters.
PHRASE = U + r"\b(?:\w+\s+\w+|\w{4,})\b"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: drop leading and trailing Unicode whitespace."""
    return F.regexp_replace(col(c), U + r"^\s+|\s+$", "")


def ws_normalise(c, lower: bool = True) -> Column:
    """``re.sub(r'\\s+', ' ', text.lower()).strip()``."""
    x = F.lower(col(c)) if lower else col(c)
    return py_strip(F.regexp_replace(x, U + r"\s+", " "))


def ascii_digits(c) -> Column:
    """Decimal digits of other scripts as ASCII digits."""
    return F.translate(col(c), "".join(chr(z + i) for z in DIGIT_ZEROS for i in range(10)), "0123456789" * len(DIGIT_ZEROS))


def blank_line_collapse(c) -> Column:
    """``re.sub(r'\\n\\s*\\n+', '\\n', text).strip()``."""
    return py_strip(F.regexp_replace(col(c), U + r"\n\s*\n+", "\n"))


def py_round2(c) -> Column:
    """Python ``round(x, 2)`` (half-even on the exact binary value)."""
    return F.regexp_replace(F.format_number(col(c), 2), ",", "").cast("double")
