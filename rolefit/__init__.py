"""rolefit: résumé ↔ job-description matching as Spark table operators.

Every operator takes DataFrames and returns a DataFrame.  Per-document work
(parsing, skill extraction, phrase counting, date parsing, vectors) runs once
per document; per-pair work runs row-wise on the pair rows after two
key joins, so no per-pair explode or shuffle of (pair × term) rows is needed.
"""

__all__ = ["session", "constants"]
