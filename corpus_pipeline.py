"""The corpus pipeline: documents -> quality rules -> language ID -> exact dedup -> near-dedup -> packed sequences.

Each stage calls one operator of ``rolefit.llm`` on all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.llm import exact_dedup, language_id, packing, quality_rules, simhash
from rolefit.llm.catalog import END_ID, TOKENIZER, fold
from rolefit.llm.shared import written
from rolefit.sources.tables import read_table

#: Mean window probability below which a text counts as no language of the corpus.
MIN_LANGUAGE_SCORE = 0.35
#: A language model's labels, a SQL oracle for a convolution or a tokenizer: SQL has none of these.
ORACLE_SQL = None
#: The columns of documents; a table may have more, whatever their names.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keeping_other_columns(stage: Stage) -> Stage:
    """The stage on ``COLUMNS`` alone: other columns pass it inside a struct, so that their names can't clash with its own."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        other = [c for c in docs.columns if c not in COLUMNS]
        if not other:
            return stage(spark, docs, sf_dir)
        own = docs.select(*[c for c in docs.columns if c in COLUMNS], F.struct(*other).alias("other_columns"))
        out = stage(spark, own, sf_dir)
        return out.select(*[F.col(c) if c in COLUMNS else F.col("other_columns")[c].alias(c) for c in docs.columns])
    return run


@keeping_other_columns
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines go from the texts that stay."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    kept = quality_rules.judged(docs, carry=rest).filter("kept").withColumn("text", F.col("clean_text"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@keeping_other_columns
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no recognised language go; a missing language is filled in.  It learns from the labelled documents.

    If nothing could be learned (no labelled document outside the fold), documents with a letter stay as they are."""
    model = language_id.fitted(docs.filter(~fold("doc_id", 4, 2)))
    if model.tables is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    out = docs.withColumn("found", language_id.predictor(model)(F.col("text")))
    out = out.filter((F.col("found.lang_pred") != "und") & (F.col("found.score") >= MIN_LANGUAGE_SCORE))
    return out.withColumn("lang", F.coalesce("lang", "found.lang_pred")).select(docs.columns)


@keeping_other_columns
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, also of rows that repeat an id or have none."""
    rest = tuple(c for c in docs.columns if c != "doc_id")
    return exact_dedup.exact_groups(docs, carry=rest).filter("kept").dropDuplicates(["text_sha256"]).select(docs.columns)


@keeping_other_columns
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    groups = simhash.near_groups(docs)
    gone = groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone_id"), "text_key")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("text_key"))
    return docs.join(gone, same, "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 1024 tokens."""
    return packing.packed(docs, public_tokenizers.path(TOKENIZER), END_ID, 1024)


STAGES = [("quality_rules", quality), ("language_id", language), ("exact_dedup", exact), ("simhash_near_dedup", near),
          ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
