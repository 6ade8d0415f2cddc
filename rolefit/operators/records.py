"""Record-explode operators (X1–X6): structured text fields → child tables,
and the chat-template rendering of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit import constants as K
from rolefit.functions.text import col, py_strip

SEP = " - "


def _part(parts: Column, i: int, default: str = "") -> Column:
    return F.when(F.size(parts) > i, F.get(parts, i)).otherwise(F.lit(default))


def _entries(df: DataFrame, id_col: str, field: str, sep: str = "\n") -> DataFrame:
    """Non-blank entries of a text field with their position."""
    e = df.select(id_col, F.posexplode(F.split(col(field), sep, -1)).alias("pos", "entry"))
    return e.filter(py_strip("entry") != "")


def _points(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ";", -1), lambda x: py_strip(x)), lambda x: x != "")


def explode_education(df: DataFrame, id_col: str) -> DataFrame:
    """``Name - Dates - Degree - Detail`` per non-blank line."""
    e = _entries(df, id_col, "education").withColumn("p", F.split("entry", SEP, -1))
    return e.select(id_col, "pos", F.get("p", 0).alias("name"), _part(F.col("p"), 1).alias("dates"),
                    _part(F.col("p"), 2).alias("degree"), _part(F.col("p"), 3).alias("detail"))


def explode_experience(df: DataFrame, id_col: str) -> DataFrame:
    """``Title - Company - Dates - a;b``, one row per achievement (NULL when none)."""
    e = _entries(df, id_col, "experience").withColumn("p", F.split("entry", SEP, -1))
    ach = F.when(F.size("p") > 3, _points(F.get("p", 3))).otherwise(F.array().cast("array<string>"))
    return e.select(id_col, "pos", F.get("p", 0).alias("title"), _part(F.col("p"), 1).alias("company"),
                    _part(F.col("p"), 2).alias("dates"),
                    F.posexplode_outer(ach).alias("ach_pos", "achievement"))


def explode_projects(df: DataFrame, id_col: str) -> DataFrame:
    """Blank-line separated ``Name - Language - Description - Link``."""
    e = _entries(df, id_col, "projects", "\n\n").withColumn("p", F.split("entry", SEP, -1))
    return e.select(id_col, "pos", F.get("p", 0).alias("name"), _part(F.col("p"), 1).alias("language"),
                    _part(F.col("p"), 2).alias("description"),
                    _part(F.col("p"), 3, K.NO_LINK).alias("link"),
                    _part(F.col("p"), 3, K.NO_LINK_HREF).alias("href"))


def explode_certs(df: DataFrame, id_col: str) -> DataFrame:
    """``Name - p;q``, one row per point (NULL when none)."""
    e = _entries(df, id_col, "certifications").withColumn("p", F.split("entry", SEP, -1))
    pts = F.when(F.size("p") > 1, _points(F.get("p", 1))).otherwise(F.array().cast("array<string>"))
    return e.select(id_col, "pos", F.get("p", 0).alias("name"), F.posexplode_outer(pts).alias("point_pos", "point"))


def default_summary_col(summary, years) -> Column:
    """Default sentence when the summary is empty."""
    return F.when(F.coalesce(col(summary), F.lit("")) == "",
                  F.concat(F.lit(K.DEFAULT_SUMMARY_HEAD), F.coalesce(col(years), F.lit(0)).cast("string"),
                           F.lit(K.DEFAULT_SUMMARY_TAIL))).otherwise(col(summary))


def chat_render(conversations: DataFrame, add_generation_prompt: bool = False) -> DataFrame:
    """One training string per conversation, messages in turn order.

    Each known role renders as ``<|role|>\\n`` + content + eos + ``\\n``;
    other roles render nothing."""
    msgs = conversations.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    piece = F.transform("m", lambda x: F.when(x["role"].isin(*K.CHAT_ROLES), F.concat(
        F.lit("<|"), x["role"], F.lit("|>\n"), F.coalesce(x["text"], F.lit("")), F.lit(K.EOS_TOKEN + "\n")))
        .otherwise(F.lit("")))
    out = F.array_join(piece, "")
    if add_generation_prompt:
        out = F.concat(out, F.when(F.size("m") > 0, F.lit("<|assistant|>\n")).otherwise(F.lit("")))
    return msgs.select("conv_id", out.alias("rendered"))
