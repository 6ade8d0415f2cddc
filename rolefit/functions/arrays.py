"""Array helpers that keep higher-order functions linear.

Catalyst inlines a projected expression that is referenced once into the
consuming expression, even into a lambda body, where it is then evaluated
once per array element.  Values a lambda needs are therefore either carried
in the accumulator of ``aggregate`` (evaluated once) or staged in their own
projection and *pinned*: referenced a second time outside the lambda, which
keeps CollapseProject from inlining them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pin(expr: Column, *staged: Column) -> Column:
    """``expr`` unchanged; each staged array column gets a reference outside
    any lambda (an always-true size test Catalyst cannot fold away)."""
    cond = None
    for s in staged:
        c = F.coalesce(F.size(s), F.lit(0)) > -2
        cond = c if cond is None else cond & c
    return F.when(cond, expr) if cond is not None else expr


#: Stands between the strings of a packed array; an array with a string that holds it is kept as it is.
_SEP = "\u0000"


def packed(strings: str | Column) -> Column:
    """An array of strings for an exchange: as one text, which has no offset and no padding for each string.  An array with
    a string that is null, empty or holds the separator stays an array (``raw``)."""
    a = F.col(strings) if isinstance(strings, str) else strings
    odd = F.exists(a, lambda s: F.coalesce((s == "") | F.contains(s, F.lit(_SEP)), F.lit(True)))
    return F.struct(F.when(~odd, F.array_join(a, _SEP)).alias("text"), F.when(odd, a).alias("raw"))


def unpacked(p: str | Column) -> Column:
    """The array of :func:`packed` (null: null)."""
    p = F.col(p) if isinstance(p, str) else p
    none = F.array().cast("array<string>")
    return F.coalesce(p["raw"], F.when(p["text"] == "", none).otherwise(F.split(p["text"], _SEP, -1)))


def inline_rows(df: DataFrame, keys: list[str], rows: str | Column, not_null: str) -> DataFrame:
    """The structs of an array that is costly to compute, a row each; ``not_null`` is a field that no row lacks.

    Below a plain ``inline`` or ``explode`` Catalyst infers a filter on the array's size and pushes it down, where the whole
    expression is computed once more, without its staged columns.  The outer form infers nothing."""
    return df.select(*keys, F.inline_outer(rows)).filter(F.col(not_null).isNotNull())


def sum_shared(items: Column, keys: Column, key: str, value: str) -> Column:
    """Σ ``value`` over the structs of ``items`` (distinct by ``key``) whose key is in ``keys``: the intersection
    (hash based) keeps the order of ``items``, so one walk of a pointer picks up the values in linear time."""
    common = F.array_intersect(F.transform(items, lambda x: x[key]), keys)
    # `common` rides in the accumulator: evaluated once, not once per element
    acc0 = F.struct(common.alias("c"), F.lit(0).alias("i"), F.lit(0).cast("long").alias("s"))

    def step(acc, x):
        hit = (acc["i"] < F.size(acc["c"])) & (F.get(acc["c"], acc["i"]) == x[key])
        return F.when(hit, F.struct(acc["c"].alias("c"), (acc["i"] + 1).alias("i"),
                                    (acc["s"] + x[value]).alias("s"))).otherwise(acc)

    return F.when(F.size(items) > 0, F.aggregate(items, acc0, step)["s"]).otherwise(F.lit(0).cast("long"))


def run_lengths(sorted_arr: Column, key: str = "term", count: str = "tf") -> Column:
    """Sorted array → ARRAY<STRUCT<key, count>> of its distinct values and
    their multiplicities, in O(n): boundaries come from a zip with the array
    shifted by one, counts from a zip of the boundary positions with
    themselves shifted by one."""
    n = F.size(sorted_arr)
    prev = F.concat(F.array(F.lit(None).cast("string")), F.slice(sorted_arr, 1, F.greatest(n - 1, F.lit(0))))
    z = F.arrays_zip(sorted_arr.alias("v"), prev.alias("p"), F.sequence(F.lit(0), n - 1).alias("i"))
    starts = F.transform(F.filter(z, lambda e: e["p"].isNull() | (e["v"] != e["p"])),
                         lambda e: F.struct(e["v"].alias("v"), e["i"].alias("i")))
    nxt = F.concat(F.slice(F.transform(starts, lambda e: e["i"]), 2, 1 << 30), F.array(n))
    return F.transform(F.arrays_zip(starts.alias("s"), nxt.alias("e")),
                       lambda e: F.struct(e["s"]["v"].alias(key), (e["e"] - e["s"]["i"]).cast("long").alias(count)))
