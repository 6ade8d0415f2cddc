"""URL filters: sort-merge range join over reversed-host keys.

A rule names a host and a path prefix; it fits the host and all its subdomains.
The key of a rule is its host with the labels reversed, ``/``, and the path
(``example.com`` + ``/en/`` -> ``com.example//en/``), so the urls that it fits on
one level of their host are those whose key begins with it: an interval of the
sorted keys, and such intervals nest or are disjoint.

A url has one key for each host level that rules can name.  Rule keys and
distinct url keys are dealt out by range, sorted, and swept: the sweep carries
the stack of nested rules that begin with the last rule passed.  Any rule that
holds a key is that last rule or one of its enclosing rules, so the stack's
first rule that the key begins with is the longest.  A range starts with the
stack that the ranges before it leave.  Of a url's levels the longest rule wins.

Rows take part with two short columns (host cut to the rules' levels, path cut
to the longest rule path); equal ones are swept once, so hot hosts do not matter.
Only DataFrame functions are used.

Defined cases: a null url, or one without ``://``, has an empty host and path and
gets the default verdict; rules without host are ignored; rules repeated with
both verdicts block; between rules of equal length the longer host wins; an
empty table returns no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolefit.llm.shared import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Sampled keys for each range: the ends of the ranges come from so many.
SAMPLE = 32


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty if it is null or has no ``://``."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(u, F.lit("://")), F.substring_index(u, "://", 1))
    tail = F.coalesce(F.substr(u, F.length(rest) + 4), F.lit(""))
    host = F.regexp_extract(tail, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(tail, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower()), path


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _rule_keys(rules: DataFrame) -> DataFrame:
    """key, rule, verdict, and chain: the rules that enclose it, itself first."""
    r = rules.select(F.translate("host", UPPER, UPPER.lower()).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    r = r.filter(F.col("host") != "").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    r = r.select(F.concat(F.array_join(_labels(F.col("host")), "."), F.lit("/"), "path").alias("key"),
                 F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"),
                          F.concat("host", "path").alias("rule"), "verdict").alias("says"))
    cut = r.select(F.col("key").alias("of"), F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n"))
    cut = cut.select("of", F.substr("of", F.lit(1), F.col("n")).alias("key"))
    chains = cut.join(r, "key").groupBy("of").agg(F.sort_array(F.collect_list(F.struct(F.length("key").alias("n"), "key", "says")), False).alias("chain"))
    return chains.select(F.col("of").alias("key"), "chain")


def _range_of(key: Column, ends: list[str]) -> Column:
    """The number of ``ends`` at or below the key."""
    return F.size(F.filter(F.array(*map(F.lit, ends)).cast("array<string>"), lambda e: e <= key)) if ends else F.lit(0)


def swept(keys: DataFrame, rules: DataFrame, ranges: int) -> DataFrame:
    """key, says (the longest rule that holds it) for the distinct ``keys`` that a rule holds.  rules: key, chain."""
    sample = [r.key for r in keys.orderBy(F.xxhash64("key"), "key").limit(SAMPLE * ranges).collect()]
    sample.sort(key=str.encode)
    ends = sorted({sample[i] for i in range(SAMPLE, len(sample), SAMPLE)}, key=str.encode)
    at = F.col("key")
    none = F.lit(None).cast(rules.schema["chain"].dataType)
    starts = rules.select(_range_of(at, ends).alias("part"), "key", F.lit(0).alias("kind"), "chain")
    last = starts.groupBy("part").agg(F.max_by("chain", "key").alias("chain"))
    parts = keys.sparkSession.range(len(ends) + 1).select(F.col("id").cast("int").alias("part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.join(last, "part", "left").select("part", F.lit("").alias("key"), F.lit(0).alias("kind"),
                                                      F.last("chain", ignorenulls=True).over(before).alias("chain"))
    ends_in = keys.select(_range_of(at, ends).alias("part"), "key", F.lit(1).alias("kind"), none.alias("chain"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stack = F.last("chain", ignorenulls=True).over(sweep)
    events = carried.unionByName(starts).unionByName(ends_in).withColumn("stack", stack).filter(F.col("kind") == 1)
    holds = F.filter("stack", lambda c: F.startswith(F.col("key"), c["key"]))
    return events.select("key", F.get(holds, F.lit(0))["says"].alias("says")).filter(F.col("says").isNotNull())


def judged(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow",
           carry: tuple[str, ...] = ()) -> DataFrame:
    """page_id, host, path, rule, verdict of every row.  ``rules``: host, path, verdict (allow or block)."""
    spark = pages.sparkSession
    host, path = url_parts(F.col(url))
    bounds = rules.agg(F.max(F.size(F.split("host", r"\."))), F.max(F.length("path"))).first()
    levels, reach = max(bounds[0] or 1, 1), bounds[1] or 0
    rows = pages.select(F.struct(F.col(page_id).alias("page_id"), *carry).alias("own"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"near": F.array_join(F.slice(_labels(F.col("host")), 1, levels), "."),
                             "head": F.substring("path", 1, reach)})
    kinds = written(rows.select("near", "head").distinct(), "urls")
    label = F.split("near", r"\.")
    keyed = kinds.select("near", "head", F.explode(F.sequence(F.lit(1), F.size(label))).alias("n"))
    keyed = keyed.select("near", "head", F.concat(F.array_join(F.slice(label, 1, F.col("n")), "."), F.lit("/"), "head").alias("key"))
    found = swept(keyed.select("key").distinct(), _rule_keys(rules), int(spark.conf.get("spark.sql.shuffle.partitions")))
    best = keyed.join(found, "key").groupBy("near", "head").agg(F.max("says").alias("says"))
    j = rows.join(best, ["near", "head"], "left")
    return j.select("own.*", "host", "path", F.col("says.rule").alias("rule"),
                    F.coalesce("says.verdict", F.lit(default)).alias("verdict"))
