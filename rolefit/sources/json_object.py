"""One large JSON object read by many tasks.

A dictionary file may be one JSON object, ``{"id": {...}, "id": {...}}``, which
Spark's JSON reader gives to one task.  Here it is cut into byte ranges.  A range
alone does not know whether it begins inside a string, or how deep.  So each first
reports what it does to either state: the change of depth and whether it ends in a
string, if it begins outside or inside one.  The reports are a few numbers a range;
added up in order they give every range's true start.  Then each range reads the
members whose separator (the opening brace or a comma of the outer object) lies in
it, and reads on to the end of its last one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range, and of what is read on at first to end a member.
RANGE_BYTES, READ_ON = 16 << 20, 1 << 16
_SIGNS = re.compile(rb'[\\"{}\[\],]')


class Scanner:
    """Depth and being inside a string, over bytes that are handed in one after the other."""

    def __init__(self, in_string: bool, depth: int, skip: int) -> None:
        self.in_string, self.depth, self.at = in_string, depth, skip

    def signs(self, raw: bytes) -> Iterator[tuple[int, bytes]]:
        """(place, sign) of the braces, brackets and commas outside strings, from where the last call ended;
        ``depth`` is the one after the sign."""
        while (m := _SIGNS.search(raw, self.at)) is not None:
            sign, self.at = m[0], m.end()
            if sign == b"\\":
                self.at += self.in_string  # the next byte is escaped
            elif sign == b'"':
                self.in_string = not self.in_string
            elif not self.in_string:
                self.depth += (sign in b"{[") - (sign in b"}]")
                yield m.start(), sign
        self.at = max(self.at, len(raw))


def change(raw: bytes, in_string: bool, skip: int) -> tuple[int, bool]:
    """What a range does to the depth, and whether it ends in a string."""
    s = Scanner(in_string, 0, skip)
    for _ in s.signs(raw):
        pass
    return s.depth, s.in_string


def members(raw: bytes, more: Callable[[int], bytes], in_string: bool, depth: int, skip: int) -> Iterator[bytes]:
    """The members whose separator lies in ``raw``; ``more(n)``: the next n bytes after what has been read (fewer at the end)."""
    s, limit, start, step = Scanner(in_string, depth, skip), len(raw), None, READ_ON
    while True:
        for place, sign in s.signs(raw):
            opens, closes = sign == b"{" and s.depth == 1, sign == b"}" and s.depth == 0
            if not (opens or closes or sign == b"," and s.depth == 1):
                continue
            if start is not None and raw[start:place].strip():
                yield raw[start:place]
            start = None
            if closes or place >= limit:
                return
            start = place + 1
        if start is None:
            return
        got = more(step)
        if not got:
            return
        raw, step = raw + got, 2 * step


def _escaped(f, start: int) -> int:
    """1 if the byte at ``start`` is escaped: an odd number of backslashes stands before it."""
    count, at = 0, start
    while at > 0:
        size = min(at, 256)
        f.seek(at - size)
        part = f.read(size)
        own = size - len(part.rstrip(b"\\"))
        count, at = count + own, at - size
        if own < size:
            break
    return count % 2


def _open(path: str):
    from pyarrow import fs
    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(place)


def json_object_members(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, key, value) of the members of the JSON objects in the files of ``path``: one object a file, each read by
    as many tasks as it has ranges; value is JSON text.  The files' system must be one that ``pyarrow`` opens."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    ranges = files.select("path", begins).repartition(F.col("path"), F.col("start"))

    def reports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                with _open(r.path) as f:
                    f.seek(r.start)
                    raw, skip = f.read(range_bytes), _escaped(f, r.start)
                outside, inside = change(raw, False, skip), change(raw, True, skip)
                rows.append((r.path, r.start, *outside, *inside))
            yield pd.DataFrame(rows, columns=["path", "start", "depth0", "string0", "depth1", "string1"])

    told = ranges.mapInPandas(reports, "path string, start long, depth0 int, string0 boolean, depth1 int, string1 boolean")
    begin: dict[str, list[tuple[int, bool, int]]] = {}  # a few numbers a range
    for r in sorted(told.collect(), key=lambda r: (r.path, r.start)):
        of = begin.setdefault(r.path, [(0, False, 0)])
        _, in_string, depth = of[-1]
        of.append((r.start + range_bytes, r.string1 if in_string else r.string0, depth + (r.depth1 if in_string else r.depth0)))
    states = [(p, start, s, d) for p, of in begin.items() for start, s, d in of[:-1]]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                rows = []
                with _open(r.path) as f:
                    skip = _escaped(f, r.start)
                    f.seek(r.start)
                    raw = f.read(range_bytes)
                    for m in members(raw, f.read, bool(r.in_string), int(r.depth), skip):
                        (key, value), = json.loads(b"{" + m + b"}").items()
                        rows.append((r.path, key, json.dumps(value, ensure_ascii=False)))
                yield pd.DataFrame(rows, columns=["path", "key", "value"])

    if not states:
        return spark.createDataFrame([], "path string, key string, value string")
    known = spark.createDataFrame(states, "path string, start long, in_string boolean, depth int")
    return known.repartition(len(states), "path", "start").mapInPandas(read, "path string, key string, value string")
