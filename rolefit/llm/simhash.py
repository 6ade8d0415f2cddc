"""SimHash near-dedup with pigeonring filtering.

A fingerprint has a bit set if more than half of the hashes of the text's
word shingles have it.  Two fingerprints link if they differ in at most
``max_distance`` bits.

Pigeonring principle: lay the fingerprint's ``segments`` in a ring.  If two
fingerprints differ in at most t bits, some segment starts a chain such that
the first l segments from it differ in at most l*t/segments bits together, for
every l.  With t=4 and five segments the first segment must be equal, the first
two may differ in one bit, three in two, four in three.  So every fingerprint
is filed, for each start, under the first segment and the second one with each
of its bits masked in turn; fingerprints that share a key are candidates, and
only chains that stay within the budgets reach the full Hamming check.

Equal fingerprints collapse first, so groups of copies cost one entry.  Inside a
run of one key, links are sought breadth-first from linked to unlinked members
and a spanning forest is returned, never all pairs; every link is viable in
some run, so the components are exact.

Defined cases: a null or empty text has the fingerprint zero and links like any
other; a null id never names a component; an id names one document; an empty
table returns no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm.components import components
from rolefit.llm.shared import written

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


@dataclass(frozen=True)
class Ring:
    """Bits of a fingerprint in ``segments`` neighbouring segments, and the allowed distance."""

    max_distance: int = 4
    segments: int = 5
    bits: int = 64

    def edges(self) -> list[tuple[int, int]]:
        """(lowest bit, width) of each segment."""
        cut = [round(i * self.bits / self.segments) for i in range(self.segments + 1)]
        return [(a, b - a) for a, b in zip(cut, cut[1:])]

    def budget(self, length: int) -> int:
        """Bits in which the first ``length`` segments of a viable chain may differ."""
        return length * self.max_distance // self.segments


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], seed) for i, j in zip(first, last)), np.uint64, n)
    planes = hashes.view(np.uint8).reshape(n, 8)  # little-endian bytes
    votes = np.concatenate([np.bincount(planes[:, k], minlength=256) @ _BITS_OF_BYTE for k in range(8)])
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint_udf(shingle: int):
    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(np.array([fingerprint(t or "", shingle) for t in s], dtype=np.uint64).view(np.int64))
    return of


def _chain_keys(fps: np.ndarray, ring: Ring) -> Iterator[np.ndarray]:
    """For each start and masked bit, every fingerprint's key: tag, first segment, masked second segment."""
    edges = ring.edges()
    part = [(fps >> np.uint64(lo)) & np.uint64((1 << w) - 1) for lo, w in edges]
    tag = 0
    for i in range(ring.segments):
        j = (i + 1) % ring.segments
        for bit in range(edges[j][1]):
            masked = part[j] & ~np.uint64(1 << bit)
            yield (np.uint64(tag) << np.uint64(48)) | (part[i] << np.uint64(24)) | masked
            tag += 1


def _starts(ring: Ring) -> np.ndarray:
    """The first segment of the chain that each tag stands for."""
    e = ring.edges()
    return np.array([i for i in range(ring.segments) for _ in range(e[(i + 1) % ring.segments][1])])


def _viable(x: np.ndarray, y: np.ndarray, start: np.ndarray | int, ring: Ring) -> np.ndarray:
    """Whether the chains from ``start`` stay within their budgets, up to the whole ring (the Hamming check)."""
    edges = ring.edges()
    diff = x ^ y
    counts = np.stack([np.bitwise_count((diff >> np.uint64(lo)) & np.uint64((1 << w) - 1)) for lo, w in edges])
    ok = np.ones(diff.shape, dtype=bool)
    total = np.zeros(diff.shape, dtype=np.int64)
    for length in range(1, ring.segments + 1):
        seg = (start + length - 1) % ring.segments
        step = counts[seg] if np.isscalar(seg) else counts[seg, np.arange(len(diff))]
        total = total + step
        ok &= total <= ring.budget(length)
    return ok


def run_links(fps: np.ndarray, start: int, ring: Ring) -> tuple[list[int], list[int]]:
    """A spanning forest (index pairs) of the links that are viable from ``start`` inside one run."""
    a, b = [], []
    left = np.arange(len(fps))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = _viable(fps[left], fps[at], start, ring)
            found = left[hit].tolist()
            a += [at] * len(found)
            b += found
            queue += found
            left = left[~hit]
    return a, b


def _file(ring: Ring):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(fps):
                continue
            for key in _chain_keys(fps.view(np.uint64), ring):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps)], names=["key", "fp"])
    return of


def _link(ring: Ring):
    """Links within runs of equal keys; batches come sorted by key, and a run may span batches."""
    starts = _starts(ring)

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(at, len(key)))
        start = starts[(key[at] >> 48).astype(np.int64)]
        two = at[size == 2]
        x, y = fp[two], fp[two + 1]
        ok = _viable(x, y, start[size == 2], ring)
        a, b = [x[ok]], [y[ok]]
        for i, n, s in zip(at[size > 2], size[size > 2], start[size > 2]):
            run = fp[i: i + n]
            p, q = run_links(run, int(s), ring)
            a.append(run[p])
            b.append(run[q])
        cols = [pa.array(np.concatenate(z).view(np.int64)) for z in (a, b)]
        return pa.RecordBatch.from_arrays(cols, names=["a", "b"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last run may go on
            if cut:
                yield links(key[:cut], fp[:cut])
            held_key, held_fp = key[cut:], fp[cut:]
        if len(held_key):
            yield links(held_key, held_fp)
    return of


def fingerprint_links(fps: DataFrame, ring: Ring = Ring()) -> DataFrame:
    """a, b: links that connect what is within the distance.  ``fps``: one column of distinct 64-bit fingerprints."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = fps.mapInArrow(_file(ring), "key long, fp long")
    return keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_link(ring), "a long, b long")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, ring: Ring = Ring()) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id, text_key (a hash of the text)."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_udf(shingle)(t).alias("fp"),
                               F.xxhash64(t).alias("text_key")), "fingerprints")
    ids = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(fingerprint_links(ids.select("fp"), ring)).withColumnRenamed("node", "fp")
    linked = roots.join(ids, "fp")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = ids.join(linked.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp", "left")
    of_fp = of_fp.select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_key")
