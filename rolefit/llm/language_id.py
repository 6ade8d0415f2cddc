"""Language ID: a byte convolutional network over fixed-length windows.

A window of bytes goes through filters of several widths over one-hot bytes, the
strongest answer of each filter over the window (max pooling, rectified), and a
softmax layer.  It is trained in numpy with Adam, on the driver, on windows of a
bounded sample of labelled texts (``Net.sample`` a language at most, two windows
each).  A text's prediction is the mean of its windows' probabilities, all
windows of the whole text counted; windows of many texts run as one batch.

Over one-hot bytes a filter is a sum of table rows, so the tables of neighbouring
bytes are added once for all 65,536 pairs and a width of four costs two look-ups.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so
is every text if there is no labelled row; repeated texts of a label count once
in the sample; an empty table returns no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAD = 0x20


@dataclass(frozen=True)
class Net:
    """Shape and training of the network."""

    window: int = 256
    filters: int = 16  # of each width 2, 3 and 4
    sample: int = 1200  # distinct texts a language that it learns from, at most
    epochs: int = 5
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


WIDTHS = (2, 3, 4)


class Weights(NamedTuple):
    """tables[w][k]: 256 rows of filter weights for the byte at place k of a filter of width WIDTHS[w]."""

    tables: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def windows(text: str, size: int) -> np.ndarray:
    """The whole text, in lower case, in rows of ``size`` bytes; the last is filled with spaces."""
    raw = text.lower().encode()
    n = max(1, -(-len(raw) // size))
    return np.frombuffer(raw.ljust(n * size, bytes([PAD])), np.uint8).reshape(n, size)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


# ---- training ------------------------------------------------------------------
def _pooled(x: np.ndarray, w: Weights) -> tuple[np.ndarray, list[np.ndarray]]:
    """Pooled answers (rows, filters) and, by width, the place of each strongest answer."""
    pooled, where = [], []
    for width, table in zip(WIDTHS, w.tables):
        places = x.shape[1] - width + 1
        answer = sum(table[k][x[:, k: k + places]] for k in range(width))
        at = answer.argmax(axis=1)
        where.append(at)
        pooled.append(np.take_along_axis(answer, at[:, None, :], axis=1)[:, 0])
    return np.concatenate(pooled, axis=1) + w.bias, where


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, classes: int, net: Net) -> Weights:
    """x: rows of bytes, y: classes of the rows."""
    rng = np.random.default_rng(net.seed)
    f = net.filters
    w = Weights([rng.normal(0, 0.1, (k, 256, f)).astype(np.float32) for k in WIDTHS], np.zeros(f * len(WIDTHS), np.float32),
                rng.normal(0, 0.1, (f * len(WIDTHS), classes)).astype(np.float32), np.zeros(classes, np.float32))
    flat = [*w.tables, w.bias, w.out, w.out_bias]
    first, second = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat]
    t = 0
    for _ in range(net.epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), net.batch):
            rows = order[i: i + net.batch]
            xb, n = x[rows], len(rows)
            pre, where = _pooled(xb, w)
            hidden = np.maximum(pre, 0)
            p = _softmax(hidden @ w.out + w.out_bias)
            p[np.arange(n), y[rows]] -= 1
            p /= n
            back = (p @ w.out.T) * (pre > 0)
            grads = []
            for j, (width, table) in enumerate(zip(WIDTHS, w.tables)):
                g = np.zeros_like(table)
                part = back[:, j * f: (j + 1) * f]
                for k in range(width):  # only the strongest place of a filter learns
                    byte = np.take_along_axis(xb, where[j] + k, axis=1)
                    np.add.at(g[k], (byte, np.arange(f)[None, :]), part)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            t += 1
            for p_, g, m, v in zip(flat, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p_ -= net.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


# ---- prediction ------------------------------------------------------------------
class Tables(NamedTuple):
    """The trained filters as tables of byte pairs."""

    pair: np.ndarray  # rows of pairs: width 2, first two bytes of width 3, first two of width 4
    single: np.ndarray  # third byte of width 3
    tail: np.ndarray  # last two bytes of width 4
    weights: Weights


def tables(w: Weights) -> Tables:
    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
    two, three, four = w.tables
    return Tables(np.concatenate([pairs(two[0], two[1]), pairs(three[0], three[1]), pairs(four[0], four[1])], axis=1),
                  three[2], pairs(four[2], four[3]), w)


def probabilities(x: np.ndarray, t: Tables, chunk: int = 128) -> np.ndarray:
    """Class probabilities of rows of bytes."""
    f = t.single.shape[1]
    pooled = np.empty((len(x), 3 * f), np.float32)
    for i in range(0, len(x), chunk):
        xb = x[i: i + chunk]
        pair = xb[:, :-1].astype(np.int32) * 256 + xb[:, 1:]
        a = t.pair[pair]
        part = pooled[i: i + chunk]
        part[:, :f] = a[:, :, :f].max(axis=1)
        part[:, f: 2 * f] = (a[:, :-1, f: 2 * f] + t.single[xb[:, 2:]]).max(axis=1)
        part[:, 2 * f:] = (a[:, :-2, 2 * f:] + t.tail[pair[:, 2:]]).max(axis=1)
    return _softmax(np.maximum(pooled + t.weights.bias, 0) @ t.weights.out + t.weights.out_bias)


def _text_probabilities(texts: list[str], t: Tables, size: int, most: int = 4096) -> np.ndarray:
    """Mean class probabilities of each text; ``most`` windows run at a time."""
    out = np.zeros((len(texts), t.weights.out.shape[1]))
    batch: list[np.ndarray] = []
    owner: list[int] = []
    count = np.ones(len(texts))

    def flush() -> None:
        if batch:
            np.add.at(out, np.repeat(owner, [len(b) for b in batch]), probabilities(np.concatenate(batch), t))
            batch.clear()
            owner.clear()

    held = 0
    for i, text in enumerate(texts):
        rows = windows(text, size)
        count[i] = len(rows)
        for at in range(0, len(rows), most):
            batch.append(rows[at: at + most])
            owner.append(i)
            held += len(batch[-1])
            if held >= most:
                flush()
                held = 0
    flush()
    return out / count[:, None]


def labelled_windows(docs: DataFrame, label: str, text: str, net: Net) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of a sample of the distinct texts of each label: ``net.sample`` of them, or all, chosen by a hash of the text."""
    rows = docs.select(F.col(label).alias("label"), F.col(text).alias("text")).filter("label is not null and text is not null")
    mark = F.xxhash64(F.lit("sample"), "text")
    counts = {r["label"]: r["count"] for r in rows.select("label", mark.alias("mark")).distinct().groupBy("label").count().collect()}
    labels = sorted(counts)
    if not labels:
        return np.zeros((0, net.window), np.uint8), np.zeros(0, np.int64), labels
    # twice the number come as candidates, one row a text; the first of them by the hash are the sample
    share = F.create_map(*[F.lit(v) for k in labels for v in (k, min(1.0, 2 * net.sample / counts[k]))])
    place = F.pmod(mark, F.lit(1_000_000_000))
    chosen = rows.filter(place < F.element_at(share, F.col("label")) * 1_000_000_000)
    room = F.greatest(F.length("text") - net.window, F.lit(1))
    cuts = [F.substr("text", F.pmod(F.xxhash64(F.lit(k), "text"), room).cast("int") + 1, F.lit(net.window)).alias(f"w{k}") for k in range(2)]
    got = chosen.select("label", place.alias("place"), mark.alias("mark"), *cuts).dropDuplicates(["label", "place", "mark"]).collect()
    by_label = {k: sorted((r for r in got if r["label"] == k), key=lambda r: (r["place"], r["mark"]))[:net.sample] for k in labels}
    got = sorted((labels.index(k), r[f"w{j}"]) for k, rs in by_label.items() for r in rs for j in range(2) if has_letter(r[f"w{j}"]))
    x = np.concatenate([windows(t, net.window)[:1] for _, t in got]) if got else np.zeros((0, net.window), np.uint8)
    return x, np.array([c for c, _ in got], dtype=np.int64), labels


class Model(NamedTuple):
    labels: list[str]
    tables: Tables | None
    window: int


def fitted(docs: DataFrame, label: str = "lang", text: str = "text", net: Net = Net()) -> Model:
    x, y, labels = labelled_windows(docs, label, text, net)
    return Model(labels, tables(train(x, y, len(labels), net)) if len(x) else None, net.window)


def predictor(model: Model):
    """A column function: text -> struct(lang_pred, score)."""
    weights = model.tables.weights if model.tables else None
    labels, size = model.labels, model.window

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = tables(weights) if weights else None
        for s in batches:
            lang, score = ["und"] * len(s), np.zeros(len(s))
            texts = s.tolist()
            at = [i for i, x in enumerate(texts) if x is not None and has_letter(x)] if t else []
            if at:
                p = _text_probabilities([texts[i] for i in at], t, size)
                for i, best, prob in zip(at, p.argmax(axis=1), p.max(axis=1)):
                    lang[i], score[i] = labels[best], min(1.0, float(prob))
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    # a filter on the result is then not pushed below the call, which would make it twice
    return F.pandas_udf(predict, "lang_pred string, score double").asNondeterministic()


def identified(docs: DataFrame, model: Model, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    out = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), predictor(model)(F.col(text)).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
