"""Operators on documents against brute force on a small fixture with nulls, blanks, ties, repeats and long texts."""
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolefit.llm import catalog, exact_dedup, language_id, lm_backoff, packing, quality_rules, sentencepiece_unigram, simhash
from rolefit.llm.components import components
from rolefit.llm.textbytes import word_hashes, words
from rolefit.llm.wordcache import encoder

from .conftest import PROSE, texts

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def split(text, lower=False):
    raw = (text or "").encode()
    return (raw.translate(LOWER) if lower else raw).split()


# ---- quality rules ---------------------------------------------------------
def brute_measures(text):
    text = text or ""
    w = split(text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    seen = collections.Counter(win)
    cover = {i + k for i, x in enumerate(win) if seen[x] > 1 for k in range(8)}
    return (len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))


def test_measures(docs):
    got = quality_rules.judged(docs).collect()
    assert len(got) == len(texts())
    want = collections.Counter((i, *brute_measures(t)) for i, t, _, _ in texts())
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), st.integers(1, 9))
def test_repeated_words(w, window):
    win = [tuple(w[i:i + window]) for i in range(len(w) - window + 1)]
    seen = collections.Counter(win)
    assert quality_rules.repeated_words(w, window) == len({i + k for i, x in enumerate(win) if seen[x] > 1 for k in range(window)})


def test_boilerplate_lines(spark):
    own = [f"document {i} tells " + " ".join(f"w{i}x{k}" for k in range(25)) for i in range(12)]
    rows = [(i, f"{t}\nAll  rights RESERVED here", "h") for i, t in enumerate(own)]
    rows += [(100 + i, "All rights reserved here\nAll rights reserved here\n" + "q " + str(i), "h") for i in range(3)]
    rows += [(200 + i, rows[0][1], "h") for i in range(50)]  # copies are one document
    limits = quality_rules.LineLimits(min_documents=4, share=0.2)
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string"), limits).collect()}
    assert len(got) == len(rows)
    with_line = [i for i in got if "rights" in got[i].clean_text.lower()]
    content = {rows[[r[0] for r in rows].index(i)][1] for i in with_line}
    assert len(content) == 1  # the holder keeps it
    assert sum(got[i].removed_words > 0 for i in range(12)) >= 11 and all(got[i].kept for i in range(12))
    assert [got[i].depleted for i in (100, 101, 102)].count(True) >= 2


def _own(i, n=25):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_boilerplate_of_a_large_host(spark):
    notice = "All rights reserved by the owner of this site and by nobody else"
    rows = [(i, f"{_own(i)}\n{notice}" if i < 30 else _own(i), "large") for i in range(3000)]  # 1 % of the host
    rows += [(9000 + i, f"{notice}\n{i}", "large") for i in range(2)]
    rows += [(9100 + i, f"{_own(i)}\n{notice}", "small") for i in range(20)]
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert sum(notice in got[i].clean_text for i in got if i < 9100) == 1
    assert sum(got[i].depleted for i in (9000, 9001)) >= 1 and all(got[i].kept for i in range(3000))
    assert all(got[9100 + i].removed_words == 0 for i in range(20))  # not above the absolute limit


def test_short_boilerplate_lines(spark):
    menu = "\n".join(["Home", "About us", "Read more", "Cookie policy", *(f"Topic {i}" for i in range(21))])
    rows = [(i, f"{menu}\n{i}", "menus") for i in range(40)]
    rows += [(100 + i, "\n".join(f"全ての権利は所有者に帰属します第{k}項、無断転載を禁じます" for k in range(25)) + f"\n{i}", "scripts") for i in range(40)]
    rows += [(1000 + i, f"{_own(i)}\nYes." if i < 30 else _own(i), "large") for i in range(1000)]  # short, below both limits
    rows += [(5000 + i, f"{_own(i)}\nHome" if i < 250 else _own(i), "hot") for i in range(6000)]
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for first in (0, 100):
        assert sum(got[first + i].depleted and not got[first + i].kept for i in range(40)) == 39  # all but the holder
    assert sum("Yes." in got[1000 + i].clean_text for i in range(30)) == 30
    assert sum("Home" in got[5000 + i].clean_text for i in range(250)) == 1 and all(got[i].kept for i in got if i >= 1000)


# ---- sentencepiece ----------------------------------------------------------
@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path(catalog.PIECES), "rb") as f:
        return f.read()


def test_sentencepiece_rows(docs, model):
    got = sentencepiece_unigram.encoded(docs, model, with_ids=True).collect()
    coder = sentencepiece_unigram.Unigram(sentencepiece_unigram.read_pieces(model))
    assert len(got) == len(texts()) and all(r.decoded_equal for r in got)
    for r in got:
        assert r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.n_byte_pieces == sum(i in coder.byte_of for i in r.ids)


def test_sentencepiece_against_the_library(model):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    m.ParseFromString(model)
    m.trainer_spec.model_type = 1  # the same pieces and scores, read as a unigram model
    for p in m.pieces:
        p.score = max(p.score, -40000.0)  # lower ones are lost in the library's 32-bit sums
    raw = m.SerializeToString()
    lib = sentencepiece.SentencePieceProcessor(model_proto=raw)
    own = sentencepiece_unigram.Unigram(sentencepiece_unigram.read_pieces(raw))
    for s in ["", " ", "a", PROSE, "  two  spaces \n\n x", "日本 🎈é\t\x00", "don't; stop -- now...", "wort für straße"]:
        ids = own.encode(s)
        assert ids.tolist() == lib.encode(s)
        assert own.decode(ids) == lib.decode(ids.tolist())


# ---- LM ----------------------------------------------------------------------
@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(docs, order):
    strength = 20.0
    held = catalog.fold("doc_id", 5, 1)
    got = lm_backoff.scored(docs, held, order=order, strength=strength, block_bytes=30_000).collect()
    assert len(got) == len(texts())
    c = [collections.Counter() for _ in range(order)]
    sent = [(i, t, ["<s>", *split(t, True), "</s>"]) for i, t, _, _ in texts()]
    for i, _, w in sent:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            for n in range(order):
                c[n].update(tuple(w[k:k + n + 1]) for k in range(len(w) - n))
    starts = c[0].pop(("<s>",))
    total, types = sum(c[0].values()), len(c[0])

    def p(h, w):
        if not h:
            return (c[0][(w,)] + 0.5) / (total + 0.5 * (types + 1))
        seen = starts if h == ("<s>",) else c[len(h) - 1][h]
        return (c[len(h)][h + (w,)] + strength * p(h[1:], w)) / (seen + strength)

    want = collections.Counter()
    for i, _, w in sent:
        score = sum(math.log10(p(tuple(w[max(0, k - order + 1):k]), w[k])) for k in range(1, len(w)))
        base = sum(math.log10(p((), x)) for x in w[1:])
        want[i, len(w) - 1, sum(c[0][(x,)] > 0 for x in w[1:]), round(base, 6), round(score, 6)] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    assert all(r.train_tokens == total and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in got)


def test_word_segmentation():
    import pyarrow as pa
    col = pa.array([t for _, t, _, _ in texts()] + ["ab", "ab", "\x1cz"])
    w = words(col, lower=True)
    h = word_hashes(w)
    byname = {}
    for i, t in enumerate(col.to_pylist()):
        own = split(t, True)
        at = slice(w.bounds[i], w.bounds[i + 1])
        assert [bytes(w.data[a:b]) for a, b in zip(w.start[at], w.end[at])] == own and set(w.row[at].tolist()) <= {i}
        for name, x in zip(own, h[at].tolist()):
            assert byname.setdefault(name, x) == x
    assert len(set(byname.values())) == len(byname)


# ---- packing -------------------------------------------------------------------
@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing(docs, capacity):
    from tokenizers import Tokenizer
    path = public_tokenizers.path(catalog.TOKENIZER)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    got = packing.packed(docs, path, 2, capacity).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
        assert 1 <= r.length <= capacity
    for s in by.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
        assert end <= capacity
    want = collections.Counter()
    for i, text, _, _ in texts():
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % capacity or capacity if len(ids) > capacity else len(ids)
        for k, a in enumerate([0, *range(first, len(ids), capacity)]):
            part = np.array(ids[a: first if k == 0 else a + capacity], "<u4")
            want[i, k, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    if capacity == 16:
        assert len(by) <= 1.02 * sum(r.length for r in got) / capacity + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=24, max_size=24))
def test_patterns_hold_the_histogram(counts):
    left = np.array([0, *counts])
    held = np.zeros_like(left)
    for lengths, times in packing.packed_counts(left, 24):
        assert sum(lengths) <= 24 and times > 0
        for n in lengths:
            held[n] += times
    assert (held == left).all()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", " ", "  ", "\n", "\t", "1", "22", ".", "'s", "'", "日", "🎈", "\x85", "\0", "<|endoftext|>"]), max_size=20).map("".join))
def test_word_cache_equals_the_tokenizer(text):
    from tokenizers import Tokenizer
    path = public_tokenizers.path(catalog.TOKENIZER)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    assert np.frombuffer(encoder(path)(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


# ---- simhash and components --------------------------------------------------------
def brute_fingerprint(text):
    w = split(text, True)
    if not w:
        return 0
    sh = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_near_groups(docs):
    got = simhash.near_groups(docs).collect()
    fp = [(i, brute_fingerprint(t)) for i, t, _, _ in texts()]
    roots = closure({f for _, f in fp}, lambda a, b: (a ^ b).bit_count() <= 4)
    least = collections.defaultdict(lambda: math.inf)
    for i, f in fp:
        if i is not None:
            least[roots[f]] = min(least[roots[f]], i)
    want = collections.Counter((i, f"{f:016x}", least[roots[f]]) for i, f in fp)
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_links_in_dense_clusters_and_at_the_limit(spark):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    fps = {centre}
    for _ in range(400):  # a dense group, members up to eight bits apart
        fps.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    for _ in range(150):  # pairs of exactly four and five differing bits
        a = int(rng.integers(0, 2**63))
        fps |= {a, a ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(4, 6)), replace=False))}
    fps |= {0, 2**64 - 1, 1, 15, 31}
    signed = {f - 2**64 if f >= 2**63 else f for f in fps}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node % 2**64: r.root % 2**64 for r in components(simhash.fingerprint_links(df)).collect()}
    roots = closure(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    groups, mine = collections.defaultdict(set), collections.defaultdict(set)
    for f in fps:
        groups[roots[f]].add(f)
        mine[got.get(f, f)].add(f)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in mine.values()}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (None, 7), (3, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 1000 for i in range(1000, 1100)}


# ---- exact dedup ----------------------------------------------------------------------
@pytest.mark.parametrize("content_hash", [exact_dedup.md5_128, lambda norm: F.length(norm) % 2])
def test_exact_groups(docs, content_hash):
    got = exact_dedup.exact_groups(docs, content_hash=content_hash).collect()
    groups = collections.defaultdict(list)
    for i, t, _, _ in texts():
        groups["".join(x.decode() for x in split(t))].append((-len(t or ""), math.inf if i is None else i))
    want = collections.Counter()
    for norm, rows in groups.items():
        best = min(rows)
        for n, i in rows:
            want[None if i == math.inf else i, None if best[1] == math.inf else best[1], len(rows), (n, i) == best, hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


# ---- language ID -----------------------------------------------------------------------
def test_language_id(spark, docs):
    rng = np.random.default_rng(1)
    voices = {"en": ["the", "and", "thing", "with", "other"], "de": ["der", "über", "schön", "nicht", "straße"], "fr": ["été", "où", "être", "leçon", "les"]}
    rows = [(i, " ".join(rng.choice(voices[k], int(rng.integers(5, 200)))), k) for i, k in enumerate(list(voices) * 60)]
    held = catalog.fold("doc_id", 4, 2)
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fitted(table.filter(~held))
    got = language_id.identified(table, model, held).collect()
    truth = {i: k for i, _, k in rows}
    test = [r for r in got if r.held_out]
    assert test and sum(r.lang_pred == truth[r.doc_id] for r in test) >= 0.98 * len(test)
    edge = language_id.identified(docs, model, held).collect()
    assert len(edge) == len(texts())
    und = {r.doc_id for r in edge if r.lang_pred == "und"}
    assert und == {4, 5, 6, 10} and all(0 <= r.score <= 1 for r in edge)
    none = language_id.fitted(table.filter("false"))
    assert {(r.lang_pred, r.score) for r in language_id.identified(docs, none, held).collect()} == {("und", 0.0)}


def test_language_id_sample_of_copies(spark):
    rows = [("copy of a text", "en")] * 3000 + [(f"text number {i}", "en") for i in range(300)] + [(f"wort {i}", "de") for i in range(40)]
    table = spark.createDataFrame(rows, "text string, lang string")
    for salt in range(3):  # whether the copies are chosen or not
        some = table.withColumn("text", F.concat(F.lit(f"v{salt} "), "text"))
        x, y, labels = language_id.labelled_windows(some, "lang", "text", language_id.Net(sample=50))
        assert labels == ["de", "en"] and [(y == k).sum() for k in range(2)] == [2 * 40, 2 * 50]
        assert collections.Counter(r.tobytes() for r in x).most_common(1)[0][1] == 2


def test_language_id_reads_whole_texts():
    w = language_id.train(np.random.default_rng(0).integers(32, 127, (64, 64)).astype(np.uint8), np.arange(64) % 2, 2, language_id.Net(window=64, filters=4, epochs=1))
    t = language_id.tables(w)
    text = "abc def " * 999
    x = language_id.windows(text, 64)
    plain, _ = language_id._pooled(x, w)
    assert np.allclose(language_id.probabilities(x, t), language_id._softmax(np.maximum(plain, 0) @ w.out + w.out_bias), atol=1e-5)
    assert np.allclose(language_id._text_probabilities([text], t, 64, most=7)[0], language_id.probabilities(x, t).mean(axis=0), atol=1e-5)


# ---- empty tables ------------------------------------------------------------------------
def test_empty_tables(docs):
    none = docs.filter("false")
    path = public_tokenizers.path(catalog.TOKENIZER)
    held = F.lit(False)
    for df in (quality_rules.judged(none), lm_backoff.scored(none, held), packing.packed(none, path), simhash.near_groups(none),
               exact_dedup.exact_groups(none), language_id.identified(none, language_id.fitted(none), held)):
        assert df.count() == 0


def test_quality_rules_equal_the_sql_on_large_hosts(spark, tmp_path):
    """A host of 3,000 documents with short and long lines around each limit."""
    import duckdb
    rows = []
    for i in range(3000):
        lines = [_own(i, 22)]
        lines += ["long boilerplate of the site here"] if i < 30 else []
        lines += ["twenty holders only in this host"] if 100 <= i < 120 else []
        lines += ["home page"] if i < 201 else []
        lines += ["read more"] if i < 199 else []
        lines += ["日本語の長い一行" * 3] if 40 <= i < 62 else []
        rows.append((i, "\n".join(lines), "large"))
    rows += [(5000 + i, f"read more\nhome page\n{_own(5000 + i, 21)}", "small") for i in range(25)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op1_quality_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(catalog.ORACLES["op1_quality_rules"])
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())
    judged = {r.doc_id: r.removed_words for r in quality_rules.judged(table).collect()}
    # all holders but one: 30 of six words, 201 and 199 of two (above 5 % of 3,000), 22 of one long word; 25 and 25 of two in the small host
    assert sum(judged[i] for i in range(3000)) == 29 * 6 + 200 * 2 + 198 * 2 + 21
    assert sum(judged[5000 + i] for i in range(25)) == 2 * 24 * 2
