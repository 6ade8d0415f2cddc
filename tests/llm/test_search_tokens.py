"""Token counts, ranked search and token alignment against the libraries and brute force."""
import collections
import functools
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rolefit.llm import catalog, lexical_nra, token_alignment, token_counts

from rolefit.llm.wordcache import byte_level_encode

from .conftest import CLASHES, PROSE, texts

MODEL, JSON = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
#: Spaces of many kinds, marks, scripts, byte fallback and special strings.
ATOMS = [" ", "  ", "   ", "\n", "\t", "\r\n", " ", "　", " ", "\u0085", "\x1c", "᠎", "▁", "a", "the", "word", "Straße", "日本",
         "🎈", "é", "1", "23", "-", "--------", "'s", "'", ".", ",", "_", "\0", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "x" * 40]
STRANGE = st.lists(st.sampled_from(ATOMS), max_size=14).map("".join)


@functools.cache
def sides():
    return token_alignment.byte_level_side(JSON), token_alignment.piece_side(MODEL)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def byte_bpe():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


# ---- token counts -------------------------------------------------------------
def test_whole_tokens_are_proved(pieces):
    whole = token_counts.proved_whole(MODEL)
    assert len(whole) > 10_000 and all(len(pieces.encode(w)) == 1 for w in random.Random(1).sample(whole, 2000))


@settings(max_examples=400, deadline=None)
@given(st.lists(STRANGE, max_size=4))
def test_counts_of_strange_texts(found):
    assert token_counts.counter(MODEL)(found) == [len(x) for x in sides()[1].encode(found)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_of_tokenizers_files(name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    found = ["", PROSE, "a <|endoftext|> b", "Ünï çödé  \n\t x", "日本語 🎈", " lead", "trail ", "x" * 500]
    assert token_counts.counter(path)(found) == [len(library.encode(t, add_special_tokens=False).ids) for t in found]


def test_memory_of_counts_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    count = token_counts.PreTokenCounts(str.split, ["one"], lambda rest: [2] * len(rest))
    for k in range(5):
        assert count([f"one a{k} b{k} c{k} d{k} e{k}", "one one"]) == [11, 2]
    long = "y" * 100
    assert count([long]) == [2] and long not in count.known and len(count.known) <= 1 + 10 + 5


def test_counted_rows(docs, pieces):
    got = collections.Counter(map(tuple, token_counts.counted(docs, MODEL, 30).collect()))
    want = collections.Counter((i, len((t or "").encode()), n := len(pieces.encode(t or "")), n > 30) for i, t, _, _ in texts())
    assert got == want
    assert token_counts.counted(docs.limit(0), MODEL, 30).collect() == []


# ---- ranked search --------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in TERM.findall(text or "")]


def brute_search(docs, items, k=10):
    own = [(i, collections.Counter(plain_terms(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    total = sum(n for _, _, n in own)
    df = collections.Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c, n in own:
            m = 100 - 90 + (90 * n * len(own)) // total
            score = sum(math.floor(1000 * math.log((2 * len(own) + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(plain_terms(text)) if c[t])
            if score:
                rows.append((-score, math.inf if i is None else i))
        out += [(item, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(rows)[:k], 1)]
    return collections.Counter(out)


def test_terms_are_the_contracts():
    for t in [PROSE, "A-b_C3 ÀÉ x²日本　語 z\x00q", "", None, "İstanbul K", *ATOMS]:
        assert [x.decode() for x in lexical_nra.terms(t)] == plain_terms(t)


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.6)) % 60}" for _ in range(400)]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.randint(1, 60)))) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(40)]  # ties
    return rows + [(n + 90, None), (n + 91, " -- "), (None, rows[3][1]), (5, rows[5][1])]


@pytest.mark.parametrize("shard,depth,block", [(3_000_000, 64, 200_000), (50, 1, 5), (400, 2, 1)])
def test_search_equals_brute_force(spark, monkeypatch, shard, depth, block):
    monkeypatch.setattr(lexical_nra, "SHARD_POSTINGS", shard)
    rows = corpus(7, 300)
    items = [(1, "w1 w2 w3 w4 w5"), (2, rows[3][1]), (3, "w40 W41 w41 unknown"), (4, None), (5, "none"), (1, "w7"), (None, "w9 w1"),
             (6, " ".join(f"w{k}" for k in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in (*CLASHES, "q", "score", "n")})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0)).withColumn("q", F.lit(0))
    got = lexical_nra.searched(docs.repartition(3), asked, 10, block_terms=block).collect()
    assert collections.Counter(map(tuple, got)) == brute_search(rows, items)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_nra.searched(docs.limit(0), items).collect() == []
    assert lexical_nra.searched(docs, items.limit(0)).collect() == []
    assert lexical_nra.searched(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(1, 5), st.integers(1, 4))
def test_nra_equals_full_sums(seed, n_lists, k, depth):
    r = np.random.default_rng(seed)
    size = 30
    full = r.integers(0, 6, (n_lists + 1, size)) * (r.random((n_lists + 1, size)) < 0.5)
    full[0] = 0
    t, d = np.nonzero(full)
    lists = lexical_nra.impact_sorted(t, d, full[t, d], n_lists)
    former = np.sort(r.integers(1, 12, r.integers(0, k + 1)))
    docs, scores = lexical_nra.nra(lists, list(range(1, n_lists + 1)), k, size, former, depth)
    sums = full.sum(axis=0)
    ranked = sorted([*sums[sums > 0], *former], reverse=True)
    bar = ranked[k - 1] if len(ranked) >= k else 1
    assert dict(zip(docs, scores)) == {i: s for i, s in enumerate(sums) if s >= bar}


def test_nra_stops_before_the_end_of_long_lists():
    impact = np.arange(100_000, 0, -1)
    lists = lexical_nra.Lists(np.array([0, 0, 100_000]), np.arange(100_000), impact)
    docs, scores = lexical_nra.nra(lists, [1], 3, 100_000, np.zeros(0, np.int64))
    assert sorted(docs)[:3] == [0, 1, 2] and set(scores) == {100_000, 99_999, 99_998}
    two = lexical_nra.impact_sorted(np.repeat([1, 2], 1000), np.tile(np.arange(1000), 2), np.r_[np.arange(1000, 0, -1), np.ones(1000, int)], 2)
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                read.append(key.stop - key.start)
            return np.asarray(super().__getitem__(key))

    two = two._replace(impact=two.impact.view(Counted))
    lexical_nra.nra(two, [1], 1, 1000, np.zeros(0, np.int64), 4)
    assert sum(read) < 100


# ---- alignment --------------------------------------------------------------------
def linear_groups(ends_a, ends_b):
    """Groups (a0, a1, b0, b1) by one walk over the common ends from left to right."""
    place_a, place_b = ({e: i + 1 for i, e in enumerate(ends)} for ends in (ends_a, ends_b))
    out, a0, b0 = [], 0, 0
    for e in ends_a:
        if e in place_b:
            out.append((a0, place_a[e], b0, place_b[e]))
            a0, b0 = place_a[e], place_b[e]
    return out


def divided(*texts):
    """Groups of texts (ends of both sides), found together."""
    ends, parts, a, b, byte = ([], []), [], 0, 0, 0
    for ends_a, ends_b in texts:
        ends[0].extend(byte + e for e in ends_a)
        ends[1].extend(byte + e for e in ends_b)
        parts.append((a, a + len(ends_a), b, b + len(ends_b)))
        a, b, byte = a + len(ends_a), b + len(ends_b), byte + ends_a[-1]
    return [tuple(g) for g in token_alignment.groups(np.array(ends[0]), np.array(ends[1]), np.array(parts)).tolist()]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=4), st.randoms(use_true_random=False), st.floats(0, 1), st.floats(0, 1))
def test_divide_and_conquer_equals_a_merge(sizes, r, p, q):
    texts = [([i for i in range(1, n) if r.random() < p] + [n], [i for i in range(1, n) if r.random() < q] + [n]) for n in sizes]
    want, a, b = [], 0, 0
    for ends_a, ends_b in texts:
        want += [(a + g[0], a + g[1], b + g[2], b + g[3]) for g in linear_groups(ends_a, ends_b)]
        a, b = a + len(ends_a), b + len(ends_b)
    assert divided(*texts) == want


def test_the_cut_nearest_to_the_middle():
    def cut(ends_a, ends_b):
        return token_alignment.common_ends(np.array(ends_a), np.array(ends_b), np.array([[0, len(ends_a), 0, len(ends_b)]])).tolist()

    ends = list(range(1, 10))
    assert cut(ends, ends) == [[5, 5]]
    assert cut(ends, [2, 9]) == [[2, 1]]
    assert cut(ends, [3, 6, 9]) == [[6, 2]]
    assert cut(ends, [4, 6, 9]) == [[4, 1]]
    assert cut([3, 9], [4, 9]) == [[-1, -1]]


def test_cutless_long_interval_is_one_group():
    a, b = list(range(2, 20_001, 2)), [*range(3, 20_000, 2), 20_000]
    assert divided((a, b)) == [(0, len(a), 0, len(b))]


def test_large_groups_are_linked_by_distinct_ids(monkeypatch):
    ids_a, ids_b, found = np.array([1, 2, 1, 3]), np.array([5, 5, 6, 7]), np.array([[0, 3, 0, 3], [3, 4, 3, 4]])
    want = collections.Counter((g, a * 10 + b) for g, (a0, a1, b0, b1) in enumerate(found) for a in ids_a[a0:a1] for b in ids_b[b0:b1])
    for limit in (4096, 2):
        monkeypatch.setattr(token_alignment, "LARGE_GROUP", limit)
        got = collections.Counter()
        for g, p, n in zip(*token_alignment.links(ids_a, ids_b, found, 10)):
            got[g, p] += n
        assert got == want


def brute_document(text, byte_bpe, pieces):
    """(groups as id lists) of one text, encoded whole."""
    none = []
    if not text:
        return none
    side = sides()
    a, b = byte_bpe.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    raw = (" " + text).encode()
    if any(b"".join(s.token[i] for i in ids) != raw for s, ids in zip(side, (a, b))):
        return none
    ends = [list(np.cumsum([len(s.token[i]) for i in ids])) for s, ids in zip(side, (a, b))]
    return [(a[a0:a1], b[b0:b1]) for a0, a1, b0, b1 in linear_groups(*ends)]


def brute_alignment(rows, byte_bpe, pieces):
    found = [(i, brute_document(t, byte_bpe, pieces)) for i, t in rows]
    links = [collections.Counter((x, y) for a, b in g for x in a for y in b) for _, g in found]
    count = collections.Counter(p for own in links for p in own)
    top = collections.defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [(i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()),
             sum(m for p, m in own.items() if count[p] == top[p[0]]), sum(m * count[p] for p, m in own.items()),
             hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g).encode()).hexdigest() if g else "")
            for (i, g), own in zip(found, links)]


def test_alignment_equals_brute_force(spark, docs, byte_bpe, pieces, monkeypatch):
    r = random.Random(3)
    rows = [(i, t) for i, t, _, _ in texts()] + [(100 + i, "".join(r.choices(ATOMS, k=r.randint(1, 25)))) for i in range(150)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("clash") for c in (*CLASHES, "block", "pair", "links", "pairs", "documents", "count", "best")})
    want = collections.Counter(brute_alignment(rows, byte_bpe, pieces))
    assert sum(n for (_, n, *_), k in want.items()) > 500
    for entries in (token_alignment.BLOCK_ENTRIES, 20):
        monkeypatch.setattr(token_alignment, "BLOCK_ENTRIES", entries)
        monkeypatch.setattr(token_alignment, "SLICE_BYTES", entries)
        monkeypatch.setattr(token_alignment, "REMEMBERED", entries)
        got = token_alignment.aligned(table.repartition(3), JSON, MODEL)
        assert collections.Counter(map(tuple, got.collect())) == want
    assert token_alignment.aligned(table.limit(0), JSON, MODEL).collect() == []


@functools.cache
def library():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


@settings(max_examples=400, deadline=None)
@given(STRANGE)
def test_byte_level_ids_are_the_librarys(text):
    assert byte_level_encode(JSON)(text) == library().encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(STRANGE)
def test_chunks_are_encoded_alone_as_in_the_text(text):
    a, b = sides()
    parts = token_alignment.chunks(text)
    assert " ".join(parts) == text
    if text:
        assert [i for x in a.encode([" " + p for p in parts]) for i in x] == a.encode([" " + text])[0]
        assert [i for x in b.encode(parts) for i in x] == b.encode([text])[0]


def test_queries_of_this_file_are_registered():
    assert {"op11_token_counts", "op12_lexical_search", "op13_token_alignment"} <= set(catalog.QUERIES)
