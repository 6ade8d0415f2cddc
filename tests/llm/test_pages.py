"""Operators on pages: url rules, WARC packages, main text."""
import base64
import collections
import hashlib
import io
import re
import struct
import tracemalloc
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rolefit.llm import html_paths, url_rules, warc_zip

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("net", "/fr/", "block"), ("x.y.z.example.com", "/E", "block"), ("example.com", "/en/a", "allow"), ("example.com", "/en/a", "block"), ("", "/", "block")]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = "".join(c.lower() if c.isascii() else c for c in raw), re.match(r"[^?#]*", rest[len(raw):])[0]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_rules(spark, pages):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "ample.com", "net", "x.net", "x.y.z.example.com", "com.net", "EXAMPLE.com:80", ""]
    paths = ["", "/", "/en", "/en/", "/en/abc", "/en/b?x", "/E/", "/es/", "/fr/#t", "/espa", "?q/en/"]
    urls = [f"{s}://{h}{p}" for s in ("http", "x") for h in hosts for p in paths]
    many = spark.createDataFrame(list(enumerate(urls, 1000)), "page_id long, url string").unionByName(pages.select("page_id", "url"))
    got = collections.Counter(tuple(r) for r in url_rules.judged(many, rules).select("page_id", "host", "path", "rule", "verdict").collect())
    want = collections.Counter((r.page_id, *brute_url(r.url)) for r in many.collect())
    assert got == want
    assert url_rules.judged(pages.filter("false"), rules).count() == 0
    assert {r.verdict for r in url_rules.judged(pages, rules.filter("false"), default="block").collect()} == {"block"}


def test_packages_round_trip(pages):
    got = warc_zip.round_trip(pages, with_payload=True).collect()
    src = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, h in src:
        if i is not None:
            first[h] = min(first.get(h, i), i)
    want = collections.Counter()
    for i, h in src:
        of = first.get(h)
        back = i != of
        want[i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if back else "response", of if back else None] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    assert all(r.payload is None if r.record_type == "revisit" else len(r.payload) == r.payload_bytes for r in got)
    assert {r.record_type for r in warc_zip.round_trip(pages, min_revisit=10**9).collect()} == {"response"}
    assert warc_zip.round_trip(pages.filter("false")).count() == 0


def zip64(names_and_bodies, comment=b""):
    """A ZIP file whose directory has 64-bit fields only."""
    out, central = io.BytesIO(), b""
    for name, body in names_and_bodies:
        at = out.tell()
        out.write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(body), len(body)) + body)
        extra = struct.pack("<HH4s", 0x9999, 4, b"abcd") + struct.pack("<HHQQQ", 1, 24, len(body), len(body), at)
        central += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    start = out.tell()
    out.write(central)
    end = out.tell()
    n = len(names_and_bodies)
    out.write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(central), start) + struct.pack("<IIQI", 0x07064B50, 0, end, 1))
    out.write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(comment)) + comment)
    return out.getvalue()


@pytest.mark.parametrize("comment", [b"", b"a comment with PK in it"])
def test_zip64_directory(comment):
    raw = zip64([(b"one", b"first body"), (b"archive/two", b"x" * 1000)], comment)
    found = warc_zip.members(io.BytesIO(raw), len(raw))
    assert {k: raw[m.start: m.start + m.size] for k, m in found.items()} == {"one": b"first body", "archive/two": b"x" * 1000}


def test_plain_zip_directory_and_broken_files():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a", b"hello")
        z.writestr("b", b"y" * 70000, zipfile.ZIP_DEFLATED)
        z.comment = b"note"
    raw = b.getvalue()
    found = warc_zip.members(io.BytesIO(raw), len(raw))
    assert raw[found["a"].start: found["a"].start + found["a"].size] == b"hello" and found["b"].method == 8
    with pytest.raises(ValueError):
        warc_zip.members(io.BytesIO(b"PK no directory here, none at all"), 33)


def test_main_text(pages):
    got = {r.page_id: r for r in html_paths.extracted(pages).collect()}
    assert got[1].text == "Head & tail\n\nFirst, of all.\n\nSecond one. more"
    assert got[2].text == "plain text <b>" and got[3].text == "" and got[4].text == "" and got[5].text == "same"
    assert got[7].text.count("\n\n") == 2999 and all(r.n_chars == len(r.text) for r in got.values())
    assert html_paths.extracted(pages).count() == pages.count()


def test_parts_left_out():
    page = """<body class="has-sidebar-no"><header>Site</header><div id="cookie-notice">We use cookies, yes.</div><div class="sidebar"><p>Hot, hot: news.</p></div>
    <div class="post"><h1>Title</h1><p>One, <a href=x>a link</a> and text. Good.<p>Two&nbsp;par;<ul><li>Item, one.<li>Two</ul><div class="share">Share!</div><h2>Sub</h2><p>Yes.</div>
    <section class="comments"><p>I like it, very much!</p></section><form>Sign up, now.</form><script>if (a<b) x="</p>"</script><!-- no, no --><footer>(c)</footer>"""
    assert html_paths.main_text(page) == "Title\n\nOne, a link and text. Good.\n\nTwo par;\n\nItem, one.\n\nTwo\n\nSub\n\nYes."


SENTENCES = [f"Sentence {i} is a long one with many words, and it goes on: about harbours and stars." for i in range(6)]


def _p(a, b):
    return "".join(f"<p>{x}</p>" for x in SENTENCES[a:b])


@pytest.mark.parametrize("page, want", [
    (f"<form id=f><nav><a href=x>Home</a></nav><div>{_p(0, 6)}</div><div class=ad>Buy, now.</div><footer>(c) us.</footer></form>", SENTENCES),
    ("".join(f'<div class="elementor-widget elementor-widget-text-editor">{_p(i, i + 1)}</div>' for i in range(6)) + "<footer>(c) us.</footer>", SENTENCES),
    (f'<article><section>{_p(0, 3)}</section><section id="legal"><h2>Law</h2>{_p(3, 5)}</section><p class="notice">{SENTENCES[5]}</p>'
     f'<div class="share">Share!</div><div class="ad">{SENTENCES[0]}</div></article>', [*SENTENCES[:3], "Law", *SENTENCES[3:]]),
    (f"<div class=legal>{_p(0, 2)}</div><div class=footer>{_p(2, 3)}</div><div class=cookies>{_p(3, 4)}</div>", SENTENCES[:2]),
    (f"<article>{_p(0, 2)}</article><div class=comments>{_p(2, 6)}</div>", SENTENCES[:2]),
    (f"<form><article>{_p(0, 2)}</article><div class=comments>{_p(2, 6)}</div></form>", SENTENCES[:2]),
    ("<nav><a href=x>Home, sweet home.</a></nav>", [])])
def test_declared_parts_with_the_text(page, want):
    assert html_paths.main_text(f"<html><body>{page}</body></html>") == "\n\n".join(want)


def test_minified_links_of_the_article():
    tags = ["<article>", "<h2>", "<a href=x>Title</a>", "</h2>", *(f"<p>{x}</p>" for x in SENTENCES), "<ul>", "<li>", "<a href=y>Source one</a>", "</li>",
            "<li>", "<a href=z><b>Source two</b></a>", "</li>", "</ul>", "</article>", "<ul>", "<li>", "<a href=u>Elsewhere</a>", "</li>", "</ul>"]
    want = "\n\n".join(["Title", *SENTENCES, "Source one", "Source two"])
    for gap in ("", "\n  "):
        assert html_paths.main_text(f"<html><body>{gap.join(tags)}</body></html>") == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=list("<>/ap=\"' b!-&;\n"), max_size=60))
def test_any_markup_is_read(page):
    assert isinstance(html_paths.main_text(page), str)


def _renamed(page):
    """The page without telling names: every sectioning element is a div, no class or id."""
    page = re.sub(r"<(/?)(nav|footer|article|aside|header|main)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"""\s(?:class|id|role)=("[^"]*"|'[^']*')""", "", page)


def test_ratios_alone_find_the_article(spark):
    """Of pages without telling names the ratios find what the names show; without ratios (all text) they would not."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r.html]
    both = missed = wrong = everything = 0
    for page in pages:
        want = collections.Counter(html_paths.main_text(page).split())
        got = collections.Counter(html_paths.main_text(_renamed(page)).split())
        both += (shared := sum((want & got).values()))
        missed += sum(want.values()) - shared
        wrong += sum(got.values()) - shared
        everything += " ".join(n.text for n in html_paths.parsed(_renamed(page)).nodes).split() == list(got.elements())
    assert len(pages) > 200 and both / (both + wrong) > 0.98 and both / (both + missed) > 0.98 and everything < len(pages) / 100


def test_names_are_a_factor_only():
    body = "".join(f"<p>A long sentence, number {k}, of the text; it goes on, and on, with words. And on.</p>" for k in range(4))
    page = f"<html><body><div><h1>Head</h1>{body}</div><div class='related'>See also: this, that.</div></body></html>"
    names = html_paths.main_text(page)
    assert names.startswith("Head\n\nA long") and "See also" not in names
    assert html_paths.main_text(page, html_paths.PathRule(factor=1.0)) == names  # the ratios leave it out as well


@pytest.mark.parametrize("values,weights,want", [([1, 1, 9, 9], [1, 1, 1, 1], 9), ([5], [2], 5), ([], [], 0), ([3, 3], [1, 4], 3),
                                                 ([1, 2, 8, 9], [1, 1, 1, 1], 8), ([9, 1, 8, 2], [1, 1, 1, 1], 8)])
def test_threshold(values, weights, want):
    assert html_paths.threshold(np.array(values, float), np.array(weights, float)) == want


def test_deep_pages_need_linear_memory():
    page = "<div>" * 30_000 + "Text, here." + "</div>" * 30_000
    tracemalloc.start()
    assert html_paths.main_text(page) == "Text, here."
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
