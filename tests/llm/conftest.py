import pytest
from pyspark.sql import functions as F

PROSE = ("The quick brown fox jumps over the lazy dog near the quiet river bank while seven old sailors "
         "sing about distant harbours and forgotten stars, again and again, until morning comes.")
CLASHES = ("kept", "own", "k", "hk", "hash", "norm", "sha", "chars", "block", "part", "fp", "m", "p", "found", "key", "near",
           "head", "host", "path", "says", "digest", "refers", "first", "whole", "salt", "number", "length", "piece")


def texts():
    out = [(1, PROSE, "en", "a"), (2, PROSE + "  ", "en", "a"), (3, PROSE, "en", "b"), (4, None, None, None), (5, "", "en", "a"),
           (6, " \n\t ", "de", "b"), (None, PROSE, "en", "a"), (7, PROSE, "en", "b"), (7, PROSE, "en", "b"),
           (8, PROSE.replace("fox", "cat"), None, "a"), (9, "日本語 テキスト é ü   x 🎈", "de", "b"), (10, "12 34 --", "de", "a"),
           (11, "wort für straße und äpfel mit übung " * 400, "de", "b"), (12, "a b c d e f g h " * 6 + PROSE, "en", "a"),
           (13, "x" * 70_000, "en", "b"), (14, "Some line here now.\nSome line here now.\n\n \nEnd | of * it.", "en", "a")]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    df = spark.createDataFrame([(i, t, l, s, None if t is None else len(t)) for i, t, l, s in texts()],
                               "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def pages(spark):
    rows = [(1, "http://WWW.Example.com/en/a?x#y", "<html><body><nav>Menu, one.</nav><article><h1>Head &amp; tail</h1><p>First, of all.<p>Second  one."
                                                    "<br>more</article><footer>End.</footer></body></html>"),
            (2, "https://example.com", "plain text &lt;b&gt;"), (3, None, None), (4, "no scheme/en/", ""), (5, "http://a.net/fr/", "<p>same"),
            (6, "http://com/x\r\ny", "<p>same"), (None, "http://b.example.com./en/", "<p>same"), (5, "http://a.net/fr/", "<p>same"),
            (7, "http://x.y.z.example.com/EN/", "<article>" + "<p>Long text, yes. " * 3000), (8, "://", "<p"), (9, "http://net/es/?q", "é" * 10)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in CLASHES})
