"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.llm import (exact_dedup, html_paths, language_id, lexical_nra, lm_backoff, packing, quality_rules, sentencepiece_unigram,
                         simhash, token_alignment, token_counts, url_rules, warc_zip)
from rolefit.sources.tables import read_table

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
PIECES = "piece_bpe_32k.model"
#: host, path, verdict: fixed values of the query.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"))


def fold(doc_id: str, folds: int, which: int) -> Column:
    """Whether crc32 of the id as text has this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == which, F.lit(False))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path(PIECES), "rb") as f:
        model = f.read()
    return sentencepiece_unigram.encoded(read_table(spark, sf_dir, "documents"), model)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_backoff.scored(read_table(spark, sf_dir, "documents"), fold("doc_id", 5, 1))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(str(r) for r in URL_RULES) + " AS t(host, path, verdict)")
    return url_rules.judged(read_table(spark, sf_dir, "pages"), rules)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID, 1024)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(read_table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4, 2)
    return language_id.identified(docs, language_id.fitted(docs.filter(~held_out)), held_out)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extracted(read_table(spark, sf_dir, "pages"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(read_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), 4096)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_nra.searched(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), 10)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.aligned(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_sentencepiece, op3_lm_scoring, op4_url_filters, op5_best_fit_packing, op6_simhash_near_dedup,
    op7_exact_dedup, op8_warc_zip, op9_language_id, op10_html_extraction, op11_token_counts, op12_lexical_search,
    op13_token_alignment)}

_WS = r"[\x20\x09-\x0D]"

ORACLES = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '{_WS}+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS k
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM again) GROUP BY r),
ln AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
nl AS (SELECT DISTINCT source, md5(t) AS k, pos, nm FROM (
         SELECT source, t, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS nm FROM (
           SELECT source, t, list_transform(string_split(t, chr(10)), lambda x: lower(trim(regexp_replace(x, '{_WS}+', ' ', 'g')))) AS ls FROM d))
       WHERE nm <> ''),
cnt AS (SELECT source, nm, len(string_split(nm, ' ')) < 3 AND length(nm) < 20 AS short, count(DISTINCT k) AS n, min(k) AS holder FROM nl GROUP BY source, nm),
hosts AS (SELECT source, count(DISTINCT md5(t)) AS n FROM d GROUP BY source),
gone AS (SELECT nl.source, nl.k, sum(len(string_split(nl.nm, ' '))) AS n
         FROM nl JOIN cnt ON nl.nm = cnt.nm AND nl.source IS NOT DISTINCT FROM cnt.source
         JOIN hosts ON nl.source IS NOT DISTINCT FROM hosts.source
         WHERE cnt.n > 20 AND (NOT short OR cnt.n > least(0.05 * hosts.n, 200)) AND nl.k <> cnt.holder GROUP BY nl.source, nl.k),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(gone.n, 0) AS BIGINT) AS removed
      FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)
      LEFT JOIN gone ON gone.k = md5(t) AND gone.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (removed > 0 AND n_words - removed < 0.3 * n_words) AS kept
FROM m""",
    "op4_url_filters": r"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                     ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (SELECT page_id, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k
         FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM p LEFT JOIN best ON p.page_id = best.page_id AND k = 1""",
    "op7_exact_dedup": rf"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{_WS}', '', 'g') AS norm FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d
      WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r""",
    "op8_warc_zip": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) // (CASE i % 4 WHEN 0 THEN 32768 WHEN 1 THEN 1024 WHEN 2 THEN 32 ELSE 1 END)) % 32), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f""",
    "op12_lexical_search": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM t),
n AS (SELECT r, doc_id, count(*) AS n FROM w GROUP BY r, doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
tf AS (SELECT r, term, count(*) AS tf FROM w GROUP BY r, term),
df AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, c GROUP BY term, docs),
q AS (SELECT i, item_id, unnest(list_distinct(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
      FROM (SELECT row_number() OVER () AS i, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark)),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms))))) AS BIGINT) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term) JOIN n USING (r), c GROUP BY i, item_id, r, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
