"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, fingerprint, infill, langid, licenses, lmscore, neardup, packing, quality, spelling, suffixdedup, tokenfile, urlrules,
)
from .common import table, tokenizer_path


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside the held-out fifth."""
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").where(~quality.held_out())
    model = quality.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in sequences of at most 4096 tokens."""
    _, placement = packing.pack_documents(table(spark, folder, "documents"), tokenizer_path())
    return placement


def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return neardup.near_duplicates(table(spark, folder, "documents"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, and whether it is accepted."""
    docs = table(spark, folder, "documents")
    model = langid.train_text_model(docs.select("lang", "text"))
    return langid.identify(langid.document_rows(docs), model)


def pages_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every page, with the trigram model of the documents."""
    model = langid.train_text_model(table(spark, folder, "documents").select("lang", "text"))
    return langid.identify(langid.page_rows(table(spark, folder, "pages")), model, "page_id")


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License notices of every document."""
    return licenses.licenses_per_document(table(spark, folder, "documents"))


#: verdict, host, start of the path
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's address; a page is labelled by the row of ``labels`` with its number."""
    pages = table(spark, folder, "pages")
    bad = {"quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.when(x, urlrules.BLOCK).when(~x, urlrules.ALLOW).alias("label"))
        for kind, x in bad.items()])))
    labelled = pages.select("page_id", "url").join(labels, "page_id")
    return urlrules.judge(pages, labelled, URL_RULES, list(bad)).drop("mined")


def op7_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the passages that earlier ones have."""
    return suffixdedup.digests(suffixdedup.remove_repeats(table(spark, folder, "documents")))


def op8_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every document beside those of its edited text and of the next document."""
    return fingerprint.against_next(table(spark, folder, "documents"))


def edited_copy_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Class of every document whose text few edits turn into another's: banding and edit distance of op8's operator."""
    return fingerprint.near_classes(table(spark, folder, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its largest tiled coverage of a benchmark item."""
    return decontaminate.flag_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all documents, read back from their token files."""
    return tokenfile.token_file_digests(table(spark, folder, "documents"), tokenizer_path())


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted form and root of every frequent word of all documents."""
    return spelling.spelling_variants(table(spark, folder, "documents"))


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document rearranged for infilling, and the text rebuilt from it, as digests."""
    return infill.digests(infill.fill_in_middle(table(spark, folder, "documents")))


def op13_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every document by the bigram model and by single words."""
    return lmscore.score_documents(table(spark, folder, "documents"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_language_id": op4_language_id,
    "op5_license_scan": op5_license_scan,
    "op6_url_filter": op6_url_filter,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_token_files": op10_token_files,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_lm_scoring": op13_lm_scoring,
    "pages_language_id": pages_language_id,
    "edited_copy_classes": edited_copy_classes,
}

_OP3 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM members a JOIN members b ON a.h = b.h AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT reach.doc_id, sides.b FROM reach JOIN sides ON reach.seen = sides.a),
least AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least USING (doc_id)
"""

_OP7 = """
WITH n AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, array_slice(b, i, i + 49) AS s FROM (SELECT doc_id, b, unnest(range(1, n - 48)) AS i FROM n WHERE n >= 50)),
earliest AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
hit AS (SELECT w.doc_id, w.i FROM w JOIN earliest ON w.s = earliest.s WHERE m < w.doc_id),
turn AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM turn),
gone AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM run GROUP BY doc_id, k),
seg AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS f, a AS t FROM gone
  UNION ALL SELECT n.doc_id, coalesce(max(z), 1), any_value(n) + 1 FROM n LEFT JOIN gone ON n.doc_id = gone.doc_id GROUP BY n.doc_id),
kept AS (
  SELECT seg.doc_id, string_agg(CASE WHEN t > f THEN hex(array_slice(b, f, t - 1)) ELSE '' END, '' ORDER BY f) AS h
  FROM seg JOIN n ON seg.doc_id = n.doc_id GROUP BY seg.doc_id),
sums AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed FROM gone GROUP BY doc_id)
SELECT n.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(h)) AS kept_sha256
FROM n JOIN kept ON n.doc_id = kept.doc_id LEFT JOIN sums ON n.doc_id = sums.doc_id
"""

_OP12 = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS d FROM documents),
k AS (
  SELECT doc_id, t, length(t) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
    CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM h),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
o AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""

#: the others need a tokenizer, a fitted model, CRC-32 or a random walk, which SQL cannot express;
#: tests compare them with brute force
SQL: dict[str, str] = {"op3_minhash_near_dedup": _OP3, "op7_suffix_array_dedup": _OP7, "op12_fill_in_middle": _OP12}
