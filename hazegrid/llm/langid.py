"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are added up as log probabilities per language: the text
under a trigram model; the language that the markup or metadata declares; the
suffix of the address; and the share of each language at the host.  How far a
declaration or a suffix is to be trusted is estimated by grouped counts of what
the texts around it look like.  Host shares are smoothed level by level: a host
towards its domain, a domain towards the whole corpus.

All tables of counts are grouped aggregations over all rows.  The trigram model
and the list of languages are bounded by ``BUCKETS`` and ``LANGUAGES``; tables
per declaration, suffix, domain and host grow with the data and are joined.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import free_encoders, raw_texts, slices

BUCKETS = 1 << 15
#: more languages than this are refused
LANGUAGES = 256
#: text evidence of n trigrams counts as n / (1 + n / SATURATION): neighbouring trigrams are not independent
SATURATION = 200.0
#: strength of the level above when shares are smoothed, in rows
PULL = 20.0
#: likelihood of a text in no language: every bucket alike
EVEN = -float(np.log(BUCKETS))
#: a text must fit better than that by so much a trigram
MARGIN = 0.25
#: trigrams of a passage, which may be in another language than the rest
PASSAGE = 32
#: standard errors that a text's mean may lie below the limit of its language
SLACK = 3.0
MIN_POSTERIOR = 0.5

#: A-Z to lower case; other ASCII but letters to space
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of words, each word between spaces."""
    raw = np.frombuffer(b" " + b" ".join(text.translate(_FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def fold_of(text: bytes) -> int:
    """Half of the training texts to which a text belongs; equal texts share one."""
    return xxhash.xxh64_intdigest(text) & 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts per language and fold of one task, combined before they leave it."""
    free_encoders()
    counts: dict[tuple[str, int], np.ndarray] = {}
    for whole in batches:
        for batch in slices(whole, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), raw_texts(batch.column("text"))):
                key = lang, fold_of(text)
                if key not in counts:
                    counts[key] = np.zeros(BUCKETS, np.int64)
                counts[key] += np.bincount(trigrams(text), minlength=BUCKETS)
    for (lang, fold), c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), fold, np.int32)),
             pa.array(at.astype(np.int32)), pa.array(c[at])],
            names=["lang", "fold", "bucket", "n"])


class TextModel:
    """Log probability of each bucket under each language, learned apart on two folds of the texts.

    ``counts`` holds folds, buckets, languages.  A text is judged by the fold that
    it is not in, so neither it nor a copy of it speaks for itself.  ``usual`` and
    ``spread`` are mean and standard deviation, by language, of the log
    probability of one fold's trigrams under the other.
    """

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)
        total = np.maximum(counts.sum(axis=(0, 1)), 1)
        across = self.logs[::-1].astype(np.float64)
        self.usual = (counts * across).sum(axis=(0, 1)) / total
        self.spread = np.sqrt((counts * (across - self.usual) ** 2).sum(axis=(0, 1)) / total)

    def likelihood(self, text: bytes) -> tuple[np.ndarray, int, float, float]:
        """Mean log probability per language, number of trigrams, of different ones that weigh as much, and the fit.

        The fit is the mean log probability with each passage of ``PASSAGE``
        trigrams in its best language, so that a text in several fits as well.
        """
        codes = trigrams(text)
        if not len(codes):
            return np.zeros(len(self.languages)), 0, 0.0, 0.0
        logs = self.logs[1 - fold_of(text)]
        total, best = np.zeros(len(self.languages)), 0.0
        for low in range(0, len(codes), 1 << 16):
            found = logs[codes[low: low + (1 << 16)]]
            passages = np.add.reduceat(found, np.arange(0, len(found), PASSAGE), axis=0)
            total += passages.sum(axis=0, dtype=np.float64)
            best += float(passages.max(axis=1).sum(dtype=np.float64))
        n = np.bincount(codes).astype(np.float64)
        return total / len(codes), len(codes), len(codes) ** 2 / float(n @ n), best / len(codes)


def train_text_model(labelled: DataFrame) -> TextModel:
    """Trigram model of ``labelled`` (``lang``, ``text``); rows without either are passed over.

    The model holds the ``LANGUAGES`` languages with the most trigrams (of equal
    ones the first in alphabetical order), and none if no row has a language.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counted = rows.mapInArrow(_count, "lang string, fold int, bucket int, n long").groupBy("lang", "fold", "bucket").agg(
        F.sum("n").alias("n"))
    found = stored(counted, "trigrams")
    most = found.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    languages = sorted(r["lang"] for r in most.collect())
    place = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((2, BUCKETS, len(languages)))
    for batch in found.where(F.col("lang").isin(languages)).toArrow().to_batches():
        columns = [place[x] for x in batch.column("lang").to_pylist()]
        counts[batch.column("fold").to_numpy(), batch.column("bucket").to_numpy(), columns] = batch.column("n").to_numpy()
    return TextModel(languages, counts)


def _score(model, id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_encoders()
        fitted = model.value
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [fitted.likelihood(t) for t in raw_texts(batch.column("text"))]
                mean = pa.array([f[0].tolist() for f in found], pa.list_(pa.float64()))
                kept = [n for n in batch.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n) for n in kept), mean, pa.array([f[1] for f in found], pa.int64()),
                     pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.float64()),
                     pa.array([int(np.argmax(f[0])) if f[1] else None for f in found], pa.int32())],
                    names=[*kept, "_text", "n_trigrams", "n_apart", "_fit", "_top"])

    return run


def _counts(scored: DataFrame, key: str, n: int) -> DataFrame:
    """Rows per value of ``key`` whose text looks like each language, ``_c0`` to ``_c<n-1>``."""
    return scored.where(F.col(key).isNotNull() & F.col("_top").isNotNull()).groupBy(key).agg(
        *[F.sum((F.col("_top") == i).cast("double")).alias(f"_c{i}") for i in range(n)])


def _given_language(scored: DataFrame, key: str, base: Sequence[int], out: str) -> DataFrame:
    """log P(value | language) of each value of ``key``: its share among the texts that look like the language.

    Half a row is added to each count and the totals run over all rows, those
    without a value included, so a value seen once says little.
    """
    return _counts(scored, key, len(base)).select(key, F.array(*[
        F.log((F.col(f"_c{i}") + 0.5) / F.lit(total + 1.0)) for i, total in enumerate(base)]).alias(out))


def _smoothed(level: DataFrame, above: Sequence[Column], out: str) -> DataFrame:
    """Shares of each language at one level, pulled towards those of the level above."""
    n = len(above)
    size = sum((F.col(f"_c{i}") for i in range(1, n)), F.col("_c0"))
    return level.withColumn(out, F.array(*[
        (F.col(f"_c{i}") + F.lit(PULL) * above[i]) / (size + F.lit(PULL)) for i in range(n)])).drop(
        *[f"_c{i}" for i in range(n)])


def identify(rows: DataFrame, model: TextModel, id_name: str = "doc_id",
             min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """Language of every row of ``rows``: ``id_name``, ``text``, ``declared``, ``suffix``, ``domain``, ``host``.

    Returns ``id_name``, ``language`` (NULL if none is accepted), ``posterior``
    of the likeliest one, ``likeliest``, ``text_language`` (by the text alone),
    ``accepted``.  Evidence columns may be NULL and then say nothing.  A row is
    not accepted if its text holds no letters (empty and NULL texts too), if no
    language reaches ``min_posterior``, or if the text fits none: its fit
    must reach half way from ``EVEN`` to what is usual in the likeliest language,
    less ``SLACK`` standard errors, and ``EVEN`` by ``MARGIN``.  Ties go to the first language in
    alphabetical order.  Repeated rows each get their result; an empty table
    gives an empty result.  A model without languages accepts nothing: the
    other columns are NULL then.
    """
    spark = rows.sparkSession
    n = len(model.languages)
    if not n:
        nothing = {"language": "string", "posterior": "double", "likeliest": "string", "text_language": "string"}
        return rows.select(id_name, *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], F.lit(False).alias("accepted"))
    narrow = rows.select(id_name, "text", *[F.col(c).cast("string").alias(c) for c in ("declared", "suffix", "domain", "host")])
    schema = narrow.drop("text").schema
    schema.add("_text", T.ArrayType(T.DoubleType())).add("n_trigrams", "long").add("n_apart", "double").add("_fit", "double").add("_top", "integer")
    scored = stored(narrow.mapInArrow(_score(spark.sparkContext.broadcast(model), id_name), schema), "scored")

    whole = scored.where("_top IS NOT NULL").groupBy("_top").count().collect()
    total = sum(r["count"] for r in whole)
    base = [next((r["count"] for r in whole if r["_top"] == i), 0) for i in range(n)]
    shares = [(c + 1.0) / (total + n) for c in base]

    corpus = [F.lit(s) for s in shares]
    domains = _smoothed(_counts(scored, "domain", n), corpus, "_domain")
    parents = scored.where("host IS NOT NULL").groupBy("host").agg(F.min("domain").alias("domain"))
    hosts = _counts(scored, "host", n).join(parents, "host").join(domains, "domain", "left").withColumn(
        "_up", F.coalesce("_domain", F.array(*corpus)))
    hosts = _smoothed(hosts, [F.col("_up")[i] for i in range(n)], "_host").select("host", "_host")
    declared = _given_language(scored, "declared", base, "_declared")
    suffixes = _given_language(scored, "suffix", base, "_suffix")

    joined = scored.join(hosts, "host", "left").join(domains, "domain", "left").join(
        declared, "declared", "left").join(suffixes, "suffix", "left")
    flat = F.array(*[F.lit(0.0)] * n)
    prior = F.coalesce("_host", "_domain", F.array(*corpus))
    weight = F.col("n_trigrams") / (1 + F.col("n_trigrams") / F.lit(SATURATION))
    joined = joined.withColumns({
        "_prior": prior, "_d": F.coalesce("_declared", flat), "_s": F.coalesce("_suffix", flat), "_w": weight})
    logs = joined.withColumn("_log", F.array(*[
        F.col("_text")[i] * F.col("_w") + F.log(F.col("_prior")[i]) + F.col("_d")[i] + F.col("_s")[i] for i in range(n)]))
    best = F.array_max("_log")
    names = F.array(*[F.lit(x) for x in model.languages])
    place = F.array_position("_log", best).cast("int")
    half = F.element_at(F.array(*[F.lit((float(u) + EVEN) / 2) for u in model.usual]), place)
    error = F.element_at(F.array(*[F.lit(float(x)) for x in model.spread]), place) / F.sqrt(F.greatest("n_apart", F.lit(1.0)))
    fits = F.col("_fit") >= F.greatest(half - F.lit(SLACK) * error, F.lit(EVEN + MARGIN))
    result = logs.select(
        id_name, "n_trigrams", "_top", fits.alias("_fits"),
        F.element_at(names, place).alias("likeliest"),
        (F.lit(1.0) / F.aggregate("_log", F.lit(0.0), lambda a, x: a + F.exp(x - best))).alias("posterior"))
    accepted = (F.col("n_trigrams") > 0) & F.col("_fits") & (F.col("posterior") >= min_posterior)
    return result.select(
        id_name, F.when(accepted, F.col("likeliest")).alias("language"), "posterior", "likeliest",
        F.element_at(names, F.col("_top") + 1).alias("text_language"), accepted.alias("accepted"))


# --- evidence columns ---------------------------------------------------------

def address_evidence(url: Column) -> dict[str, Column]:
    """``suffix``, ``domain`` (last two labels) and ``host`` of an address; NULL without a host."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))
    return {
        "suffix": F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit("")),
        "domain": F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")),
        "host": host,
    }


def markup_language(markup: Column) -> Column:
    """Language that an ``html`` tag declares, its first part in lower case; NULL if none."""
    return F.nullif(F.lower(F.regexp_extract(markup, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def document_rows(docs: DataFrame) -> DataFrame:
    """Evidence of a table with ``doc_id``, ``text``, ``lang`` and ``source``.

    The declared language is that of an ``html`` tag in the text, or else the
    table's own ``lang``; the suffix is that of the first address in the text;
    the host is the source.
    """
    first = F.regexp_extract("text", r"(https?://[^\s\"'<>]+)", 1)
    return docs.select(
        F.col("doc_id").cast("long"), "text", F.coalesce(markup_language(F.col("text")), F.col("lang")).alias("declared"),
        address_evidence(first)["suffix"].alias("suffix"), F.lit(None).cast("string").alias("domain"),
        F.col("source").alias("host"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Evidence of a table with ``page_id``, ``url`` and ``html``; the text is what stands outside of tags."""
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<[^>]*>|&(?:amp|lt|gt|quot|apos|nbsp|copy|middot);", " ")
    at = address_evidence(F.col("url"))
    return pages.select(
        "page_id", body.alias("text"), markup_language(F.col("html")).alias("declared"),
        *[c.alias(k) for k, c in at.items()])
