"""Benchmark decontamination by greedy string tiling.

A test item and a document are compared token by token.  Tiles are the longest
runs that both share; tiling marks the longest first, never overlapping, until
no shared run of five tokens is left, so a passage whose sentences stand in
another order is still covered.  The part of an item that its tiles cover is
its coverage; a document is contaminated if it covers half of some item.

Only documents that share enough five-token seeds with an item are tiled.  A
bit map of fixed size over the seed hashes of the benchmark, made by a grouped
``bit_or``, goes to every task and drops nearly all document seeds there; those
it lets through are joined with the seeds themselves.  The map's size does not
depend on the input: a larger benchmark fills it and more seeds reach the join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import _WORD_HASHES, bit_map, in_map, lean, narrowed, raw_texts, shingles, slices, whole_sequence

SEED = 5
COVERAGE = 0.5

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: A-Z to lower case, ASCII marks and white space to space
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of several texts in a row, and the tokens per text.

    A token is a run of ASCII letters, digits and bytes above 127.
    """
    words = [t.translate(_FOLD).split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter((h for w in words for h in map(_WORD_HASHES.__getitem__, w)), np.uint64, int(counts.sum())), counts


class _Rolling:
    """Karp-Rabin hashes of all windows of a token sequence, for any window length."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values * inverse[:n], dtype=np.uint64)])

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.powers[:n]


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows without a marked token."""
    total = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(total[size:] == total[: len(total) - size])


def tile(pattern: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (start in pattern, start in text, length), in the order they are marked.

    Ties go to the earlier place in the pattern, then in the text.
    """
    if len(pattern) < least or len(text) < least:
        return []
    roll_p, roll_t = _Rolling(pattern), _Rolling(text)
    mark_p, mark_t = np.zeros(len(pattern), bool), np.zeros(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(len(pattern), len(text)) // 2)
    while True:
        found: list[tuple[int, int, int]] = []
        longest = 0
        starts_p, starts_t = _free(mark_p, size), _free(mark_t, size)
        hash_p, hash_t = roll_p.windows(size)[starts_p], roll_t.windows(size)[starts_t]
        places: dict[int, list[int]] = {}
        for p, h in zip(starts_p.tolist(), hash_p.tolist()):
            places.setdefault(h, []).append(p)
        hits = np.flatnonzero(np.isin(hash_t, hash_p))
        for t, h in zip(starts_t[hits].tolist(), hash_t[hits].tolist()):
            for p in places[h]:
                # a run that begins earlier is found from its own start
                if p and t and not mark_p[p - 1] and not mark_t[t - 1] and pattern[p - 1] == text[t - 1]:
                    continue
                room = min(len(pattern) - p, len(text) - t)
                same = (pattern[p: p + room] == text[t: t + room]) & ~mark_p[p: p + room] & ~mark_t[t: t + room]
                run = room if same.all() else int(same.argmin())
                if run >= size:
                    found.append((run, p, t))
                    longest = max(longest, run)
        if longest > 2 * size:
            size = longest
            continue
        # longest first; of a run that an earlier tile cut, the free parts queue up again
        queue = [(-run, p, t) for run, p, t in found]
        heapq.heapify(queue)
        while queue:
            run, p, t = heapq.heappop(queue)
            taken = mark_p[p: p - run] | mark_t[t: t - run]
            if taken.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
                for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    if high - low >= size:
                        heapq.heappush(queue, (low - high, p + low, t + low))
                continue
            mark_p[p: p - run] = True
            mark_t[t: t - run] = True
            tiles.append((p, t, -run))
        if size > 2 * least:
            size //= 2
        elif size > least:
            size = least
        else:
            return tiles


def covered(pattern: np.ndarray, text: np.ndarray, least: int = SEED) -> int:
    return sum(run for _, _, run in tile(pattern, text, least))


def _item_seeds(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, counts = tokens(raw_texts(batch.column("text")))
            seeds, per = shingles(values, counts, least)
            # an item of fewer tokens has one seed, its whole sequence
            owner = np.repeat(np.arange(len(per)), per)
            ids = batch.column("item_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(seeds.view(np.int64)), pa.array(ids[owner]), pa.array(counts[owner])],
                names=["seed", "item_id", "n_tokens"])

    return run


def _windows(values: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of all windows of ``size`` tokens, hashed as an item of just these tokens is, and their texts."""
    full, per = shingles(values, counts, size)
    owner = np.repeat(np.arange(len(per)), per)
    keep = np.repeat(counts >= size, per)
    return whole_sequence(full[keep], size), owner[keep]


def _document_seeds(bits, least: int, short: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bits.value
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                values, counts = tokens(raw_texts(batch.column("text")))
                seeds, per = shingles(values, counts, least)
                owner = np.repeat(np.arange(len(per)), per)
                for more, texts in (_windows(values, counts, size) for size in short):
                    seeds, owner = np.concatenate([seeds, more]), np.concatenate([owner, texts])
                hit = np.flatnonzero(in_map(seen, seeds))
                if len(hit):
                    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[owner[hit]]
                    pairs = np.unique(np.stack([ids, seeds[hit].view(np.int64)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["doc_id", "seed"])

    return run


def _tiled(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                values, counts = tokens(raw_texts(batch.column("text")))
                ends = np.cumsum(counts)
                out: dict[str, list] = {k: [] for k in ("doc_id", "item_id", "n_tokens", "n_covered")}
                for doc, begin, end, items in zip(
                        batch.column("doc_id").to_pylist(), ends - counts, ends, batch.column("_items").to_pylist()):
                    for item in items:
                        pattern, _ = tokens([item["text"].encode()])
                        out["doc_id"].append(doc)
                        out["item_id"].append(item["item_id"])
                        out["n_tokens"].append(len(pattern))
                        out["n_covered"].append(covered(pattern, values[begin:end], min(least, len(pattern))))
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def overlaps(docs: DataFrame, items: DataFrame, least: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """Tiled coverage of items by documents: ``doc_id``, ``item_id``, ``n_tokens``, ``n_covered``.

    Holds every pair that reaches ``coverage``; pairs below it may be absent.
    Rows without an id, NULL texts and items without tokens match nothing; an item
    of fewer than ``least`` tokens matches by all of them in a row; repeated rows
    count once, with the larger coverage.  Empty tables give an empty result.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    seeds = stored(
        items.mapInArrow(_item_seeds(least), "seed long, item_id long, n_tokens long")
        .groupBy("seed", "item_id").agg(F.count("*").alias("_w"), F.max("n_tokens").alias("n_tokens")), "seeds")
    bits = spark.sparkContext.broadcast(bit_map(seeds.select("seed")))
    # lengths below ``least`` that occur: four at most
    short = [r["n_tokens"] for r in seeds.where(F.col("n_tokens") < least).select("n_tokens").distinct().collect()]
    hits = docs.mapInArrow(lean(_document_seeds(bits, least, short)), "doc_id long, seed long")
    # tiles cover c tokens with c / least seeds at the very least
    candidates = stored(
        hits.join(seeds, "seed").groupBy("doc_id", "item_id")
        .agg(F.sum("_w").alias("_hits"), F.max("n_tokens").alias("_n"))
        .where(F.col("_hits") * least >= F.col("_n") * coverage).select("doc_id", "item_id"), "candidates")
    wanted = candidates.join(items, "item_id").groupBy("doc_id").agg(
        F.collect_list(F.struct("item_id", "text")).alias("_items"))
    tiled = narrowed(docs, candidates.select("doc_id").distinct()).join(wanted, "doc_id").mapInArrow(
        lean(_tiled(least)), "doc_id long, item_id long, n_tokens long, n_covered long")
    return tiled.groupBy("doc_id", "item_id").agg(
        F.max(F.struct((F.col("n_covered") / F.col("n_tokens")).alias("c"), "n_covered", "n_tokens")).alias("_m")
    ).select("doc_id", "item_id", "_m.n_tokens", "_m.n_covered")


def contaminated(docs: DataFrame, items: DataFrame, least: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """Documents that cover ``coverage`` of some item.

    ``doc_id``, ``coverage`` (the largest), ``item_id`` (the smallest with it),
    ``n_items`` (how many items reach it).
    """
    share = F.col("n_covered") / F.col("n_tokens")
    found = overlaps(docs, items, least, coverage).where(share >= coverage)
    return found.groupBy("doc_id").agg(
        F.max(F.struct(share.alias("coverage"), (-F.col("item_id")).alias("item"))).alias("_m"),
        F.count("*").alias("n_items")
    ).select("doc_id", F.col("_m.coverage").alias("coverage"), (-F.col("_m.item")).alias("item_id"), "n_items")


def flag_documents(docs: DataFrame, items: DataFrame, least: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """One row per document: ``doc_id``, ``contaminated``, ``coverage`` (0 below the threshold), ``item_id``, ``n_items``."""
    found = stored(contaminated(docs, items, least, coverage), "contaminated")
    return docs.select(F.col("doc_id").cast("long")).join(found, "doc_id", "left").select(
        "doc_id", F.col("coverage").isNotNull().alias("contaminated"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "item_id",
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"))
