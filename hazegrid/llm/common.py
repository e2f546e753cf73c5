"""Small helpers that several operators share: text access, hashing, encoding."""

from __future__ import annotations

import ctypes
import gc
import os
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare

#: a worker forgets its cached words beyond this many; results do not depend on it
CACHE_WORDS = 1_000_000
#: the same for word hashes, which are cheap to make again
CACHE_HASHES = 200_000
#: longer words are hashed each time
CACHE_BYTES = 48

_MUL1 = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xD6E8FEB86659FD93)
_S32 = np.uint64(32)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; a bijection."""
    h = h ^ (h >> _S32)
    h = h * _MUL2
    h ^= h >> _S32
    h *= _MUL2
    h ^= h >> _S32
    return h


def raw_texts(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes; NULL becomes empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about ``limit`` bytes of text; one row may exceed it."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if sizes.sum() <= limit:
        if batch.num_rows:
            yield batch
        return
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    yield batch.slice(begin)


class WordHashes(dict):
    """64-bit hash of each distinct word, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_HASHES:
                self.clear()
            self[word] = value
        return value


_WORD_HASHES = WordHashes()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of several texts in a row, and the words per text.

    Only A-Z are lower-cased; words are split at space and the bytes 9 to 13.
    """
    words = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    values = np.fromiter(
        (h for w in words for h in map(_WORD_HASHES.__getitem__, w)), np.uint64, int(counts.sum()))
    return values, counts


def shingles(values: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words, text by text, and the shingles per text.

    A text with fewer words gives one shingle, its whole sequence; none without words.
    """
    n = len(values)
    ends = np.cumsum(counts)
    begins = ends - counts
    per_text = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    h = np.zeros(n, np.uint64)
    for j in range(size):
        if n > j:
            h[: n - j] = mix(h[: n - j] + values[j:] * _MUL1 + np.uint64(j + 1))
    out_begin = np.cumsum(per_text) - per_text
    index = np.repeat(begins - out_begin, per_text) + np.arange(int(per_text.sum()))
    out = h[index]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        v = np.zeros(1, np.uint64)
        for j, at in enumerate(range(begins[i], ends[i])):
            v = mix(v + values[at: at + 1] * _MUL1 + np.uint64(j + 1))
        out[out_begin[i]] = whole_sequence(v, int(counts[i]))[0]
    return out, per_text


def whole_sequence(windows: np.ndarray, size: int) -> np.ndarray:
    """Hashes of sequences of ``size`` words from those of full windows: shorter sequences hash apart from full shingles."""
    return mix(windows + np.uint64(size) * _MUL2)


def flatten_sets(hashes: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, one text after the other, and their numbers."""
    sizes = np.zeros(len(per_text), np.int64)
    parts, at = [], 0
    for i, n in enumerate(per_text.tolist()):
        if n:
            part = np.unique(hashes[at: at + n])
            parts.append(part)
            sizes[i] = len(part)
            at += n
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), sizes


def in_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of each run of equal ``keys`` in sorted Arrow batches; keys are whole numbers without NULL.

    A run is held whole, so callers bound the number of rows per key.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for begin, end in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[begin] for c in columns)
            if held and key != last:
                yield _one(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = key
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


# --- bit maps -----------------------------------------------------------------

#: bits of a map over hashes, as a power of two: 8 MB
MAP_BITS = 26


def bit_map(hashes: DataFrame) -> np.ndarray:
    """Map of fixed size over the first column, 64-bit hashes: at most 2^(MAP_BITS - 6) rows come to the driver.

    It answers "surely not" or "perhaps"; more hashes make "perhaps" likelier and
    the map no larger.
    """
    name = hashes.columns[0]
    place = F.shiftrightunsigned(F.col(name), 64 - MAP_BITS)
    rows = hashes.select(
        F.shiftright(place, 6).alias("word"),
        F.expr(f"shiftleft(1L, int(shiftrightunsigned(`{name}`, {64 - MAP_BITS}) & 63))").alias("bit")
    ).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (MAP_BITS - 6), "<i8")
    for batch in rows.toArrow().to_batches():
        out[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
    return out.view(np.uint8)


def in_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes.view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    return ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)


def narrowed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of the documents that a join with ``ids`` can meet, and perhaps a few more.

    Drops the others where they are read, so that a join moves only texts in question.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(ids.select(F.xxhash64(ids.columns[0]).alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = pa.array(in_map(bits.value, batch.column("_h").to_numpy()))
            yield batch.select(["doc_id", "text"]).filter(kept)

    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("_h")).mapInArrow(run, "doc_id long, text string")


# --- tokens ------------------------------------------------------------------

class Encoder(dict):
    """Token ids of whole texts by a tokenizer file whose words never cross white space.

    The library encodes every distinct piece between ASCII white space once per
    worker and this dictionary remembers it; a text's ids are those of its pieces
    in a row.  That holds for a tokenizer that drops white space before its merges
    and lower-cases, as ``word_bpe_49k.json`` does; texts that hold ``<|`` (the
    opening of a special token) go to the library whole.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = self.tokenizer.model.tokenize

    def _whole(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: bytes) -> bytes:
        if piece.isalpha():  # ASCII letters only: nothing to normalise or split
            ids = [t.id for t in self.split(piece.decode())]
            found = struct.pack(f"<{len(ids)}I", *ids)
        elif piece[-1:] in (b".", b",") and piece[-2:-1].isalpha():
            # a letter before one closing mark: two words of the tokenizer
            found = self[piece[:-1]] + self[piece[-1:]]
        else:
            found = self._whole(piece)
        if len(piece) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[piece] = found
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        get = self.__getitem__
        return [self._whole(t) if b"<|" in t else b"".join(map(get, t.lower().split())) for t in texts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process for a tokenizer file."""
    _WORD_HASHES.clear()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def free_encoders() -> None:
    """Give up what earlier tasks left in this worker process: encoders, and memory that is free but still held."""
    _ENCODERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for one task, in a worker that holds as little as it can before and afterwards."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_encoders()
        yield from run(batches)
        _WORD_HASHES.clear()
        free_encoders()

    return task


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- connected components ----------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (``a``, ``b``): rows (``node``, ``component``), the smallest member.

    Alternates the two star steps until nothing changes.  Every step takes a
    minimum per node, combined before the shuffle, and an equi-join, so a node
    with very many links is split by adaptive execution.  Each round is cut off
    by a checkpoint.  Links of a node to itself count as a node of its own.
    """
    from ..session import checkpointed

    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    links = checkpointed(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct()
        )
        links = checkpointed(small)
        # settled when every node points at a node that points nowhere, as before
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None and tuple(now) == before:
            break
        before = tuple(now)
    return nodes.join(links, nodes["node"] == links["u"], "left").select(
        "node", F.coalesce("v", "node").alias("component"))
