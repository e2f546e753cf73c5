"""Log-probabilities of texts by an n-gram model in a log-frequency Bloom filter.

Counts are quantised on a logarithmic scale.  An n-gram of level q enters the
filter q times, once with each level from 1 on; a lookup probes level after
level until one is missing, and the last one found gives the count.  Levels are
never too low, and one too high with the probability that all probes of an
absent entry hit.

Each n-gram belongs to one block of 2^16 bits, each entry to one word of it.  Slices of text send their distinct
n-grams to buckets of blocks, packed; a task adds up one bucket after the other and fills its blocks, which
together are the filter that goes to the workers.  The
filter grows with the training tokens up to ``MAX_BITS``.  From there on a block
whose n-grams exceed its load starts its scale at the lowest level that fits.
Rarer n-grams, and those few levels above that a false hit might feign, then
stand in a table with their levels.  Slices of text ask it, bucket by bucket, for
every n-gram that the filter does not find well above that level, and get a level
each.  All counting covers all rows at any size.

Probabilities mix each order with the shorter one by a Dirichlet prior; the
shortest order adds one to each count and keeps one place for unseen words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import in_groups, lean, mix, raw_texts, slices

ORDER = 2
#: weight of the shorter context, in occurrences
PRIOR = 20.0
#: ratio between the counts of neighbouring levels
SCALE = 1.5
#: bits set per entry, all in one word, so that a lookup touches memory once
PROBES = 4
BLOCK_BITS = 1 << 16
WORDS = BLOCK_BITS // 64
#: most entries of a block: three fifths of its bits set
CAPACITY = int(BLOCK_BITS * -math.log(0.4) / PROBES)
#: bits of the filter per training token and order above the first, and per distinct token; and bits at most: 128 MB
BITS_PER_TOKEN, BITS_PER_TYPE = 7, 12
MAX_BITS = 1 << 30
#: words whose exact counts go to the workers, at most: 4 MB; the others are joined
HEAD = 1 << 18
#: n-grams of the training text per bucket, before equal ones are added up; a bucket has one block at least
BUCKET_GRAMS = 1 << 21
#: levels from a raised block's lowest one on that its table confirms
CONFIRM = 3
#: beyond this many buckets a task takes several
MAX_TASKS = 20_000

START, END = (np.uint64(xxhash.xxh64_intdigest(mark)) for mark in (b"\n", b" "))
_MUL = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = np.uint64(0xC2B2AE3D27D4EB4F)
_S32 = np.uint64(32)


def _least_counts() -> np.ndarray:
    """Smallest count of every level, from level 1 on."""
    return np.unique(np.ceil(SCALE ** np.arange(105)).clip(max=2.0 ** 60).astype(np.int64))


LEAST = _least_counts()
#: count that a level stands for: the middle of its range
VALUE = np.concatenate([[0.0], (LEAST + np.append(LEAST[1:] - 1, LEAST[-1])) / 2])


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEAST, counts, side="right")


# --- tokens and n-grams --------------------------------------------------------

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


def _short_hashes(data: bytes, at: np.ndarray, length: int) -> np.ndarray:
    """xxh64 of the ``length`` bytes from each place on, fewer than 32."""

    def read(kind: str, offset: int) -> np.ndarray:
        places = np.ndarray((len(data) - 8,), kind, data, strides=(1,))
        return places[at + offset].astype(np.uint64)

    h = np.full(len(at), _P5 + np.uint64(length), np.uint64)
    done = 0
    while done + 8 <= length:
        h = _turned(h ^ (_turned(read("<u8", done) * _P2, 31) * _P1), 27) * _P1 + _P4
        done += 8
    if done + 4 <= length:
        h = _turned(h ^ (read("<u4", done) * _P1), 23) * _P2 + _P3
        done += 4
    while done < length:
        h = _turned(h ^ (read("u1", done) * _P5), 11) * _P1
        done += 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> _S32)


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, each between its start and its end, and the index of every start.

    Words are split at space and the bytes 9 to 13; only A-Z are lower-cased.
    """
    data = b"".join([b"\n", b"\n".join(texts), b"\n", bytes(8)]).lower()
    raw = np.frombuffer(data, np.uint8, len(data) - 8)
    word = (raw != 32) & ((raw - np.uint8(9)) > 4)
    turns = np.flatnonzero(word[1:] != word[:-1]) + 1
    at, sizes = turns[::2], turns[1::2] - turns[::2]
    values = np.empty(len(at), np.uint64)
    order = np.argsort(np.minimum(sizes, 32).astype(np.uint8), kind="stable")
    cuts = np.searchsorted(sizes[order], np.arange(1, 33)).tolist()
    for length in range(1, 32):
        same = order[cuts[length - 1]: cuts[length]]
        if len(same):
            values[same] = _short_hashes(data, at[same], length)
    for k in order[cuts[31]:].tolist():
        values[k] = xxhash.xxh64_intdigest(data[at[k]: at[k] + sizes[k]])
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.searchsorted(at, ends), prepend=0)
    out = np.empty(len(values) + 2 * len(texts), np.uint64)
    begins = np.cumsum(counts + 2) - (counts + 2)
    out[np.arange(len(values)) + 2 * np.repeat(np.arange(len(texts)), counts) + 1] = values
    out[begins] = START
    out[begins + counts + 1] = END
    return out, begins


def gram_hashes(tokens: np.ndarray, begins: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: hash of the n-gram that ends at a position, and the positions that have one.  A start has no word before it."""
    after = np.arange(len(tokens)) - np.repeat(begins, np.diff(begins, append=len(tokens)))
    h = mix(tokens + np.uint64(1))
    yield h, np.arange(len(tokens))
    for k in range(2, order + 1):
        longer = np.zeros_like(h)
        longer[1:] = mix(h[:-1] * _MUL + tokens[1:] + np.uint64(k))
        h = longer
        yield h, np.flatnonzero(after >= k - 1)


def _batch(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            tokens, begins = sequences(raw_texts(batch.column("text")))
            yield _batch(*np.unique(np.delete(tokens, begins), return_counts=True))


def _cuts(bucket: np.ndarray) -> list[int]:
    """Where runs of equal numbers begin, and the end."""
    return [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else []


def _grams(order: int, blocks: int, buckets: int):
    """Distinct n-grams of each slice with their numbers, one row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                tokens = sequences(raw_texts(batch.column("text")))
                h, n = np.unique(np.concatenate([h[at] for h, at in gram_hashes(*tokens, order)]), return_counts=True)
                bucket = _bucket_of(h, blocks, buckets)
                cuts = _cuts(bucket)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cuts[:-1]]), pa.array([h[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                     pa.array([zstandard.compress(n[a:b].astype("<u4").tobytes(), 1) for a, b in zip(cuts, cuts[1:])], pa.binary())],
                    names=["bucket", "h", "n"])

    return run


# --- the filter ------------------------------------------------------------------

def _block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return (((h >> _S32) * np.uint64(blocks)) >> _S32).astype(np.int64)


def _bucket_of(h: np.ndarray, blocks: int, buckets: int) -> np.ndarray:
    """Buckets are runs of blocks, blocks are ranges of hashes."""
    return _block_of(h, blocks) * buckets // blocks


def _scrambled(h: np.ndarray, lev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of an entry, and its word inside its block."""
    x = mix(h + lev.astype(np.uint64) * _LEVEL)
    return x, (x & np.uint64(WORDS - 1)).astype(np.int64)


def _bit(x: np.ndarray, probe: int) -> np.ndarray:
    return (x >> np.uint64(10 + 6 * probe)) & np.uint64(63)


def _places(h: np.ndarray, lev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word of an entry inside its block, and the bits that it sets there."""
    x, word = _scrambled(h, lev)
    mask = np.zeros(len(x), np.uint64)
    for j in range(PROBES):
        mask |= np.uint64(1) << _bit(x, j)
    return word, mask


class Block:
    """N-grams of one block; starts its scale at the lowest level that they leave room for."""

    def __init__(self, h: np.ndarray, counts: np.ndarray):
        self.h, self.levels, self.floor = h, level(counts), 1
        while np.maximum(self.levels - self.floor + 1, 0).sum() > CAPACITY:
            self.floor += 1

    def bits(self) -> bytes:
        kept = self.levels >= self.floor
        h, times = self.h[kept], self.levels[kept] - self.floor + 1
        within = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        x, word = _scrambled(np.repeat(h, times), within + self.floor)
        flags = np.zeros(BLOCK_BITS, bool)
        for j in range(PROBES):
            flags[word * 64 + _bit(x, j).astype(np.int64)] = True
        return np.packbits(flags, bitorder="little").tobytes()

    def rest(self) -> tuple[bytes, bytes]:
        """Hashes in order and levels of the n-grams that the bits leave out, and of those just above; none if they leave out none."""
        kept = (self.levels < self.floor + CONFIRM) & (self.floor > 1)
        return self.h[kept].tobytes(), zstandard.compress(self.levels[kept].astype(np.uint8).tobytes(), 1)


FILTER = "bucket long, block int, floor int, bits binary, h binary, levels binary"


def _fill(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in in_groups(batches, ["bucket"]):
            h = np.concatenate([np.frombuffer(x, "<u8") for x in group.column("h").to_pylist()])
            n = np.concatenate([np.frombuffer(zstandard.decompress(x), "<u4") for x in group.column("n").to_pylist()])
            order = np.argsort(h)
            h, n = h[order], n[order].astype(np.int64)
            begins = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            h, n = h[begins], np.add.reduceat(n, begins)
            number = _block_of(h, blocks)
            bucket = group.column("bucket")[0].as_py()
            cuts = _cuts(number)
            for begin, end in zip(cuts, cuts[1:]):
                block = Block(h[begin:end], n[begin:end])
                hashes, levels = block.rest()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket], pa.int64()), pa.array([number[begin]], pa.int32()), pa.array([block.floor], pa.int32()),
                     pa.array([block.bits()], pa.binary()), pa.array([hashes], pa.binary()), pa.array([levels], pa.binary())],
                    names=["bucket", "block", "floor", "bits", "h", "levels"])

    return run


@dataclass
class Filter:
    """Blocks of words of bits, the lowest level of each, and the size of the training text."""

    bits: np.ndarray
    floors: np.ndarray
    tokens: int
    types: int
    order: int

    def counts(self, h: np.ndarray, asked: np.ndarray | None = None, answers: np.ndarray | None = None) -> np.ndarray:
        """Count of each n-gram by its hash; 0 if unseen.  ``answers`` are the levels of those ``asked`` (in order) of the table."""
        found = self.levels(h)
        if asked is not None:
            unsure = self.unsure(h, found)
            found[unsure] = answers[np.searchsorted(asked, h[unsure])]
        return VALUE[found]

    def unsure(self, h: np.ndarray, found: np.ndarray) -> np.ndarray:
        """N-grams whose level the bits alone cannot tell: in raised blocks, those not found well above the lowest level."""
        floor = self.floors[_block_of(h, len(self.floors))]
        return np.flatnonzero((floor > 1) & (found < floor + CONFIRM))

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Level of each n-gram, from probes of one level after the other; 0 if not found."""
        block = _block_of(h, len(self.floors))
        lev = self.floors[block].astype(np.int64)
        found = np.zeros(len(h), np.int64)
        flat = self.bits.reshape(-1)
        base = block * WORDS
        alive = np.arange(len(h))
        while len(alive):
            word, mask = _places(h[alive], lev[alive])
            alive = alive[flat[base[alive] + word] & mask == mask]
            found[alive] = lev[alive]
            lev[alive] += 1
            alive = alive[lev[alive] < len(VALUE)]
        return found

    def false_positive_rate(self) -> float:
        """Chance that an absent entry seems present, on the mean over the words."""
        return float(((np.bitwise_count(self.bits) / 64) ** PROBES).mean())

    def to_ask(self, tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Hashes, in order, of the n-grams to ask the table for."""
        h = np.unique(np.concatenate([h[at] for h, at in gram_hashes(tokens, begins, self.order)]))
        return h[self.unsure(h, self.levels(h))]

    def log_probabilities(self, tokens: np.ndarray, begins: np.ndarray, asked: np.ndarray | None = None,
                          answers: np.ndarray | None = None) -> np.ndarray:
        """log10 of the probability of every token after those before it; 0 at the starts."""
        shorter = probability = None
        for h, at in gram_hashes(tokens, begins, self.order):
            distinct, place = np.unique(h[at], return_inverse=True)
            seen = np.zeros(len(tokens))
            seen[at] = self.counts(distinct, asked, answers)[place]
            if shorter is None:
                probability = (seen + 1) / (self.tokens + self.types + 1)
            else:
                before = shorter[at - 1]
                both = np.minimum(seen[at], np.minimum(before, shorter[at]))
                probability[at] = (both + PRIOR * probability[at]) / (before + PRIOR)
                seen[at] = both
            shorter = seen
        out = np.log10(probability)
        out[begins] = 0.0
        return out


def held_out(doc_id: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % parts == part


def train(docs: DataFrame, order: int = ORDER) -> tuple[Filter, DataFrame]:
    """The filter over all of ``docs`` and the exact count of each distinct token (``h``, ``n``).

    The driver takes the blocks, ``MAX_BITS`` in all at most.
    """
    model, counts, _, _ = _train(docs, order)
    return model, counts


def _train(docs: DataFrame, order: int) -> tuple[Filter, DataFrame, DataFrame, int]:
    """As ``train``, and the blocks with their tables (``FILTER``) and the number of buckets."""
    texts = docs.select("text")
    counts = stored(texts.mapInArrow(lean(_words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "tokens")
    size = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, types = size["n"] or 0, size["v"]
    wanted = min(MAX_BITS, tokens * BITS_PER_TOKEN * (order - 1) + types * BITS_PER_TYPE)
    blocks = 2 * max(1, -(-wanted // (2 * BLOCK_BITS)))
    buckets = min(blocks, max(1, -(-tokens * order // BUCKET_GRAMS)))
    grams = texts.mapInArrow(lean(_grams(order, blocks, buckets)), "bucket long, h binary, n binary")
    dealt = grams.repartition(min(buckets, MAX_TASKS), "bucket").sortWithinPartitions("bucket")
    rows = stored(dealt.mapInArrow(lean(_fill(blocks)), FILTER), "filter")
    bits, floors = np.zeros((blocks, WORDS), "<u8"), np.ones(blocks, np.int32)
    for batch in rows.select("block", "floor", "bits").toArrow().to_batches():
        for block, floor, data in zip(*(batch.column(c).to_pylist() for c in ("block", "floor", "bits"))):
            bits[block], floors[block] = np.frombuffer(data, "<u8"), floor
    return Filter(bits, floors, tokens, types, order), counts, rows, buckets


# --- n-grams that the bits leave out ------------------------------------------------

SLICES = "slice long, ids binary, held binary, sizes binary, data binary"


def _make_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for whole in batches:
        for batch in slices(whole, "text", 2 << 20):
            texts = raw_texts(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([batch.column("doc_id").to_numpy().astype("<i8").tobytes()]),
                 pa.array([batch.column("held_out").to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()]),
                 pa.array([np.array([len(t) for t in texts], "<i8").tobytes()]),
                 pa.array([zstandard.compress(b"".join(texts), 3)])],
                names=["slice", "ids", "held", "sizes", "data"])
            number += 1


def _each_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[bytes]]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            ends = np.cumsum(np.frombuffer(row["sizes"], "<i8")).tolist()
            data = zstandard.decompress(row["data"])
            yield row, [data[a:b] for a, b in zip([0, *ends], ends)]


ASKED = "bucket long, slice long, h binary, levels binary"


def _ask(model, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = Filter(*model.value)
        for row, texts in _each_slice(batches):
            h = filter_.to_ask(*sequences(texts))
            bucket = _bucket_of(h, len(filter_.floors), buckets)
            cuts = _cuts(bucket)
            if cuts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cuts[:-1]]), pa.array(np.full(len(cuts) - 1, row["slice"], np.int64)),
                     pa.array([h[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.nulls(len(cuts) - 1, pa.binary())],
                    names=["bucket", "slice", "h", "levels"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables of a bucket's blocks come first; the questions of the slices stream by."""
    bucket, parts, known, levels = None, [], np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    for batch in batches:
        out = []
        for number, slice_, h, lev in zip(*(batch.column(c).to_pylist() for c in ("bucket", "slice", "h", "levels"))):
            if number != bucket:
                bucket, parts, known = number, [], None
            h = np.frombuffer(h, "<u8")
            if lev is not None:
                parts.append((h, np.frombuffer(zstandard.decompress(lev), np.uint8)))
                continue
            if known is None:
                known, levels = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                order = np.argsort(known)
                # one more that no question has, so that every search ends on an entry
                known, levels = np.append(known[order], np.uint64(0)), np.append(levels[order], np.uint8(0))
            at = np.searchsorted(known[:-1], h)
            found = np.where(known[at] == h, levels[at], 0).astype(np.uint8)
            out.append((number, slice_, zstandard.compress(found.tobytes(), 1)))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))],
                names=["bucket", "slice", "levels"])


def _with_answers(rows: DataFrame, model, tables: DataFrame, buckets: int) -> DataFrame:
    """Slices of the texts (``SLICES``) with the levels, by bucket, of the n-grams that they ask for."""
    cut = stored(rows.select("doc_id", "held_out", "text").mapInArrow(lean(_make_slices), SLICES), "slices")
    asked = cut.mapInArrow(lean(_ask(model, buckets)), ASKED)
    rest = tables.select("bucket", F.lit(None).cast("long").alias("slice"), "h", "levels")
    dealt = rest.unionByName(asked).repartition(min(buckets, MAX_TASKS), "bucket").sortWithinPartitions(
        "bucket", F.col("slice").asc_nulls_first())
    answers = stored(dealt.mapInArrow(lean(_answer), "bucket long, slice long, levels binary"), "levels")
    return cut.join(answers.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("bucket", "levels"))).alias("_answers")), "slice", "left")


# --- scoring -----------------------------------------------------------------------

_RARITY = "floor(log2(n) * 8)"


def _head(counts: DataFrame) -> int:
    """Rarity class from which on the words go to the workers: at most ``HEAD`` words."""
    classes = counts.groupBy(F.expr(_RARITY).alias("class")).agg(F.count("*").alias("n")).collect()
    least, held = 1 << 30, 0
    for row in sorted(classes, reverse=True):
        held += row["n"]
        if held > HEAD:
            break
        least = row["class"]
    return least


SCORES = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<struct<h:long,n:long>>"


def _score(model, frequent):
    """Scores of slices of documents: rows of documents, or slices with answers."""

    def read(batches: Iterator[pa.RecordBatch], filter_: Filter) -> Iterator[tuple]:
        for whole in batches:
            if "slice" not in whole.schema.names:
                for batch in slices(whole, "text", 2 << 20):
                    tokens, begins = sequences(raw_texts(batch.column("text")))
                    yield batch.column("doc_id"), batch.column("held_out"), tokens, begins, filter_.log_probabilities(tokens, begins)
                continue
            for row, texts in _each_slice([whole]):
                tokens, begins = sequences(texts)
                asked = filter_.to_ask(tokens, begins)
                answers = np.frombuffer(b"".join(zstandard.decompress(a["levels"]) for a in row["_answers"] or []), np.uint8)
                if len(answers) != len(asked):
                    raise RuntimeError("a slice needs one answer per n-gram that it asked for")
                yield (pa.array(np.frombuffer(row["ids"], "<i8")), pa.array(np.frombuffer(row["held"], np.uint8) > 0), tokens, begins,
                       filter_.log_probabilities(tokens, begins, asked, answers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = Filter(*model.value)
        known_h, known_n = frequent.value
        gain = np.log10(known_n + 1.0)
        for ids, held_out_, tokens, begins, gains in read(batches, filter_):
            lengths = np.diff(begins, append=len(tokens))
            score = np.add.reduceat(gains, begins)
            base, known = np.zeros(len(tokens)), np.zeros(len(tokens), np.int64)
            counted = np.ones(len(tokens), bool)
            counted[begins] = False
            rare = counted
            if len(known_h):
                at = np.minimum(np.searchsorted(known_h, tokens), len(known_h) - 1)
                hit = (known_h[at] == tokens) & counted
                base[hit], known[hit] = gain[at[hit]], 1
                rare = counted & ~hit
            owner = np.repeat(np.arange(len(begins)), lengths)[rare]
            h = tokens[rare]
            order = np.lexsort((h, owner))
            owner, h = owner[order], h[order]
            first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            offsets = np.searchsorted(owner[first], np.arange(len(begins) + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays(
                [pa.array(h[first].view(np.int64)), pa.array(np.diff(first, append=len(h)))], names=["h", "n"])
            yield pa.RecordBatch.from_arrays(
                [ids, held_out_, pa.array(lengths - 1),
                 pa.array(np.add.reduceat(known, begins)), pa.array(np.add.reduceat(base, begins)), pa.array(score),
                 pa.ListArray.from_arrays(pa.array(offsets), pairs)],
                names=["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare"])

    return run


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """log10 probability of every text of ``docs`` (``doc_id``, ``text``), learned from those outside the held-out seventh.

    Returns ``doc_id``, ``held_out``, ``n_tokens`` (words and one end),
    ``n_known`` (tokens of the training texts), ``train_tokens``, ``base_score``
    (words by themselves, exact counts) and ``score`` (the model).

    NULL and empty texts consist of their end.  Rows without a ``doc_id`` are
    left out.  Repeated rows and ids count each and get a row each.  Without
    training texts all probabilities are 1 and scores 0.  An empty table gives
    an empty result; other columns are not read.  A text must fit in a task.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").withColumn("held_out", held_out())
    model, counts, tables, buckets = _train(rows.where("NOT held_out"), order)
    least = _head(counts)
    known = counts.where(F.expr(_RARITY) >= least).toArrow()
    h, n = (np.concatenate([np.zeros(0, np.int64), *(b.column(c).to_numpy() for b in known.to_batches())]) for c in ("h", "n"))
    by_hash = np.argsort(h.view(np.uint64))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((model.bits, model.floors, model.tokens, model.types, model.order))
    frequent = context.broadcast((h.view(np.uint64)[by_hash], n[by_hash]))
    texts = rows.select("doc_id", "held_out", "text")
    if (model.floors > 1).any():
        texts = _with_answers(rows, shared, tables, buckets)
    scored = stored(texts.mapInArrow(lean(_score(shared, frequent)), SCORES)
                    .withColumn("_row", F.monotonically_increasing_id()), "scores")
    # a word without training occurrences adds log10(0 + 1) and is not known: only matches matter
    matched = scored.select("_row", F.inline("rare").alias("h", "_times")).join(counts.where(F.expr(_RARITY) < least), "h")
    rest = matched.groupBy("_row").agg(
        F.sum(F.col("_times") * F.log10(F.col("n") + 1)).alias("_gain"), F.sum("_times").alias("_seen"))
    return scored.join(rest, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("_seen", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_gain", F.lit(0.0)) - F.col("n_tokens") * math.log10(model.tokens + model.types + 1)).alias("base_score"),
        "score")
