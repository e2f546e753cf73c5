"""Removal of passages of 50 bytes and more that an earlier document has, by suffix arrays.

Every 50-byte window of a text has one anchor, its smallest hashed 24-byte
string (the leftmost of equal ones).  Equal windows have equal anchors at equal
places.  Windows of one anchor whose starts lie in the same four bytes form a
unit; they all hold the same 47-byte core, and differ from other windows of the
unit by up to three bytes on either side.  So windows that might be equal meet
under the hash of their core, whatever documents they come from.

Texts that share a core but not the bytes around it are told apart by a suffix
array over those few bytes, with the core as one symbol: windows are equal if
their symbols are, and equal ones stand next to each other.  The array is built
in linear time by grouping: suffixes are grouped by their Lyndon prefixes,
groups are processed from the largest down, each moving the nearest smaller
suffixes before its members into groups of their own; then the order inside
each group follows from the order of the suffixes that come after, with no
renaming round.

Documents travel as blocks of about a megabyte, compressed.  A block sends
its distinct anchors to buckets, which answer with one bit each: seen elsewhere
or not.  It then sends its distinct units (core hash, outer bytes, smallest
document) for the anchors seen, and gets four bits each: which windows a smaller
document has.  So a passage in a third of all documents costs one entry per
block, not per document, and no text is sent to a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import in_groups, lean, mix, raw_texts

WINDOW = 50
ANCHOR = 24
PLACES = WINDOW - ANCHOR + 1
UNIT = 4
CORE = WINDOW - UNIT + 1
BLOCK_BYTES = 1 << 20
#: bytes of text per bucket of anchors or units
BUCKET_BYTES = 8 << 20
#: beyond this many buckets (eight terabytes) the buckets grow instead
MAX_BUCKET_BITS = 20
#: bits sent of an anchor's hash beyond those that choose the bucket
ANCHOR_BITS = 40
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_LOWER = np.uint64(0xFFFFFFFF)


# --- suffix arrays by grouping -------------------------------------------------

def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of whole numbers that end in a smallest one found nowhere else."""
    n = len(text)
    counts: dict[int, int] = {}
    for c in text:
        counts[c] = counts.get(c, 0) + 1
    begin, at = {}, 0
    for c in sorted(counts):
        begin[c] = at
        at += counts[c]
    size = [0] * n
    for c, b in begin.items():
        size[b] = counts[c]
    group = [begin[c] for c in text]
    free = dict(begin)
    order, place = [0] * n, [0] * n
    for i, c in enumerate(text):
        order[free[c]] = i
        place[i] = free[c]
        free[c] += 1

    # groups from the largest down; a group ends where the last one processed began
    smaller = [-1] * n
    end = n
    while end:
        start = group[order[end - 1]]
        met: dict[int, int] = {}
        for i in sorted(order[start:end]):
            p = i - 1
            # all suffixes passed on the way are in this group or larger ones, so they know their own pointer
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                met[p] = met.get(p, 0) + 1
        moves: dict[int, list[tuple[int, int]]] = {}
        for p, times in met.items():
            moves.setdefault(group[p], []).append((times, p))
        for old, moved in moves.items():
            moved.sort()
            top = old + size[old]
            first = top - len(moved)
            for k in range(len(moved) - 1, -1, -1):
                p, target = moved[k][1], first + k
                other, source = order[target], place[p]
                order[source], place[other] = other, source
                order[target], place[p] = p, target
            size[old] -= len(moved)
            k = 0
            while k < len(moved):
                run = k
                while run < len(moved) and moved[run][0] == moved[k][0]:
                    group[moved[run][1]] = first + k
                    run += 1
                size[first + k] = run - k
                k = run
        end = start

    # order inside the groups, from the smallest suffix up
    out = [-1] * n
    out[0] = n - 1
    done = [False] * n
    done[n - 1] = True
    filled = [0] * n
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[g + filled[g]] = j
            filled[g] += 1
            done[j] = True
            j = smaller[j]
    return out


_END, _BREAK, _MIDDLE, _BYTE = 0, 1, 2, 3


def smallest_owner(contexts: list[tuple[bytes, bytes, int]]) -> list[list[int]]:
    """Smallest document that has each window of each context.

    A context is the bytes left and right of a common core and its document; its
    windows take ``UNIT`` - 1 bytes around the core, the leftmost window first.
    """
    text: list[int] = []
    owner: list[tuple[int, int] | None] = []
    out: list[list[int]] = []
    for c, (left, right, _) in enumerate(contexts):
        windows = len(left) + len(right) - UNIT + 2
        out.append([0] * windows)
        owner += [(c, k) if k < windows else None for k in range(len(left) + len(right) + 2)]
        text += [b + _BYTE for b in left]
        text.append(_MIDDLE)
        text += [b + _BYTE for b in right]
        text.append(_BREAK)
    text.append(_END)
    owner.append(None)
    run: list[tuple[int, int]] = []
    last: list[int] = []
    for p in [*suffix_array(text), len(text) - 1]:
        if owner[p] is None and p != len(text) - 1:
            continue
        symbols = text[p: p + UNIT]
        if symbols != last or owner[p] is None:
            if run:
                least = min(contexts[c][2] for c, _ in run)
                for c, k in run:
                    out[c][k] = least
            run, last = [], symbols
        if owner[p] is not None:
            run.append(owner[p])
    return out


# --- anchors and units of a block ----------------------------------------------

class Block:
    """Texts of one block, smallest document first, in one byte array."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, raw: bytes):
        self.ids, self.sizes = ids, sizes
        self.n = len(raw)
        self.bytes = np.frombuffer(raw + bytes(WINDOW + 8), np.uint8)
        self.ends = np.cumsum(sizes)
        self.raw = raw

    @classmethod
    def read(cls, ids: bytes, sizes: bytes, data: bytes) -> Block:
        return cls(np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i8"), zstandard.decompress(data))

    def _eights(self) -> np.ndarray:
        """The eight bytes from each place on as one number."""
        out = np.empty(len(self.bytes) - 8, np.uint64)
        buffer = self.bytes.tobytes()
        for r in range(8):
            part = out[r::8]
            part[:] = np.ndarray(len(part), "<u8", buffer, r)
        return out

    def anchors(self) -> None:
        """Runs of windows with one anchor: first and last start, anchor place, anchor hash, text number."""
        n = self.n
        words = self.eights = self._eights()
        h = words[:n] * _FACTORS[0]
        for j, factor in zip((8, 16), _FACTORS[1:]):
            h += words[j: j + n] * factor
        h = mix(h)
        # upper half of the hash, then the place, so that the least is the leftmost of equal ones
        least = (h & ~_LOWER) | np.arange(n, dtype=np.uint64)
        width = 1
        # a block shorter than a window has none
        while n >= WINDOW and width < PLACES:
            step = min(width, PLACES - width)
            # the last ones have no whole window
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        at = np.full(n, -1, np.int64)
        # behind the start of a text's last window none starts
        starts = np.repeat(np.tile([True, False], len(self.sizes)), np.stack(
            [np.maximum(self.sizes - (WINDOW - 1), 0), np.minimum(self.sizes, WINDOW - 1)], axis=1).ravel())
        at[: len(least)] = least & _LOWER
        at[~starts] = -1
        turn = np.flatnonzero(np.diff(at, prepend=-1, append=-1))
        first = turn[:-1][at[turn[:-1]] >= 0] if len(turn) else turn
        last = turn[1:][at[turn[:-1]] >= 0] - 1 if len(turn) else turn
        self.run_first, self.run_last = first, last
        self.run_anchor = at[first]
        self.run_hash = h[self.run_anchor]
        self.run_text = np.searchsorted(self.ends, first, side="right").astype(np.int32)

    def anchor_codes(self, bucket_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shortened anchor hashes in order, which of them several documents have, and each run's number."""
        code = self.run_hash >> np.uint64(64 - bucket_bits - ANCHOR_BITS)
        codes, number = np.unique(code, return_inverse=True)
        low, high = np.full(len(codes), np.iinfo(np.int64).max), np.full(len(codes), np.iinfo(np.int64).min)
        doc = self.ids[self.run_text]
        np.minimum.at(low, number, doc)
        np.maximum.at(high, number, doc)
        return codes, low < high, number

    def units(self, runs: np.ndarray) -> None:
        """Units of the given runs, in text order: core hash, outer bytes, text, start of slot 0."""
        first, last, anchor = self.run_first[runs], self.run_last[runs], self.run_anchor[runs]
        q0, q1 = (anchor - last) // UNIT, (anchor - first) // UNIT
        count = q1 - q0 + 1
        which = np.repeat(np.arange(len(runs)), count)
        q = q0[which] + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        core = anchor[which] - UNIT * q
        low = np.maximum(first[which], core - (UNIT - 1))
        high = np.minimum(last[which], core)
        left, right = core - low, high + WINDOW - (core + CORE)
        # scrambled, since a small number would be made up for by the core's first byte
        h = mix(q.astype(np.uint64) + np.uint64(1))
        for j in (0, 8, 16, 24, 32, CORE - 8):
            h = mix(h + self.eights[core + j])
        outer = np.zeros(len(core), np.uint64)
        for k in range(UNIT - 1):
            byte = np.where(k < left, self.bytes[np.maximum(core - 1 - k, 0)], 0).astype(np.uint64)
            outer |= byte << np.uint64(8 * k)
            byte = np.where(k < right, self.bytes[core + CORE + k], 0).astype(np.uint64)
            outer |= byte << np.uint64(24 + 8 * k)
        outer |= (left.astype(np.uint64) << np.uint64(48)) | (right.astype(np.uint64) << np.uint64(52))
        self.unit_hash, self.unit_outer, self.unit_core = h, outer, core
        self.unit_low, self.unit_high = low, high
        self.unit_text = self.run_text[runs][which]
        # distinct units, each with its first occurrence, which is that of its smallest document
        both = mix(h + mix(outer))
        order = np.argsort(both)
        new = np.ones(len(order), bool)
        new[1:] = np.diff(both[order]) != 0
        index = np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order
        entry = np.zeros(len(order), bool)
        entry[index] = True
        rank = np.cumsum(entry) - 1
        self.entry_unit, self.unit_entry = np.flatnonzero(entry), np.empty(len(order), np.int64)
        self.unit_entry[order] = rank[index][np.cumsum(new) - 1]

    def entries(self, bucket_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each distinct unit, and the order that puts buckets together and keeps text order inside."""
        bucket = (self.unit_hash[self.entry_unit] >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else (
            np.zeros(len(self.entry_unit), np.int64))
        return bucket, np.argsort(bucket, kind="stable")

    def removed(self, bits: np.ndarray) -> np.ndarray:
        """Bytes that an earlier document has, from the four bits of each distinct unit."""
        doc = self.ids[self.unit_text]
        earlier = doc > doc[self.entry_unit[self.unit_entry]]
        known = bits[self.unit_entry]
        cover = np.zeros(self.n + 1, np.int32)
        for slot in range(UNIT):
            start = self.unit_core - slot
            hit = (start >= self.unit_low) & (start <= self.unit_high) & (earlier | ((known >> slot) & 1).astype(bool))
            np.add.at(cover, start[hit], 1)
            np.add.at(cover, start[hit] + WINDOW, -1)
        return np.cumsum(cover[:-1]) > 0


# --- jobs -----------------------------------------------------------------------

def _make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    number = context.partitionId() << 32
    ids: list[int] = []
    texts: list[bytes] = []
    held = 0

    def close() -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda k: ids[k])
        row = {
            "block": pa.array([number], pa.int64()),
            "ids": [np.array([ids[k] for k in order], "<i8").tobytes()],
            "sizes": [np.array([len(texts[k]) for k in order], "<i8").tobytes()],
            "data": [zstandard.compress(b"".join(texts[k] for k in order), 3)],
            "n_bytes": pa.array([held], pa.int64()),
        }
        ids.clear()
        texts.clear()
        return pa.RecordBatch.from_pydict(row)

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text"))):
            if texts and held + len(text) > BLOCK_BYTES:
                yield close()
                number, held = number + 1, 0
            ids.append(doc)
            texts.append(text)
            held += len(text)
    if texts:
        yield close()


BLOCKS = "block long, ids binary, sizes binary, data binary, n_bytes long"


def _each_block(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            number, ids, sizes, data, *rest = (
                batch.column(c)[k].as_py() for c in ("block", "ids", "sizes", "data", *more))
            block = Block.read(ids, sizes, data)
            block.anchors()
            yield number, block, *rest


def _messages(number: int, buckets: np.ndarray, payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets.astype(np.int64)), pa.array(np.full(len(buckets), number, np.int64)), pa.array(payloads, pa.binary())],
        names=["bucket", "block", "payload"])


MESSAGES = "bucket long, block long, payload binary"


def _cuts(sorted_buckets: np.ndarray) -> list[int]:
    if not len(sorted_buckets):
        return []
    return [0, *(np.flatnonzero(sorted_buckets[1:] != sorted_buckets[:-1]) + 1).tolist(), len(sorted_buckets)]


def _send_anchors(bucket_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _each_block(batches):
            codes, several, _ = block.anchor_codes(bucket_bits)
            bucket = codes >> np.uint64(ANCHOR_BITS)
            short = np.ascontiguousarray(codes).view(np.uint8).reshape(-1, 8)[:, :5]
            cuts = _cuts(bucket)
            payloads = [short[a:b].tobytes() + np.packbits(several[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
            if cuts:
                yield _messages(number, bucket[cuts[:-1]], payloads)

    return run


def _answer_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in in_groups(batches, ["bucket"]):
        parts, flags = [], []
        for payload in group.column("payload").to_pylist():
            # five bytes and one bit each
            n = len(payload) * 8 // 41
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :5] = np.frombuffer(payload, np.uint8, 5 * n).reshape(n, 5)
            parts.append(wide.view("<u8")[:, 0])
            flags.append(np.unpackbits(np.frombuffer(payload, np.uint8, offset=5 * n))[:n])
        codes, number, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        common = times > 1
        common[number[np.concatenate(flags) > 0]] = True
        ends = np.cumsum([len(p) for p in parts])
        answers = [np.packbits(common[number[e - len(p): e]]).tobytes() for p, e in zip(parts, ends)]
        yield pa.RecordBatch.from_arrays(
            [group.column("bucket"), group.column("block"), pa.array(answers, pa.binary())],
            names=["bucket", "block", "payload"])


def _flagged(block: Block, bucket_bits: int, answers: list[dict]) -> np.ndarray:
    """Runs whose anchor other documents have too."""
    codes, _, number = block.anchor_codes(bucket_bits)
    cuts = _cuts(codes >> np.uint64(ANCHOR_BITS))
    common = np.zeros(len(codes), bool)
    for a, b, answer in zip(cuts[:-1], cuts[1:], sorted(answers or [], key=lambda x: x["bucket"]), strict=True) if cuts else ():
        common[a:b] = np.unpackbits(np.frombuffer(answer["payload"], np.uint8))[: b - a]
    return np.flatnonzero(common[number])


def _pack_units(hashes: np.ndarray, outers: np.ndarray, docs: np.ndarray) -> bytes:
    """Message of one bucket: six bytes of each hash, then outer bytes and documents by column, compressed."""
    short = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :6]
    columns = np.ascontiguousarray(outers).view(np.uint8).reshape(-1, 8)[:, :7].T
    packed = zstandard.compress(columns.tobytes() + docs.astype("<i8").tobytes(), 1)
    return np.array([len(docs)], "<u4").tobytes() + short.tobytes() + packed


def _unpack_units(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(payload, "<u4", 1)[0])
    hashes, outers = np.zeros((n, 8), np.uint8), np.zeros((n, 8), np.uint8)
    hashes[:, :6] = np.frombuffer(payload, np.uint8, 6 * n, 4).reshape(n, 6)
    rest = zstandard.decompress(payload[4 + 6 * n:])
    outers[:, :7] = np.frombuffer(rest, np.uint8, 7 * n).reshape(7, n).T
    return hashes.view("<u8")[:, 0], outers.view("<u8")[:, 0], np.frombuffer(rest, "<i8", n, 7 * n)


def _send_units(bucket_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, answers in _each_block(batches, "_anchors"):
            block.units(_flagged(block, bucket_bits, answers))
            bucket, order = block.entries(bucket_bits)
            unit = block.entry_unit[order]
            hashes, outers = block.unit_hash[unit], block.unit_outer[unit]
            docs = block.ids[block.unit_text[unit]]
            cuts = _cuts(bucket[order])
            if cuts:
                yield _messages(number, bucket[order][cuts[:-1]], [
                    _pack_units(hashes[a:b], outers[a:b], docs[a:b]) for a, b in zip(cuts, cuts[1:])])

    return run


def _answer_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in in_groups(batches, ["bucket"]):
        parts = [_unpack_units(payload) for payload in group.column("payload").to_pylist()]
        sizes = [len(docs) for _, _, docs in parts]
        h, outer, doc = (np.concatenate(column) for column in zip(*parts))
        bits = _answer(h, outer, doc)
        ends = np.cumsum(sizes)
        answers = [bits[e - n: e].tobytes() for n, e in zip(sizes, ends)]
        yield pa.RecordBatch.from_arrays(
            [group.column("bucket"), group.column("block"), pa.array(answers, pa.binary())],
            names=["bucket", "block", "payload"])


def _answer(h: np.ndarray, outer: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows of each unit a smaller document has, one bit per slot."""
    out = np.zeros(len(h), np.uint8)
    by_hash = np.argsort(h)
    alone = np.ones(len(h) + 1, bool)
    alone[1:-1] = np.diff(h[by_hash]) != 0
    # a unit whose core nobody else has needs no order
    shared = by_hash[~(alone[1:] & alone[:-1])]
    order = shared[np.lexsort((doc[shared], outer[shared], h[shared]))]
    hs, os, ds = h[order], outer[order], doc[order]
    new_hash = np.ones(len(order), bool)
    new_hash[1:] = hs[1:] != hs[:-1]
    new_pair = new_hash.copy()
    new_pair[1:] |= os[1:] != os[:-1]
    pair = np.cumsum(new_pair) - 1
    first = np.flatnonzero(new_pair)
    least = ds[first]
    # smallest document of each window of each distinct (core, outer bytes)
    windows = np.repeat(least[:, None], UNIT, axis=1)
    per_hash = np.add.reduceat(new_pair, np.flatnonzero(new_hash)) if len(order) else np.zeros(0, np.int64)
    at = np.cumsum(per_hash) - per_hash
    for a, k in zip(at[per_hash > 1].tolist(), per_hash[per_hash > 1].tolist()):
        contexts, lefts = [], []
        for c in range(a, a + k):
            o = int(os[first[c]])
            left, right = o >> 48 & 15, o >> 52 & 15
            raw = o.to_bytes(8, "little")
            contexts.append((raw[:left][::-1], raw[3: 3 + right], int(least[c])))
            lefts.append(left)
        for c, (left, found) in enumerate(zip(lefts, smallest_owner(contexts))):
            for step, owner in enumerate(found):
                windows[a + c, left - step] = owner
    sorted_bits = ((windows[pair] < ds[:, None]) << np.arange(UNIT)).sum(axis=1).astype(np.uint8)
    out[order] = sorted_bits
    return out


def _clean(bucket_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, anchors, units in _each_block(batches, "_anchors", "_units"):
            block.units(_flagged(block, bucket_bits, anchors))
            bucket, order = block.entries(bucket_bits)
            bits = np.zeros(len(order), np.uint8)
            cuts = _cuts(bucket[order])
            for a, b, answer in zip(cuts[:-1], cuts[1:], sorted(units or [], key=lambda x: x["bucket"]), strict=True) if cuts else ():
                bits[order[a:b]] = np.frombuffer(answer["payload"], np.uint8)
            gone = block.removed(bits)
            texts, starts, ends = [], [], []
            for size, end in zip(block.sizes.tolist(), block.ends.tolist()):
                own = gone[end - size: end]
                if own.any():
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]])))
                    starts.append(turns[::2].tolist())
                    ends.append(turns[1::2].tolist())
                    texts.append(block.bytes[end - size: end][~own].tobytes())
                else:
                    starts.append([])
                    ends.append([])
                    texts.append(block.raw[end - size: end])
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ids), pa.array(block.sizes), pa.array(starts, pa.list_(pa.int64())),
                 pa.array(ends, pa.list_(pa.int64())), pa.array(texts, pa.binary())],
                names=["doc_id", "n_bytes", "starts", "ends", "kept"])

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Cut from ``docs`` (``doc_id``, ``text``) what a document with a smaller ``doc_id`` has.

    A byte goes if a 50-byte string covers it that also stands in a document with
    a smaller ``doc_id``, judged on the texts as they come in.  One row per
    document: ``doc_id``, ``n_bytes``, ``starts`` and ``ends`` of the maximal
    removed runs in bytes, ``kept`` (the bytes left).

    NULL texts count as empty; rows without a ``doc_id`` are left out; rows that
    repeat one are judged against smaller ids only, never against each other; an
    empty table gives an empty result; other columns are not read.  One text must
    fit into a task's memory.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    blocks = stored(rows.mapInArrow(lean(_make_blocks), BLOCKS), "blocks")
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(MAX_BUCKET_BITS, max(0, int(np.ceil(np.log2(max(1, total) / BUCKET_BYTES)))))
    n_buckets = 1 << bits
    light = blocks.drop("n_bytes")

    def answered(sent: DataFrame, answer) -> DataFrame:
        dealt = sent.repartition(min(n_buckets, 20_000), "bucket").sortWithinPartitions("bucket", "block")
        return stored(dealt.mapInArrow(lean(answer), MESSAGES), "answers").groupBy("block").agg(
            F.collect_list(F.struct("bucket", "payload")).alias("_a"))

    anchors = answered(light.mapInArrow(lean(_send_anchors(bits)), MESSAGES), _answer_anchors).withColumnRenamed("_a", "_anchors")
    flagged = light.join(anchors, "block", "left")
    units = answered(flagged.mapInArrow(lean(_send_units(bits)), MESSAGES), _answer_units).withColumnRenamed("_a", "_units")
    return flagged.join(units, "block", "left").mapInArrow(
        lean(_clean(bits)), "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.decode("utf-8", "ignore") for t in batch.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def texts_left(cut: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of the result of ``remove_repeats``; bytes of characters cut in two go."""
    return cut.select("doc_id", "kept").mapInArrow(_decode, "doc_id long, text string")


def digests(cut: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of the result of ``remove_repeats``."""
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
