"""Token-id files of patched frame-of-reference blocks.

A shard holds the ids of consecutive documents in blocks of 256.  Each block
stores its minimum; the distances from it are packed at the width that the
chosen percentile of them needs; the ids beyond that width stand in an
exception list of (place, distance).  The shard's head has the start of every
block, so a range of ids is read without touching the blocks around it, and the
documents with their lengths.

Shard layout, little-endian:  ``PFOR``, u32 ids per block, u64 ids, u32
documents, u32 blocks; i64 document numbers; u32 document lengths; u64 block
starts (blocks + 1, from the end of the head); blocks of: u32 minimum, u8
width, u8 zero, u16 exceptions, packed distances, u16 places, u32 distances.

Shards are rows of a Parquet table, written by Spark's committer: a lost or
repeated task leaves no half-written shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import scratch_path
from .common import encoder, raw_texts, slices

BLOCK = 256
PERCENTILE = 0.9
#: a shard is closed when it has so many ids
SHARD_IDS = 1 << 20
_HEAD = np.dtype([("magic", "S4"), ("block", "<u4"), ("ids", "<u8"), ("docs", "<u4"), ("blocks", "<u4")])
_BLOCK_HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("zero", "u1"), ("exceptions", "<u2")])

SHARD_SCHEMA = "first_doc long, last_doc long, part int, n_docs long, n_ids long, payload binary"


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """Blocks of an id sequence, and the start of each block (one more for the end)."""
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.empty(n_blocks * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    if len(ids):
        padded[len(ids):] = ids[-1]
    rows = padded.reshape(n_blocks, BLOCK)
    least = rows.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    apart = rows - least[:, None]
    rank = min(BLOCK - 1, int(BLOCK * percentile))
    widths = _bit_length(np.partition(apart, rank, axis=1)[:, rank]) if n_blocks else np.zeros(0, np.int64)
    beyond = _bit_length(apart) > widths[:, None]
    n_beyond = beyond.sum(axis=1)
    sizes = _BLOCK_HEAD.itemsize + widths * (BLOCK // 8) + n_beyond * 6
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64)
    out = np.zeros(int(starts[-1]), np.uint8)
    head = np.zeros(n_blocks, _BLOCK_HEAD)
    head["least"], head["width"], head["exceptions"] = least, widths, n_beyond
    begin = starts[:-1].astype(np.int64)
    out[begin[:, None] + np.arange(8)] = head.view(np.uint8).reshape(n_blocks, 8)
    body = begin + 8
    for width in np.unique(widths):
        if width == 0:
            continue
        these = np.flatnonzero(widths == width)
        held = np.where(beyond[these], 0, apart[these])
        if width <= 16:
            bits = np.unpackbits(held.astype(">u2").view(np.uint8).reshape(len(these), BLOCK, 2), axis=2)
        else:
            bits = np.unpackbits(held.astype(">u4").view(np.uint8).reshape(len(these), BLOCK, 4), axis=2)
        bits = bits[:, :, bits.shape[2] - width:]
        packed = np.packbits(bits.reshape(len(these), -1), axis=1)
        out[body[these][:, None] + np.arange(packed.shape[1])] = packed
    block, place = np.nonzero(beyond)
    if len(block):
        lists = body + widths * (BLOCK // 8)
        order = np.arange(len(block)) - (np.cumsum(n_beyond) - n_beyond)[block]
        at = lists[block] + order * 2
        out[at[:, None] + np.arange(2)] = place.astype("<u2").view(np.uint8).reshape(-1, 2)
        at = lists[block] + n_beyond[block] * 2 + order * 4
        out[at[:, None] + np.arange(4)] = apart[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), starts


def unpack(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that begin at ``starts`` of ``raw``."""
    begin = starts.astype(np.int64)
    head = raw[begin[:, None] + np.arange(8)].reshape(-1).view(_BLOCK_HEAD)
    widths, counts = head["width"].astype(np.int64), head["exceptions"].astype(np.int64)
    apart = np.zeros((len(begin), BLOCK), np.uint32)
    for width in np.unique(widths):
        if width == 0:
            continue
        these = np.flatnonzero(widths == width)
        packed = raw[(begin[these] + 8)[:, None] + np.arange(width * BLOCK // 8)]
        bits = np.unpackbits(packed, axis=1).reshape(len(these), BLOCK, width)
        full = 16 if width <= 16 else 32
        wide = np.zeros((len(these), BLOCK, full), np.uint8)
        wide[:, :, full - width:] = bits
        apart[these] = np.packbits(wide, axis=2).reshape(len(these), BLOCK, full // 8).view(
            ">u2" if full == 16 else ">u4")[:, :, 0]
    total = int(counts.sum())
    if total:
        block = np.repeat(np.arange(len(begin)), counts)
        order = np.arange(total) - (np.cumsum(counts) - counts)[block]
        lists = begin + 8 + widths * (BLOCK // 8)
        place = raw[(lists[block] + order * 2)[:, None] + np.arange(2)].reshape(-1).view("<u2")
        value = raw[(lists[block] + counts[block] * 2 + order * 4)[:, None] + np.arange(4)].reshape(-1).view("<u4")
        apart[block, place] = value
    return (apart + head["least"][:, None]).reshape(-1)


def make_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    blocks, starts = pack(ids, percentile)
    head = np.array([(b"PFOR", BLOCK, len(ids), len(doc_ids), len(starts) - 1)], _HEAD)
    return b"".join((head.tobytes(), doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(),
                     starts.astype("<u8").tobytes(), blocks))


class Shard:
    """Reader of one shard."""

    def __init__(self, payload: bytes):
        raw = np.frombuffer(payload, np.uint8)
        head = raw[: _HEAD.itemsize].view(_HEAD)[0]
        if head["magic"] != b"PFOR" or head["block"] != BLOCK:
            raise ValueError("not a shard of this format")
        self.n_ids, docs, blocks = int(head["ids"]), int(head["docs"]), int(head["blocks"])
        at = _HEAD.itemsize
        self.doc_ids = raw[at: at + 8 * docs].view("<i8")
        at += 8 * docs
        self.lengths = raw[at: at + 4 * docs].view("<u4").astype(np.int64)
        at += 4 * docs
        self.starts = raw[at: at + 8 * (blocks + 1)].view("<u8")
        self.blocks = raw[at + 8 * (blocks + 1):]

    def read(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` to ``end`` of the shard, from their own blocks only."""
        if end <= begin:
            return np.zeros(0, np.uint32)
        first, last = begin // BLOCK, -(-end // BLOCK)
        part = unpack(self.blocks, self.starts[first:last])
        return part[begin - first * BLOCK: end - first * BLOCK]


def _encode_shards(path: str, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        docs: list[int] = []
        parts: list[bytes] = []
        held, part = 0, 0
        end = np.array([end_id], "<u4").tobytes()

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            lengths = np.array([len(p) // 4 for p in parts], np.int64)
            payload = make_shard(np.array(docs, np.int64), lengths, ids)
            row = {"first_doc": pa.array([docs[0]], pa.int64()), "last_doc": pa.array([docs[-1]], pa.int64()),
                   "part": pa.array([part], pa.int32()), "n_docs": [len(docs)], "n_ids": [len(ids)],
                   "payload": [payload]}
            docs.clear()
            parts.clear()
            return pa.RecordBatch.from_pydict(row)

        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                for doc, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode(raw_texts(batch.column("text")))):
                    docs.append(doc)
                    parts.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= shard_ids:
                        yield close()
                        held, part = 0, part + 1
        if docs:
            yield close()

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2,
                      shard_ids: int = SHARD_IDS) -> str:
    """Encode ``docs`` (``doc_id``, ``text``) and write them as shards in ascending ``doc_id`` order.

    The documents are dealt out by ranges of ``doc_id`` and sorted inside each
    range; a range streams through its task and leaves one shard per
    ``shard_ids`` ids.  NULL texts are empty; rows without a ``doc_id`` are left
    out; repeated ids each keep their place; an empty table leaves no shard;
    other columns are not read.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(_encode_shards(tokenizer, end_id, shard_ids), SHARD_SCHEMA).write.parquet(folder)
    return folder


#: a shard's place in the order of shards; a run of equal document numbers may fill several
SHARD_KEY = ["first_doc", "last_doc", "part"]
_KEY_SCHEMA = "first_doc long, last_doc long, part int"


def _keys(key: list, n: int) -> list[pa.Array]:
    return [pa.array(np.full(n, value), kind) for value, kind in zip(key, (pa.int64(), pa.int64(), pa.int32()))]


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for *key, payload in zip(*(batch.column(c).to_pylist() for c in (*SHARD_KEY, "payload"))):
            shard = Shard(payload)
            ids = shard.read(0, shard.n_ids).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(shard.lengths)])
            n = len(shard.lengths)
            # a few thousand documents of a shard at a time
            for low in range(0, n, 2000):
                high = min(n, low + 2000)
                a, b = offsets[low], offsets[high]
                lists = pa.ListArray.from_arrays(pa.array((offsets[low: high + 1] - a).astype(np.int32)), pa.array(ids[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [*_keys(key, high - low), pa.array(shard.doc_ids[low:high]), pa.array(offsets[low:high]), lists],
                    names=[*SHARD_KEY, "doc_id", "shard_start", "ids"])


def _read_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for *key, payload in zip(*(batch.column(c).to_pylist() for c in (*SHARD_KEY, "payload"))):
            shard = Shard(payload)
            raw = memoryview(shard.read(0, shard.n_ids).astype("<u4")).cast("B")
            offsets = np.concatenate([[0], np.cumsum(shard.lengths)])
            sums = [zlib.crc32(raw[a * 4: b * 4]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            n = len(sums)
            yield pa.RecordBatch.from_arrays(
                [*_keys(key, n), pa.array(shard.doc_ids), pa.array(offsets[:-1]), pa.array(shard.lengths),
                 pa.array(sums, pa.int64())],
                names=[*SHARD_KEY, "doc_id", "shard_start", "n_tokens", "ids_crc32"])


def _placed(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Add each shard's place in the whole: one narrow row per shard is put in order."""
    before = W.orderBy(*SHARD_KEY).rowsBetween(W.unboundedPreceding, -1)
    base = shards.select(*SHARD_KEY, F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("_base"))
    return rows.join(base, SHARD_KEY).withColumn("start", F.col("_base") + F.col("shard_start")).drop(
        "_base", "shard_start", *SHARD_KEY)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the shards: ``doc_id``, ``ids array<int>``, ``start`` (ids before it)."""
    shards = spark.read.parquet(folder)
    rows = shards.select(*SHARD_KEY, "payload").mapInArrow(
        _read_documents, f"{_KEY_SCHEMA}, doc_id long, shard_start long, ids array<int>")
    return _placed(rows, shards).select("doc_id", "start", "ids")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the shards: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    shards = spark.read.parquet(folder)
    rows = shards.select(*SHARD_KEY, "payload").mapInArrow(
        _read_digests,
        f"{_KEY_SCHEMA}, doc_id long, shard_start long, n_tokens long, ids_crc32 long")
    return _placed(rows, shards).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_file_digests(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the token files of ``docs`` below the shared folder and read back their digests."""
    spark = docs.sparkSession
    folder = write_token_files(docs, scratch_path(spark, "tokens"), tokenizer, end_id)
    return read_digests(spark, folder)
