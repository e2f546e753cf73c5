"""Best-fit packing of documents into sequences, after dominance reduction.

Lengths are whole numbers up to the capacity, so the instance is a table of
counts per length, at most ``capacity`` rows however many documents there are.
The plan is made on that table: first the Martello-Toth dominance criterion
fixes sets of up to three lengths that no other choice can beat, for all copies
at once; then best fit in descending length packs what is left, treating bins
of equal room as one run.  The plan says for each length which copies go to
which run of sequences; documents find their place by their rank among those of
equal length.

Only the count table reaches the driver.  A plan row is one length in one run
of bins.  A length step starts at most three new runs and a run holds at most
90 different lengths (1 + 2 + ... + 90 = 4095), so for a capacity of 4096 the
plan, which is broadcast, has under 1.2 million rows at any input size; real
ones have some ten thousand.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import stored
from .common import encoder, raw_texts, slices

CAPACITY = 4096
#: documents of one length are ranked in so many parts
RANK_PARTS = 1024


class _Plan:
    """Counts left per length, and the rows placed so far."""

    def __init__(self, counts: Mapping[int, int], capacity: int):
        self.capacity = capacity
        self.left = {int(k): int(n) for k, n in counts.items() if n}
        self.lengths = sorted(self.left)
        self.used = dict.fromkeys(self.left, 0)
        self.bins = 0
        self.rows: list[tuple[int, int, int, int, int, int]] = []

    def place(self, length: int, bins: int, per_bin: int, first_bin: int, offset: int) -> None:
        """``per_bin`` copies of a length in each of ``bins`` sequences, from ``offset`` on."""
        self.rows.append((length, self.used[length], bins, per_bin, first_bin, offset))
        taken = bins * per_bin
        self.used[length] += taken
        self.left[length] -= taken
        if not self.left[length]:
            del self.left[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def fix(self, lengths: list[int]) -> None:
        """Close as many sequences with just these lengths as there are copies for."""
        each = {x: lengths.count(x) for x in lengths}
        bins = min(self.left[x] // k for x, k in each.items())
        first, offset = self.bins, 0
        self.bins += bins
        for x, k in each.items():
            self.place(x, bins, k, first, offset)
            offset += x * k

    def others(self, length: int) -> int:
        """Copies of a length that stand beside the one in hand."""
        return self.left.get(length, 0)


def _smallest(plan: _Plan, without: int, n: int) -> list[int]:
    """The ``n`` smallest lengths left beside one copy of ``without``, in ascending order."""
    found: list[int] = []
    for x in plan.lengths:
        found += [x] * min(n - len(found), plan.left[x] - (x == without))
        if len(found) == n:
            break
    return found


def _largest_fit(plan: _Plan, without: int, room: int) -> int:
    """The largest length up to ``room`` left beside one copy of ``without``."""
    at = bisect.bisect_right(plan.lengths, room) - 1
    if plan.lengths[at] == without and plan.left[without] == 1:
        at -= 1
    return plan.lengths[at]


def _best_pair(plan: _Plan, without: int, room: int) -> tuple[int, int]:
    """Two lengths of the largest sum up to ``room``, the larger first."""
    free = {x: plan.left[x] - (x == without) for x in plan.lengths}
    xs = [x for x in plan.lengths if free[x]]
    low, high, best = 0, len(xs) - 1, (0, 0)
    while low <= high:
        total = xs[low] + xs[high]
        if total > room or (low == high and free[xs[low]] < 2):
            high -= 1
            continue
        if total > sum(best):
            best = (xs[high], xs[low])
        low += 1
    return best


def _dominant(plan: _Plan, j: int) -> list[int]:
    """The set with ``j`` that dominates all others, or nothing.

    With k the number of smallest others that fit beside j: none fits, j alone;
    one fits, or the largest fitting one fills the bin, j with that one; two
    fit, j with the largest one if it outweighs the best pair, or with the best
    pair if its larger half is the largest fitting one and no better smaller
    half can exist.
    """
    room = plan.capacity - j
    small = _smallest(plan, j, 3)
    if not small or small[0] > room:
        return [j]
    top = _largest_fit(plan, j, room)
    if top == room or len(small) == 1 or small[0] + small[1] > room:
        return [j, top]
    if len(small) == 3 and sum(small) <= room:
        return []
    a, b = _best_pair(plan, j, room)
    if top >= a + b:
        return [j, top]
    if top == a:
        # the two lengths next above b among the others; at most one between a and b suffices too
        above: list[int] = []
        for x in plan.lengths[bisect.bisect_right(plan.lengths, b):]:
            above += [x] * min(2 - len(above), plan.left[x] - (x == j))
            if len(above) == 2:
                break
        between = sum(plan.left[x] - (x == j) for x in plan.lengths[
            bisect.bisect_right(plan.lengths, b): bisect.bisect_left(plan.lengths, a)])
        if between <= 1 or len(above) < 2 or sum(above) > room:
            return [j, a, b]
    return []


def reduce_instance(plan: _Plan) -> None:
    """Fix dominating sets, largest length first, until none is left to fix."""
    changed = True
    while changed:
        changed = False
        for j in sorted(plan.lengths, reverse=True):
            while plan.left.get(j, 0):
                chosen = _dominant(plan, j)
                if not chosen:
                    break
                plan.fix(chosen)
                changed = True


def best_fit(plan: _Plan) -> None:
    """Best fit in descending length over runs of bins with equal room."""
    capacity = plan.capacity
    runs: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def add(room: int, first: int, bins: int) -> None:
        if room and bins:
            if room not in runs:
                runs[room] = []
                bisect.insort(rooms, room)
            runs[room].append((first, bins))

    for length in sorted(plan.lengths, reverse=True):
        n = plan.left[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                room, per_bin = capacity, capacity // length
                first, bins = plan.bins, -(-n // per_bin)
                plan.bins += bins
            else:
                room = rooms[at]
                first, bins = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(at)
                per_bin = room // length
            offset = capacity - room
            full = min(bins, n // per_bin)
            if full:
                plan.place(length, full, per_bin, first, offset)
                add(room - per_bin * length, first, full)
                n -= full * per_bin
            if n and full < bins:
                plan.place(length, 1, n, first + full, offset)
                add(room - n * length, first + full, 1)
                full, n = full + 1, 0
            add(room, first + full, bins - full)


def plan_packing(counts: Mapping[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Plan rows (length, first rank, bins, copies per bin, first bin, offset) and the number of bins."""
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    plan = _Plan(counts, capacity)
    reduce_instance(plan)
    best_fit(plan)
    rows = np.array(plan.rows, np.int64).reshape(-1, 6)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))], plan.bins


def _locate(plan_value):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan_value.value
        key = (rows[:, 0] << 44) + rows[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            row = rows[np.searchsorted(key, (length << 44) + rank, side="right") - 1]
            apart = rank - row[:, 1]
            sequence = row[:, 4] + apart // row[:, 3]
            offset = row[:, 5] + apart % row[:, 3] * length
            names = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"])

    return run


def place_pieces(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces``, which have a ``length``.

    ``pieces`` should be a stored table: it is read twice, once for the counts
    per length.  ``order`` names the columns that tell the rows apart; rows equal
    in them are interchangeable.  A very common length is ranked in
    ``RANK_PARTS`` parts.  NULL or non-positive lengths, or lengths above the
    capacity, raise; an empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = pieces.withColumn("length", F.col("length").cast("long"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if None in counts:
        raise ValueError("a length is missing")
    rows, _ = plan_packing(counts, capacity)
    parted = pieces.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(RANK_PARTS)).cast("int"))
    group = ["length", "_part"]
    sizes = parted.groupBy(*group).agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = parted.join(base, group).withColumn(
        "_rank", F.col("_base") + F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1
    ).drop("_part", "_base")
    schema = ranked.drop("_rank").schema
    schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(_locate(spark.sparkContext.broadcast(rows)), schema)


def _encode_pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                doc_ids, pieces, starts, parts = [], [], [], []
                for doc, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode(raw_texts(batch.column("text")))):
                    ids += end
                    for i, a in enumerate(range(0, len(ids), 4 * capacity)):
                        doc_ids.append(doc)
                        pieces.append(i)
                        starts.append(a // 4)
                        parts.append(ids[a: a + 4 * capacity])
                lengths = np.array([len(p) // 4 for p in parts], np.int64)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                     pa.array(lengths), pa.array([zlib.crc32(p) for p in parts], pa.int64()), ids],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Token ids of whole documents with an end id, longer ones cut at the capacity.

    NULL texts are empty and give one piece with the end id alone; rows without
    a ``doc_id`` keep a NULL one; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_encode_pieces(tokenizer, end_id, capacity), PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1,
                   capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    Returns the stored pieces with their ids, and the placement of every piece:
    ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset``.  Documents are encoded once; the placement reads the stored
    table without the ids.
    """
    pieces = stored(encode_pieces(docs, tokenizer, end_id, capacity), "pieces")
    narrow = pieces.select("doc_id", "piece", "start", "length", "ids_crc32")
    return pieces, place_pieces(narrow, ["doc_id", "piece", "ids_crc32"], capacity)


def sequences(pieces: DataFrame, placement: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids``, ``doc_ids``, ``lengths`` in place order.

    A group is one sequence, so it never holds more than the capacity.
    """
    placed = placement.select("doc_id", "piece", "ids_crc32", "sequence_id", "offset").join(
        pieces.select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"]),
        ["doc_id", "piece", "ids_crc32"])
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(rows.alias("_r")).select(
        "sequence_id", F.flatten("_r.ids").alias("ids"), F.col("_r.doc_id").alias("doc_ids"),
        F.transform("_r.ids", F.size).alias("lengths"))
