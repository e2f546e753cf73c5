"""Near-duplicate documents by HyperMinHash sketches.

Every five-word shingle falls into one of 160 buckets; a bucket keeps its
smallest hash, compressed to the number of leading zeros and the ten bits after
the leading one.  Empty buckets of short texts borrow from a full one in an
order fixed per bucket, so that two texts agree in a bucket with the
probability of their Jaccard similarity.  Bands of four registers retrieve
candidates; the estimate from all registers, corrected for chance collisions,
drops those that lie five standard deviations below the threshold; the full
shingle sets decide.

At a similarity of 0.75 the 40 bands miss a pair with probability
(1 - 0.75^4)^40 < 3e-7, and a pair needs no band of its own if its texts are
linked over others.

Texts with equal sets form one class first.  Every text of a band's bucket is
compared with the one there that shares buckets with the most texts, which in a
group of edited copies is the original or nearest to it.  After that only
buckets with texts of different components matter.  There every pair from
different components is compared, first by registers, then by full shingle
sets, in blocks of bounded size; a block names one pair for each
two components it joins, so the output does not grow with the square of a
bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import components, flatten_sets, in_groups, lean, mix, narrowed, raw_texts, shingles, slices, word_hashes

WORDS = 5
PERCENT = 75
BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: chance that two different minima share a register, times 2^MANTISSA (HyperMinHash, large sets)
COLLISION = 0.1699194871597391
SIGMAS = 5.0
#: texts per side of a block of comparisons; a long text weighs as one for each so many shingles
BLOCK = 512
WEIGHT = 1024
#: members of a candidate star that are verified in one group
STAR = 256

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _borrow_order() -> np.ndarray:
    """For each bucket the order in which it looks at the others: one fixed permutation per bucket."""
    bucket = np.arange(REGISTERS, dtype=np.uint64)
    return np.argsort(mix(bucket[:, None] * np.uint64(1_000_003) + bucket[None, :] + np.uint64(17)), axis=1).T


_ORDER = _borrow_order()


def registers(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (u16) of several sets, one row each; sets without members give zeros."""
    n = len(sizes)
    scrambled = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    bucket = ((scrambled >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    least = np.full(n * REGISTERS, _EMPTY)
    owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
    np.minimum.at(least, owner * REGISTERS + bucket.astype(np.int64), mix(scrambled + np.uint64(1)))
    least = least.reshape(n, REGISTERS)
    todo = np.flatnonzero((least == _EMPTY).any(axis=1) & (sizes > 0))
    if len(todo):
        known, filled = least[todo], least[todo].copy()
        alive = np.arange(len(todo))
        for order in _ORDER:
            offer, now = known[alive][:, order], filled[alive]
            now = np.where(now == _EMPTY, offer, now)
            filled[alive] = now
            alive = alive[(now == _EMPTY).any(axis=1)]
            if not len(alive):
                break
        least[todo] = filled
    zeros = np.minimum(64 - np.frexp(least.astype(np.float64))[1], 62).astype(np.uint64)
    after = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out = ((zeros << np.uint64(MANTISSA)) | after).astype(np.uint16)
    out[sizes == 0] = 0
    return out


def estimate(matches: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, corrected for chance collisions."""
    chance = COLLISION * 2.0 ** -MANTISSA
    return (matches / REGISTERS - chance) / (1 - chance)


def hopeless(matches: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Pairs whose sizes rule them out or whose estimate lies far below the threshold.

    Few shingles make the registers depend on each other, which widens the margin.
    """
    j = percent / 100
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    margin = SIGMAS * np.sqrt(j * (1 - j) * (1 / REGISTERS + 1 / np.maximum(small, 1)))
    return (100 * small < percent * large) | (estimate(matches) < j - margin)


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                hashes, sizes = flatten_sets(*shingles(*word_hashes(raw_texts(batch.column("text"))), words))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + np.uint64(3)))])
                other = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + np.uint64(5)))])
                sketch = registers(hashes, sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes),
                     pa.array((total[ends[1:]] - total[ends[:-1]]).view(np.int64)),
                     pa.array((other[ends[1:]] - other[ends[:-1]]).view(np.int64)),
                     pa.array([r.tobytes() for r in sketch], pa.binary())],
                    names=["doc_id", "n_shingles", "_k1", "_k2", "_registers"])

    return run


SKETCH = "doc_id long, n_shingles long, _k1 long, _k2 long, _registers binary"


def _estimated(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                    for c in ("_ra", "_rb"))
            drop = hopeless((a == b).sum(axis=1), batch.column("_na").to_numpy(), batch.column("_nb").to_numpy(), percent)
            kept = pa.array(np.flatnonzero(~drop))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(kept), batch.column("b").take(kept)], names=["a", "b"])

    return run


def _block_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in in_groups(batches, ["_key", "_t", "_i", "_j"]):
            node, part, comp, size = (group.column(c).to_numpy() for c in ("node", "_part", "_comp", "_n"))
            major = group.column("_major").to_numpy(zero_copy_only=False)
            sketch = np.frombuffer(b"".join(group.column("_registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            sets = [np.frombuffer(x, np.uint64) for x in group.column("_set").to_pylist()]
            kind, i, j = (group.column(c)[0].as_py() for c in ("_t", "_i", "_j"))
            if kind == 0:
                left, right = np.flatnonzero(~major), np.flatnonzero(major)
            else:
                left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
            joined: dict[int, int] = {}

            def root(c: int) -> int:
                while joined.get(c, c) != c:
                    c = joined[c]
                return c

            found_a, found_b = [], []
            for x in left:
                y = right[comp[right] != comp[x]]
                if kind and i == j:
                    y = y[node[y] > node[x]]
                y = y[~hopeless((sketch[y] == sketch[x]).sum(axis=1), size[y], size[x], percent)]
                for k in y.tolist():
                    p, q = root(int(comp[x])), root(int(comp[k]))
                    if p == q:
                        continue
                    both = len(np.intersect1d(sets[x], sets[k], assume_unique=True))
                    if 100 * both >= percent * (len(sets[x]) + len(sets[k]) - both):
                        joined[max(p, q)] = min(p, q)
                        found_a.append(int(min(node[x], node[k])))
                        found_b.append(int(max(node[x], node[k])))
            if found_a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text and band: the band's registers, hashed."""
    band = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        wide = np.frombuffer(b"".join(batch.column("_registers").to_pylist()), np.uint64).reshape(-1, BANDS)
        node, size = (batch.column(c).to_numpy() for c in ("node", "n_shingles"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(node, BANDS)), pa.array(np.repeat(size.astype(np.int32), BANDS)),
             pa.array(mix(wide ^ band).ravel().view(np.int64))], names=["node", "_n", "_key"])


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                hashes, sizes = flatten_sets(*shingles(*word_hashes(raw_texts(batch.column("text"))), words))
                raw = hashes.tobytes()
                ends = (8 * np.concatenate([[0], np.cumsum(sizes)])).tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), pa.array([raw[p:q] for p, q in zip(ends, ends[1:])], pa.binary())],
                    names=["node", "_set"])

    return run


def _blocks(rows: DataFrame) -> DataFrame:
    """Deal the texts of mixed buckets out to blocks so that every pair from different components meets once.

    The commonest component of a bucket needs no pairs inside; the other texts
    meet it in blocks of kind 0 and each other in blocks of kind 1.  A block has
    texts of about ``BLOCK`` weights a side.
    """
    rows = rows.withColumns({
        "_major": F.col("_comp") == F.col("_most"),
        "_p": F.ceil(F.col("_in_most") / BLOCK).cast("int"),
        "_q": F.ceil((F.col("_size") - F.col("_in_most")) / BLOCK).cast("int")})
    own = F.pmod(F.xxhash64("node"), F.when(F.col("_major"), F.col("_p")).otherwise(F.col("_q"))).cast("int")
    rows = rows.withColumn("_part", own)

    def place(kind: int, i: Column, j: Column) -> Column:
        return F.struct(F.lit(kind).alias("_t"), i.cast("int").alias("_i"), j.cast("int").alias("_j"))

    across_major = F.transform(F.sequence(F.lit(0), F.col("_q") - 1), lambda q: place(0, F.col("_part"), q))
    across_minor = F.transform(F.sequence(F.lit(0), F.col("_p") - 1), lambda p: place(0, p, F.col("_part")))
    among = F.transform(F.sequence(F.lit(0), F.col("_q") - 1),
                        lambda o: place(1, F.least("_part", o), F.greatest("_part", o)))
    to = F.when(F.col("_major"), across_major).otherwise(F.concat(across_minor, among))
    return rows.withColumn("_to", F.explode(to)).select("_key", "_to.*", "node", "_part", "_comp", "_major")


def _verify(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, have = None, None
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                hashes, sizes = flatten_sets(*shingles(*word_hashes(raw_texts(batch.column("text"))), words))
                ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                out_a, out_b = [], []
                for k, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                    mine = hashes[ends[k]: ends[k + 1]]
                    if b is None:
                        center, have = a, mine
                    elif center == a and len(mine) and len(have):
                        at = np.minimum(np.searchsorted(have, mine), len(have) - 1)
                        both = int((have[at] == mine).sum())
                        if 100 * both >= percent * (len(mine) + len(have) - both):
                            out_a.append(a)
                            out_b.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Those of the ``pairs`` (``a``, ``b``) whose full shingle sets are similar enough.

    Pairs are grouped by ``a``, whose text comes first and is kept while the
    others stream by; a text with many partners is cut into groups of about
    ``STAR``, each with a copy of its text.
    """
    docs = narrowed(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    fans = pairs.groupBy("a").agg(F.count("*").alias("_fan"))
    salted = pairs.join(fans, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("_fan") / STAR)).cast("int").alias("_salt"))
    members = salted.join(docs, salted["b"] == docs["doc_id"]).select("a", "_salt", "b", "text")
    heads = salted.select("a", "_salt").distinct().join(docs, F.col("a") == docs["doc_id"]).select(
        "a", "_salt", F.lit(None).cast("long").alias("b"), "text")
    rows = heads.unionByName(members).repartition("a", "_salt").sortWithinPartitions(
        "a", "_salt", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "text").mapInArrow(lean(_verify(words, percent)), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Classes of near-duplicates among ``docs`` (``doc_id``, ``text``).

    Links documents whose sets of ``words``-word shingles have a Jaccard
    similarity of ``percent`` or more.  One row per document: ``doc_id``,
    ``n_shingles``, ``component_id`` (the smallest ``doc_id`` reachable),
    ``kept`` (the document is that smallest one).

    A text with fewer words counts as one shingle.  NULL and empty texts have an
    empty set and stand alone.  Rows without a ``doc_id`` are left out, rows
    that repeat one count as copies of each other if their texts agree.  An
    empty table gives an empty result; other columns are not read.
    """
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    sketches = stored(docs.mapInArrow(lean(_sketch(words)), SKETCH), "sketches")
    same = ["n_shingles", "_k1", "_k2"]
    classes = stored(
        sketches.where("n_shingles > 0").groupBy(*same)
        .agg(F.min(F.struct("doc_id", "_registers")).alias("_m"))
        .select(F.col("_m.doc_id").alias("node"), *same, F.col("_m._registers").alias("_registers")), "classes")
    bands = classes.select("node", "n_shingles", "_registers").mapInArrow(lean(_bands), "node long, _n int, _key long")
    shared = bands.groupBy("_key").agg(F.count("*").alias("_size")).where("_size > 1")
    members = stored(bands.join(shared, "_key"), "bands")

    registered = classes.select("node", F.col("n_shingles").alias("_n"), "_registers")
    company = members.groupBy("node").agg(F.sum("_size").alias("_company"))
    centers = members.join(company, "node").groupBy("_key").agg(
        F.max(F.struct("_company", (-F.col("node")).alias("_m"))).alias("_c")).select("_key", (-F.col("_c._m")).alias("a"))
    stars = members.join(centers, "_key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    sides = stars.join(
        registered.select(F.col("node").alias("a"), F.col("_n").alias("_na"), F.col("_registers").alias("_ra")), "a"
    ).join(
        registered.select(F.col("node").alias("b"), F.col("_n").alias("_nb"), F.col("_registers").alias("_rb")), "b"
    ).where(F.lit(100) * F.least("_na", "_nb") >= F.lit(percent) * F.greatest("_na", "_nb"))
    pairs = stored(sides.mapInArrow(lean(_estimated(percent)), "a long, b long"), "stars")
    links = stored(confirmed(pairs, docs, words, percent), "links")
    found = stored(components(links), "components")

    # buckets of three or more texts that still hold several components: all pairs across components
    open_members = members.where("_size > 2").join(found, "node", "left").select(
        "_key", "node", "_n", F.coalesce("component", "node").alias("_comp"))
    weight = F.greatest(F.col("_n") / WEIGHT, F.lit(1.0))
    counted = open_members.groupBy("_key", "_comp").agg(F.sum(weight).alias("_k"))
    mixed = counted.groupBy("_key").agg(
        F.count("*").alias("_comps"), F.sum("_k").alias("_size"), F.max(F.struct("_k", "_comp")).alias("_m")
    ).where("_comps > 1").select("_key", "_size", F.col("_m._k").alias("_in_most"), F.col("_m._comp").alias("_most"))
    rows = stored(open_members.drop("_n").join(mixed, "_key"), "mixed")
    wanted = stored(rows.select("node").distinct(), "wanted")
    sets = wanted.join(narrowed(docs, wanted).withColumnRenamed("doc_id", "node"), "node").mapInArrow(
        lean(_sets(words)), "node long, _set binary")
    sketched = stored(wanted.join(registered, "node").join(sets, "node"), "sets")
    blocks = _blocks(rows).join(sketched, "node").repartition("_key", "_t", "_i", "_j").sortWithinPartitions(
        "_key", "_t", "_i", "_j")
    rest = blocks.mapInArrow(lean(_block_pairs(percent)), "a long, b long").distinct()
    more = stored(confirmed(stored(rest, "rest"), docs, words, percent), "more")
    merged = components(more.union(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    of_class = classes.select(*same, "node").join(merged, "node", "left").select(
        *same, F.coalesce("component", "node").alias("component_id"))
    return sketches.drop("_registers").join(of_class, same, "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))
