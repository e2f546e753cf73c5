"""Document fingerprints by a randomised edit embedding.

A text is walked by one shared random walk: step j writes the character under
the pointer, then the pointer moves on or stays, as a random bit of j and of
that character says.  Two texts that differ by few edits soon walk in step
again, so their edit distance shows as the Hamming distance of what the walks
wrote.  A fingerprint keeps a sample of the steps, chosen by a hash of j; long
texts use a sparser sample that is part of the denser one, so fingerprints of
different lengths compare on the steps they share.

Walks of many texts go forward together, one array operation per step.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.ml.feature import Bucketizer

from ..session import stored
from .common import components, in_groups, lean, mix, narrowed, slices
from .neardup import _blocks as deal_blocks

#: a fingerprint keeps about half to all of so many steps
SAMPLE = 256
#: random bits repeat after so many steps
PERIOD = 8192
#: fewer texts than this walk one by one
TOGETHER = 24
#: rows per range of documents that are neighbours in order
RANGE_ROWS = 2000
MAX_RANGES = 20_000
#: characters of a fingerprint, one per sampled step
_SYMBOLS = np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-_", np.uint8)
_PAD = 255

_steps = np.arange(PERIOD, dtype=np.uint64)
#: move or stay, by step and kind of character; the filler behind a text never moves
_BITS = (mix(_steps[:, None] * np.uint64(256) + np.arange(256, dtype=np.uint64) + np.uint64(99)) & np.uint64(1)).astype(np.int64)
_BITS[:, _PAD] = 0
_BIT_LISTS = [row.tolist() for row in _BITS]


def _kinds(text: str) -> np.ndarray:
    """Kind (0 to 254) of each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return ((points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % 255


_RARITY = np.zeros(0, np.int8)


def _rarity(n: int) -> np.ndarray:
    """Level up to which each of the first ``n`` steps is sampled."""
    global _RARITY
    if len(_RARITY) < n:
        j = np.arange(max(n, 1 << 16), dtype=np.uint64)
        h = mix(j + np.uint64(12345))
        lowest = h & (~h + np.uint64(1))
        _RARITY = (np.frexp(lowest.astype(np.float64))[1] - 1).astype(np.int8)
    return _RARITY[:n]


def _level(n: int) -> int:
    """Sampling level of a text of ``n`` code points; its walk takes about 2 n steps."""
    return max(0, int(np.ceil(np.log2(max(1, 2 * n) / SAMPLE))))


def _walk_one(kinds: np.ndarray, level: int) -> np.ndarray:
    cells, n, i, path = kinds.tolist(), len(kinds), 0, []
    bits, period = _BIT_LISTS, PERIOD
    while i < n:
        for row in bits:
            c = cells[i]
            path.append(c)
            i += row[c]
            if i >= n:
                break
    written = np.array(path, np.uint8)
    return written[_rarity(len(written)) >= level]


def _walk_together(kinds: list[np.ndarray], level: int) -> list[np.ndarray]:
    """Sampled symbols of texts of one level."""
    order = np.argsort([-len(k) for k in kinds], kind="stable")
    sizes = np.array([len(kinds[i]) for i in order], np.int64)
    flat = np.concatenate([np.append(kinds[i], _PAD) for i in order]).astype(np.uint8)
    base = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    last = base + sizes
    at = base.copy()
    alive = len(order)
    columns: list[np.ndarray] = []
    rarity = _rarity(1 << 16)
    j = 0
    while alive:
        if j >= len(rarity):
            rarity = _rarity(2 * len(rarity))
        now = flat[at[:alive]]
        if rarity[j] >= level:
            columns.append(now)
        at[:alive] += _BITS[j % PERIOD][now]
        j += 1
        if j % 32 == 0:
            done = at[:alive] >= last[:alive]
            if done.any():
                going = np.flatnonzero(~done)
                # texts that are done leave from the end of the order; others wait with filler
                alive = int(going[-1]) + 1 if len(going) else 0
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(order)
    table = np.full((len(columns), len(order)), _PAD, np.uint8)
    for k, c in enumerate(columns):
        table[k, : len(c)] = c
    for rank, i in enumerate(order):
        column = table[:, rank]
        out[i] = column[: int((column != _PAD).sum())]
    return out


def fingerprint_texts(texts: list[str]) -> list[str]:
    """Fingerprint of each text: two hex digits for the level, one character per sampled step."""
    kinds = [_kinds(t) for t in texts]
    groups: dict[int, list[int]] = {}
    for i, k in enumerate(kinds):
        groups.setdefault(_level(len(k)), []).append(i)
    out = [""] * len(texts)
    for level, members in groups.items():
        if len(members) < TOGETHER:
            walked = [_walk_one(kinds[i], level) for i in members]
        else:
            walked = _walk_together([kinds[i] for i in members], level)
        for i, symbols in zip(members, walked):
            out[i] = f"{level:02x}" + _SYMBOLS[symbols % 64].tobytes().decode()
    return out


def _samples(fingerprint: str, level: int) -> np.ndarray:
    """Symbols of a fingerprint at its own or a sparser level."""
    own = int(fingerprint[:2], 16)
    symbols = np.frombuffer(fingerprint[2:].encode(), np.uint8)
    if own == level:
        return symbols
    n = 1 << 12
    while True:
        rarity = _rarity(n)
        kept = rarity[rarity >= own]
        if len(kept) >= len(symbols):
            return symbols[kept[: len(symbols)] >= level]
        n *= 2


def likeness(a: str, b: str) -> float:
    """Share of equal symbols among the sampled steps of the longer walk, 0 to 1.

    Both empty: 1; one empty: 0.
    """
    if a == b:
        return 1.0
    level = max(int(a[:2], 16), int(b[:2], 16))
    x, y = _samples(a, level), _samples(b, level)
    longer = max(len(x), len(y))
    if not longer:
        return 0.0
    n = min(len(x), len(y))
    return float((x[:n] == y[:n]).sum()) / longer


def _text_list(column: pa.Array) -> list[str]:
    return [t if t is not None else "" for t in column.to_pylist()]


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 16 << 20):
            texts = _text_list(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(fingerprint_texts(texts))],
                names=["doc_id", "n_chars", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars`` (code points), ``fingerprint`` of every row of ``docs``.

    Equal texts have equal fingerprints; a NULL text counts as empty and has a
    fingerprint without symbols.  Other columns are not read.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _fingerprint, "doc_id long, n_chars long, fingerprint string")


# --- neighbours in order ------------------------------------------------------

def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as many first code points of the next one, or all of them."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _against_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, str, bool]] = []
    for whole in batches:
        for batch in slices(whole, "text", 16 << 20):
            held += zip(batch.column("doc_id").to_pylist(), _text_list(batch.column("text")),
                        batch.column("_guest").to_pylist())
            texts = [t for _, t, _ in held]
            # a guest closes its range: it is the document after the range's last one
            own = [k for k in range(len(held) - 1) if not held[k][2]]
            changed = [edited(texts[k], texts[k + 1]) for k in own]
            prints = fingerprint_texts(texts + changed)
            plain, after = prints[: len(texts)], prints[len(texts):]
            yield pa.RecordBatch.from_arrays(
                [pa.array([held[k][0] for k in own], pa.int64()), pa.array([len(texts[k]) for k in own], pa.int64()),
                 pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                 pa.array([plain[k] for k in own], pa.string()), pa.array(after, pa.string()),
                 pa.array([likeness(plain[k], f) for k, f in zip(own, after)], pa.float64()),
                 pa.array([likeness(plain[k], plain[k + 1]) for k in own], pa.float64())],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            held = held[-1:]


NEXT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def against_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness to it and to the next document.

    The next document is the one with the next smaller ``doc_id``, after the
    smallest the largest.  Documents are dealt out by ranges of ``doc_id``, whose
    bounds come from a sample of the ids; every range is sorted and streams
    through its task, followed by a guest, the first document of the next range.
    So each text is shuffled once, and one text per range twice.

    Rows without a ``doc_id`` are left out; rows that repeat one follow each
    other in the order of a hash of their texts.  A NULL text counts as empty.  A
    single document is its own next one.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    n = docs.count()
    n_ranges = min(MAX_RANGES, max(1, n // RANGE_ROWS))
    cuts: list[float] = []
    if n_ranges > 1:
        sample = docs.select("doc_id").sample(fraction=min(1.0, 32 * n_ranges / n), seed=1)
        ids = sorted(r[0] for r in sample.collect())
        cuts = sorted({float(ids[k * len(ids) // n_ranges]) for k in range(1, n_ranges)}) if ids else []
    keyed = docs.withColumn("_x", F.col("doc_id").cast("double"))
    if cuts:
        keyed = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_x", outputCol="_r").transform(keyed)
    else:
        keyed = keyed.withColumn("_r", F.lit(0.0))
    keyed = keyed.select("doc_id", "text", F.col("_r").cast("int").alias("_range"))
    tops = {r["_range"]: r["top"] for r in keyed.groupBy("_range").agg(F.max("doc_id").alias("top")).collect()}
    ranges = sorted(tops)
    # the largest id of a range visits the next range above; the largest of all visits the lowest
    visits = [(tops[low], high) for low, high in zip(ranges, ranges[1:])] + [(tops[ranges[-1]], ranges[0])] if ranges else []
    guests: dict[int, list[int]] = {}
    for top, where in visits:
        guests.setdefault(top, []).append(where)
    table = spark.createDataFrame(list(guests.items()), "doc_id long, _visits array<int>")
    # at most one row per range
    rows = keyed.join(F.broadcast(table), "doc_id", "left").select("doc_id", "text", F.explode(F.concat(
        F.array(F.struct(F.col("_range"), F.lit(False).alias("_guest"))),
        F.transform(F.coalesce("_visits", F.array().cast("array<int>")),
                    lambda r: F.struct(r.alias("_range"), F.lit(True).alias("_guest"))))).alias("_to"))
    dealt = rows.select("doc_id", "text", "_to._range", "_to._guest").repartition(max(1, len(ranges)), "_range")
    ordered = dealt.sortWithinPartitions("_range", "_guest", F.desc("doc_id"), F.xxhash64("text"))
    return ordered.select("doc_id", "text", "_guest").mapInArrow(_against_next, NEXT)


# --- near pairs ---------------------------------------------------------------

def _in_band(a: str, b: str, most: int) -> int:
    """Edit distance by bit vectors over the diagonals that ``most`` edits reach (Hyyrö 2003); beyond it ``most`` + 1.

    Row j of the table keeps the cells of ``width`` diagonals, the lowest in the
    top bit; the characters' places move by one bit a row.  Needs lengths of at
    least ``most`` that differ by at most as much.
    """
    width = 2 * most + 2
    every, lowest, along = (1 << width) - 1, 1 << (width - 1), 1 << (width - 2)
    where: dict[str, int] = {}
    points = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), "<u4")
    order = np.argsort(points, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(points[order])) + 1):
        marks = np.zeros(len(a), np.uint8)
        marks[places] = 1
        where[a[places[0]]] = int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")
    up, down, score = (every << (width - most - 1)) & every, 0, most
    turn = len(a) - most
    shift = most + 1 - width
    for j, c in enumerate(b):
        places = where.get(c, 0)
        equal = (places << -shift if shift < 0 else places >> shift) & every
        shift += 1
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & every
        grows, shrinks = down | (every & ~(diagonal | up)), diagonal & up
        if j < turn:
            # down the lowest diagonal, then along the last row
            score += not diagonal & lowest
        else:
            score += bool(grows & along) - bool(shrinks & along)
            along >>= 1
        if score > most + (len(b) - turn):
            return most + 1
        slid = diagonal >> 1
        up, down = shrinks | (every & ~(slid | grows)), slid & grows
    return min(score, most + 1)


#: edits that the first band reaches; narrower ones take as long a step
FIRST_REACH = 128


def edit_distance(a: str, b: str, most: int, least: int = 0) -> int:
    """Edit distance of two texts, or ``most`` + 1 if it is larger; ``least`` is a known lower bound.

    Equal beginnings and ends are left out, then ever wider bands are tried up to
    the one that ``most`` edits need, so the time follows the distance.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    begin = len(os.path.commonprefix((a, b)))
    a, b = a[begin:], b[begin:]
    end = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = (a[: len(a) - end], b[: len(b) - end]) if end else (a, b)
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return min(len(b), most + 1)
    # more edits than the longer text has characters are never needed
    most = min(most, len(b))
    reach = min(most, max(FIRST_REACH, len(b) - len(a), 2 * least))
    while True:
        # filler that only meets itself makes both texts long enough for the band
        found = _in_band(a + "\0" * reach, b + "\0" * reach, reach)
        if found <= reach or reach == most:
            return found
        reach = min(most, 8 * reach)


def _near(a: str, b: str, max_share: float, least: int = 0) -> bool:
    most = int(max_share * max(len(a), len(b)))
    return least <= most and edit_distance(a, b, most, least) <= most


#: an edit takes away at most so many runs of so many characters
RUN = 6
#: places that a run is counted at; runs that share one only make texts look closer
PLACES = 20


def runs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's runs of ``RUN`` characters, and how often each occurs."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = max(0, len(points) - RUN + 1)
    h = np.zeros(n, np.uint64)
    for k in range(RUN):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[k: k + n] + np.uint64(1)
    places, counts = np.unique((mix(h) >> np.uint64(64 - PLACES)).astype(np.int32), return_counts=True)
    return places, counts.astype(np.int32)


class RunCounts:
    """Runs of one text, for a bound on its edit distance to others before the distance itself.

    Texts of ``most`` edits share all runs of the longer one but ``RUN`` for each
    edit (Ukkonen 1992), so no pair that is close enough is left out.
    """

    def __init__(self):
        self.counts = np.zeros(1 << PLACES, np.int32)
        self.held = np.zeros(0, np.int32)

    def hold(self, found: tuple[np.ndarray, np.ndarray]) -> None:
        if self.held is found[0]:
            return
        self.counts[self.held] = 0
        self.held = found[0]
        self.counts[self.held] = found[1]

    def least_edits(self, found: tuple[np.ndarray, np.ndarray], longer: int) -> int:
        """Edits, at least, between the text held and one of these runs; the longer of both has ``longer`` characters."""
        shared = int(np.minimum(self.counts[found[0]], found[1]).sum())
        return max(0, -(-(longer - RUN + 1 - shared) // RUN))


def agreement(n: np.ndarray, max_share: float) -> np.ndarray:
    """Share of equal registers below which a pair is not asked for its edit distance; ``n`` is the longer text's length."""
    return np.maximum(LEAST, (1 - max_share) ** SPAN - MARGIN - MARGIN_SHORT / np.sqrt(n))


#: a text is walked again from places in it that its own characters choose: about one in EVERY, by a hash of GRAM characters
GRAM, EVERY = 3, 4
#: steps of such a walk, and how many of them a sampling keeps
SHORT_WALK, KEPT_STEPS, SAMPLINGS = 20, 8, 4
#: characters that a register depends on: at a share e of edits about (1 - e) ^ SPAN of the registers agree
SPAN = 13
#: margins below that share of agreeing registers: for bursts of edits, and for the few walks of a text of n characters by 1 / sqrt(n)
MARGIN, MARGIN_SHORT, LEAST = 0.15, 2.2, 0.04
#: texts beside one centre in a group of comparisons
STAR = 256
#: a text weighs as one in a block for each so many code points
WEIGHT = 2000

_CHOSEN = [np.sort(np.random.default_rng(41 + k).choice(SHORT_WALK, KEPT_STEPS, replace=False)) for k in range(SAMPLINGS)]


def _short_walks(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of what short walks wrote at the sampled steps, one array per sampling, and the walks per text (one at least)."""
    kinds = [_kinds(t) for t in texts]
    sizes = np.array([len(k) for k in kinds], np.int64)
    gap = np.full(GRAM, _PAD, np.uint8)
    flat = np.concatenate([part for k in kinds for part in (k.astype(np.uint8), gap)] + [gap])
    begins = np.cumsum(sizes + GRAM) - (sizes + GRAM)
    grams = np.zeros(len(flat) - GRAM, np.uint64)
    for i in range(GRAM):
        grams = mix(grams * np.uint64(31) + flat[i: i + len(grams)] + np.uint64(1))
    chosen = grams % np.uint64(EVERY) == 0
    chosen &= flat[: len(chosen)] != _PAD
    chosen[begins] = True
    at = np.flatnonzero(chosen)
    per_text = np.add.reduceat(chosen.astype(np.int64), begins)
    written = np.empty((SHORT_WALK, len(at)), np.uint8)
    for step in range(SHORT_WALK):
        written[step] = flat[at]
        # the filler behind a text never moves
        at = at + _BITS[step][written[step]]
    hashes = [mix(np.ascontiguousarray(written[c].T).view(np.uint64).ravel() + np.uint64(7 * k)) for k, c in enumerate(_CHOSEN)]
    return hashes, per_text


def near_registers(texts: list[str], bands: int, rows: int) -> np.ndarray:
    """For each text ``bands`` x ``rows`` registers (u16): least hashes over its walks, each band of one sampling."""
    hashes, per_text = _short_walks(texts)
    begins = np.cumsum(per_text) - per_text
    turn = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) + np.uint64(77))
    out = np.empty((len(texts), bands * rows), np.uint16)
    for r in range(bands * rows):
        scrambled = (hashes[(r // rows) % SAMPLINGS] ^ (turn[r] >> np.uint64(7))) * (turn[r] | np.uint64(1))
        out[:, r] = (mix(np.minimum.reduceat(scrambled, begins)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _near_sketch(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                texts = batch.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("_h"), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([r.tobytes() for r in near_registers(texts, bands, rows)], pa.binary())],
                    names=["doc_id", "_h", "_n", "_registers"])

    return run


def _registers_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    wide = sketch.reshape(-1, bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), wide.shape[:2]).copy()
    for r in range(rows):
        key = mix(key + wide[:, :, r])
    return key.view(np.int64)


def _near_bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = _band_keys(_registers_of(batch.column("_registers")), bands, rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("node").to_numpy(), bands)), pa.array(np.repeat(batch.column("_n").to_numpy(), bands)),
                 pa.array(key.ravel())], names=["node", "_n", "_key"])

    return run


def _agree(max_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _registers_of(batch.column("_ra")), _registers_of(batch.column("_rb"))
            longer = np.maximum(batch.column("_na").to_numpy(), batch.column("_nb").to_numpy())
            kept = pa.array(np.flatnonzero((x == y).mean(axis=1) >= agreement(longer, max_share)))
            yield batch.select(["a", "b"]).take(kept)

    return run


def _close(max_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, have, counted = None, [], RunCounts()

        def near(text: str) -> bool:
            found = runs(text)
            for other, held in have:
                counted.hold(held)
                if _near(other, text, max_share, counted.least_edits(found, max(len(other), len(text)))):
                    return True
            return False

        for batch in batches:
            out_a, out_b = [], []
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text"))):
                if b is None:
                    have = [*have, (text, runs(text))] if a == centre else [(text, runs(text))]
                    centre = a
                elif a == centre and near(text):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def _close_to_centre(pairs: DataFrame, texts: DataFrame, max_share: float) -> DataFrame:
    """Those of the ``pairs`` whose texts few edits turn into each other.

    A centre's text comes first and is kept while the others stream by; a centre
    with many partners is cut into groups of about ``STAR``.
    """
    fans = pairs.groupBy("a").agg(F.count("*").alias("_fan"))
    salted = pairs.join(fans, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("_fan") / STAR)).cast("int").alias("_salt"))
    members = salted.join(texts, salted["b"] == texts["node"]).select("a", "_salt", "b", "text")
    heads = salted.select("a", "_salt").distinct().join(texts, F.col("a") == texts["node"]).select(
        "a", "_salt", F.lit(None).cast("long").alias("b"), "text")
    rows = heads.unionByName(members).repartition("a", "_salt").sortWithinPartitions(
        "_salt", "a", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "text").mapInArrow(lean(_close(max_share)), "a long, b long").distinct()


def _close_in_blocks(max_share: float, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = RunCounts()
        for group in in_groups(batches, ["_key", "_t", "_i", "_j"]):
            node, part, comp, size = (group.column(c).to_numpy() for c in ("node", "_part", "_comp", "_n"))
            major = group.column("_major").to_numpy(zero_copy_only=False)
            sketch = _registers_of(group.column("_registers"))
            # a pair that shares several buckets is compared in that of its first common band
            here, keys = group.column("_key")[0].as_py(), _band_keys(sketch, bands, rows)
            texts = group.column("text").to_pylist()
            known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

            def near(x: int, k: int) -> bool:
                for t in (x, k):
                    if t not in known:
                        known[t] = runs(texts[t])
                counted.hold(known[x])
                least = counted.least_edits(known[k], max(len(texts[x]), len(texts[k])))
                return _near(texts[x], texts[k], max_share, least)

            kind, i, j = (group.column(c)[0].as_py() for c in ("_t", "_i", "_j"))
            if kind == 0:
                left, right = np.flatnonzero(~major), np.flatnonzero(major)
            else:
                left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
            # components that this block has joined, by number
            label = {int(c): int(c) for c in np.unique(comp)}
            found = []
            for x in left.tolist():
                y = right[comp[right] != comp[x]]
                if kind and i == j:
                    y = y[node[y] > node[x]]
                y = y[np.abs(size[y] - size[x]) <= max_share * np.maximum(size[y], size[x])]
                y = y[(sketch[y] == sketch[x]).mean(axis=1) >= agreement(np.maximum(size[y], size[x]), max_share)]
                y = y[keys[x][(keys[y] == keys[x]).argmax(axis=1)] == here]
                for k in y.tolist():
                    p, q = label[int(comp[x])], label[int(comp[k])]
                    if p != q and near(x, k):
                        label = {c: p if v == q else v for c, v in label.items()}
                        found.append((int(node[x]), int(node[k])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return run


def near_classes(docs: DataFrame, max_share: float = 0.05, bands: int = 80, rows: int = 4) -> DataFrame:
    """Classes of documents that few edits apart: ``doc_id``, ``class_id`` (smallest reachable ``doc_id``), ``n_links``.

    Two texts are linked if their edit distance is at most ``max_share`` of the
    longer one's code points; equal texts are.  A walk over a whole text falls out
    of step after many edits, so short walks of the same kind start at places
    that the text's own characters choose.  Samples of their steps are hashed;
    the least hashes fill ``bands`` x ``rows`` registers, and a band whose
    registers all agree makes two texts candidates.  ``rows`` = 3 and 96 bands
    find more pairs of a tenth edits, for more candidates.

    Equal texts form one class first.  Every text of a bucket is compared with
    the one there that shares buckets with the most texts.  Buckets that still
    hold several classes after that are gone through pair by pair, in blocks of
    bounded size.  A share of agreeing registers that ``max_share`` leads one to
    expect comes first (``agreement``), then the exact edit distance.
    ``n_links`` counts the links that this needed, 0 for a class of equal texts.

    NULL and empty texts stand alone.  Rows without a ``doc_id`` are left out; of
    rows that repeat one every text counts.  An empty table gives an empty result.
    Other columns are not read.  A text must fit in a task.
    """
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    some = docs.where("text <> ''").withColumn("_h", F.sha2(F.col("text"), 256))
    sketches = stored(some.mapInArrow(
        lean(_near_sketch(bands, rows)), "doc_id long, _h string, _n long, _registers binary"), "near-sketches")
    classes = stored(sketches.groupBy("_h").agg(F.min(F.struct("doc_id", "_n", "_registers")).alias("_m")).select(
        "_h", F.col("_m.doc_id").alias("node"), "_m._n", "_m._registers"), "near-classes")
    banded = classes.select("node", "_n", "_registers").mapInArrow(
        lean(_near_bands(bands, rows)), "node long, _n long, _key long")
    shared = banded.groupBy("_key").agg(F.count("*").alias("_size")).where("_size > 1")
    members = stored(banded.join(shared, "_key"), "near-bands")

    def texts_of(nodes: DataFrame) -> DataFrame:
        """``node``, ``text`` of classes, one row each."""
        found = narrowed(docs, nodes).select(F.col("doc_id").alias("node"), F.sha2(F.col("text"), 256).alias("_h"), "text")
        wanted = classes.select("node", "_h").join(nodes, "node", "left_semi")
        return found.join(wanted, ["node", "_h"]).groupBy("node", "_h").agg(F.max("text").alias("text")).drop("_h")

    company = members.groupBy("node").agg(F.sum("_size").alias("_company"))
    centres = members.join(company, "node").groupBy("_key").agg(
        F.max(F.struct("_company", (-F.col("node")).alias("_m"))).alias("_c")).select("_key", (-F.col("_c._m")).alias("a"))
    stars = members.join(centres, "_key").where("node <> a").select("a", F.col("node").alias("b")).distinct()

    def side(name: str) -> DataFrame:
        return classes.select(F.col("node").alias(name), F.col("_n").alias(f"_n{name}"), F.col("_registers").alias(f"_r{name}"))

    sides = stars.join(side("a"), "a").join(side("b"), "b").where(
        F.abs(F.col("_na") - F.col("_nb")) <= F.greatest("_na", "_nb") * max_share)
    pairs = stored(sides.select("a", "b", "_na", "_nb", "_ra", "_rb").mapInArrow(lean(_agree(max_share)), "a long, b long").distinct(), "near-stars")
    links = stored(_close_to_centre(pairs, texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), max_share), "near-links")
    found = stored(components(links), "near-components")

    open_members = members.where("_size > 2").join(found, "node", "left").select(
        "_key", "node", "_n", F.coalesce("component", "node").alias("_comp"))
    weight = F.greatest(F.col("_n") / WEIGHT, F.lit(1.0))
    counted = open_members.groupBy("_key", "_comp").agg(F.sum(weight).alias("_k"))
    mixed = counted.groupBy("_key").agg(
        F.count("*").alias("_comps"), F.sum("_k").alias("_size"), F.max(F.struct("_k", "_comp")).alias("_m")
    ).where("_comps > 1").select("_key", "_size", F.col("_m._k").alias("_in_most"), F.col("_m._comp").alias("_most"))
    dealt = stored(open_members.drop("_n").join(mixed, "_key"), "near-mixed")
    wanted = stored(dealt.select("node").distinct(), "near-wanted")
    content = stored(classes.select("node", "_n", "_registers").join(texts_of(wanted), "node"), "near-texts")
    blocks = deal_blocks(dealt).join(content, "node").repartition("_key", "_t", "_i", "_j").sortWithinPartitions(
        "_key", "_t", "_i", "_j")
    more = stored(blocks.mapInArrow(lean(_close_in_blocks(max_share, bands, rows)), "a long, b long").distinct(), "near-more")

    merged = components(more.union(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    ends = links.union(more).select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("_links"))
    of_text = classes.select("_h", "node").join(merged, "node", "left").join(ends, "node", "left").select(
        "_h", F.coalesce("component", "node").alias("_c"), "_links")
    return docs.withColumn("_h", F.sha2(F.col("text"), 256)).select("doc_id", "_h").join(of_text, "_h", "left").select(
        "doc_id", F.coalesce("_c", "doc_id").alias("class_id"), F.coalesce("_links", F.lit(0)).alias("n_links"))
