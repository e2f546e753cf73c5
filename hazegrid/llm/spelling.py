"""Spelling variants among the frequent words, by k-d trees over letter counts.

A word's vector counts its letters (a-z each for itself, all others folded onto
six places).  One inserted, deleted or replaced letter raises one count by at
most one and lowers one by at most one, so the words near a word lie in a box
range of L1 radius two around it, and of radius one where a letter is inserted.
For each pair of lengths (equal, or one apart) the words of one length search
the tree of the other: a branch is left out where its box asks for more than
the one raised and the one lowered count; the letters in order decide.

Two levels of the same tree spread the work.  The upper one is cut from a
bounded sample of vectors and deals every word out: to its own cell, and as a
search to all cells that its range meets.  A cell's words then get an exact tree
of their own, and the searches of the cell stream by it.  The sample shapes the
cells and never the result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import raw_texts, slices

LEAST_CHARS, LEAST_COUNT = 6, 5
#: one run in this many loses a letter
DROPPED = 199
#: a form occurs at least so many times as often
FACTOR = 5

#: places of a vector
DIMS = 32
#: most vectors in the sample that shapes the cells
SAMPLE = 1 << 14
#: words of a cell, about; and most words a task holds of one cell
CELL = 4096
#: words of a leaf of a cell's own tree
LEAF = 24
#: searches compared at once
CHUNK = 4096
#: distinct words a task counts before it hands them on
HELD_WORDS = 200_000

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BEYOND = re.compile(rb"[\xc2\xc4-\xf4]")
_RUNS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


# --- counting ------------------------------------------------------------------

def runs(text: bytes) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased."""
    if _BEYOND.search(text):
        return _RUNS.findall(text.lower())
    return text.translate(_LETTERS).split()


def _dropped(run: bytes, h: int) -> bytes:
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        rows = [(w, n) for w, n in total.items() if len(w) >= LEAST_CHARS]
        words, counts = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

    total: Counter = Counter()
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text"))):
                start = zlib.crc32(b"%d:" % doc_id)
                crc = zlib.crc32
                for run, n in Counter(runs(text)).items():
                    h = crc(run, start)
                    if h % DROPPED:
                        total[run] += n
                    else:
                        total[_dropped(run, h)] += n
            if len(total) > HELD_WORDS:
                yield out()
                total.clear()
    if total:
        yield out()


def frequent_words(docs: DataFrame) -> DataFrame:
    """Words of ``docs`` (``doc_id``, ``text``) and their occurrences ``n``: six letters and five occurrences at least.

    A word is a maximal run of letters, A-Z lower-cased; a hash of ``doc_id`` and
    run decides which runs lose a letter first.  Counts are added up inside a
    task before the shuffle.  NULL texts have no words, rows without a
    ``doc_id`` are left out, repeated rows count again.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(
        (F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_CHARS))


# --- vectors and trees -----------------------------------------------------------

def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and the length of each word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), lengths


def vectors(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Letter counts of each word; beyond 120 a count stands still, which one letter moves by at most one too."""
    place = np.where((codes >= 97) & (codes <= 122), codes - 97, 26 + codes % 6).astype(np.int64)
    owner = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    counts = np.bincount(owner * DIMS + place, minlength=len(lengths) * DIMS)
    return np.minimum(counts, 120).astype(np.int8).reshape(-1, DIMS)


@dataclass
class Tree:
    """Node k: its box, and either two children or a leaf number (then ``left`` is -1)."""

    low: np.ndarray
    high: np.ndarray
    dim: list[int]
    split: list[int]
    left: list[int]
    right: list[int]
    leaf: list[int]
    members: list[np.ndarray]

    def home(self, points: np.ndarray) -> np.ndarray:
        """Leaf in which each point lies."""
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if self.left[node] < 0:
                out[rows] = self.leaf[node]
                continue
            below = points[rows, self.dim[node]] <= self.split[node]
            todo += [(self.left[node], rows[below]), (self.right[node], rows[~below])]
        return out

    def meet(self, points: np.ndarray, lowered: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves whose box holds a vector with one count raised and ``lowered`` (0 or 1) lowered, with those points."""
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            p = points[rows]
            more = np.maximum(self.low[node] - p, 0).sum(axis=1)
            less = np.maximum(p - self.high[node], 0).sum(axis=1)
            rows = rows[(more <= 1) & (less <= lowered)]
            if not len(rows):
                continue
            if self.left[node] < 0:
                yield self.leaf[node], rows
            else:
                todo += [(self.left[node], rows), (self.right[node], rows)]


def grow(points: np.ndarray, leaf_size: int, tight: bool) -> Tree:
    """A tree over the points, cut at the median of the place that varies most.

    ``tight`` boxes hold just the points; others hold all that falls on their side.
    Points that all are equal stay in one leaf.
    """
    tree = Tree(np.zeros((0, DIMS)), np.zeros((0, DIMS)), [], [], [], [], [], [])
    low, high = [np.zeros(DIMS, np.int16)], [np.full(DIMS, 127, np.int16)]
    todo = [np.arange(len(points))]
    k = 0
    while k < len(todo):
        rows = todo[k]
        mine = points[rows]
        if tight and len(rows):
            low[k], high[k] = mine.min(axis=0).astype(np.int16), mine.max(axis=0).astype(np.int16)
        tree.dim.append(-1)
        tree.split.append(0)
        tree.left.append(-1)
        tree.right.append(-1)
        tree.leaf.append(len(tree.members))
        cut = None
        if len(rows) > leaf_size:
            spread = mine.astype(np.float32).var(axis=0)
            dim = int(spread.argmax())
            if spread[dim] > 0:
                values, counts = np.unique(mine[:, dim], return_counts=True)
                # the cut between two values that leaves both sides most alike
                at = int(np.abs(np.cumsum(counts)[:-1] * 2 - len(rows)).argmin())
                cut = dim, int(values[at])
        if cut is None:
            tree.members.append(rows)
        else:
            tree.leaf[k] = -1
            tree.dim[k], tree.split[k] = cut
            below = mine[:, cut[0]] <= cut[1]
            tree.left[k], tree.right[k] = len(todo), len(todo) + 1
            todo += [rows[below], rows[~below]]
            here = np.arange(DIMS) == cut[0]
            low += [low[k], np.where(here, cut[1] + 1, low[k])]
            high += [np.where(here, cut[1], high[k]), high[k]]
        k += 1
    tree.low, tree.high = np.stack(low).astype(np.int8), np.stack(high).astype(np.int8)
    return tree


# --- searching a cell ------------------------------------------------------------

def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of words ``a`` that become the row of ``b`` by one replaced letter, or by one inserted where ``b`` is longer."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    head, tail = a != b[:, :n], a != b[:, 1:]
    same_head = np.where(head.any(axis=1), head.argmax(axis=1), n)
    last_tail = np.where(tail.any(axis=1), n - tail[:, ::-1].argmax(axis=1), 0)
    return same_head >= last_tail


class Cell:
    """Words of one length with a tree of their own."""

    def __init__(self, words: list[str], counts: np.ndarray):
        codes, lengths = codes_of(words)
        self.words, self.counts = np.array(words, object), counts
        self.codes = codes.reshape(len(words), -1)
        self.points = vectors(codes, lengths)
        self.tree = grow(self.points, LEAF, tight=True)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place among ``words``, place in the cell) one edit apart; ``words`` are as long or one letter shorter."""
        codes, lengths = codes_of(words)
        points, codes = vectors(codes, lengths), codes.reshape(len(words), -1)
        grown = codes.shape[1] < self.codes.shape[1]
        radius = 1 if grown else 2
        found_q, found_m = [], []
        for leaf, rows in self.tree.meet(points, 0 if grown else 1):
            mine = self.tree.members[leaf]
            # equal vectors have no bound on their number: compare in pieces
            for first in range(0, len(mine), 256):
                part = mine[first: first + 256]
                step = max(1, CHUNK * LEAF // len(part))
                for begin in range(0, len(rows), step):
                    some = rows[begin: begin + step]
                    apart = np.abs(points[some][:, None, :] - self.points[part][None, :, :]).sum(axis=2, dtype=np.int16)
                    q, m = np.nonzero(apart <= radius)
                    if len(q):
                        q, m = some[q], part[m]
                        ok = self._verified(codes, q, m)
                        found_q.append(q[ok])
                        found_m.append(m[ok])
        none = np.zeros(0, np.int64)
        return (np.concatenate(found_q), np.concatenate(found_m)) if found_q else (none, none)


    def _verified(self, codes: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
        step = max(1, (1 << 22) // max(codes.shape[1], 1))
        return np.concatenate([one_edit(codes[q[k: k + step]], self.codes[m[k: k + step]]) for k in range(0, len(q), step)])


LINKS = "word string, other string, n_other long"


def _pieces(cell: np.ndarray, cuts: list[int]) -> Iterator[tuple[int, int]]:
    """Row ranges inside the cuts, shorter for longer words."""
    for begin, end in zip(cuts[:-1], cuts[1:]):
        step = max(1, CHUNK * 64 // max(64, int(cell[begin]) >> 20))
        for at in range(begin, end, step):
            yield at, min(at + step, end)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, part and role: the words of a cell first, then the searches, which stream by."""
    key, words, counts, cell = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        rank = [batch.column(c).to_numpy() for c in ("cell", "part", "role")]
        change = np.zeros(batch.num_rows, bool)
        for c in rank:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for begin, end in _pieces(rank[0], cuts):
            now = int(rank[0][begin]), int(rank[1][begin])
            if now != key:
                key, words, counts, cell = now, [], [], None
            some = batch.slice(begin, end - begin)
            names, n = some.column("word").to_pylist(), some.column("n").to_numpy()
            if rank[2][begin] == 0:
                words += names
                counts.append(n)
                continue
            if not words:
                continue
            cell = cell or Cell(words, np.concatenate(counts))
            q, m = cell.near(names)
            if not len(q):
                continue
            a, b = np.array(names, object)[q], cell.words[m]
            if rank[2][begin] == 1:
                columns = a, b, cell.counts[m]
            else:  # a shorter word: neither side searches the other way
                columns = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([cell.counts[m], n[q]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())],
                names=["word", "other", "n_other"])


# --- dealing the words out ---------------------------------------------------------

class Cells:
    """One upper tree per word length; a cell's number names length and leaf."""

    def __init__(self, sample: dict[int, np.ndarray], words: dict[int, int]):
        self.trees = {}
        for length, points in sample.items():
            cells = -(-words.get(length, 1) // CELL)
            self.trees[length] = grow(points, max(4, -(-len(points) // cells)), tight=False)

    def home(self, length: int, points: np.ndarray) -> np.ndarray:
        tree = self.trees.get(length)
        return np.int64(length << 20) + (tree.home(points) if tree else np.zeros(len(points), np.int64))

    def meet(self, length: int, points: np.ndarray, lowered: int) -> Iterator[tuple[int, np.ndarray]]:
        tree = self.trees.get(length)
        if tree is None:
            yield length << 20, np.arange(len(points))
        else:
            for leaf, rows in tree.meet(points, lowered):
                yield (length << 20) + leaf, rows


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length: places of its words, and their vectors."""
    codes, lengths = codes_of(words)
    points = vectors(codes, lengths)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield length, rows, points[rows]


def _homes(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for length, _, points in _by_length(batch.column("word").to_pylist()):
                keys, counts = np.unique(cells.home(length, points), return_counts=True)
                total.update(dict(zip(keys.tolist(), counts.tolist())))
        yield pa.RecordBatch.from_arrays(
            [pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["cell", "n"])

    return run


def _deal(cells: Cells, parts: dict[int, int]):
    """Rows of a word: as a member of its cell (role 0), as a search among its length (1) and the next one (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

                def add(cell, part, role, rows):
                    out.append((np.broadcast_to(np.int64(cell), rows.shape), np.broadcast_to(np.int32(part), rows.shape),
                                np.full(rows.shape, role, np.int8), rows))

                names = batch.column("word").to_pylist()
                for length, places, points in _by_length(names):
                    home = cells.home(length, points)
                    for cell in np.unique(home).tolist():
                        rows = places[home == cell]
                        many = parts.get(cell, 1)
                        salt = np.zeros(len(rows), np.int32) if many == 1 else np.fromiter(
                            (zlib.crc32(names[r].encode()) % many for r in rows), np.int32, len(rows))
                        add(cell, salt, 0, rows)
                    for role, other in ((1, length), (2, length + 1)):
                        for cell, rows in cells.meet(other, points, 2 - role):
                            for part in range(parts.get(cell, 0)):
                                add(cell, part, role, places[rows])
                if out:
                    cell, part, role, rows = (np.concatenate(c) for c in zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell), pa.array(part), pa.array(role), batch.column("word").take(pa.array(rows)),
                         batch.column("n").take(pa.array(rows))], names=["cell", "part", "role", "word", "n"])

    return run


def _plan(words: DataFrame) -> tuple[Cells, dict[int, int]]:
    """Cells and the parts of each.

    The driver gets at most about ``SAMPLE`` words, a row per word length and a
    row per cell, of which there are no more than sampled words and lengths.
    """
    per_length = {r["length"]: r["n"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    total = sum(per_length.values())
    share = min(1.0, 0.9 * SAMPLE / max(total, 1))
    picked = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 40)) < int(share * (1 << 40)))
    sampled = [r["word"] for r in picked.select("word").where(F.length("word") <= 1000).limit(SAMPLE).collect()]
    cells = Cells({length: points for length, _, points in _by_length(sampled)} if sampled else {}, per_length)
    sizes = words.select("word").mapInArrow(_homes(cells), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return cells, {r["cell"]: -(-r["n"] * max(64, r["cell"] >> 20) // (128 * CELL)) for r in sizes.collect()}


def near_words(words: DataFrame) -> DataFrame:
    """All pairs of ``words`` (distinct ``word``, ``n``) exactly one edit apart, in both directions.

    Columns ``word``, ``other``, ``n_other``.  A cell with more words than planned
    is dealt in parts, each of which all searches of the cell visit.
    """
    words = words.where("word IS NOT NULL").select("word", F.col("n").cast("long"))
    cells, parts = _plan(words)
    tasks = max(1, sum(parts.values()) // 2)
    dealt = words.repartition(tasks, "word").mapInArrow(_deal(cells, parts), "cell long, part int, role byte, word string, n long")
    sorted_ = dealt.repartition(tasks, "cell", "part").sortWithinPartitions("cell", "part", "role")
    return sorted_.mapInArrow(_search, LINKS)


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """Last word of each chain: rows (``word``, ``root``), by doubling the reach of every word."""
    reach = forms.select("word", F.col("form").alias("root"))
    for _ in range(steps):
        beyond = reach.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        reach = stored(reach.join(beyond, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return reach


def variants(words: DataFrame) -> DataFrame:
    """The accepted form of every word of ``words`` (``word``, ``n``) and the last word of its chain of forms.

    Columns ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.  A form is
    the near word of largest ``n`` (of equal ones the smallest in code-point
    order), if it occurs five times as often at least.  Along a chain ``n`` grows
    fivefold each step, which bounds the rounds.  An empty table gives an empty
    result.
    """
    words = stored(words, "words")
    best = F.min(F.struct((-F.col("n_other")).alias("n"), F.col("other").alias("word")))
    around = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("_best"))
    joined = words.join(around, "word", "left")
    known = -F.col("_best.n") >= FACTOR * F.col("n")
    rows = stored(joined.select(
        "word", F.when(known, F.col("_best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(known, -F.col("_best.n")).alias("form_n")), "forms")
    most = rows.agg(F.max("form_n")).first()[0] or 0
    links = 0
    while LEAST_COUNT * FACTOR ** (links + 1) <= most:
        links += 1
    roots = _roots(rows.where("form IS NOT NULL"), (links - 1).bit_length() if links else 0)
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Spelling variants among the frequent words of ``docs``; see ``frequent_words`` and ``variants``.

    NULL and empty texts and empty tables give no words; rows without a
    ``doc_id`` are left out; repeated rows count again; other columns are not read.
    """
    return variants(frequent_words(docs))

