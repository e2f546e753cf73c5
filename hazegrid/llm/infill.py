"""Fill-in-the-middle training texts, cut with an indexable skip list.

A text is a list of units (single code points by default).  The bottom lane of
its skip list holds every unit; each express lane links a random eighth of the
lane below.  A link carries how many units, code points and bytes it passes, so
a search adds widths from the top lane down and stops exactly at the unit of a
given rank, with the code points and bytes before it, in a logarithmic number
of links.  Where lanes stand decides the cost of a search and never its result.

Both cut ranks and the form of the output come from a hash of ``doc_id`` alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, slices

#: opening marks of prefix, suffix and middle
MARKS = ("<P>", "<S>", "<M>")
#: per cent of texts left plain, and of the others in suffix-prefix-middle order
PLAIN, SPM = 10, 20
#: links of a lane to one of the next
SPAN = 8
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class SkipList:
    """Units of one text with three widths a link: units, code points, bytes.

    ``chars`` and ``octets`` are the widths of the units themselves.
    """

    def __init__(self, chars: np.ndarray, octets: np.ndarray, rng: np.random.Generator):
        self.units = len(chars)
        widths = [(None, chars, octets)]
        #: per express lane, bottom up: index in the lane below of every link's start
        self.starts: list[np.ndarray] = []
        size = self.units
        while size > SPAN:
            gaps = rng.geometric(1 / SPAN, 2 * size // SPAN + 8)
            at = np.cumsum(gaps)
            at = np.concatenate([[0], at[at < size]])
            if len(at) == size:
                continue
            below = widths[-1]
            units = np.diff(at, append=size) if below[0] is None else np.add.reduceat(below[0], at)
            widths.append((units, *(np.add.reduceat(w, at, dtype=np.int64) for w in below[1:])))
            self.starts.append(at)
            size = len(at)
        self.widths = widths

    def seek(self, rank: int) -> tuple[int, int]:
        """Code points and bytes before the unit of this rank (0 to the number of units)."""
        at = left = chars = octets = 0
        left = rank
        for lane in range(len(self.widths) - 1, -1, -1):
            units, cw, ow = self.widths[lane]
            if units is None:  # the bottom lane: every link passes one unit
                return chars + int(cw[at: at + left].sum(dtype=np.int64)), octets + int(ow[at: at + left].sum(dtype=np.int64))
            while at < len(units) and units[at] <= left:
                left -= int(units[at])
                chars += int(cw[at])
                octets += int(ow[at])
                at += 1
            at = int(self.starts[lane - 1][at]) if at < len(units) else len(self.widths[lane - 1][1])
        raise AssertionError("a skip list has a bottom lane")


def _code_points(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    if text.isascii():
        one = np.ones(len(text), np.uint8)
        return one, one
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return np.ones(len(starts), np.uint8), np.diff(starts, append=len(text)).astype(np.uint8)


def _units(pattern: str):
    """Units by a pattern, matched left to right; what it passes over belongs to the unit before, or to the first."""
    compiled = regex.compile(pattern)

    def run(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        whole = text.decode()
        starts = [m.start() for m in compiled.finditer(whole) if m.end() > m.start()]
        if not starts:
            starts = [0] if whole else []
        elif starts[0]:
            starts[0] = 0
        chars = np.diff(np.array(starts, np.int64), append=len(whole))
        _, octets = _code_points(text)
        return chars, np.add.reduceat(octets, starts, dtype=np.int64) if starts else np.zeros(0, np.int64)

    return run


def _check_marks(marks: Sequence[str]) -> list[bytes]:
    first = {m[:1] for m in marks}
    if len(set(marks)) != 3 or not all(marks) or len(first) > 1 or any(first & set(m[1:]) for m in marks) or any(
            a != b and b.startswith(a) for a in marks for b in marks):
        raise ValueError("three different marks are needed that open with one character found nowhere else in them")
    return [m.encode() for m in marks]


def _rewrite(marks: Sequence[str], pattern: str | None, seed: int, plain: int, spm: int):
    p, s, m = _check_marks(marks)
    units = _units(pattern) if pattern else _code_points

    def one(doc_id: int, text: bytes, rng) -> tuple:
        digest = hashlib.sha256(b"%d:%d" % (seed, doc_id)).hexdigest()
        h = [int(digest[8 * k: 8 * k + 8], 16) for k in range(4)]
        chars, octets = units(text)
        n = len(chars)
        if not text or p in text or s in text or m in text or h[2] % 100 >= 100 - plain:
            return n, "plain", None, None, text
        cuts = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        lanes = SkipList(chars, octets, rng)
        (c1, b1), (c2, b2) = map(lanes.seek, cuts)
        before, middle, after = text[:b1], text[b1:b2], text[b2:]
        if h[3] % 100 < spm:
            return n, "spm", c1, c2 - c1, b"".join((s, after, p, before, m, middle))
        return n, "psm", c1, c2 - c1, b"".join((p, before, s, after, m, middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                ids = batch.column("doc_id").to_pylist()
                rows = [one(i, t, rng) for i, t in zip(ids, raw_texts(batch.column("text")))]
                n, form, prefix, middle, out = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, pattern: str | None = None, marks: Sequence[str] = MARKS, seed: int = 1,
                   plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """Texts of ``docs`` (``doc_id``, ``text``) rearranged for training on infilling.

    Returns ``doc_id``, ``n`` (units), ``form``, ``prefix_chars`` and
    ``middle_chars`` (code points; NULL if plain) and the ``output``.  ``form`` is
    ``plain`` (the text as it is), ``psm`` (prefix, suffix, middle) or ``spm``
    (suffix, prefix, middle), each part after its mark.  ``pattern`` names the
    units: code points where absent, else its matches, with what lies between
    them belonging to the match before.

    NULL and empty texts give the empty text, plain.  A text that holds a mark
    stays plain.  Rows without a ``doc_id`` are left out; repeated rows and ids
    give a row each, with the same cuts for the same text.  An empty table gives
    an empty result; other columns are not read.  A text and its lanes (some two
    bytes a code point) must fit in a task.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_rewrite(marks, pattern, seed, plain, spm), SCHEMA)


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The exact text, from an output and its form alone."""
    _check_marks(marks)
    any_mark = "|".join(rf"\Q{m}\E" for m in marks)
    part = F.split(output, any_mark, -1)
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    out = F.when(form == "plain", output)
    for name, places in order.items():
        out = out.when(form == name, F.concat(*[part[k] for k in places]))
    return out


def digests(filled: DataFrame, marks: Sequence[str] = MARKS) -> DataFrame:
    """Result of ``fill_in_middle`` with hashes of the output and of the text rebuilt from it."""
    return filled.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form"), marks), 256).alias("restored_sha256"))
