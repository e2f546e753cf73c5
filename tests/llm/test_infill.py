import hashlib
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from hazegrid.llm import infill

SCHEMA = "doc_id long, text string, form int, output string"


def plain_run(doc_id, text, pattern=None):
    """Units, cuts and output by counting."""
    text = text or ""
    units = list(text)
    if pattern:
        at = [m.start() for m in regex.finditer(pattern, text)] or ([0] if text else [])
        at = [0, *at[1:]] if at else []
        units = [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]
    n = len(units)
    d = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(d[k: k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    rng = random.Random(5)
    letters = "ab <>PSM\né日\U0001F600"
    out = [(k, "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 9, 60, 700])))) for k in range(150)]
    out += [(900, "x<M>y"), (901, None), (902, ""), (903, "<"), (904, "<P"), (905, "wörd " * 60_000), (3, out[3][1]), (3, "another"), (-7, "minus")]
    return out


def test_lanes_reach_every_rank():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 8, 9, 100, 5000):
        chars, octets = rng.integers(1, 9, n), rng.integers(1, 30, n)
        lanes = infill.SkipList(chars, octets, rng)
        for rank in {0, n, *rng.integers(0, n + 1, 40).tolist()}:
            assert lanes.seek(rank) == (chars[:rank].sum(), octets[:rank].sum())
    assert len(lanes.widths) >= 3


@pytest.mark.parametrize("pattern", [None, r"\S+"])
def test_equals_counting(spark, pattern):
    docs = spark.createDataFrame([(i, t, 1, "o") for i, t in rows()] + [(None, "no id", 1, "o")], SCHEMA)
    filled = infill.fill_in_middle(docs, pattern)
    got = sorted((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in filled.collect() if r["doc_id"] != 3)
    assert got == sorted((i, *plain_run(i, t, pattern)) for i, t in rows() if i != 3)
    assert filled.where("doc_id = 3").count() == 3 and {r[2] for r in got} == {"plain", "psm", "spm"}
    back = filled.withColumn("back", infill.restored(F.col("output"), F.col("form"))).select("doc_id", "back").collect()
    assert sorted((r["doc_id"], r["back"]) for r in back) == sorted((i, t or "") for i, t in rows())
    assert infill.fill_in_middle(docs.limit(0), pattern).count() == 0


def test_marks_are_checked(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<<", "<S>", "<M>"), ("<P", "<P>", "<M>"), ("[P]", "<S>", "<M>")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(docs, marks=marks)
    other = infill.fill_in_middle(docs, marks=("[.P", "[.S", "[.M"), plain=0)
    assert other.select(infill.restored(F.col("output"), F.col("form"), ("[.P", "[.S", "[.M"))).first()[0] == "a b"
