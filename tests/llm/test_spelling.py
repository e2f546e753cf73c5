import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hazegrid.llm import spelling

SCHEMA = "doc_id long, text string, word int, n string, cell int"


def counted(rows):
    """Frequent words by one loop."""
    total = Counter()
    for doc_id, text in rows:
        if doc_id is None:
            continue
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def by_pairs(words):
    """Every result row by comparing all pairs."""
    around = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(around[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def edited(rng, word, letters):
    k, c = rng.randrange(len(word)), rng.choice(letters)
    return rng.choice([word[:k] + word[k + 1:], word[:k] + c + word[k:], word[:k] + c + word[k + 1:]])


def vocabulary(rng, n):
    letters = "abcdeféÿ×É"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(n)]
    words += [edited(rng, rng.choice(words), letters) for _ in range(2 * n)]
    words += ["".join(rng.sample(words[0] + "abc", len(words[0]) + 3)) for _ in range(n // 3)]  # one bag of letters
    words += ["x" * 300, "x" * 299 + "y", "x" * 301, "aaaaaa", "aaaaaaa"]
    return sorted(set(words))


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("cell", [4096, 40])
def test_variants_equal_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(spelling, "CELL", cell)  # small cells: several per length, and cells in parts
    rng = random.Random(cell)
    words = {w: rng.choice([5, 6, 25, 26, 130, 700, 9000]) for w in vocabulary(rng, 200)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert rows_of(spelling.variants(frame)) == by_pairs(words)
    assert any(r[2] != r[1] and r[1] for r in by_pairs(words))


def test_chains_and_ties(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "cccccc": 5, "cccccd": 30, "ccccce": 30, "zzzzzz": 7}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r[0]: r for r in rows_of(spelling.variants(frame))}
    assert got["aaaaaa"][1:3] == ("aaaaab", "aabbbb") and got["cccccc"][1] == "cccccd" and got["zzzzzz"] == ("zzzzzz", None, "zzzzzz", 7, 0, None)
    assert list(got.values()) == by_pairs(words)


def test_words_equal_one_loop(spark):
    rng = random.Random(8)
    words = vocabulary(rng, 60)
    text = lambda n: "".join(rng.choice(words).title() + rng.choice([" ", ", ", "-", "9", "中", "Ā", "\n"]) for _ in range(n))
    rows = [(k - 3, text(rng.choice([0, 1, 30, 200]))) for k in range(120)] + [(5, text(40)), (6, None), (7, ""), (None, "aaaaaa " * 9), (8, "ABCDEF " * 20_000)]
    frame = spark.createDataFrame([(i, t, 1, "n", 2) for i, t in rows], SCHEMA)
    got = {r["word"]: r["n"] for r in spelling.frequent_words(frame).collect()}
    assert got == counted(rows) and len(got) > 50
    assert rows_of(spelling.spelling_variants(frame)) == by_pairs(got)
    assert spelling.spelling_variants(frame.limit(0)).count() == 0


def test_runs_split_alike():
    for text in ("AbÀÿx Āyſ×z", "aéb-c", "¿À", "", "A中b", "\U0001F600q"):
        assert [r.decode() for r in spelling.runs(text.encode())] == [
            r.translate({c: c + 32 for c in range(65, 91)}) for r in re.findall("[A-Za-zÀ-ÿ]+", text)]


def test_boxes_never_hide_a_neighbour():
    rng = random.Random(2)
    words = [w for w in vocabulary(rng, 300) if len(w) == 7]
    for w in words:
        for other in (x for x in words if near(w, x)):
            points = spelling.vectors(*spelling.codes_of([w, other])).astype(int)
            assert np.abs(points[0] - points[1]).sum() <= 2
    cell = spelling.Cell(words, np.ones(len(words)))
    q, m = cell.near(words)
    assert sorted(zip(q.tolist(), m.tolist())) == [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)]
