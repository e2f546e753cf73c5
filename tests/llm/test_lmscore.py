import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hazegrid.llm import lmscore

SCHEMA = "doc_id long, text string, h int, n string, score int"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def by_hand(rows, order, quantised=True):
    """Rows of the result with exact dictionaries; counts quantised as in the filter, without its false hits."""
    value = (lambda c: float(lmscore.VALUE[lmscore.level(np.array([c]))[0]])) if quantised else float
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    one, grams = Counter(), Counter()
    for i, t in rows:
        if not held[i]:
            seq = ["<s>", *words_of(t), " end"]
            one.update(seq[1:])
            for k in range(1, order + 1):
                grams.update(tuple(seq[j: j + k]) for j in range(len(seq) - k + 1))
    total, types = sum(one.values()), len(one)
    out = []
    for i, t in rows:
        seq = ["<s>", *words_of(t), " end"]
        base = sum(math.log10((one[w] + 1) / (total + types + 1)) for w in seq[1:])
        score = 0.0
        for j in range(1, len(seq)):
            shorter = value(grams[(seq[j],)])
            before = value(grams[(seq[j - 1],)])
            p = (shorter + 1) / (total + types + 1)
            for k in range(2, order + 1):
                if j - k + 1 < 0:
                    break
                both = min(value(grams[tuple(seq[j - k + 1: j + 1])]), before, shorter)
                p = (both + lmscore.PRIOR * p) / (before + lmscore.PRIOR)
                if j - k >= 0:
                    before = min([value(grams[tuple(seq[a: j])]) for a in range(j - k, j)] + [value(grams[tuple(seq[a: j - 1])]) for a in range(j - k, j - 1)])
                shorter = both
            score += math.log10(p)
        out.append((i, held[i], len(seq) - 1, sum(one[w] > 0 for w in seq[1:]), total, base, score))
    return sorted(out, key=lambda r: (r[0], r[2], r[6]))


def sample_rows(rng, n=150):
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    text = lambda k: "".join(rng.choice(vocabulary[: rng.choice([5, 50, 300])]).title() + rng.choice([" ", "\n", " \t ", "\x85 ", "  "]) for _ in range(k))
    rows = [(k, text(rng.choice([0, 1, 30, 120]))) for k in range(n)]
    return rows + [(7, None), (8, ""), (3, rows[3][1]), (-5, text(30_000)), (1000, "nowhere else " * 50)]


def result(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: (r[0], r[2], r[6]))


@pytest.mark.parametrize("order,head", [(2, 1 << 18), (2, 40), (3, 0), (1, 40)])
def test_scores_equal_dictionaries(spark, monkeypatch, order, head):
    monkeypatch.setattr(lmscore, "BITS_PER_TOKEN", 4000)  # no false hits
    monkeypatch.setattr(lmscore, "BITS_PER_TYPE", 4000)
    monkeypatch.setattr(lmscore, "HEAD", head)
    rows = sample_rows(random.Random(order))
    frame = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows] + [(None, "no id", 1, "x", 2)], SCHEMA).repartition(3)
    got, wanted = result(lmscore.score_documents(frame, order)), by_hand(rows, order)
    assert [r[:5] for r in got] == [r[:5] for r in wanted] and {r[1] for r in got} == {True, False}
    assert np.allclose([r[5] for r in got], [r[5] for r in wanted]) and np.allclose([r[6] for r in got], [r[6] for r in wanted])


def test_production_filter_is_close_and_beats_the_base(spark):
    rng = random.Random(9)
    follow = {w: [f"{w}{k}"[-3:] for k in range(3)] for w in (f"{a:03d}" for a in range(1000))}

    def text(n):
        w, out = "000", []
        for _ in range(n):
            w = rng.choice(follow[w]) if rng.random() < 0.9 else f"{rng.randrange(1000):03d}"
            out.append(w)
        return " ".join(out)

    rows = [(k, text(200)) for k in range(600)]
    got = result(lmscore.score_documents(spark.createDataFrame(rows, "doc_id long, text string")))
    exact = {r[0]: r for r in by_hand(rows, 2, quantised=False)}
    held = [r for r in got if r[1]]
    assert np.mean([abs(r[6] - exact[r[0]][6]) / -r[6] for r in held]) < 0.03
    assert all(r[6] > r[5] for r in held)


def test_filter_is_never_too_low_and_seldom_too_high(spark):
    docs = spark.createDataFrame([(" ".join(f"w{k}" for k in range(j, j + 400)) * (j % 5 + 1),) for j in range(0, 20_000, 200)], "text string")
    model, _ = lmscore.train(docs)
    assert (model.floors == 1).all() and model.false_positive_rate() < 0.08
    counts = Counter()
    for (text,) in docs.collect():
        tokens, begins = lmscore.sequences([text.encode()])
        for h, at in lmscore.gram_hashes(tokens, begins, 2):
            counts.update(h[at].tolist())
    h = np.array(list(counts), np.uint64)
    true = lmscore.VALUE[lmscore.level(np.array(list(counts.values())))]
    got = model.counts(h)
    assert (got >= true).all() and (got > true).mean() < 0.08
    assert (model.counts(np.random.default_rng(1).integers(0, 2 ** 63, 20_000).astype(np.uint64)) > 0).mean() < 0.08


def test_full_blocks_raise_their_lowest_level(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "MAX_BITS", 2 * lmscore.BLOCK_BITS)
    rng = random.Random(3)
    rows = [(k, " ".join(f"{rng.randrange(30_000)}" for _ in range(2000)) + " the same end") for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model, _ = lmscore.train(frame.select("text"))
    assert (model.floors > 1).all() and model.false_positive_rate() < 0.2
    tokens, begins = lmscore.sequences([b"the same end"])
    grams = list(lmscore.gram_hashes(tokens, begins, 2))[1]
    assert (model.counts(grams[0][2:4]) >= 30).all()
    got, wanted = result(lmscore.score_documents(frame)), by_hand(rows, 2)
    assert np.allclose([r[5] for r in got], [r[5] for r in wanted]) and [r[3] for r in got] == [r[3] for r in wanted]


def test_empty_and_untrained(spark):
    frame = spark.createDataFrame([(2, "a b"), (2, None)], "doc_id long, text string")
    assert lmscore.score_documents(frame.limit(0)).count() == 0
    only = frame.withColumn("doc_id", F.lit(next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2)).cast("long"))
    assert {tuple(r)[2:] for r in lmscore.score_documents(only).collect()} == {(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)}


def test_rare_ngrams_of_full_blocks_are_counted(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "MAX_BITS", 2 * lmscore.BLOCK_BITS)
    monkeypatch.setattr(lmscore, "BUCKET_GRAMS", 100_000)
    rng = random.Random(4)
    rows = [(k, " ".join(f"{rng.randrange(30_000)}" for _ in range(2000)) + " the same end") for k in range(40)] + [(99, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model, _ = lmscore.train(frame.select("text"))
    assert (model.floors > 1).all()
    got, wanted = result(lmscore.score_documents(frame)), by_hand(rows, 2)
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    assert np.allclose([r[6] for r in got], [r[6] for r in wanted], rtol=2e-3)


def test_word_hashes_are_xxh64():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aBc\t\n\x0b\x0c\r \x85\xa0\x00é!") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["", " ", "X" * 31, " " + "y" * 32, "z" * 500 + " ", *(" ".join("Q" * k for k in range(1, 40)) for _ in range(2))]
    tokens, begins = lmscore.sequences([t.encode() for t in texts])
    wanted = [[lmscore.START, *(xxhash.xxh64_intdigest(w.encode()) for w in words_of(t)), lmscore.END] for t in texts]
    assert begins.tolist() == np.cumsum([0] + [len(w) for w in wanted])[:-1].tolist()
    assert tokens.tolist() == [int(h) for w in wanted for h in w]
