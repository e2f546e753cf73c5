import random
import zlib
from collections import Counter

import numpy as np
import pytest

from hazegrid.llm import packing, tokenfile
from hazegrid.llm.common import encoder, tokenizer_path

PATH = tokenizer_path()
TEXTS = ["Hello, world. it's 12 o'clock!", "", "ÀÉ Straße ﬁne ½ ", "a|b | c", "x" * 6000, "tab\tnew\nline\x0b\x0c\rend",
         "<|endoftext|> <|ENDOFTEXT|>", "…well,, no.. yes.", "日本語 текст \u00a0nbsp\u2003em \x1csep", "don't CAN'T 's", "é. e\u0301. ó,"]


def library(text):
    return encoder(PATH).tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_equals_library():
    for chosen in (TEXTS, TEXTS[::-1]):
        for text, raw in zip(chosen, encoder(PATH).encode([t.encode() for t in chosen])):
            assert np.frombuffer(raw, "<u4").tolist() == library(text), text


def fewest(items, capacity):
    """Exact number of bins by search."""
    items = sorted(items, reverse=True)
    best = len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in sorted(set(range(len(bins))), key=lambda i: bins[i]):
            if bins[i] >= items[k] and (i == 0 or bins[i] != bins[i - 1]):
                place(k + 1, bins[:i] + [bins[i] - items[k]] + bins[i + 1:])
        place(k + 1, bins + [capacity - items[k]])

    place(0, [])
    return best


def laid_out(counts, capacity):
    rows, bins = packing.plan_packing(counts, capacity)
    held = [[] for _ in range(bins)]
    taken = Counter()
    for length, rank, n, per, first, offset in rows.tolist():
        for b in range(n):
            for k in range(per):
                held[first + b].append((offset + k * length, length))
                taken[length] += 1
        assert rank >= 0
    for h in held:
        end = 0
        for offset, length in sorted(h):
            assert offset == end
            end += length
        assert 0 < end <= capacity
    assert taken == Counter({k: v for k, v in counts.items() if v})
    return bins


def test_plan_is_whole_and_near_the_best():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        got, best = laid_out(Counter(items), capacity), fewest(items, capacity)
        assert best <= got <= best + 1


def test_reduction_keeps_an_optimum():
    rng = random.Random(5)
    for _ in range(300):
        capacity = rng.choice([12, 20])
        items = [rng.randint(capacity // 4, capacity) for _ in range(rng.randint(1, 9))]
        plan = packing._Plan(Counter(items), capacity)
        packing.reduce_instance(plan)
        rest = [x for x, n in plan.left.items() for _ in range(n)]
        assert plan.bins + (fewest(rest, capacity) if rest else 0) == fewest(items, capacity), items


def test_plan_of_many_copies_is_small():
    rows, bins = packing.plan_packing({7: 10 ** 9, 4089: 10 ** 6, 3000: 10 ** 8, 1: 3}, 4096)
    assert len(rows) < 50 and bins >= 10 ** 8


def test_plan_refuses_bad_lengths():
    for bad in (0, 11):
        with pytest.raises(ValueError):
            packing.plan_packing({bad: 1}, 10)
    assert packing.plan_packing({}, 10)[1] == 0


ROWS = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(40, None, "x", 1), (41, "same text here", "y", 2), (42, "same text here", "y", 2)]


def test_pack_documents(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, length string, piece int")
    pieces, placement = packing.pack_documents(docs, PATH, capacity=64)
    got = {}
    for r in placement.collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {r[0] for r in ROWS}
    for doc, text, *_ in ROWS:
        ids = library(text or "") + [1]
        own = sorted(got[doc], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), 64)) and sum(r["length"] for r in own) == len(ids)
        for r in own:
            part = ids[r["start"]: r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for row in packing.sequences(pieces, placement).collect():
        assert len(row["ids"]) <= 64 and sum(row["lengths"]) == len(row["ids"])
    assert packing.pack_documents(docs.limit(0), PATH)[1].count() == 0


@pytest.mark.parametrize("ids", [[], [5], [49407] * 256, list(range(1000)), [3] * 300 + [70_000, 4_000_000_000] + [3] * 300])
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    shard = tokenfile.Shard(tokenfile.make_shard(np.array([7]), np.array([len(ids)]), ids))
    assert shard.read(0, len(ids)).tolist() == ids.tolist()
    for a, b in ((0, 1), (200, 300), (255, 257), (10, 10)):
        if b <= len(ids):
            assert shard.read(a, b).tolist() == ids[a:b].tolist()


def test_random_blocks_round_trip():
    rng = np.random.default_rng(1)
    for _ in range(60):
        top = int(rng.choice([1, 2, 50, 50_000, 2 ** 32]))
        ids = rng.integers(0, top, int(rng.integers(1, 2000)), dtype=np.uint32)
        raw, starts = tokenfile.pack(ids, float(rng.choice([0.0, 0.5, 0.9, 1.0])))
        assert len(raw) == starts[-1]
        assert tokenfile.unpack(np.frombuffer(raw, np.uint8), starts[:-1])[: len(ids)].tolist() == ids.tolist()


def test_token_files(spark, tmp_path):
    docs = spark.createDataFrame([*ROWS, (3, "again", "z", 0), (None, "left out", "z", 0)], "doc_id long, text string, ids string, start int")
    folder = tokenfile.write_token_files(docs, str(tmp_path / "f"), PATH, shard_ids=40)
    rows = tokenfile.read_token_files(spark, folder).orderBy("start").collect()
    wanted = sorted([(d, library(t or "") + [2]) for d, t, *_ in ROWS] + [(3, library("again") + [2])], key=lambda x: x[0])
    assert [r["doc_id"] for r in rows] == [d for d, _ in wanted]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == Counter((d, tuple(i)) for d, i in wanted)
    at = 0
    for r in rows:
        assert r["start"] == at
        at += len(r["ids"])
    for r, x in zip(rows, tokenfile.read_digests(spark, folder).orderBy("start").collect()):
        assert (x["doc_id"], x["start"], x["n_tokens"]) == (r["doc_id"], r["start"], len(r["ids"]))
        assert x["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert tokenfile.token_file_digests(docs.limit(0), PATH).count() == 0
