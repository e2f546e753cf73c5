import hashlib
import random
import re
from collections import Counter

import numpy as np

from hazegrid.llm import fingerprint, neardup, suffixdedup
from hazegrid.llm.common import components


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        out[i] = {tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def classes_of(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_rows(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = [[rng.choice(words) for _ in range(n)] for n in (60, 40, 200, 12)]
    rows = []
    for b in base:
        for _ in range(45):
            copy = list(b)
            for _ in range(rng.randint(0, max(1, len(b) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(5, 30))) for _ in range(60)]
    rows += ["One two three", "one TWO\tthree", "one two", "", None, " \n", "É é", "a b c d e", "a b c d e f", "A b\x0bc d e"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "STAR", 4)
    rows = near_rows(1)
    docs = spark.createDataFrame([(i, t, "n", 0) for i, t in rows], "doc_id long, text string, node string, a int").repartition(3)
    sets = sets_of(rows)
    wanted = classes_of(sets)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), wanted[r["doc_id"]], wanted[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0
    rows = [(5, "x y z"), (5, "x y z"), (3, "x y z"), (None, "x y z"), (9, None)]
    got = Counter(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(5, 1, 3, False): 2, (3, 1, 3, True): 1, (9, 0, 9, True): 1})


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(1, 2 ** 63, 3000, dtype=np.uint64)
    for n, shared in ((2000, 1500), (400, 320), (30, 24)):
        a, b = pool[:n], np.concatenate([pool[:shared], pool[n: 2 * n - shared]])
        r = neardup.registers(np.concatenate([a, b]), np.array([n, n]))
        j = shared / (2 * n - shared)
        assert abs(neardup.estimate((r[0] == r[1]).sum()) - j) < 5 * np.sqrt(j * (1 - j) * (1 / 160 + 1 / n))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 200)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[100 + k] == 100 for k in range(30)) and got[200] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_array():
    rng = random.Random(6)
    for _ in range(1500):
        k = rng.choice([1, 2, 3, 6])
        text = [rng.randint(1, k) for _ in range(rng.randint(0, 40))] + [0]
        assert suffixdedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        for a in range(len(t) - 49):
            w = t[a: a + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - 49):
            if first[t[a: a + 50]] < i:
                gone[a: a + 50] = True
        runs = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((i, len(t), int(gone.sum()), int((runs == 1).sum()),
                    hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return Counter(out)


def test_repeats_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "BUCKET_BYTES", 4000)
    rng = random.Random(8)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 90))) for _ in range(20)] + ["a" * 70, "ab" * 60, "é" * 40]
    parts += ["".join(rng.choice("abcdefghij ") for _ in range(rng.randint(30, 300))) for _ in range(20)]
    rows = [(rng.randint(0, 150), "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))) for _ in range(220)]
    rows += [(500, None), (501, ""), (502, "a" * 49), (503, "b" * 50), (504, "b" * 50)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, block int").repartition(4)
    got = Counter(tuple(r) for r in suffixdedup.digests(suffixdedup.remove_repeats(docs)).collect())
    assert got == brute_repeats([(i, (t or "").encode()) for i, t in rows])


def test_codes_fit_the_largest_number_of_buckets():
    raw = "".join(random.Random(3).choice("abcd") for _ in range(3000)).encode()
    block = suffixdedup.Block(np.array([1, 2]), np.array([1500, 1500]), raw)
    block.anchors()
    block.units(np.arange(len(block.run_first)))
    for bits in (0, 7, suffixdedup.MAX_BUCKET_BITS):
        codes, _, number = block.anchor_codes(bits)
        assert (codes[1:] > codes[:-1]).all() and len(number) == len(block.run_hash)
        wanted = block.run_hash >> np.uint64(64 - bits) if bits else np.zeros(len(number), np.uint64)
        assert (codes[number] >> np.uint64(suffixdedup.ANCHOR_BITS) == wanted).all()
        bucket, order = block.entries(bits)
        assert (bucket >= 0).all() and (bucket < 1 << bits).all() and (np.diff(bucket[order]) >= 0).all()


def test_repeats_of_nothing_and_spans(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixdedup.remove_repeats(empty).count() == 0
    shared = "".join(random.Random(2).choice("abcdefgh ") for _ in range(80))
    docs = spark.createDataFrame([(1, "x" + shared), (2, "yy" + shared + "é"), (None, shared)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffixdedup.remove_repeats(docs).collect()}
    assert set(got) == {1, 2} and got[1]["starts"] == [] and (got[2]["starts"], got[2]["ends"]) == ([2], [82])
    assert {r["text"] for r in suffixdedup.texts_left(suffixdedup.remove_repeats(docs)).collect()} == {"x" + shared, "yyé"}


def test_repeats_of_short_texts_alone():
    for n in range(60):
        block = suffixdedup.Block(np.array([1]), np.array([n]), b"a" * n)
        block.anchors()
        assert sum(block.run_last - block.run_first + 1) == max(0, n - 49)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(7)
    for _ in range(400):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(2))
        most = rng.randint(0, 8)
        assert fingerprint.edit_distance(a, b, most) == min(levenshtein(a, b), most + 1)


def test_fingerprints_do_not_depend_on_company():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefé ") for _ in range(rng.randint(0, 3000))) for _ in range(80)] + ["", "a"]
    together = fingerprint.fingerprint_texts(texts)
    assert [fingerprint.fingerprint_texts([t])[0] for t in texts] == together


def test_likeness_follows_edits():
    rng = random.Random(10)
    for n in (300, 5000):
        text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
        few = list(text)
        for _ in range(2):
            few.insert(rng.randrange(len(few)), "q")
        other = "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
        p, q, r, e = fingerprint.fingerprint_texts([text, "".join(few), other, ""])
        assert fingerprint.likeness(p, p) == 1 and fingerprint.likeness(p, q) > 0.5 and fingerprint.likeness(p, r) < 0.3
        assert fingerprint.likeness(e, e) == 1 and fingerprint.likeness(p, e) == 0


def test_cores_that_differ_in_their_first_byte_are_told_apart():
    rest = prose(random.Random(18), 80).encode()[:59]
    block = suffixdedup.Block(np.array([1, 2]), np.array([60, 60]), b"b" + rest + b"a" + rest)
    block.anchors()
    # the second window's anchor is four bytes on, one slot, and its core's first byte is smaller by one
    block.run_first = block.run_last = np.array([0, 60])
    block.run_anchor, block.run_text = np.array([0, 64]), np.array([0, 1])
    block.units(np.arange(2))
    assert block.unit_core.tolist() == [0, 60] and len(set(block.unit_hash.tolist())) == 2


def test_against_next(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 7)
    rng = random.Random(11)
    rows = [(k * 3, "".join(rng.choice("abc é") for _ in range(rng.randint(0, 200)))) for k in range(60)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _range int").repartition(5)
    got = sorted(fingerprint.against_next(docs).collect(), key=lambda r: -r["doc_id"])
    order = [(i, t or "") for i, t in sorted(rows, key=lambda x: -x[0])]
    assert [r["doc_id"] for r in got] == [i for i, _ in order]
    for r, (_, t), (_, following) in zip(got, order, order[1:] + order[:1]):
        changed = fingerprint.edited(t, following)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        p, q, f = fingerprint.fingerprint_texts([t, changed, following])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (p, q)
        assert (r["near_edited"], r["near_next"]) == (fingerprint.likeness(p, q), fingerprint.likeness(p, f))
    assert fingerprint.against_next(docs.limit(0)).count() == 0
    assert fingerprint.against_next(docs.where("doc_id = 0")).count() == 1


def edited_by(text, share, rng):
    letters = list(text)
    for _ in range(int(share * len(text))):
        at, kind = rng.randrange(len(letters)), rng.random()
        if kind < 1 / 3:
            letters[at] = rng.choice("abcdefghijklmnop ")
        elif kind < 2 / 3 or len(letters) < 2:
            letters.insert(at, rng.choice("abcdefghijklmnop "))
        else:
            del letters[at]
    return "".join(letters)


def prose(rng, n):
    words = ["".join(rng.choice("abcdefghijklmnoprstuvé") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    text = ""
    while len(text) < n:
        text += rng.choice(words) + " "
    return text[:n]


def classes_by_distance(rows, share):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            most = int(share * max(len(a or ""), len(b or "")))
            if a and b and fingerprint.edit_distance(a, b, most) <= most:
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in parent}


def test_near_classes(spark):
    rng = random.Random(12)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(600))
    rows = [(1, base), (2, base[:300] + "X" + base[300:]), (3, base), (4, "".join(rng.choice("abcdefghijklmnop ") for _ in range(600))), (5, None), (6, ""), (None, base), (7, "a"), (7, "a"), (8, "b")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _h int")
    got = sorted(tuple(r) for r in fingerprint.near_classes(docs).collect())
    assert [(i, c) for i, c, _ in got] == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 7), (7, 7), (8, 8)]
    assert [n for *_, n in got] == [1, 1, 1, 0, 0, 0, 0, 0, 0]
    assert fingerprint.near_classes(docs.limit(0)).count() == 0


def test_shared_runs_bound_the_distance(monkeypatch):
    rng = random.Random(15)
    counted, asked, in_band = fingerprint.RunCounts(), [], fingerprint._in_band
    monkeypatch.setattr(fingerprint, "_in_band", lambda a, b, most: asked.append(most) or in_band(a, b, most))
    for n in (3, 40, 900):
        text = prose(rng, n)
        for share in (0, 0.02, 0.1, 0.5):
            other = edited_by(text, share, rng)
            counted.hold(fingerprint.runs(text))
            least = counted.least_edits(fingerprint.runs(other), max(len(text), len(other)))
            exact = fingerprint.edit_distance(text, other, 1000)
            assert least <= exact == fingerprint.edit_distance(text, other, 1000, least)
    # runs alone tell these apart, and no band is tried that cannot hold the distance
    asked.clear()
    assert not fingerprint._near(text, other, 0.05, least) and not asked
    assert fingerprint._near(text, edited_by(text, 0.03, rng), 0.05) and len(asked) == 1


def test_near_classes_equal_all_pairs(spark, monkeypatch):
    # small blocks: the texts with one header share buckets and are no copies of each other
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(13)
    header = prose(rng, 500)
    rows = [header + prose(rng, 120) for _ in range(40)]
    for n, copies in ((60, 8), (300, 8), (900, 12), (6000, 4)):
        first = prose(rng, n)
        rows += [first] + [edited_by(first, rng.choice([0.01, 0.02, 0.045]), rng) for _ in range(copies)]
    rows += [edited_by(t, 0.02, rng) for t in rows[:10]]
    chain = prose(rng, 400)
    for _ in range(6):
        rows.append(chain)
        chain = edited_by(chain, 0.04, rng)
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in fingerprint.near_classes(docs).collect()}
    assert got == classes_by_distance(rows, 0.05)


def test_recall_of_near_bands():
    """Pairs that a band retrieves and the registers let through, by share of edits."""
    rng = random.Random(14)

    def recall(length, share, bands, rows):
        found = 0
        for _ in range(60):
            text = prose(rng, length)
            x, y = fingerprint.near_registers([text, edited_by(text, share, rng)], bands, rows)
            same = x == y
            found += bool(same.reshape(bands, rows).all(axis=1).any() and same.mean() >= fingerprint.agreement(length, max(share, 0.05)))
        return found / 60

    for length in (60, 300, 2000, 10_000):
        for share in (0.01, 0.02, 0.05):
            assert recall(length, share, 80, 4) >= 0.9, (length, share)


def test_registers_do_not_depend_on_company():
    rng = random.Random(15)
    texts = [prose(rng, n) for n in (1, 2, 3, 4, 30, 500)] + ["é", "\U0001F600" * 9]
    together = fingerprint.near_registers(texts, 8, 3)
    for t, r in zip(texts, together):
        assert (fingerprint.near_registers([t], 8, 3)[0] == r).all()
