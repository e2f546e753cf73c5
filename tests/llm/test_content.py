import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazegrid.llm import decontaminate, langid, licenses, quality, queries, urlrules


# --- tiling --------------------------------------------------------------------

def greedy(p, t, least):
    mp, mt, tiles = [0] * len(p), [0] * len(t), []
    while True:
        best = None
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not mp[i + k] and not mt[j + k]:
                    k += 1
                if k >= least and (best is None or k > best[0]):
                    best = (k, i, j)
        if not best:
            return tiles
        k, i, j = best
        for x in range(k):
            mp[i + x] = mt[j + x] = 1
        tiles.append((i, j, k))


def test_tiles_equal_greedy_search():
    rng = np.random.default_rng(1)
    for _ in range(300):
        p, t = (rng.integers(0, 3, int(rng.integers(0, n))).astype(np.uint64) for n in (30, 60))
        assert sorted(decontaminate.tile(p, t, 3)) == sorted(greedy(p.tolist(), t.tolist(), 3))


def test_contamination(spark):
    rng = random.Random(3)
    word = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(n))
    a, b, c, d = word(12), word(12), word(12), word(12)
    items = spark.createDataFrame([(1, f"{a}. {b}. {c}"), (2, word(40)), (3, "too short"), (4, None), (5, ""), (6, "?!")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, f"{word(50)} {a} {b} {c} {word(50)}", 1), (2, f"{c}, {word(9)} {a}! {word(30)} {b.upper()}", 1), (3, f"{word(60)} {a[:40]}", 1),
        (4, f"{word(30)} {a} {word(5)} {b[:36]}", 1), (5, None, 1), (6, "", 1), (7, "it is Too, short!", 1), (8, "too long short", 1), (9, "short", 1), (1, "a repeated id", 1), (None, f"{a} {b} {c}", 1),
    ], "doc_id long, text string, item_id int")
    got = {r["doc_id"]: r for r in decontaminate.flag_documents(docs, items).collect()}
    assert {k for k, r in got.items() if r["contaminated"]} == {1, 2, 4, 7}
    assert got[7]["item_id"] == 3 and got[7]["coverage"] == 1.0
    assert got[1]["coverage"] == 1.0 and got[2]["coverage"] == 1.0 and 0.5 <= got[4]["coverage"] < 0.6 and got[2]["item_id"] == 1
    assert decontaminate.flag_documents(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.flag_documents(docs.limit(0), items).count() == 0


# --- licenses --------------------------------------------------------------------

def test_license_windows_find_every_place(spark):
    rng = random.Random(4)
    filler = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(n))
    rows, wanted = [], {}
    for k in range(120):
        name = rng.choice(list(licenses.TEMPLATES))
        text = licenses.TEMPLATES[name]
        if k % 3 == 0:
            text = re.sub(r"[ ,.]+", lambda m: rng.choice([" ", ",  ", "\n"]), text).upper()
        rows.append((k, filler(rng.randint(0, 90)) + " " + text + ". " + filler(rng.randint(0, 90))))
        wanted[k] = name
    rows += [(200, filler(500)), (201, None), (202, ""), (203, "Licensed under")]
    got = {r["doc_id"]: r for r in licenses.licenses_per_document(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")).collect()}
    assert len(got) == len(rows)
    for k, name in wanted.items():
        assert name in got[k]["licenses"].split(";")
    assert all(got[k]["n_licenses"] == 0 for k in (200, 201, 202, 203))
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_finds_do_not_depend_on_neighbours(spark):
    rng = random.Random(14)
    rows = []
    for k in range(60):
        words = rng.choice(list(licenses.TEMPLATES.values())).split()
        for _ in range(rng.randint(0, 12)):  # near the limit of containment
            words.insert(rng.randrange(len(words)), "x")
        rows.append((k, "w " * rng.randint(0, 40) + " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(tuple(r) for r in licenses.scan(d).collect()) for d in (docs.coalesce(1), docs.repartition(30), docs.orderBy(F.desc("doc_id")))]
    assert found[0] == found[1] == found[2] and found[0]
    assert licenses.scan(docs, {}).count() == 0


def test_license_windows_cover_their_templates():
    for n in range(1, 400):
        length = licenses.window_length(n)
        assert length - licenses.slide(length) + 1 >= n
    with pytest.raises(ValueError):
        licenses.Index({"short": "two words"})


# --- addresses -------------------------------------------------------------------

def by_hand(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, rule_host, rule_path in queries.URL_RULES:
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            if best is None or len(rule_host + rule_path) > len(best[0]):
                best = (rule_host + rule_path, verdict)
    return host, path, best


def test_stated_rules(spark):
    urls = [None, "", "no scheme/x", "HTTP://A.ORG/", "x://ORG", "x://org/", "https://u@EX.com:80/fr/?a://b#c", "a\nb://example.org/es/\nq",
            "q://example.org/es", "q://notexample.org/es/1", "q://www.example.org/en/12", "://com/de/", "://", "x://?://com/fr/", "x://a.com#/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "url string, label string")
    got = {r["page_id"]: r for r in urlrules.judge(pages, none, queries.URL_RULES).collect()}
    assert len(got) == len(urls)
    for k, url in enumerate(urls):
        host, path, best = by_hand(url)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == (
            host, path, best and best[0], best[1] if best else "allow"), url


def test_mined_rules_block(spark):
    bad = [(f"http://casino-win.example.net/en/{k}", "block") for k in range(40)]
    good = [(f"http://good{k % 7}.example.net/en/{k}", "allow") for k in range(150)]
    labelled = spark.createDataFrame([*bad, *good, (None, "block"), ("http://x.y/", None)], "url string, label string")
    pages = spark.createDataFrame([(1, "https://www.casino-win.example.net/de/7"), (2, "http://good9.example.net/en/1"), (2, "http://good9.example.net/en/1"), (None, None)],
                                  "page_id long, url string")
    got = sorted((str(r["page_id"]), r["verdict"]) for r in urlrules.judge(pages, labelled, []).collect())
    assert got == [("1", "block"), ("2", "allow"), ("2", "allow"), ("None", "allow")]
    assert urlrules.judge(pages.limit(0), labelled, []).count() == 0


def test_rules_are_judged_against_the_base_rate_of_each_kind(spark):
    rng = random.Random(16)
    rows = []
    for k in range(3000):
        host = "free-bets" if k % 10 == 0 else f"good{k % 7}"
        url = f"http://{host}.example.net/{rng.choice(['en', 'de'])}/{k}"
        # four in ten against one in ten elsewhere; the other kind does not depend on the address
        rows += [(url, "toxic", "block" if rng.random() < (0.4 if k % 10 == 0 else 0.1) else "allow"),
                 (url, "quality", "block" if rng.random() < 0.15 else "allow")]
    labelled = spark.createDataFrame(rows, "url string, kind string, label string")
    pages = spark.createDataFrame([(1, "http://free-bets.example.net/fr/1"), (2, "http://good3.example.net/en/2")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urlrules.judge(pages, labelled, [], ["quality", "toxic"]).collect()}
    assert got == {1: "block", 2: "allow"}
    chance = labelled.where("kind = 'quality'").select(urlrules.tokens_of(F.col("url")).alias("tokens"), "label")
    assert urlrules.mine_rules(chance).count() == 0


# --- languages --------------------------------------------------------------------

EN, DE = "the and of to in that it was for on are with as his they be at one have this".split(), "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split()


def language_rows(rng, n):
    return [(k, " ".join(rng.choice(EN if k % 2 else DE) for _ in range(40)), "en" if k % 2 else "de", f"s{k % 5}") for k in range(n)]


def test_language_of_held_out_rows(spark):
    rng = random.Random(5)
    rows = language_rows(rng, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.train_text_model(docs.where("doc_id % 3 <> 0"))
    asked = [r for r in rows if r[0] % 3 == 0] + [(900, None, None, None), (901, "", "en", "s1"), (902, "1234 !!", "de", "s1"),
                                                   (903, "Ω≈ç√∫ 漢字かな交じり文 漢字かな", None, None), (904, "the", None, "s1")]
    frame = spark.createDataFrame(asked, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in langid.identify(langid.document_rows(frame), model).collect()}
    assert len(got) == len(asked)
    for k, _, lang, _ in asked[:100]:
        assert got[k]["language"] == lang and got[k]["accepted"]
    assert not any(got[k]["accepted"] for k in (900, 901, 902, 903)) and got[904]["language"] == "en"
    assert langid.identify(langid.document_rows(frame.limit(0)), model).count() == 0


def test_texts_in_no_known_language_are_rejected_though_they_are_trained_on(spark):
    rng = random.Random(15)
    junk = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 9))) for _ in range(80))
    italian = "domani andremo dalla nonna che abita in campagna e prepara sempre una torta di mele per tutti noi"
    rows = language_rows(rng, 300) + [(900, junk, "en", "s1"), (901, junk, "en", "s1"), (902, italian, "de", "s2"), (903, junk[::-1], "xx", "s3")]
    rows += [(904, " ".join(EN + DE), "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in langid.identify(langid.document_rows(docs), langid.train_text_model(docs)).collect()}
    assert {k for k, r in got.items() if not r["accepted"]} == {900, 901, 902, 903}
    assert all(got[k]["language"] == lang for k, _, lang, _ in rows[:300])


def test_other_evidence_decides_short_texts(spark):
    rng = random.Random(6)
    rows = language_rows(rng, 200)
    model = langid.train_text_model(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    pages = [(k, t, lang, lang, f"{lang}.org", f"www.{lang}.org") for k, t, lang, _ in rows]
    pages += [(900, "in", "de", "de", "de.org", "www.de.org"), (901, "in", "en", "en", "en.org", "www.en.org"), (902, "in", None, None, None, None)]
    got = {r["page_id"]: r for r in langid.identify(spark.createDataFrame(
        pages, "page_id long, text string, declared string, suffix string, domain string, host string"), model, "page_id").collect()}
    assert got[900]["language"] == "de" and got[901]["language"] == "en" and got[902]["posterior"] < 0.9


def test_address_and_markup(spark):
    frame = spark.createDataFrame([("https://WWW.Example.co.UK:8080/x", '<html class="a" lang="EN-gb">'), ("nothing", "<p lang=de>"), (None, None)], "u string, h string")
    at = langid.address_evidence(F.col("u"))
    got = [tuple(r) for r in frame.select(at["host"], at["domain"], at["suffix"], langid.markup_language(F.col("h"))).collect()]
    assert got == [("www.example.co.uk", "co.uk", "uk", "en"), (None,) * 4, (None,) * 4]


# --- quality ----------------------------------------------------------------------

def test_quality_on_held_out_rows(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for k in range(400):
        good = k % 4 != 0
        words = [rng.choice(EN) for _ in range(rng.randint(20, 60))]
        rows.append((k, " ".join(words) if good else "### ".join(words), 0.5))
        labels.append((k, int(good)))
    labels += [(None, 1), (3, None), (7, 9)]
    rows += [(1000, None, 0.1), (1001, "", 0.1), (1001, "", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    held = quality.held_out()
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, label int").where(~held))
    got = quality.score(docs, model).withColumn("h", held).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    asked = [r for r in got if r["h"] and r["doc_id"] < 400]
    assert np.mean([(r["doc_id"] % 4 != 0) == bool(r["predicted"]) for r in asked]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, label int"))
    one = quality.train(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, label int"))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert all(r["score"] > 0.5 for r in quality.score(docs, one).collect())


def test_dual_descent_minimises_the_hinge_loss():
    rng = np.random.default_rng(8)
    rows = [np.array([0, 1]) for _ in range(60)]
    values = [rng.normal(size=2) for _ in rows]
    signs = np.array([1.0 if v[0] + 0.5 * v[1] + 0.2 * rng.normal() > 0 else -1.0 for v in values])
    w, b = quality.dual_descent(rows, values, signs, epochs=2000)
    x = np.array(values)

    def loss(p):
        return 0.5 * (p @ p) + np.maximum(0, 1 - signs * (x @ p[:2] + p[2])).sum()

    best = loss(np.array([w[0], w[1], b]))
    for _ in range(300):
        assert best <= loss(np.array([w[0], w[1], b]) + rng.normal(size=3) * 0.05) + 1e-2
