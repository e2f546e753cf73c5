"""The pipeline against a plain run of its stages, on a small fixture with planted cases."""

import random

import corpus_pipeline
from hazegrid.llm import decontaminate

WORDS = {
    "en": "the and of to in that it was for on are with as his they be at one have this from or had by word but what".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat".split(),
}


def planted(tmp_path, spark):
    rng = random.Random(1)
    words = {k: v + ["".join(rng.choice(v) for _ in range(2)) for _ in range(200)] for k, v in WORDS.items()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(k, text("en" if k % 3 else "de", rng.randint(60, 200)), "en" if k % 3 else "de", f"s{k % 4}") for k in range(60)]
    near = rows[5][1].split()
    near[20] = "changed"
    passage = text("en", 30)
    item = text("en", 40)
    rows += [(100, rows[4][1], "en", "s1"), (101, " ".join(near), "en", "s1"), (102, "12345 !!", "en", "s1"), (103, None, "en", "s1"),
             (104, f"{text('en', 40)} {passage} {text('en', 40)}", "en", "s1"), (105, f"{text('en', 40)} {passage} {text('en', 40)}", "en", "s1"),
             (106, f"{text('en', 30)} {item} {text('en', 30)}", "en", "s2")]
    frame = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return {i: t for i, t, *_ in rows}, passage


def test_stages(spark, tmp_path):
    texts, passage = planted(tmp_path, spark)
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(texts) - set(kept["language_id"]) == {102, 103}
    assert set(kept["language_id"]) - set(kept["near_dedup"]) == {100, 101}
    assert set(kept["suffix_dedup"]) == set(kept["near_dedup"])
    assert passage in kept["suffix_dedup"][104] and passage not in kept["suffix_dedup"][105]
    assert all(kept["suffix_dedup"][k] == texts[k] for k in range(60))
    assert set(kept["suffix_dedup"]) - set(kept["decontamination"]) == {106}
    placement = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in placement.collect()} == set(kept["decontamination"])
    assert set(corpus_pipeline.QUERIES) == {"pipeline"} and corpus_pipeline.ORACLE_SQL is None
    assert decontaminate.COVERAGE == 0.5


def test_empty_documents(spark, tmp_path):
    planted(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
