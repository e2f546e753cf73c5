import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazegrid.functions import fixed
from hazegrid.operators import checks
from hazegrid.plans import models, trees
from hazegrid.sources import views

FOLDER = "/root/testdata/sf0.001"
FEATURES = views.REGR_FEATURES


@pytest.fixture(scope="module")
def rows(spark):
    return views.regr(spark, FOLDER)


def test_reloaded_model_predicts_alike(spark, rows, tmp_path):
    model = models.train(rows, FEATURES, models.forest("pm2_5", trees=5, depth=4))
    path = models.save(model, str(tmp_path / "model"))
    with pytest.raises(Exception, match="exists"):
        models.save(model, path)
    fresh, again = (sorted(map(tuple, models.predictor(m)(rows).select(*views.REGR_KEY, "prediction").collect())) for m in (model, models.load(path)))
    assert fresh == again and len(fresh) == rows.count()
    gaps = rows.limit(3).withColumns({c: F.lit(None).cast("double") for c in FEATURES})
    assert models.predictor(models.load(path))(gaps).where("prediction IS NOT NULL").count() == 3


def test_training_rows_are_dealt_out(spark, rows, monkeypatch):
    monkeypatch.setattr(models, "PART_ROWS", 1000)
    dealt = models.spread(rows, [*FEATURES, "pm2_5"])
    assert dealt.rdd.getNumPartitions() > 1 and dealt.count() == rows.count()


def test_tuning_equals_single_fits(spark, rows):
    few = rows.where("l_orderkey % 5 = 0")
    splits = models.random_splits(few, views.SPLIT_KEY, 2)
    assert sum(test.count() for _, test in splits) == few.count()
    grid = {"maxIter": [2, 5], "featureSubsetStrategy": ["0.9", "1.0"], "maxDepth": [2]}
    got = models.tune(splits, FEATURES, models.boosted("pm2_5", rounds=9), grid)
    assert [s for _, s in got] == sorted(s for _, s in got) and len(got) == 4
    by = {(c["maxIter"], c["featureSubsetStrategy"]): s for c, s in got}
    assert by[2, "0.9"] == by[2, "1.0"] and by[5, "0.9"] < by[2, "0.9"]
    for rounds in (2, 5):
        alone = models.validate(splits, models.fitted(FEATURES, models.boosted("pm2_5", rounds=rounds, depth=2)), "pm2_5")
        assert alone.agg(F.avg("mae")).first()[0] == pytest.approx(by[rounds, "1.0"], rel=1e-6)
    forest = models.tune(splits, FEATURES, models.forest("pm2_5"), {"numTrees": [3], "maxDepth": [3], "featureSubsetStrategy": ["sqrt", "log2", "all"]})
    errors = {c["featureSubsetStrategy"]: s for c, s in forest}
    assert errors["sqrt"] == errors["log2"] != errors["all"]
    whole = [len(list(itertools.product(*g.values()))) for g in (fixed.FOREST_GRID, fixed.BOOSTED_GRID)]
    assert whole == [108, 243]


def test_search_is_whole_without_a_spark_fit_per_combination(spark, monkeypatch):
    rng = random.Random(6)
    # one feature with more values than are sent to the driver, gaps, and a third that does not matter
    data = [(rng.random() * 9, rng.choice([None, 1.0, 2.0, 5.0]), float(rng.randrange(40))) for _ in range(1500)]
    rows = spark.createDataFrame([(i, a, b, c, 3 * a + 2 * (b or 0) + rng.random()) for i, (a, b, c) in enumerate(data)],
                                 "id long, a double, b double, c double, y double")
    splits, names = models.random_splits(rows, ["id"], 2), ["a", "b", "c"]
    monkeypatch.setattr(models.trees, "VALUES", 1000)
    alone = models.validate(splits, models.fitted(names, models.forest("y", trees=20, depth=6).setFeatureSubsetStrategy("all")), "y").agg(F.avg("mae")).first()[0]
    for kind in (models.RandomForestRegressor, models.GBTRegressor):
        monkeypatch.setattr(kind, "_fit", None)
    grid = {"numTrees": [5, 20], "maxDepth": [2, 6], "minInstancesPerNode": [1, 4], "featureSubsetStrategy": ["sqrt", "all"]}
    whole = models.tune(splits, names, models.forest("y"), grid)
    assert len(whole) == 16 and whole[0][1] < whole[-1][1]
    # a smaller forest or a shallower one alone is judged alike
    for c, error in whole[::8]:
        assert models.tune(splits, names, models.forest("y"), {n: [v] for n, v in c.items()}) == [(c, pytest.approx(error, rel=1e-12))]
    by = {tuple(c.values()): e for c, e in whole}
    assert by[20, 6, 1, "sqrt"] != by[20, 6, 4, "sqrt"] and by[20, 6, 1, "all"] == pytest.approx(alone, rel=0.1)
    boosted = models.tune(splits, names, models.boosted("y"), {"maxIter": [3, 9], "subsamplingRate": [0.8, 1.0], "stepSize": [0.1, 0.2], "maxDepth": [3]})
    assert len({e for _, e in boosted}) == 8
    # order and parts of the rows do not matter
    again = models.tune([(a.orderBy("c").repartition(5), b) for a, b in splits], names, models.forest("y"), {"numTrees": [5], "maxDepth": [6]})
    assert again[0][1] == models.tune(splits, names, models.forest("y"), {"numTrees": [5], "maxDepth": [6]})[0][1]
    with pytest.raises(ValueError, match="without a target"):
        models.tune([(rows.withColumn("y", F.when(F.col("id") > 3, F.col("y"))), rows)], names, models.forest("y"), {"maxDepth": [2]})


def test_least_rows_hold_for_both_children():
    bins = [np.arange(8, dtype=np.uint8)]
    weight, total = np.ones(8), np.array([9.0, 0, 0, 0, 0, 0, 0, 0])
    free, held = (trees.grow(bins, 32, weight, total, [1], 1, least, 0.0, 1)[1] for least in (0, 2))
    assert free.tolist() == [9.0] + [0.0] * 7 and held.tolist() == [4.5] * 2 + [0.0] * 6


def test_no_training_day_follows_a_test_day(spark, rows):
    splits = checks.forward_splits(rows, "datetime", 4)
    assert len(splits) == 3
    for before, test in splits:
        last, first = before.agg(F.max(F.to_date("datetime"))).first()[0], test.agg(F.min(F.to_date("datetime"))).first()[0]
        assert last < first
    assert rows.columns == splits[0][0].columns


def test_band_keeps_training_cells_away(spark):
    rng = random.Random(4)
    cells = [(rng.randint(-20, 20), rng.randint(-20, 20)) for _ in range(900)]
    frame = spark.createDataFrame(cells, "a int, b int")
    splits = checks.station_splits(frame, "a", "b", 4, size=5, guard=2)
    tested = []
    for before, test in splits:
        train, held = {tuple(r) for r in before.collect()}, [tuple(r) for r in test.collect()]
        tested += held
        assert all(max(abs(x - p), abs(y - q)) > 2 for x, y in train for p, q in set(held))
        assert train
    assert sorted(tested) == sorted(cells)
    with pytest.raises(ValueError):
        checks.station_splits(frame, "a", "b", 4, size=2, guard=3)


@pytest.mark.parametrize("least", [1, 40])
def test_folded_rows_train_the_same_trees(spark, least):
    rng = random.Random(5)
    data = [(float(rng.randrange(6)), rng.choice([None, 1.0, 2.0, 5.0])) for _ in range(2000)]
    rows = spark.createDataFrame([(a, b, 3 * a + (b or 0) + rng.random()) for a, b in data], "a double, b double, y double")
    estimator = models.boosted("y", rounds=4, depth=3).setMinInstancesPerNode(least)
    assert models.folded(rows, ["a", "b"], "y").count() <= 24 * models.DRAWS
    assert models.folded(rows, ["a", "b"], "y").agg(F.sum(models.WEIGHT), F.sum(F.col(models.WEIGHT) * F.col("y"))).first() == pytest.approx(
        (2000, rows.agg(F.sum("y")).first()[0]))
    steps = models.prepared(rows, ["a", "b"])
    whole = estimator.fit(steps.transform(rows)).transform(steps.transform(rows))
    kinds = {(r["a"], r["b"]): r["prediction"] for r in whole.collect()}
    got = models.predictor(models.train(rows, ["a", "b"], estimator))(rows)
    assert {(r["a"], r["b"]): r["prediction"] for r in got.collect()} == pytest.approx(kinds)
