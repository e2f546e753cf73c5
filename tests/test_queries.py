"""Every registered query of this side against its SQL on the smallest tables."""

import itertools

import duckdb
import pytest

import __spark_entry__
from hazegrid import registry
from hazegrid.functions import fixed

FOLDER = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(frame):
    columns = sorted(frame.columns)
    rows = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return columns, sorted(repr([round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    assert plain(registry.QUERIES[name](spark, FOLDER).toPandas()) == plain(duck.execute(registry.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL) - {"boosted_predictions", "tuning_results", "score_model"}))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_model_queries_use_whole_settings_and_grids(spark, monkeypatch):
    class Fitted(Exception):
        pass

    def fit(rows, features, estimator):
        raise Fitted(estimator)

    asked = []

    def tune(splits, features, estimator, grid):
        asked.append((type(estimator).__name__, grid, len(splits)))
        names, lists = list(grid), list(grid.values())
        return [(dict(zip(names, p)), 1.0) for p in itertools.product(*lists)]

    monkeypatch.setattr(registry.models, "train", fit)
    monkeypatch.setattr(registry.models, "tune", tune)
    for name, trees, depth in (("forest_predictions", "numTrees", 10), ("feature_importance", "numTrees", 10), ("score_model", "numTrees", 10), ("boosted_predictions", "maxIter", 6)):
        with pytest.raises(Fitted) as found:
            registry.QUERIES[name](spark, FOLDER)
        estimator = found.value.args[0]
        assert (estimator.getOrDefault(trees), estimator.getMaxDepth()) == (100, depth)
    got = registry.QUERIES["tuning_results"](spark, FOLDER).collect()
    assert asked == [("RandomForestRegressor", fixed.FOREST_GRID, 3), ("GBTRegressor", fixed.BOOSTED_GRID, 3)]
    assert [sum(r["model"] == m for r in got) for m in ("forest", "boosted")] == [108, 243] and len(set(got)) == len(got)
