import math
import random

from pyspark.sql import functions as F

from hazegrid.functions import cpcb_aqi, cpcb_category, epa_category
from hazegrid.functions import advisory_level, fixed, sql
from hazegrid.operators import sketches


def test_merged_sketches_equal_whole(spark):
    rng = random.Random(5)
    data = [(k % 30, rng.randrange(20_000), None if k % 7 else "x") for k in range(60_000)]
    rows = spark.createDataFrame(data, "day int, cell long, rare string")
    values = {"cell": F.col("cell"), "rare": F.col("rare")}
    daily = sketches.distinct_sketches(rows, {"day": F.col("day")}, values)
    for low, high in ((0, 30), (3, 4), (5, 20)):
        part = F.col("day").between(low, high - 1)
        merged = sketches.estimates(sketches.merge_sketches(daily.where(part), [], list(values)), list(values)).first()
        whole = sketches.estimates(sketches.distinct_sketches(rows.where(part), {}, values), list(values)).first()
        exact = len({c for d, c, _ in data if low <= d < high})
        assert merged["records"] == whole["records"] == sum(low <= d < high for d, _, _ in data)
        assert abs(merged["cell"] - exact) <= 5 * sketches.SIGMA * exact
        assert abs(whole["cell"] - exact) <= 5 * sketches.SIGMA * exact
        assert merged["rare"] == whole["rare"] == 1


def test_sketches_of_nothing(spark):
    none = spark.createDataFrame([(1, None), (1, None)], "day int, cell long")
    values = {"cell": F.col("cell")}
    got = sketches.estimates(sketches.distinct_sketches(none, {"day": F.col("day")}, values), ["cell"]).collect()
    assert [(r["day"], r["records"], r["cell"]) for r in got] == [(1, 2, 0)]
    assert sketches.distinct_sketches(none.limit(0), {"day": F.col("day")}, values).count() == 0


def test_sql_functions_equal_columns(spark):
    sql.register(spark)
    values = [None, math.nan, -5.0, 0.0, 500.0, 1e9, math.inf]
    values += [x + e for _, x, _ in fixed.CPCB_BANDS for e in (-0.01, 0.0, 0.01)] + [x for _, x in fixed.EPA_BANDS]
    rows = spark.createDataFrame([(x,) for x in values], "pm2_5 double")
    ladders = {f"advisory_level_{n}": advisory_level("pm2_5", n) for n in fixed.ADVISORY_LIMITS}
    both = {"cpcb_aqi": cpcb_aqi("pm2_5"), "cpcb_category": cpcb_category("pm2_5"), "epa_category": epa_category("pm2_5"), **ladders}
    for name, column in both.items():
        got = spark.sql(f"SELECT {name}(pm2_5) AS a, pm2_5 FROM {{rows}}", rows=rows).withColumn("b", column)
        assert got.where("NOT (a <=> b)").count() == 0, name


def test_sql_functions_are_inlined(spark, tmp_path):
    sql.register(spark)
    path = str(tmp_path / "t")
    spark.range(10).select(F.col("id").cast("double").alias("pm2_5"), F.lit("x").alias("other")).write.parquet(path)
    plan = spark.sql("SELECT cpcb_category(pm2_5) AS c FROM {t} WHERE pm2_5 > 3", t=spark.read.parquet(path))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "CASE WHEN" in text and "UDF" not in text and "Python" not in text
    assert "GreaterThan(pm2_5,3.0)" in text and "other" not in text.split("ReadSchema")[1]
