import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clientela.operators.ntile import add_tiles, descending


def rows(n, values, seed=5):
    rng = random.Random(seed)
    return [(f"c{i}", None if rng.random() < 0.1 else rng.randrange(values)) for i in range(n)]


def frame(spark, n, values):
    return spark.createDataFrame(rows(n, values), "id string, metric long")


@pytest.mark.parametrize("n,values", [(0, 3), (1, 3), (3, 3), (5, 2), (7, 1), (103, 4), (5000, 3)])
def test_same_as_window(spark, n, values):
    df = frame(spark, n, values)
    metric, id = F.col("metric"), F.col("id")
    keys = {"up": [metric, id], "down": [*descending(metric), id]}
    tiled = add_tiles(df, keys, 5)
    both = tiled.withColumns(
        {
            "up_window": F.ntile(5).over(Window.orderBy("metric", "id")),
            "down_window": F.ntile(5).over(Window.orderBy(F.desc("metric"), "id")),
        }
    )
    assert both.count() == n
    assert both.filter("up <> up_window or down <> down_window").count() == 0


def test_tiles_differ_by_one_at_most(spark):
    tiled = add_tiles(frame(spark, 1234, 2), {"tile": [F.col("metric"), F.col("id")]}, 7)
    counts = [r["count"] for r in tiled.groupBy("tile").count().collect()]
    assert len(counts) == 7 and max(counts) - min(counts) <= 1 and sum(counts) == 1234


def test_one_value_spreads_over_partitions(spark):
    """A metric value shared by everyone does not end up in one task."""
    df = spark.range(20000).withColumn("metric", F.lit(1))
    ranged = df.repartitionByRange(8, "metric", "id")
    sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 20000 / 4


def test_no_sort_in_one_task(spark):
    df = frame(spark, 50, 5)
    tiled = add_tiles(df, {"a": [F.col("metric"), F.col("id")]}, 4)
    assert tiled.columns == ["id", "metric", "a"]
    plan = tiled._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
