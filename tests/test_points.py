from collections import Counter

from pyspark.sql import functions as F

from tilespan.operators import cache


def test_points_of_one_cell_are_dealt_over_tasks(spark):
    spans = spark.createDataFrame([(0, 0, 0, 0), (7, 5, 3, 9)], "zoom int, y long, x0 long, x1 long")
    id_ = F.col("id")
    points = spark.range(3000).select("id", F.when(id_ < 2000, 0).otherwise(7).alias("zoom"), F.when(id_ < 2000, 0).otherwise(id_ % 20).cast("long").alias("x"), F.when(id_ < 2000, 0).otherwise(5).cast("long").alias("y"))
    given = points.union(points.where("id = 7"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, value in settings.items():
            spark.conf.set(k, value)
        found = cache.points_in_spans(given, spans).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    want = Counter([*range(2000), 7, *(k for k in range(2000, 3000) if 3 <= k % 20 <= 9)])
    assert Counter(r["id"] for r in found) == want
    # One row of tiles at zoom 0 is one cell; its points are in several tasks.
    assert len({r["task"] for r in found if r["zoom"] == 0}) > 1
