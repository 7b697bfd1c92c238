from pyspark.sql import functions as F

from plumbline.plans import layers
from plumbline.streaming import points

PATH = "/root/testdata/sf0.001"


def run(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def arriving(spark, tmp_path):
    obs = layers.observations(spark, PATH).select(F.col("idx").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "x", "y")
    obs.repartition(3).write.parquet(str(tmp_path / "in"))
    return obs, spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_counts_are_those_of_the_batch(spark, tmp_path):
    obs, stream = arriving(spark, tmp_path)
    got = run(points.cell_counts(stream, 50.0, late="40 days"), "cell_counts", "complete")
    want = obs.groupBy(F.date_trunc("day", "ts"), F.floor(F.col("x") / 50), F.floor(F.col("y") / 50)).count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_points_inside_are_those_of_the_batch(spark, tmp_path):
    obs, stream = arriving(spark, tmp_path)
    parcels = layers.parcels(spark, PATH)
    got = run(points.inside(stream, parcels, 50.0).select("event_id", "idx"), "points_inside", "append")
    want = points.inside(obs, parcels, 50.0).select("event_id", "idx")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
