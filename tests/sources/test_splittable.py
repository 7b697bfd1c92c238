"""Data sources whose reads are split by headers and whose writes are committed."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.table import Refused
from plumbline.sources import splittable as sp


def cloud(spark, n, parts=3):
    x = F.col("id") % 100
    return spark.range(n, numPartitions=parts).select(x.cast("double").alias("x"), (F.col("id") / 8).alias("y"), (F.col("id") % 1000 / 4).alias("z"), (F.col("id") % 65536).cast("int").alias("intensity"), (F.col("id") % 32).cast("int").alias("classification"))


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "las")
    sp.write_las(cloud(spark, 5000).coalesce(1), path, records=5000)
    files = os.listdir(path)
    assert len(files) == 1 and files[0].endswith(".las")
    back = sp.read_las(spark, f"{path}/{files[0]}", records=700)
    assert back.rdd.getNumPartitions() == 8
    rows = back.select("idx", "x", "y", "z", "intensity", "classification").orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(5000))
    want = cloud(spark, 5000).collect()
    assert sorted(map(tuple, (r[1:] for r in rows))) == sorted(map(tuple, want))


def test_filters_leave_out_files_by_their_boxes(spark, tmp_path):
    path = str(tmp_path / "las")
    for k in range(3):
        sp.write_las(cloud(spark, 1000, 1).withColumn("z", F.col("z") + 1000 * k), path)
    assert len(os.listdir(path)) == 3
    high = sp.read_las(spark, path).where("z > 1999")
    assert high.rdd.getNumPartitions() == 1 and high.count() == 1000
    assert sp.read_las(spark, path).where("z > 1999 and z <= 2010.5").count() == sum(k % 1000 / 4 <= 10.5 for k in range(1000))
    assert sp.read_las(spark, path).where("z < -5").rdd.getNumPartitions() <= 1 and sp.read_las(spark, path).where("z < -5").count() == 0
    reader = sp.LasReader({"path": path})
    list(reader.pushFilters([]))
    assert len(reader.partitions()) == 3


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "las")
    sp.write_las(cloud(spark, 100), path)
    before = sorted(os.listdir(path))
    bad = cloud(spark, 3000, 6).withColumn("x", F.when(F.col("y") > 300, F.raise_error(F.lit("spoilt"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="spoilt"):
        sp.write_las(bad, path)
    assert sorted(os.listdir(path)) == before
    sp.write_las(cloud(spark, 10), path, mode="overwrite")
    assert sp.read_las(spark, path).count() == 10 and not set(os.listdir(path)) & set(before)


def test_files_that_are_no_las(spark, tmp_path):
    (tmp_path / "x.las").write_bytes(b"nothing")
    with pytest.raises(Exception, match="no LAS file"):
        sp.read_las(spark, str(tmp_path)).count()
    with pytest.raises(Refused):
        sp.files_of(str(tmp_path / "none"), (".las",))
    assert sp.files_of(str(tmp_path), (".tif",)) == []


def test_geotiff_strips_are_planned_and_written_as_a_mosaic(spark, tmp_path):
    path = str(tmp_path / "tif")
    px = spark.range(50 * 7).select((F.col("id") / 7).cast("int").alias("row"), (F.col("id") % 7).cast("int").alias("col"), (F.col("id") * 1.5).alias("value")).where("id % 11 <> 3")
    sp.write_geotiff(px, path, 7, 50, (100.0, 2.0, 0.0, 500.0, 0.0, -2.0), rows=20)
    names = sorted(os.listdir(path))
    assert [n[:14] for n in names] == ["rows-000000000", "rows-000000020", "rows-000000040"]
    from plumbline.sources.binary_formats import geotransform

    assert geotransform((tmp_path / "tif" / names[1]).read_bytes()) == (100.0, 2.0, 0.0, 460.0, 0.0, -2.0)
    back = sp.read_geotiff(spark, path).where("value <> -9999")
    got = sorted((int(r["path"].split("rows-")[1][:9]) + r["row"], r["col"], r["value"]) for r in back.collect())
    assert got == sorted(map(tuple, px.select("row", "col", "value").collect()))
    from plumbline.sources.binary_formats import geotiff_bytes

    big = tmp_path / "big.tif"
    big.write_bytes(geotiff_bytes(np.arange(640.0 * 5).reshape(640, 5), (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)))
    one = sp.read_geotiff(spark, str(big), pixels=320)
    assert one.rdd.getNumPartitions() == 10 and one.agg(F.sum("value")).first()[0] == sum(range(3200))
    low = one.where("row >= 600")
    assert low.rdd.getNumPartitions() == 1 and low.count() == 200
