"""Tables kept in the folder that driver and executors share, and deleted when they are done with."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, as in tests, a temporary folder takes its place where the session
    names none; on a cluster that is an error, since executors would not see each other's files.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    sc = spark.sparkContext
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
    return sc.getCheckpointDir()


#: What this process has put into the shared folder and not yet deleted.
_kept: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``released`` deletes, or else the end of the process."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _kept.append((spark, path))
    return path


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` computed once and kept as compressed Parquet in the shared folder.

    Executors can be lost without losing it, and the lineage of what follows starts there.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_now() -> int:
    """A mark for ``released``: how many paths are kept."""
    return len(_kept)


def released(since: int = 0, but: int = 0) -> None:
    """Deletes what was kept since a mark, but for the last ``but`` paths.

    A result that still reads these paths must be written before.
    """
    going = _kept[since : len(_kept) - but]
    del _kept[since : len(_kept) - but]
    for spark, path in going:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session's JVM may be gone
        released()


atexit.register(_at_exit)
