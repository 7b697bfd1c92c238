"""Streams with state for each key, against the whole batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import tracks

START = dt.datetime(2024, 1, 1)
FIELDS = "user string, ts timestamp, x double, y double"


def moves(seed, n=60):
    rnd = random.Random(seed)
    out = []
    for user in "abc":
        t = 0
        for _ in range(n):
            t += rnd.choice((1, 2, 5, 20, 45))
            out.append((user, START + dt.timedelta(minutes=t), float(rnd.randint(0, 29)), float(rnd.randint(0, 9)) + 0.5))
    return out


def arriving(spark, folder, parts):
    """A file for each part, in the order of their names."""
    for k, rows in parts:
        spark.createDataFrame(rows, FIELDS).coalesce(1).write.mode("append").parquet(f"{folder}/in-{k:03d}")
    return spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in-*")


def run(made, name, folder):
    q = made.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return made.sparkSession.read.parquet(f"{folder}/{name}")


def batch_sessions(rows, gap):
    out = []
    for user in sorted({r[0] for r in rows}):
        own = sorted((r[1:] for r in rows if r[0] == user), key=lambda r: (r[0], str(r[1]), str(r[2])))
        groups = []
        for r in own:
            if groups and r[0] - groups[-1][-1][0] <= gap:
                groups[-1].append(r)
            else:
                groups.append([r])
        out += [(user, g[0][0], g[-1][0], len(g), round(sum(((b[1] - a[1]) ** 2 + (b[2] - a[2]) ** 2) ** 0.5 for a, b in zip(g, g[1:])), 6)) for g in groups]
    return sorted(out)


END = ("z", START + dt.timedelta(days=30), 0.0, 0.5)


def shuffled(rows, by, seed=1):
    """Parts of a stream in which no row comes later than ``by`` rows behind."""
    rnd = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[1])
    order = sorted(range(len(rows)), key=lambda k: k + rnd.random() * by)
    rows = [rows[k] for k in order]
    return [rows[k : k + 45] for k in range(0, len(rows), 45)]


def test_sessions_are_those_of_the_batch_over_restarts(spark, tmp_path):
    rows = moves(3)
    parts = shuffled(rows, 12) + [[END]]
    # Two runs over the first files and then all of them: the second goes on from the checkpoint.
    arriving(spark, tmp_path, list(enumerate(parts))[:2])
    for k in range(2):
        stream = arriving(spark, tmp_path, list(enumerate(parts))[2:] if k else [])
        got = run(tracks.sessions(stream, "user", "30 minutes", "12 hours"), "sessions", tmp_path)
    made = sorted((r["user"], r["since"], r["until"], r["points"], round(r["length"], 6)) for r in got.collect())
    assert made == batch_sessions(rows, dt.timedelta(minutes=30))


def test_rows_that_are_too_late_are_dropped(spark, tmp_path):
    rows = moves(5, 10)
    late = ("a", START - dt.timedelta(days=2), 1.0, 1.5)
    stream = arriving(spark, tmp_path, list(enumerate([rows, [END], [late], [("z", END[1] + dt.timedelta(days=9), 0.0, 0.5)]])))
    got = run(tracks.sessions(stream, "user", "30 minutes", "1 hour"), "late", tmp_path)
    made = sorted((r["user"], r["since"], r["until"], r["points"], round(r["length"], 6)) for r in got.collect())
    assert made == sorted([*batch_sessions(rows, dt.timedelta(minutes=30)), ("z", END[1], END[1], 1, 0.0)])


def test_crossings_are_those_of_the_batch(spark, tmp_path):
    from plumbline.functions import geometry as g

    x = F.col("id") * 10.0
    layer = spark.range(3).select(F.col("id").cast("int").alias("idx"), x.alias("minx"), F.lit(0.0).alias("miny"), (x + 12.0).alias("maxx"), F.lit(5.0).alias("maxy"))
    layer = layer.withColumn("geom", g.polygon(g.box(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))))
    rows = moves(8, 25)
    got = run(tracks.crossings(arriving(spark, tmp_path, list(enumerate([*shuffled(rows, 8), [END]]))), layer, 10.0, "user", "12 hours"), "crossings", tmp_path)
    want = []
    for user in "abc":
        inside, times = set(), {}
        for _, ts, px, py in sorted(r for r in rows if r[0] == user):
            times.setdefault(ts, set()).update(str(k) for k in range(3) if 10 * k <= px < 10 * k + 12 and py < 5)
        for ts in sorted(times):
            want += [(user, ts, s, "exit") for s in inside - times[ts]] + [(user, ts, s, "enter") for s in times[ts] - inside]
            inside = times[ts]
    assert sorted(map(tuple, got.where("user <> 'z'").select("user", "ts", "shape", "event").collect())) == sorted(want)


@pytest.mark.parametrize("text, ms", [("30 minutes", 1_800_000), ("1 day", 86_400_000), ("2 seconds", 2000)])
def test_intervals(text, ms):
    assert tracks._interval_ms(text) == ms
