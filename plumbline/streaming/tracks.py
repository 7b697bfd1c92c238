"""State for each key of a stream: a user's track in sessions, and when it enters and leaves the shapes of a fixed layer.

Both keep what may still change, and no more: the points of a key since the last session that is closed, or since
the watermark. A timer wakes a key when the watermark has passed its gap or its points; then what is settled
is put into the order of event time, given out and dropped. So results are those of the whole batch for any order
of arrival within the lateness, rows that are later still are dropped, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.operators import spatial

#: The state store that timers and lists need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(t: datetime) -> int:
    """Milliseconds of a time; one without a zone is in the session's zone, as Spark hands it out."""
    return int(t.timestamp() * 1000) if t.tzinfo else int(t.astimezone(timezone.utc).timestamp() * 1000)


class _Ordered(StatefulProcessor):
    """Keeps rows in a list and wakes up at the times that ``due`` gives."""

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)

    def due(self, row: Any) -> int:
        raise NotImplementedError

    def settled(self, key: tuple, rows: list, watermark: int) -> tuple[list[Row], list]:
        """What can be given out, and the rows to keep."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        new = [tuple(r[c] for c in self.columns) for r in rows]
        if new:
            self.rows.appendList(new)
            # A timer for the last row is enough: what comes out earlier is found when any timer rings.
            for at in {self.due(r) for r in new}:
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        held = sorted((tuple(r) for r in self.rows.get()), key=lambda r: (r[0], *map(str, r[1:])))
        out, rest = self.settled(key, held, timerValues.getCurrentWatermarkInMs())
        if rest:
            self.rows.put(rest)
        else:
            self.rows.clear()
        yield from out

    def close(self) -> None:
        pass


class _Sessions(_Ordered):
    schema = "ts timestamp, x double, y double"
    columns = ("ts", "x", "y")

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def due(self, row: Any) -> int:
        return _ms(row[0]) + self.gap

    def settled(self, key: tuple, rows: list, watermark: int) -> tuple[list[Row], list]:
        sessions: list[list] = []
        for r in rows:
            if sessions and _ms(r[0]) - _ms(sessions[-1][-1][0]) <= self.gap:
                sessions[-1].append(r)
            else:
                sessions.append([r])
        out, rest = [], []
        for s in sessions:
            if _ms(s[-1][0]) + self.gap > watermark:
                rest += s
                continue
            length = sum(((b[1] - a[1]) ** 2 + (b[2] - a[2]) ** 2) ** 0.5 for a, b in zip(s, s[1:], strict=False))
            out.append(Row(key=key[0], since=s[0][0], until=s[-1][0], points=len(s), length=float(length)))
        return out, rest


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Tracks of points ``x, y`` cut where a key is silent for more than ``gap``: ``key, since, until, points, length``.

    A session is given out once the watermark (``late`` behind the latest time) is past its end and gap. Points of
    one time go by their coordinates.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    gap_ms = _interval_ms(gap)
    rows = stream.select(F.col(key).alias("key"), F.col(time).alias("ts"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withWatermark("ts", late)
    kind = stream.schema[key].dataType.simpleString()
    made = rows.groupBy("key").transformWithState(_Sessions(gap_ms), f"key {kind}, since timestamp, until timestamp, points long, length double", "Append", "EventTime")
    return made.withColumnRenamed("key", key)


def _interval_ms(text: str) -> int:
    n, unit = text.split()
    return int(float(n) * {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")])


class _Crossings(_Ordered):
    schema = "ts timestamp, shape string"
    columns = ("ts", "shape")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.now = handle.getValueState("now", "shapes array<string>")

    def due(self, row: Any) -> int:
        return _ms(row[0])

    def settled(self, key: tuple, rows: list, watermark: int) -> tuple[list[Row], list]:
        known = self.now.get() if self.now.exists() else None
        inside = set(known[0]) if known else set()
        times: dict[datetime, set] = {}
        rest = []
        for ts, shape in rows:
            if _ms(ts) > watermark:
                rest.append((ts, shape))
            else:
                times.setdefault(ts, set()).update([shape] if shape is not None else [])
        out = []
        for ts, there in times.items():
            out += [Row(key=key[0], ts=ts, shape=s, event="exit") for s in sorted(inside - there)]
            out += [Row(key=key[0], ts=ts, shape=s, event="enter") for s in sorted(there - inside)]
            inside = there
        self.now.update((sorted(inside),))
        return out, rest


def crossings(stream: DataFrame, polygons: DataFrame, size: float, key: str, late: str = "1 hour", time: str = "ts", shape: str = "idx") -> DataFrame:
    """When a key's points come into and leave the polygons of a fixed layer: ``key, ts, shape`` (as text), ``event``.

    A key is where its latest point is; all its points of one time count together. Before its first point it is nowhere.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    points = stream.select(F.col(key).alias("key"), F.col(time).alias("ts"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    layer = polygons.select(F.col(shape).cast("string").alias("shape"), "geom", *spatial.BOX)
    held = spatial.contained(points, layer, size).select("key", "ts", "shape")
    # A mark for each point, whether a polygon holds it or not.
    marks = points.select("key", "ts", F.lit(None).cast("string").alias("shape")).unionByName(held).withWatermark("ts", late)
    kind = stream.schema[key].dataType.simpleString()
    made = marks.groupBy("key").transformWithState(_Crossings(), f"key {kind}, ts timestamp, shape string, event string", "Append", "EventTime")
    return made.withColumnsRenamed({"key": key, "ts": time})
