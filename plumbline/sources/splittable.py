"""LAS and GeoTIFF as data sources of Spark: reads are planned from headers, writes are committed.

A reader plans its partitions from the files' headers alone: ranges of records of a LAS file, runs of strips or tiles
of a GeoTIFF, so one large file is read by many tasks, each of which reads its own bytes. Filters on
coordinates are pushed to where they can leave out whole files (by the box in a header) or strips (by their rows).

A writer's tasks write whole files into a folder of the job's own next to the target. Only when all tasks have
ended well, files move to their names; if the job fails, the folder goes and nothing is left.

Paths are local, or URIs that Arrow's file systems know.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from plumbline.operators.table import Refused


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_of(path: str, ends: tuple[str, ...]) -> list[str]:
    """The files of a folder by their ending, hidden ones left out, or the one file that a path names."""
    fs, at = file_system(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type != pafs.FileType.Directory:
        raise Refused(f"{path} doesn't exist")
    found = [i.path for i in fs.get_file_info(pafs.FileSelector(at)) if i.type == pafs.FileType.File]
    found = sorted(p for p in found if p.lower().endswith(ends) and PurePosixPath(p).name[0] not in "._")
    scheme = path.partition("://")[0] + "://" if "://" in path else ""
    return [scheme + p for p in found]


def read_bytes(path: str, start: int, size: int) -> bytes:
    fs, at = file_system(path)
    with fs.open_input_file(at) as f:
        f.seek(start)
        return f.read(size)


class Bounds:
    """What pushed comparisons leave of columns: ``low <= value <= high``; wide enough for strict ones."""

    def __init__(self, names: tuple[str, ...]):
        self.low, self.high = dict.fromkeys(names, -np.inf), dict.fromkeys(names, np.inf)

    def take(self, filters: list[Filter]) -> Iterator[Filter]:
        """Notes the comparisons it knows. Spark applies all filters to the rows again."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in self.low and isinstance(getattr(f, "value", None), (int, float)):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(self.low[name], f.value)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high[name] = min(self.high[name], f.value)
            yield f

    def meets(self, name: str, low: float, high: float) -> bool:
        return low <= self.high[name] and high >= self.low[name]


# Writing.


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class StagedWriter(DataSourceArrowWriter):
    """Files of tasks in a folder of the job's own, which move to their names on commit."""

    ending = ""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.options = options["path"].rstrip("/"), overwrite, dict(options)
        self.job = uuid.uuid4().hex

    def staging(self) -> str:
        return f"{file_system(self.path)[1]}/_staging-{self.job}"

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, int]]:
        """Names, contents and rows of the files of a task."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, _ = file_system(self.path)
        fs.create_dir(self.staging(), recursive=True)
        done, rows = [], 0
        task = TaskContext.get()
        for name, content, n in self.files(iterator):
            # An attempt that is given up leaves a file that no message names.
            place = f"{self.staging()}/{name}-{task.partitionId()}-{task.taskAttemptId()}{self.ending}"
            with fs.open_output_stream(place) as f:
                f.write(content)
            done.append(place)
            rows += n
        return Written(done, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = file_system(self.path)
        fs.create_dir(at, recursive=True)
        old = [i.path for i in fs.get_file_info(pafs.FileSelector(at)) if i.type == pafs.FileType.File] if self.overwrite else []
        for m in messages:
            for place in m.files if m else []:
                fs.move(place, f"{at}/{PurePosixPath(place).name.rsplit('-', 1)[0]}-{self.job[:8]}{self.ending}")
        for p in old:
            fs.delete_file(p)
        self._gone(fs)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._gone(file_system(self.path)[0])

    def _gone(self, fs: pafs.FileSystem) -> None:
        if fs.get_file_info(self.staging()).type == pafs.FileType.Directory:
            fs.delete_dir(self.staging())


# LAS.

#: Bytes of a LAS record before its colours, by point format.
_COLOUR = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
_LAS_ENDS = (".las",)


@dataclass
class LasHead:
    kind: int
    start: int
    size: int
    n: int
    scale: tuple[float, ...]
    offset: tuple[float, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]


def las_head(path: str) -> LasHead:
    raw = np.frombuffer(read_bytes(path, 0, 375).ljust(375, b"\0"), np.uint8)
    if bytes(raw[:4]) != b"LASF":
        raise Refused(f"{path} is no LAS file")
    kind = int(raw[104])
    if kind & 0xC0:
        raise Refused(f"{path} is compressed (LAZ)")
    number = lambda a, b, t: raw[a:b].view(t)[0].item()
    n = number(107, 111, "<u4")
    if n == 0 and raw[25] >= 4:
        n = number(247, 255, "<u8")
    box = raw[179:227].view("<f8").tolist()
    return LasHead(kind, number(96, 100, "<u4"), number(105, 107, "<u2"), n, tuple(raw[131:155].view("<f8").tolist()), tuple(raw[155:179].view("<f8").tolist()), tuple(box[1::2]), tuple(box[::2]))


def las_points(path: str, head: LasHead, first: int, n: int, raw: bytes) -> pa.RecordBatch:
    """Records as points: ``path, idx, x, y, z, intensity, classification, red, green, blue``."""
    rows = np.frombuffer(raw, np.uint8, n * head.size).reshape(n, head.size)
    field = lambda a, b, t: rows[:, a:b].copy().view(t)[:, 0]
    xyz = [field(4 * k, 4 * k + 4, "<i4") * head.scale[k] + head.offset[k] for k in range(3)]
    cls = rows[:, 16] if head.kind >= 6 else rows[:, 15] & 31
    c = _COLOUR.get(head.kind)
    rgb = [pa.array(field(c + 2 * k, c + 2 * k + 2, "<u2").astype(np.int32)) if c else pa.nulls(n, pa.int32()) for k in range(3)]
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * n, pa.string()), pa.array(np.arange(first, first + n, dtype=np.int64)), *map(pa.array, xyz), pa.array(field(12, 14, "<u2").astype(np.int32)), pa.array(cls.astype(np.int32)), *rgb],
        names=["path", "idx", "x", "y", "z", "intensity", "classification", "red", "green", "blue"],
    )


@dataclass
class Records(InputPartition):
    path: str
    head: LasHead
    first: int
    n: int


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.records, self.bounds = options["path"], int(options.get("records", 1 << 20)), Bounds(("x", "y", "z"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        return self.bounds.take(filters)

    def partitions(self) -> list[Records]:
        out = []
        for path in files_of(self.path, _LAS_ENDS):
            head = las_head(path)
            # A header's box may be rounded; one quantum more on each side is enough.
            if head.n and all(self.bounds.meets(c, head.low[k] - head.scale[k], head.high[k] + head.scale[k]) for k, c in enumerate("xyz")):
                out += [Records(path, head, at, min(self.records, head.n - at)) for at in range(0, head.n, self.records)]
        return out

    def read(self, part: Records | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # nothing was planned
            return
        for at in range(part.first, part.first + part.n, 1 << 17):
            n = min(1 << 17, part.first + part.n - at)
            yield las_points(part.path, part.head, at, n, read_bytes(part.path, part.head.start + at * part.head.size, n * part.head.size))


def las_bytes(points: np.ndarray, intensity: np.ndarray, classification: np.ndarray, scale: float = 0.001) -> bytes:
    """A LAS 1.2 file of format 0 from ``n x 3`` coordinates."""
    n, offset = len(points), np.floor(points.min(axis=0)) if len(points) else np.zeros(3)
    record = np.zeros(n, np.dtype([("xyz", "<i4", 3), ("i", "<u2"), ("f", "u1"), ("c", "u1"), ("a", "i1"), ("u", "u1"), ("s", "<u2")]))
    record["xyz"] = np.round((points - offset) / scale)
    record["i"], record["c"], record["f"] = intensity, classification, 9
    head = np.zeros(227, np.uint8)
    head[:4] = np.frombuffer(b"LASF", np.uint8)
    head[24:26] = 1, 2
    head[94:96], head[96:100] = np.array([227], "<u2").view(np.uint8), np.array([227], "<u4").view(np.uint8)
    head[105:107], head[107:111] = np.array([20], "<u2").view(np.uint8), np.array([n], "<u4").view(np.uint8)
    head[131:155], head[155:179] = np.array([scale] * 3, "<f8").view(np.uint8), offset.astype("<f8").view(np.uint8)
    if n:
        span = np.column_stack([points.max(axis=0), points.min(axis=0)]).astype("<f8").ravel()
        head[179:227] = span.view(np.uint8)
    return head.tobytes() + record.tobytes()


class LasWriter(StagedWriter):
    """Files of at most ``records`` points each, with the box of their own points."""

    ending = ".las"

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, int]]:
        most, held, size, k = int(self.options.get("records", 1 << 20)), [], 0, 0
        scale = float(self.options.get("scale", 0.001))

        def made() -> tuple[str, bytes, int]:
            t = pa.Table.from_batches(held)
            col = lambda c: t.column(c).to_numpy()
            return f"points-{k:05d}", las_bytes(np.column_stack([col("x"), col("y"), col("z")]), col("intensity"), col("classification"), scale), t.num_rows

        for b in batches:
            while b.num_rows:
                part = b.slice(0, most - size)
                held.append(part)
                size, b = size + part.num_rows, b.slice(part.num_rows)
                if size == most:
                    yield made()
                    held, size, k = [], 0, k + 1
        if size:
            yield made()


class LasSource(DataSource):
    """``spark.read.format("las")``: points of LAS files 1.0 to 1.4, formats 0 to 10; options ``path``, ``records`` of a partition."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return "path string, idx long, x double, y double, z double, intensity int, classification int, red int, green int, blue int"

    def reader(self, schema: StructType) -> LasReader:
        return LasReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> LasWriter:
        return LasWriter(dict(self.options), overwrite)


# GeoTIFF.


@dataclass
class Strips(InputPartition):
    path: str
    first: int
    end: int


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pixels, self.bounds = options["path"], int(options.get("pixels", 1 << 22)), Bounds(("row", "col"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        return self.bounds.take(filters)

    def partitions(self) -> list[Strips]:
        from plumbline.sources.binary_formats import TiffLayout

        out = []
        for path in files_of(self.path, (".tif", ".tiff")):
            layout = TiffLayout(lambda at, n, p=path: read_bytes(p, at, n))
            run: list[int] = []
            step = max(1, self.pixels // max(1, layout.block_width * layout.block_height))
            for k in range(len(layout.offsets)):
                _, row, col = layout.place(k)
                if not (self.bounds.meets("row", row, row + layout.block_height - 1) and self.bounds.meets("col", col, col + layout.block_width - 1)):
                    continue
                if run and (k != run[-1] + 1 or len(run) == step):
                    out.append(Strips(path, run[0], run[-1] + 1))
                    run = []
                run.append(k)
            if run:
                out.append(Strips(path, run[0], run[-1] + 1))
        return out

    def read(self, part: Strips | None) -> Iterator[pa.RecordBatch]:
        from plumbline.sources.binary_formats import TiffLayout

        if part is None:
            return
        get = lambda at, n: read_bytes(part.path, at, n)
        layout = TiffLayout(get)
        for k in range(part.first, part.end):
            for band, r0, c0, px in layout.block(k, get(layout.offsets[k], layout.sizes[k])):
                yield pixel_batch(part.path, band, r0, c0, px)


def pixel_batch(path: str, band: int, r0: int, c0: int, px: np.ndarray) -> pa.RecordBatch:
    r, c = np.indices(px.shape, dtype=np.int32)
    values = px.astype(np.float64).ravel()
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * values.size, pa.string()), pa.array(np.full(values.size, band + 1, np.int32)), pa.array((r + r0).ravel().astype(np.int32)), pa.array((c + c0).ravel().astype(np.int32)), pa.array(values)],
        names=["path", "band", "row", "col", "value"],
    )


class TiffWriter(StagedWriter):
    """A file for each run of rows, placed by its own geotransform. Rows must come sorted by ``part``."""

    ending = ".tif"

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, int]]:
        from plumbline.sources.binary_formats import geotiff_bytes

        width, height, rows = (int(self.options[k]) for k in ("width", "height", "rows"))
        transform = tuple(float(v) for v in self.options["transform"].split(","))
        blank = float(self.options.get("nodata", -9999.0))
        part, grid, n = None, None, 0

        def made() -> tuple[str, bytes, int]:
            x0, dx, kx, y0, ky, dy = transform
            top = part * rows
            return f"rows-{top:09d}", geotiff_bytes(grid, (x0 + top * kx, dx, kx, y0 + top * dy, ky, dy)), n

        for b in batches:
            of, row, col, value = (b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "row", "col", "value"))
            cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else []
            for a, z in zip(cuts, np.append(cuts[1:], len(of)).astype(int), strict=True) if len(of) else []:
                if part is not None and of[a] != part:
                    yield made()
                    grid = None
                if grid is None:
                    part, n = int(of[a]), 0
                    grid = np.full((min(rows, height - part * rows), width), blank)
                grid[row[a:z] - part * rows, col[a:z]] = value[a:z]
                n += int(z - a)
        if grid is not None:
            yield made()


class TiffSource(DataSource):
    """``spark.read.format("geotiff")``: pixels ``path, band, row, col, value``; options ``path``, ``pixels`` of a partition."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "path string, band int, row int, col int, value double"

    def reader(self, schema: StructType) -> TiffReader:
        return TiffReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> TiffWriter:
        return TiffWriter(dict(self.options), overwrite)


# Archives.


class ArchiveWriter(StagedWriter):
    """ZIP archives with one text each: a head, at most ``rows`` lines, and a foot."""

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.ending = options["ending"]

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, int]]:
        most, held, k = int(self.options["rows"]), [], 0

        def made() -> tuple[str, bytes, int]:
            raw = io.BytesIO()
            with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(self.options["member"], "\n".join([self.options["head"], *held, self.options["foot"]]))
            return f"archive-{k:05d}", raw.getvalue(), len(held)

        for b in batches:
            for v in b.column("value").to_pylist():
                held.append(v)
                if len(held) == most:
                    yield made()
                    held, k = [], k + 1
        if held:
            yield made()


class ArchiveSource(DataSource):
    """``df.write.format("textarchive")``: lines of ``value`` as text in archives; only written."""

    @classmethod
    def name(cls) -> str:
        return "textarchive"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options), overwrite)


def write_archives(lines: DataFrame, path: str, member: str, head: str, foot: str, rows: int, ending: str = ".zip", mode: str = "append") -> None:
    """Lines of ``value`` as archives of at most ``rows`` lines each between head and foot, which are there all or not at all."""
    registered(lines.sparkSession)
    options = {"member": member, "head": head, "foot": foot, "rows": rows, "ending": ending}
    lines.select("value").write.format("textarchive").options(**options).mode(mode).save(path)


def registered(spark: SparkSession) -> SparkSession:
    for source in (LasSource, TiffSource, ArchiveSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_las(spark: SparkSession, path: str, records: int = 1 << 20) -> DataFrame:
    """Points of the LAS files in a folder, or of one file; a task for each ``records`` of them. Compressed ones are refused."""
    return registered(spark).read.format("las").option("records", records).load(path)


def write_las(points: DataFrame, path: str, records: int = 1 << 20, mode: str = "append") -> None:
    """``x, y, z, intensity, classification`` as LAS files, which are there all or not at all."""
    registered(points.sparkSession)
    of = [F.col(c).cast(t).alias(c) for c, t in (("x", "double"), ("y", "double"), ("z", "double"), ("intensity", "int"), ("classification", "int"))]
    points.select(*of).write.format("las").option("records", records).mode(mode).save(path)


def read_geotiff(spark: SparkSession, path: str, pixels: int = 1 << 22) -> DataFrame:
    """Pixels of the GeoTIFFs in a folder, or of one (bands from 1); a task for each run of strips or tiles of so many pixels."""
    return registered(spark).read.format("geotiff").option("pixels", pixels).load(path)


def write_geotiff(pixels: DataFrame, path: str, width: int, height: int, transform: tuple[float, ...], rows: int = 256, nodata: float = -9999.0, mode: str = "append") -> None:
    """One band (``row, col, value``) as a mosaic of files of ``rows`` rows each; what is missing is ``nodata``."""
    registered(pixels.sparkSession)
    of = [F.floor(F.col("row") / rows).cast("int").alias("part"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value")]
    dealt = pixels.select(*of).repartition("part").sortWithinPartitions("part")
    options = {"width": width, "height": height, "rows": rows, "transform": ",".join(map(repr, map(float, transform))), "nodata": nodata}
    dealt.write.format("geotiff").options(**options).mode(mode).save(path)
