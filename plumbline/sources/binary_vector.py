"""Well-known binary, GeoParquet, and members of ZIP archives."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.geometry import GEOMETRY
from plumbline.operators.table import Refused

#: Geometry codes of well-known binary.
CODES = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}
KINDS = {v: k for k, v in CODES.items()}
#: Limits of an archive: members, and bytes of one when unpacked.
MEMBERS, MEMBER_BYTES = 10_000, 1 << 30


def encode(kind: str, parts: list) -> bytes:
    """Little-endian, with Z where positions have three ordinates."""
    flat = [p for rings in parts for r in rings for p in r]
    z = len(flat) > 0 and len(flat[0]) > 2
    n = 3 if z else 2

    def head(code: int) -> bytes:
        return struct.pack("<BI", 1, code + (1000 if z else 0))

    def path(r: list) -> bytes:
        return struct.pack(f"<I{n * len(r)}d", len(r), *(v for p in r for v in p[:n]))

    def single(code: int, rings: list) -> bytes:
        if code == 1:
            at = rings[0][0] if len(rings) and len(rings[0]) else [float("nan")] * n
            return head(1) + struct.pack(f"<{n}d", *at[:n])
        return head(code) + (path(rings[0]) if code == 2 else struct.pack("<I", len(rings)) + b"".join(map(path, rings)))

    code = CODES[kind]
    if code < 4:
        return single(code, parts[0] if len(parts) else [])
    return head(code) + struct.pack("<I", len(parts)) + b"".join(single(code - 3, rings) for rings in parts)


def decode(raw: bytes) -> tuple[str, list]:
    """ISO and extended codes, either byte order; ordinates past Z are dropped."""
    at = 0

    def take(form: str) -> tuple:
        nonlocal at
        out = struct.unpack_from(form, raw, at)
        at += struct.calcsize(form)
        return out

    def one() -> tuple[str, list]:
        (order,) = take("<B")
        e = "<" if order else ">"
        (code,) = take(f"{e}I")
        has_z, has_m = bool(code & 0x80000000), bool(code & 0x40000000)
        if code & 0x20000000:
            take(f"{e}I")
        code &= 0x0FFFFFFF
        base = code % 1000
        has_z, has_m = has_z or code // 1000 in (1, 3), has_m or code // 1000 in (2, 3)
        n, keep = 2 + has_z + has_m, 2 + has_z

        def path() -> list:
            (k,) = take(f"{e}I")
            v = take(f"{e}{n * k}d")
            return [list(v[i * n : i * n + keep]) for i in range(k)]

        if base == 1:
            p = list(take(f"{e}{n}d"))[:keep]
            return "Point", [] if p[0] != p[0] else [[[p]]]
        if base == 2:
            return "LineString", [[path()]]
        if base == 3:
            return "Polygon", [[path() for _ in range(take(f"{e}I")[0])]]
        if base in (4, 5, 6):
            return KINDS[base], [part for _ in range(take(f"{e}I")[0]) for part in one()[1]]
        raise Refused(f"well-known binary of type {base} isn't read")

    return one()


def to_wkb(g: Column) -> Column:
    @F.pandas_udf("binary")
    def run(kind: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([None if k is None else encode(k, p) for k, p in zip(kind, parts, strict=True)])

    return run(g["type"], g["parts"])


def from_wkb(raw: Column) -> Column:
    @F.pandas_udf(GEOMETRY)
    def run(rows: pd.Series) -> pd.DataFrame:
        made = [decode(bytes(r)) if r is not None else (None, None) for r in rows]
        return pd.DataFrame({"type": [k for k, _ in made], "parts": [p for _, p in made]})

    return F.when(raw.isNotNull(), run(raw))


def read_geoparquet(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    """Parquet with a column of well-known binary; other columns are pruned and filtered as usual."""
    return spark.read.parquet(path).withColumn("geom", from_wkb(F.col(geometry))).drop(geometry)


def write_geoparquet(df: DataFrame, path: str, geom: str = "geom") -> None:
    df.withColumn("geometry", to_wkb(F.col(geom))).drop(geom).write.parquet(path)


def expand_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file in ZIP archives: ``archive, name, crc32, content``. Unsafe names and bombs are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    infos = [i for i in z.infolist() if not i.is_dir()]
                    if len(infos) > MEMBERS:
                        raise Refused(f"{archive} has more than {MEMBERS} members")
                    for i in infos:
                        if i.filename.startswith(("/", "\\")) or ".." in i.filename.replace("\\", "/").split("/") or ":" in i.filename:
                            raise Refused(f"{archive} has an unsafe name: {i.filename!r}")
                        if i.file_size > MEMBER_BYTES:
                            raise Refused(f"{i.filename!r} in {archive} is too large")
                        yield pa.RecordBatch.from_pydict({"archive": [archive], "name": [i.filename], "crc32": [i.CRC], "content": [z.read(i)]})

    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    return rows.mapInArrow(run, "archive string, name string, crc32 long, content binary")


def group_companions(files: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """Files of one folder and base name, in any case, with the parts that are missing.

    ``files`` has ``path``; ``required`` gives, for a main extension, what must stand beside it.
    """
    named = files.select(
        F.regexp_extract("path", r"^(.*?)[^/]*$", 1).alias("folder"),
        F.lower(F.regexp_extract("path", r"([^/]*)\.[^./]+$", 1)).alias("base"),
        F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"),
        "path",
    )
    groups = named.groupBy("folder", "base").agg(F.sort_array(F.collect_set("ext")).alias("parts"))
    needs = F.create_map(*[x for k, v in required.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    main = F.get(F.filter("parts", lambda e: F.map_contains_key(needs, e)), F.lit(0))
    return groups.select("*", main.alias("main"), F.array_except(F.coalesce(needs[main], F.array().cast("array<string>")), "parts").alias("missing"))
