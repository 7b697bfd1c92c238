"""Vector formats that are text: GeoJSON, GeoJSON sequences, WKT, Surpac strings and OSM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry as g

_PROPERTIES = "map<string,string>"


def _feature(text: Column) -> list[Column]:
    return [
        F.get_json_object(text, "$.id").alias("id"),
        g.from_geojson(F.get_json_object(text, "$.geometry")).alias("geom"),
        F.from_json(F.get_json_object(text, "$.properties"), _PROPERTIES).alias("properties"),
    ]


def read_geojsonl(spark: SparkSession, path: str) -> DataFrame:
    """One feature a line, so files are split; blank lines and record separators are skipped."""
    line = F.regexp_replace("value", "^\x1e", "")
    return spark.read.text(path).where(F.length(F.trim(line)) > 0).select(*_feature(line))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Whole collections; a file is read by one task, then its features are dealt out."""
    whole = spark.read.text(path, wholetext=True)
    several = F.variant_get(F.parse_json("value"), "$.features", "array<variant>")
    one = F.when(F.get_json_object("value", "$.type") == "Feature", F.array(F.parse_json("value")))
    each = whole.select(F.posexplode(F.coalesce(several, one)).alias("idx", "v")).repartition("idx")
    return each.select("idx", *_feature(F.to_json("v")))


def feature_json(geom: str, properties: list[str], id_col: str | None = None) -> Column:
    """A GeoJSON feature as text; null properties are written as null."""
    start = F.concat(F.lit('{"type":"Feature",'), F.concat(F.lit('"id":'), F.col(id_col).cast("string"), F.lit(",")) if id_col else F.lit(""))
    props = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}) if properties else F.lit("{}")
    return F.concat(start, F.lit('"geometry":'), F.coalesce(g.to_geojson(F.col(geom)), F.lit("null")), F.lit(',"properties":'), props, F.lit("}"))


def write_geojsonl(df: DataFrame, path: str, geom: str = "geom", id_col: str | None = None) -> None:
    others = [c for c in df.columns if c not in (geom, id_col)]
    df.select(feature_json(geom, others, id_col).alias("value")).write.text(path)


def write_geojson(df: DataFrame, path: str, geom: str = "geom", id_col: str | None = None) -> None:
    """A collection for each task's rows: every file in the folder is valid by itself."""
    others = [c for c in df.columns if c not in (geom, id_col)]

    def wrapped(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        first = True
        for b in batches:
            for v in b.column(0):
                yield pa.RecordBatch.from_pydict({"value": [('{"type":"FeatureCollection","features":[\n' if first else ",\n") + v.as_py()]})
                first = False
        if not first:
            yield pa.RecordBatch.from_pydict({"value": ["]}"]})

    df.select(feature_json(geom, others, id_col).alias("value")).mapInArrow(wrapped, "value string").write.option("lineSep", "\n").text(path)


def from_wkt(text: Column) -> Column:
    """A geometry from well-known text, with or without ``SRID=n;``; null where it can't be read."""
    body = F.regexp_replace(F.trim(text), r"(?i)^SRID=\d+;\s*", "")
    word = F.upper(F.regexp_extract(body, r"^([A-Za-z]+)", 1))
    kinds = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[word]
    number = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
    raw = F.regexp_extract(body, r"(?s)(\(.*\))", 1)
    raw = F.regexp_replace(raw, rf"{number}\s+{number}(?:\s+{number})?(?:\s+{number})?", "[$1,$2,$3]")
    raw = F.regexp_replace(F.replace(F.replace(raw, F.lit("("), F.lit("[")), F.lit(")"), F.lit("]")), r",\]", "]")
    # A point's brackets are one too many, and points of a multi point may have their own.
    raw = F.when(kind == "Point", F.regexp_replace(raw, r"^\[(.*)\]$", "$1")).when(
        kind == "MultiPoint", F.regexp_replace(raw, r"\[\s*(\[[^\[\]]*\])\s*\](?=\s*[,\]])", "$1")
    ).otherwise(raw)
    # JSON wants a digit before a point, and no plus.
    raw = F.regexp_replace(F.regexp_replace(raw, r"(?<=[\[,])\+", ""), r"(?<=[\[,-])\.", "0.")
    return g.from_geojson(F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), raw, F.lit("}")))


def read_wkt(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.select(F.regexp_extract("value", r"(?i)^SRID=(\d+);", 1).alias("srid"), from_wkt(F.col("value")).alias("geom"))


def write_wkt(df: DataFrame, path: str, geom: str = "geom", srid: int | None = None) -> None:
    prefix = F.lit(f"SRID={srid};" if srid else "")
    df.select(F.concat(prefix, g.to_wkt(F.col(geom))).alias("value")).write.text(path)


def read_surpac(spark: SparkSession, path: str) -> DataFrame:
    """String files: ``number, northing, easting, elevation, descriptions``; a record of number 0 ends a string.

    A file is a sequence, so each file's lines are numbered by one task (strings of a file
    are its groups); files are read in parallel.
    """

    def numbered(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for b in batches:
            out = []
            for name, text in zip(b.column("path").to_pylist(), b.column("value").to_pylist(), strict=True):
                part = 0
                for i, line in enumerate(text.splitlines()[2:]):
                    f = [x.strip() for x in line.split(",")]
                    try:
                        number, y, x, z = int(f[0]), *(float(v) for v in f[1:4])
                    except (ValueError, IndexError):
                        continue
                    if number == 0:
                        part += 1
                        continue
                    out.append((name, part, i, number, x, y, z, f[4] if len(f) > 4 else None))
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "part", "idx", "string", "x", "y", "z", "d1"), r, strict=True)) for r in out], schema=pa.schema([("path", pa.string()), ("part", pa.int64()), ("idx", pa.int64()), ("string", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("d1", pa.string())]))

    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    rows = whole.mapInArrow(numbered, "path string, part long, idx long, string long, x double, y double, z double, d1 string")
    at = F.transform(F.array_sort(F.collect_list(F.struct("idx", "x", "y", "z"))), lambda p: F.array(p["x"], p["y"], p["z"]))
    return rows.groupBy("path", "part", "string").agg(g.line(at).alias("geom"))


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    """Tagged nodes as points and ways as lines, or polygons where they close; ways meet their nodes by a join."""
    tag = "tag array<struct<_k:string,_v:string>>"
    tags = F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"], t["_v"])))
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id long, _lat double, _lon double, {tag}").load(path)
    ways = spark.read.format("xml").option("rowTag", "way").schema(f"_id long, nd array<struct<_ref:long>>, {tag}").load(path)
    refs = ways.select("_id", F.posexplode("nd").alias("i", "nd")).select("_id", "i", F.col("nd._ref").alias("ref"))
    at = nodes.select(F.col("_id").alias("ref"), F.array("_lon", "_lat").alias("p"))
    paths = refs.join(at, "ref").groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda s: s["p"]).alias("path"))
    closed = (F.size("path") > 3) & g.is_closed(F.col("path"))
    lines = ways.select("_id", tags.alias("tags")).join(paths, "_id").select(
        F.concat(F.lit("way/"), "_id").alias("id"), "tags", F.when(closed, g.polygon(F.col("path"))).otherwise(g.line(F.col("path"))).alias("geom")
    )
    points = nodes.where(F.size("tag") > 0).select(F.concat(F.lit("node/"), "_id").alias("id"), tags.alias("tags"), g.point(F.col("_lon"), F.col("_lat")).alias("geom"))
    return points.unionByName(lines)
