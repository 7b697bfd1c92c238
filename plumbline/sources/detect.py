"""What format a file is: evidence from names, magic bytes and text, combined by noisy-or."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File extensions and the formats they suggest.
EXTENSIONS = {
    "geojson": "geojson", "json": "geojson", "geojsonl": "geojsonl", "ndjson": "geojsonl", "jsonl": "geojsonl", "topojson": "topojson",
    "shp": "shapefile", "kml": "kml", "kmz": "kmz", "gpx": "gpx", "wkt": "wkt", "wkb": "wkb", "gml": "gml", "osm": "osm", "csv": "csv",
    "tsv": "csv", "txt": "csv", "xlsx": "xlsx", "dxf": "dxf", "dwg": "dwg", "asc": "asciigrid", "grd": "asciigrid", "tif": "geotiff",
    "tiff": "geotiff", "las": "las", "laz": "laz", "xyz": "xyz", "pts": "pts", "ply": "ply", "str": "surpac", "zip": "zip",
    "gpkg": "geopackage", "fgb": "flatgeobuf", "parquet": "geoparquet",
}
#: First bytes, in hex, and what they prove.
MAGIC = {
    "504B0304": "zip", "4C415346": "las", "49492A00": "geotiff", "4D4D002A": "geotiff", "0000270A": "shapefile", "666762": "flatgeobuf",
    "706C79": "ply", "41433130": "dwg", "53514C69746520666F726D6174203300": "geopackage", "50415231": "geoparquet",
}
#: Patterns in the first text of a file.
TEXT = {
    "geojson": r'(?s)^\s*\{.*"type"\s*:\s*"(FeatureCollection|Feature)"', "topojson": r'(?s)^\s*\{.*"type"\s*:\s*"Topology"',
    "kml": r"<kml[\s>]", "gpx": r"<gpx[\s>]", "osm": r"<osm[\s>]", "gml": r"<(\w+:)?FeatureCollection[\s>]", "landxml": r"<LandXML[\s>]",
    "dxf": r"(?s)^\s*0\s*\r?\n\s*SECTION", "asciigrid": r"(?is)^\s*ncols\s+\d+", "wkt": r"(?i)^\s*(SRID=\d+;)?\s*(MULTI)?(POINT|LINESTRING|POLYGON)\s*Z?\s*\(",
    "pts": r"^\s*\d+\s*\r?\n\s*[-\d.]+\s+[-\d.]+\s+[-\d.]+",
}
#: How much each kind of evidence weighs; under which confidence a person has to confirm.
WEIGHTS = {"extension": 0.35, "magic": 0.5, "json": 0.85, "root": 0.8, "header": 0.85, "text": 0.55, "probe": 0.85, "companion": 0.25}
#: Kinds of shapes in GeoJSON.
SHAPES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection")
#: Which kind of evidence a pattern is.
KIND = {"geojson": "json", "topojson": "json", "dxf": "header", "asciigrid": "header", "wkt": "text", "pts": "text"}
SURE = 0.6
#: Extensions of files beside one of the same name, and the format that they speak for.
COMPANIONS = {"shp": (("shx", "dbf"), "shapefile"), "tif": (("tfw",), "geotiff"), "tiff": (("tfw",), "geotiff")}


def _probes(content: Column, text: Column) -> list[Column]:
    """Formats whose headers agree with themselves; null where one doesn't."""
    head = F.hex(F.substring(content, 1, 227))
    byte = lambda i: F.conv(F.substring(head, 2 * i + 1, 2), 16, 10).cast("long")
    # A number of two bytes, the lower one first; and of four, the highest one first.
    short, whole = byte(94) + 256 * byte(95), ((byte(24) * 256 + byte(25)) * 256 + byte(26)) * 256 + byte(27)
    zipped, las = head.startswith("504B0304"), head.startswith("4C415346") & (F.length(content) >= 227) & (byte(24) == 1) & (byte(25) <= 4)
    packed = byte(104) >= 64
    return [
        F.when(zipped & (text.contains("[Content_Types].xml") | text.contains("xl/workbook")), "xlsx").when(zipped & text.rlike(r"(?i)\.kml"), "kmz"),
        F.when(las & packed, "laz").when(las & short.between(227, 512), "las"),
        F.when(head.rlike("^(49492A00|4D4D002A|49492B00|4D4D002B)"), "geotiff"),
        F.when(head.startswith("0000270A") & (whole * 2 == F.length(content)), "shapefile"),
    ]


def _beside(files: DataFrame) -> DataFrame:
    """Evidence of files that stand beside one another; only paths are read."""
    ext, base = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)), F.lower(F.regexp_extract("path", r"^(.*)\.[^./]+$", 1))
    known = {*COMPANIONS, *(e for others, _ in COMPANIONS.values() for e in others)}
    named = files.select("path", ext.alias("ext"), base.alias("base")).where(F.col("ext").isin(*sorted(known)))
    others = named.groupBy("base").agg(F.collect_set("ext").alias("exts"))
    format_ = F.coalesce(*[F.when((F.col("ext") == e) & F.arrays_overlap("exts", F.array(*map(F.lit, others_))), f) for e, (others_, f) in COMPANIONS.items()])
    return named.join(others, "base").select("path", F.lit("companion").alias("kind"), format_.alias("format")).where("format is not null")


def evidence(files: DataFrame) -> DataFrame:
    """Rows of ``path, kind, format, weight`` from files' ``path`` and ``content``."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    by_ext = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[ext]
    head = F.hex(F.substring("content", 1, 16))
    text = F.decode(F.substring("content", 1, 65536), "ISO-8859-1")
    found = [F.struct(F.lit("extension").alias("kind"), by_ext.alias("format"))]
    found += [F.struct(F.lit("magic").alias("kind"), F.when(head.startswith(m), f).alias("format")) for m, f in MAGIC.items()]
    found += [F.struct(F.lit(KIND.get(f, "root")).alias("kind"), F.when(text.rlike(p), f).alias("format")) for f, p in TEXT.items()]
    found += [F.struct(F.lit("probe").alias("kind"), f.alias("format")) for f in _probes(F.col("content"), F.substring(text, 1, 4096))]
    # A whole JSON document of another structure is none of these, whatever its name says.
    other = text.rlike(r"^\s*[{\[]") & F.try_parse_json(text).isNotNull() & (F.length("content") <= 65536)
    shaped = F.get_json_object(text, "$.type").isin("FeatureCollection", "Feature", "Topology", *SHAPES)
    json = F.array(*map(F.lit, ("geojson", "topojson")))
    ruled_out = F.when(other & ~F.coalesce(shaped, F.lit(False)), json).otherwise(F.array().cast("array<string>"))
    each = files.select("path", ruled_out.alias("out"), F.inline(F.array(*found)))
    rows = each.where(F.col("format").isNotNull() & ~F.array_contains("out", F.col("format"))).drop("out").unionByName(_beside(files))
    return rows.withColumn("weight", F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("kind")])


def detect_formats(spark: SparkSession, path: str) -> DataFrame:
    """The likeliest format of each file under a path, its confidence, and whether it needs to be confirmed."""
    return detected(spark.read.format("binaryFile").load(path))


def detected(files: DataFrame) -> DataFrame:
    scored = evidence(files).groupBy("path", "format").agg(
        (1 - F.exp(F.sum(F.log1p(-F.least("weight", F.lit(0.99)))))).alias("confidence"), F.sort_array(F.collect_set("kind")).alias("evidence")
    )
    first = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("confidence"), "format"))
    best = scored.withColumn("k", first).where("k = 1").drop("k")
    return files.select("path").join(best, "path", "left").withColumn("needs_confirmation", F.coalesce(F.col("confidence") < SURE, F.lit(True)))
