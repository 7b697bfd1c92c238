"""One door to all readers: by the name of a format, or by what a file is found to be."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.table import Refused
from plumbline.sources import binary_formats, binary_vector, detect, packages, splittable, tables, text_vector, xml_vector

Reader = Callable[[SparkSession, str], DataFrame]

READERS: dict[str, Reader] = {
    "geojson": text_vector.read_geojson, "geojsonl": text_vector.read_geojsonl, "wkt": text_vector.read_wkt, "osm": text_vector.read_osm,
    "surpac": text_vector.read_surpac, "kml": xml_vector.read_kml, "kmz": xml_vector.read_kmz, "gpx": xml_vector.read_gpx, "gml": xml_vector.read_gml,
    "landxml": xml_vector.read_landxml, "topojson": packages.read_topojson, "shapefile": binary_formats.read_shapefile, "dxf": binary_formats.read_dxf,
    "ply": binary_formats.read_ply, "geoparquet": binary_vector.read_geoparquet, "csv": lambda s, p: tables.read_csv_table(s, p)[0],
    "xyz": tables.read_xyz, "pts": lambda s, p: tables.read_xyz(s, p, skip_counts=True), "asciigrid": lambda s, p: tables.read_ascii_grid(s, p)[0],
    "las": splittable.read_las, "geotiff": splittable.read_geotiff,
}
#: Formats that are known but only read by outside converters, and what to hand in instead.
OUTSIDE = {"dwg": "dxf", "dgn": "dxf", "laz": "las", "e57": "las", "geopackage": "geoparquet", "flatgeobuf": "geojsonl", "filegdb": "geoparquet"}


def read_source(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:  # noqa: A002
    """The rows of files of one format; without its name, what all files under the path are found to be.

    Refused by name: formats of outside converters, unknown ones, paths without files, files of several formats, and a guess that would
    have to be confirmed.
    """
    if format is None:
        found = detect.detect_formats(spark, path).groupBy("format").agg({"needs_confirmation": "max"}).limit(3).collect()
        if not found:
            raise Refused(f"there is no file at {path}")
        if len(found) > 1:
            raise Refused(f"files at {path} are of several formats: {', '.join(sorted(str(r[0]) for r in found))}")
        format, unsure = found[0]  # noqa: A001
        if format is None or unsure and format not in OUTSIDE:
            raise Refused(f"what {path} is isn't sure{f'; it may be {format}' if format else ''}: name its format")
    if format in OUTSIDE:
        raise Refused(f"{format} needs an outside converter: hand it in as {OUTSIDE[format]}")
    if format not in READERS:
        raise Refused(f"no reader is called {format!r}")
    return READERS[format](spark, path)
