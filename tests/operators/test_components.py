import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators import components as c
from plumbline.operators import edits, planar
from plumbline.operators.table import Refused
from plumbline.sources import detect
from plumbline.storage import stored


def test_components_of_a_long_chain(spark):
    nodes = spark.range(300)
    links = spark.range(299).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a <> 149")
    got = c.components(nodes, links).groupBy("component").count().orderBy("component").collect()
    assert [tuple(r) for r in got] == [(0, 150), (150, 150)]


def test_regions_and_their_polygons(spark):
    grid = ["1122", "1122", "3311", "3411"]
    px = spark.createDataFrame([(1, r, k, float(v)) for r, row in enumerate(grid) for k, v in enumerate(row)], "band int, row int, col int, value double")
    cells = sorted((r["value"], r["cells"]) for r in c.raster_regions(px).collect())
    assert cells == [(1.0, 4), (1.0, 4), (2.0, 4), (3.0, 3), (4.0, 1)]
    shapes = c.region_polygons(px).select("cells", g.area(F.col("geom")).alias("a")).collect()
    assert sorted(r["cells"] for r in shapes) == [1, 3, 4, 4, 4] and all(abs(r["cells"] - r["a"]) < 1e-9 for r in shapes)


def test_lines_merge_at_nodes_of_two(spark):
    paths = {1: [[0.0, 0.0], [1.0, 0.0]], 2: [[2.0, 0.0], [1.0, 0.0]], 3: [[2.0, 0.0], [3.0, 0.0]], 4: [[3.0, 0.0], [4.0, 1.0]], 5: [[3.0, 0.0], [4.0, -1.0]]}
    df = spark.createDataFrame(list(paths.items()), "idx long, path array<array<double>>")
    rows = sorted((r["merged"], len(r["path"])) for r in c.merge_lines(df).collect())
    assert rows == [(1, 2), (1, 2), (3, 4)]


def test_gaps_and_duplicates(spark):
    at = [(float(i), float(j)) for i in range(0, 30, 10) for j in range(0, 30, 10) if (i, j) != (10, 10)]
    x, y = F.col("x"), F.col("y")
    df = spark.createDataFrame([(k, *p) for k, p in enumerate([*at, (0.001, 0.0)])], "idx long, x double, y double")
    df = df.select("idx", x.alias("minx"), y.alias("miny"), (x + 10).alias("maxx"), (y + 10).alias("maxy"), g.polygon(g.box(x, y, x + 10, y + 10)).alias("geom"))
    assert [tuple(r) for r in c.near_duplicates(df, 40.0, 0.01).collect()] == [(0, len(at))]
    assert [round(r["area"], 6) for r in planar.coverage_gaps(df.where(f"idx < {len(at)}"), 100.0).collect()] == [100.0]


def test_replay_and_workflow(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "b", None)], "idx long, layer string, v double")
    with pytest.raises(Refused, match="command 2"):
        edits.replay(df, [{"kind": "add-field", "field": "w", "type": "int"}, {"kind": "add-field", "field": "w", "type": "int"}])
    with pytest.raises(Refused, match="protected"):
        edits.replay(df, [{"kind": "delete-layer", "layer": "a"}], protected=("a",))
    flow = edits.Workflow("w", [{"kind": "delete-field", "field": "v"}])
    with pytest.raises(Refused, match="confirmed"):
        flow.run(df)
    assert flow.run(df, confirmed={0}).columns == ["idx", "layer"]
    h = edits.History.of(df)
    h.record("less", df.where("idx = 1"))
    assert (h.undo().count(), h.redo().count(), h.revert_to("start").count()) == (2, 1, 2)


def test_detection(spark, tmp_path):
    (tmp_path / "a.las").write_bytes(b"LASF" + bytes(300))
    (tmp_path / "b.txt").write_text("<?xml version='1.0'?><kml xmlns='x'></kml>")
    (tmp_path / "c.bin").write_bytes(b"\x00\x01")
    got = {r["path"][-5:]: (r["format"], r["needs_confirmation"]) for r in detect.detect_formats(spark, str(tmp_path)).collect()}
    assert got == {"a.las": ("las", False), "b.txt": ("kml", False), "c.bin": (None, True)}


def test_contours_of_equal_bands_stay_apart(spark):
    """A cone in two bands: each level is one closed line in each band; the lowest leaves the raster at its corners."""
    rows = [(b, r, c, 10.0 - ((r - 5) ** 2 + (c - 5) ** 2) ** 0.5) for b in (1, 2) for r in range(11) for c in range(11)]
    pixels = spark.createDataFrame(rows, "band int, row int, col int, value double")
    got = c.contour_lines(pixels, 2.0, 5.5).where("elevation < 10").collect()
    assert sorted((r["band"], r["elevation"], r["closed"]) for r in got) == [x for b in (1, 2) for x in [(b, 3.5, False)] * 4 + [(b, e, True) for e in (5.5, 7.5, 9.5)]]


def test_long_chains_and_rings_are_ordered(spark):
    """Shuffled pieces of one long line, of a ring, and of lines that meet at a junction of three."""
    import random

    rng = random.Random(4)
    chain = [[float(i), float(i * i % 7)] for i in range(300)]
    ring = [[1000.0 + x, y] for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0))]
    star = [[[2000.0, 0.0], [2000.0 + x, y]] for x, y in ((1.0, 0.0), (-1.0, 0.0), (0.0, 1.0))]
    pieces = [[p, q] for path in (chain, ring) for p, q in zip(path, path[1:])] + star
    pieces = [p[::-1] if rng.random() < 0.5 else p for p in pieces]
    rng.shuffle(pieces)
    df = spark.createDataFrame(list(enumerate(pieces)), "idx long, path array<array<double>>")
    got = [(r["merged"], [list(p) for p in r["path"]]) for r in c.merge_lines(df).collect()]
    longest = max(got, key=lambda x: len(x[1]))
    assert longest[0] == 299 and longest[1] in (chain, chain[::-1])
    rings = [p for _, p in got if p[0] == p[-1]]
    assert len(rings) == 1 and sorted(map(tuple, rings[0][:-1])) == sorted(map(tuple, ring[:-1]))
    assert sorted(n for n, _ in got) == [1, 1, 1, 4, 299]
    assert c.merge_lines(df.limit(0)).count() == 0


def test_rounds_of_a_long_block_are_few(spark, monkeypatch):
    """A block of squares, and chains whose ids go up and down: few tables are kept, however far a label has to go."""
    kept = []
    monkeypatch.setattr(c, "stored", lambda df, name="rows": (kept.append(name), stored(df, name))[1])
    n = 1000
    grid = [(r * 10 + k, (r + i) * 10 + k + j) for r in range(n) for k in range(10) for i, j in ((0, 1), (1, 0)) if k + j < 10 and r + i < n]
    up_and_down = [(20_000 + k, 30_000 + k) for k in range(300)] + [(30_000 + k, 20_001 + k) for k in range(299)]
    ids = {k for p in grid + up_and_down for k in p} | {50_000}
    got = c.components(spark.createDataFrame([(k,) for k in ids], "id long"), spark.createDataFrame(grid + up_and_down, "a long, b long"))
    assert {tuple(r) for r in got.select("id", "component").collect()} == {(k, 0 if k < 20_000 else 50_000 if k == 50_000 else 20_000) for k in ids}
    assert len(kept) < 35
