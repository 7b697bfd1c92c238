"""Comparing two versions of a layer, and judging one: overlays, differences, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators import spatial
from plumbline.storage import stored


def difference(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Keys with ``added``, ``removed`` or ``changed``, and which fields differ; one full outer join."""
    shared = [c for c in before.columns if c in after.columns and c not in key]
    b = before.select(*key, F.struct(*[F.col(c) for c in shared]).alias("b"))
    a = after.select(*key, F.struct(*[F.col(c) for c in shared]).alias("a"))
    both = b.join(a, key, "full")
    fields = F.array_compact(F.array(*[F.when(~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")), F.lit(c)) for c in shared]))
    change = (
        F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.size(fields) > 0, "changed")
    )
    changed = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), fields)
    return both.select(*key, change.alias("change"), F.array_join(F.coalesce(changed, F.array().cast("array<string>")), ",").alias("fields")).where("change is not null")


def paired_layers(before: DataFrame, after: DataFrame) -> DataFrame:
    """Which layer of two versions is which: ``before``, ``after`` and ``paired_by`` (``name``, ``position`` or null).

    Both have a row for each layer with ``layer`` and ``position``, different for each. Layers of one name are the same: of several the first
    one before and the last one after. The rest is paired in order of position, but only if as many are left on either
    side; else each stays by itself. Layers are numbered by one task; their features take no part.
    """
    def sides(df: DataFrame, side: str, last: bool) -> tuple[DataFrame, DataFrame]:
        own = df.select(F.col("layer").alias(side), F.col("position").alias(f"{side}_at"))
        order = F.desc(f"{side}_at") if last else F.asc(f"{side}_at")
        return own, own.withColumn("__k", F.row_number().over(Window.partitionBy(side).orderBy(order))).where("__k = 1").drop("__k")

    (b, b1), (a, a1) = sides(before, "before", False), sides(after, "after", True)
    named = b1.join(a1, F.col("before") == F.col("after")).withColumn("paired_by", F.lit("name"))

    def left(df: DataFrame, side: str) -> DataFrame:
        rest = df.join(named.select(f"{side}_at"), f"{side}_at", "left_anti")
        every = Window.partitionBy(F.lit(0))
        return rest.select(side, F.row_number().over(every.orderBy(f"{side}_at")).alias("__k"), F.count(F.lit(1)).over(every).alias("__n"))

    # Numbers only meet where as many are left on either side.
    rest = left(b, "before").join(left(a, "after"), ["__k", "__n"], "full")
    by = F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), "position")
    return named.select("before", "after", "paired_by").unionByName(rest.select("before", "after", by.alias("paired_by")))


def overlay(before: DataFrame, after: DataFrame, key: list[str], tolerance: float = 0.0) -> DataFrame:
    """Points of two versions: ``added``, ``removed``, ``moved`` beyond the tolerance, or ``unchanged``."""
    b = before.select(*key, F.col("x").alias("bx"), F.col("y").alias("by"))
    a = after.select(*key, F.col("x").alias("ax"), F.col("y").alias("ay"))
    moved = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    state = F.when(F.col("bx").isNull(), "added").when(F.col("ax").isNull(), "removed").when(moved > tolerance, "moved").otherwise("unchanged")
    return b.join(a, key, "full").select(*key, state.alias("state"), moved.alias("moved_by"))


def _vertices(df: DataFrame, keys: list[str], geom: str) -> DataFrame:
    return df.select(*keys, F.explode(g.positions(F.col(geom))).alias("p")).select(*keys, F.col("p")[0].alias("x"), F.col("p")[1].alias("y")).distinct()


def layer_drift(before: DataFrame, after: DataFrame, start: float, geom: str = "geom") -> DataFrame:
    """One row, ``drift``: of all vertices of a layer the farthest from the nearest one before, on its larger axis.

    Vertices that stayed are matched by an equi-join; the others look for the nearest one in growing cells from ``start`` on.
    """
    a, b = _vertices(after, [], geom), _vertices(before, [], geom)
    moved = stored(a.join(b, ["x", "y"], "left_anti").select(F.col("x").alias("lx"), F.col("y").alias("ly"), F.xxhash64("x", "y").alias("lkey")), "moved")
    found = spatial.nearest(moved, b.select(F.col("x").alias("rx"), F.col("y").alias("ry"), F.xxhash64("x", "y").alias("rkey")), "lkey", start, by_axis=True)
    rows = [found.select("distance", F.lit(0).alias("n"), F.lit(0).alias("m"))]
    rows += [df.limit(1).select(F.lit(0.0).alias("distance"), F.lit(n).alias("n"), F.lit(1 - n).alias("m")) for df, n in ((a, 1), (b, 0))]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2]).agg(*[F.max(c).alias(c) for c in ("distance", "n", "m")])
    return both.select(F.when((F.col("n") > 0) & (F.col("m") > 0), F.col("distance")).alias("drift"))


def vertex_drift(before: DataFrame, after: DataFrame, key: list[str], geom: str = "geom") -> DataFrame:
    """For each feature of both versions the farthest that a vertex is from the nearest one before, on its larger axis: ``drift``.

    Vertices that stayed are matched by an equi-join; only others are compared with those of their feature.
    """
    a, b = _vertices(after, key, geom), _vertices(before, key, geom)
    moved = a.join(b, [*key, "x", "y"], "left_anti")
    off = F.greatest(F.abs(F.col("x") - F.col("bx")), F.abs(F.col("y") - F.col("by")))
    pairs = moved.join(b.withColumnsRenamed({"x": "bx", "y": "by"}), key)
    worst = pairs.groupBy(*key, "x", "y").agg(F.min(off).alias("d")).groupBy(*key).agg(F.max("d").alias("drift"))
    both = before.select(*key).join(after.select(*key), key).distinct()
    return both.join(worst, key, "left").withColumn("drift", F.coalesce("drift", F.lit(0.0)))


def field_changes(before: DataFrame, after: DataFrame) -> tuple[list[str], list[str]]:
    """Fields that were lost and that are new."""
    return [c for c in before.columns if c not in after.columns], [c for c in after.columns if c not in before.columns]


def compare(source: DataFrame, output: DataFrame, checks: dict[str, tuple[Column, float]]) -> DataFrame:
    """Each check's aggregate on both sides, and PASS where they differ by at most its tolerance.

    A side without rows isn't validated.
    """
    def facts(df: DataFrame) -> DataFrame:
        made = df.agg(*[c.cast("double").alias(f"c{i}") for i, (c, _) in enumerate(checks.values())], F.count(F.lit(1)).alias("n"))
        rows = [
            F.struct(F.lit(k).alias("check"), F.col(f"c{i}").alias("v"), F.lit(float(t)).alias("tolerance"))
            for i, (k, (_, t)) in enumerate(checks.items())
        ]
        return made.select(F.explode(F.array(*rows)).alias("x"), "n").select("x.*", "n")

    both = facts(source).join(facts(output).select("check", F.col("v").alias("w"), F.col("n").alias("m")), "check")
    verdict = F.when((F.col("n") == 0) | (F.col("m") == 0), "NOT_VALIDATED").when(F.abs(F.col("v") - F.col("w")) <= F.col("tolerance"), "PASS").otherwise("FAILED")
    return both.select("check", F.col("v").alias("source_value"), F.col("w").alias("output_value"), verdict.alias("verdict"))


def deduction(affected: Column, total: Column, weight: float) -> Column:
    """Grows with the root of the affected share, up to the weight."""
    return F.least(F.lit(weight), weight * F.sqrt(F.coalesce(F.try_divide(affected, total), F.lit(0.0))))


#: The weights of the parts of a layer's health.
HEALTH = {"geometry": 25, "topology": 20, "attributes": 20, "crs": 10, "coordinates": 5, "duplicates": 12, "completeness": 8}


def health(parts: DataFrame) -> DataFrame:
    """The weighted mean of the scores ``(part, score)`` that were evaluated, its grade, and the weight they cover."""
    weights = F.create_map(*[F.lit(x) for kv in HEALTH.items() for x in kv])
    known = parts.where(F.col("score").isNotNull()).withColumn("w", weights[F.col("part")])
    mean = F.try_divide(F.sum(F.col("score") * F.col("w")), F.sum("w"))
    grade = F.when(mean >= 85, "good").when(mean >= 60, "fair").when(mean.isNotNull(), "poor").otherwise("not evaluated")
    return known.agg(mean.alias("score"), grade.alias("grade"), F.coalesce(F.sum("w"), F.lit(0)).alias("covered"))


def duplicate_features(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Later rows whose geometry, to nine decimals, an earlier row has; only keys and orders are grouped."""
    first = df.groupBy(key.alias("k")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return df.withColumn("k", key).join(first, "k").where(F.col(order) > F.col("first")).drop("k", "n")


def coordinate_key(*columns: str) -> Column:
    return F.concat_ws(";", *[F.format_string("%.9f", F.col(c).cast("double")) for c in columns])


def counts_by(df: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """How many rows each defect holds for; one pass for all."""
    made = df.agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
    rows = [F.struct(F.lit(k).alias("defect"), F.col(k).alias("n")) for k in kinds]
    return made.select(F.inline(F.array(*rows)))
