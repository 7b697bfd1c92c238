"""Labels that would overlap: the one with more room keeps its place.

The rule is greedy, one label after another by clearance. A label's fate only hangs on labels before it that overlap it,
so it is found in rounds: those before all of their undecided neighbours are placed, their neighbours are
suppressed, and the rest goes on. Overlaps are found by a join on grid cells; no layer is put into one order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import spatial
from plumbline.storage import stored

#: Fixed value: the width of a letter as a share of its height.
LETTER = 0.6


def half_width(text: F.Column, height: float) -> F.Column:
    return F.length(text) * height * LETTER / 2


def resolve_collisions(labels: DataFrame, height: float, size: float, key: str = "idx", text: str = "text") -> DataFrame:
    """``labels`` (``x, y, clearance`` and a text of one line) with ``suppressed``.

    Labels go by clearance, largest first, then by key. One is suppressed if it overlaps a placed one before it, edges that
    only touch aside; it isn't moved elsewhere. Null texts have no width; labels without a place or clearance overlap
    nothing and stay. ``size`` is about the width of a label.
    """
    own = labels.select(F.col(key).alias("a"), "x", "y", F.coalesce(half_width(F.col(text), height), F.lit(0.0)).alias("w"), "clearance")
    own = stored(own.where("x is not null and y is not null and clearance is not null"), "labels")
    box = {"minx": F.col("x") - F.col("w"), "miny": F.col("y") - height / 2, "maxx": F.col("x") + F.col("w"), "maxy": F.col("y") + height / 2}
    left = own.withColumns(box)
    right = left.select(*[F.col(c).alias(f"o_{c}") for c in left.columns])
    met = spatial.box_join(left, right, size, spatial.BOX, tuple(f"o_{c}" for c in spatial.BOX))
    overlap = (F.abs(F.col("x") - F.col("o_x")) < F.col("w") + F.col("o_w")) & (F.abs(F.col("y") - F.col("o_y")) < height)
    before = (F.col("o_clearance") > F.col("clearance")) | ((F.col("o_clearance") == F.col("clearance")) & (F.col("o_a") < F.col("a")))
    # Each overlap once, from the label to the one before it.
    links = stored(met.where(overlap & before).select("a", F.col("o_a").alias("b")), "overlaps")
    placed = own.select("a").join(links.select("a").distinct(), "a", "left_anti").withColumn("suppressed", F.lit(False))
    done = stored(placed, "decided")
    while links.take(1):
        # Whoever has a placed one before it is suppressed; links from it, and those to suppressed ones, are settled.
        gone = stored(links.join(done.where(~F.col("suppressed")).select(F.col("a").alias("b")), "b", "left_semi").select("a").distinct().withColumn("suppressed", F.lit(True)), "suppressed")
        waiting = links.join(gone.select("a"), "a", "left_anti").join(gone.select(F.col("a").alias("b")), "b", "left_anti")
        waiting = stored(waiting, "overlaps")
        fresh = links.select("a").distinct().join(gone.select("a"), "a", "left_anti").join(waiting.select("a").distinct(), "a", "left_anti").withColumn("suppressed", F.lit(False))
        fresh = stored(fresh, "decided")
        done = done.unionByName(gone).unionByName(fresh)
        links = waiting
    return labels.join(done.withColumnRenamed("a", key), key, "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))
