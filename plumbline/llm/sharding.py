"""Sharding: a k-d tree over document metadata whose leaves are shards of near equal bytes.

Points are groups of equal texts (hashes, never texts), weighted by the bytes of their
documents. A node that is to hold k shards is cut at the weighted quantile that gives its
halves floor(k/2) and the rest, along the metadata dimension in which it is widest. All
nodes of a level are cut together. Weighted quantiles are found over all points by
histograms of a key of 62 bits, refined until a bin weighs little: only bin sums reach the
driver, at most ``BINS`` for each node.

Groups of at most a shard stay together. Large ones, which are few by their weight, are dealt
first, by falling weight, each to the shard with most room, and the tree fills what is left. A
shard can so exceed an even share by less than the last group it got. A group larger than
``HUGE`` of a shard is dissolved to its single documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stored

BINS = 4096
#: Shares of a shard: a group over LARGE is dealt before the tree, one over HUGE is dissolved.
LARGE, HUGE = 0.02, 1.0
#: A quantile's bin is refined until it weighs less than this share of a shard, or is one point.
FINE = 0.0005
DIMENSIONS = ("d_size", "d_source", "d_lang", "d_id")
KEY_BITS = 62
VALUE_BITS = 22


@dataclass
class Node:
    """A part of the tree: shards with the bytes each may still take; a cut once it is split."""

    number: int
    shards: list[tuple[int, float]]
    dim: str = ""
    cut: int = 0
    low: Node | None = None
    high: Node | None = None
    bounds: tuple[int, int] = field(default=(0, 1 << KEY_BITS))


def document_sizes(docs: DataFrame, text: str = "text", extra: int = 16) -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + extra


def _key(value: Column, low: float, high: float, tie: Column) -> Column:
    """A dimension's value on 22 bits, then 40 bits of hash so that equal values can be cut."""
    width = max(high - low, 1e-12)
    top = F.floor((value - low) / width * ((1 << VALUE_BITS) - 1)).cast("long")
    return F.shiftleft(top, KEY_BITS - VALUE_BITS) + tie


def _node_of(n: Node) -> Column:
    """The number of the leaf below a node that a point falls into."""
    if n.low is None:
        return F.lit(n.number)
    return F.when(F.col(n.dim) < n.cut, _node_of(n.low)).otherwise(_node_of(n.high))


def _shard_of(root: Node) -> Column:
    leaf = F.create_map(*[F.lit(x) for n in _leaves(root) for x in (n.number, n.shards[0][0])])
    return leaf[_node_of(root)]


def _leaves(n: Node) -> list[Node]:
    return [n] if n.low is None else _leaves(n.low) + _leaves(n.high)


def build_tree(points: DataFrame, room: dict[int, float]) -> Node:
    """Cuts ``points (weight, four dimension keys)`` until each leaf is one shard."""
    root = Node(0, sorted(room.items()))
    made = 1
    here = points.withColumn("node", F.lit(0))
    target = sum(room.values()) / max(len(room), 1)
    while any(len(n.shards) > 1 for n in _leaves(root)):
        level = [n for n in _leaves(root) if len(n.shards) > 1]
        spread = here.groupBy("node").agg(
            F.sum("weight").alias("w"),
            *[F.stddev_pop(F.col(d) / F.lit(float(1 << KEY_BITS))).alias(d) for d in DIMENSIONS],
        )
        stats = {r["node"]: r for r in spread.collect()}
        goal: dict[int, float] = {}
        for n in level:
            r = stats.get(n.number)
            n.dim = max(DIMENSIONS, key=lambda d: ((r[d] or 0.0) if r else 0.0))
            half = len(n.shards) // 2
            share = sum(x for _, x in n.shards[:half]) / max(sum(x for _, x in n.shards), 1e-12)
            goal[n.number] = share * (r["w"] if r else 0.0)
            n.bounds = (0, 1 << KEY_BITS)
        open_, before = list(level), dict.fromkeys(goal, 0.0)
        while open_:
            key = F.lit(None).cast("long")
            start = F.lit(0).cast("long")
            shift = F.lit(0)
            for n in open_:
                of = F.col("node") == n.number
                key = F.when(of, F.col(n.dim)).otherwise(key)
                start = F.when(of, F.lit(n.bounds[0]).cast("long")).otherwise(start)
                shift = F.when(of, F.lit(_shift(n.bounds))).otherwise(shift)
            binned = (
                here.where(F.col("node").isin([n.number for n in open_]))
                .select("node", "weight", key.alias("key"), start.alias("start"), shift.alias("shift"))
                .withColumn("bin", F.expr("shiftright(key - start, shift)"))
                .where((F.col("bin") >= 0) & (F.col("bin") < BINS))
                .groupBy("node", "bin")
                .agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"))
            )
            bins: dict[int, list[tuple[int, float, int]]] = {n.number: [] for n in open_}
            for r in binned.collect():
                bins[r["node"]].append((r["bin"], float(r["w"]), r["n"]))
            still = []
            for n in open_:
                size, (low, high) = 1 << _shift(n.bounds), n.bounds
                # The cut is in the first bin that reaches the goal, or at an end of it.
                n.cut = low
                for b, w, points_in in sorted(bins[n.number]):
                    if before[n.number] + w < goal[n.number]:
                        before[n.number] += w
                        n.cut = low + (b + 1) * size
                        continue
                    if w > FINE * target and size > 1 and points_in > 1:
                        n.bounds = (low + b * size, min(high, low + (b + 1) * size))
                        still.append(n)
                    else:
                        nearer = goal[n.number] - before[n.number] > w / 2
                        n.cut = low + (b + nearer) * size
                    break
            open_ = still
        for n in level:
            half = len(n.shards) // 2
            n.low, n.high = Node(made, n.shards[:half]), Node(made + 1, n.shards[half:])
            made += 2
        # Points of finished shards leave; the others learn their new node.
        child = F.lit(None).cast("int")
        for n in level:
            side = F.when(F.col(n.dim) < n.cut, n.low.number).otherwise(n.high.number)
            child = F.when(F.col("node") == n.number, side).otherwise(child)
        going = [x.number for n in level for x in (n.low, n.high) if len(x.shards) > 1]
        if going:
            here = stored(here.withColumn("node", child).where(F.col("node").isin(going)))
    return root


def _shift(bounds: tuple[int, int]) -> int:
    """So that the range has at most BINS bins, each a power of two wide."""
    return max(0, (bounds[1] - bounds[0] - 1).bit_length() - (BINS.bit_length() - 1))


def shard_documents(
    docs: DataFrame,
    shards: int = 40,
    text: str = "text",
    id_col: str = "doc_id",
    source: str | None = "source",
    lang: str | None = "lang",
) -> DataFrame:
    """``docs`` without its text, with ``size``, ``text_crc32``, ``shard`` and ``slot``.

    ``size`` is the text's UTF-8 bytes and 16; shards get near equal sums of it, as near as
    groups of equal texts allow, which stay in one shard where they fit one. ``slot`` counts
    from 0 without gaps in each shard. ``source`` and ``lang`` may be None or absent.

    A null text has no bytes, and groups with empty ones. Null metadata and ids are values
    like others. Equal rows are separate documents. An empty table gives an empty one, and
    with fewer documents than shards some shards stay empty. Columns of ``docs`` with the
    names of results are replaced; others pass.
    """
    spark = docs.sparkSession
    results = ["size", "text_crc32", "shard", "slot"]
    kept = [c for c in docs.columns if c != text and c not in results]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stored(
        docs.select(
            *kept,
            document_sizes(docs, text).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("__g1"),
            F.xxhash64(F.lit("shard"), body).alias("__g2"),
            *[_place(docs, c).alias(f"__{k}") for k, c in (("source", source), ("lang", lang), ("id", id_col))],
        )
    )
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    target = total / shards
    group = ["__g1", "__g2"]
    groups = stored(
        rows.groupBy(*group).agg(
            F.sum("size").alias("weight"),
            F.min("size").alias("size"),
            *[F.min(f"__{k}").alias(f"__{k}") for k in ("source", "lang", "id")],
        )
    )
    # By their weight there are fewer than 1 / LARGE such groups for each shard.
    heavy = groups.where(F.col("weight") > LARGE * target).select(*group, "weight", "size").collect()
    room, dealt = dict.fromkeys(range(shards), target), []
    for r in sorted(heavy, key=lambda r: (-r["weight"], r["__g1"], r["__g2"])):
        best = max(room, key=lambda s: (room[s], -s))
        fits = r["weight"] == r["size"] or r["weight"] <= HUGE * target
        room[best] -= r["weight"] * fits
        dealt.append((r["__g1"], r["__g2"], best if fits else -1))
    room = {s: x for s, x in room.items() if x > 0} or {0: 1.0}
    known = F.broadcast(spark.createDataFrame(dealt, "__g1 long, __g2 long, dealt int"))
    groups = groups.join(known, group, "left")
    dissolved = rows.join(known.where("dealt = -1"), group, "left_semi")

    measures = {"d_size": F.log(F.col("size").cast("double")), **{f"d_{k}": F.col(f"__{k}") for k in ("source", "lang", "id")}}
    whole = groups.where(F.col("dealt").isNull())
    dissolved = dissolved.withColumn("weight", F.col("size"))
    inputs = ["size", "__source", "__lang", "__id"]
    ends = (
        whole.select(*inputs)
        .unionByName(dissolved.select(*inputs))
        .agg(*[f(v).alias(f"{d}_{f.__name__}") for d, v in measures.items() for f in (F.min, F.max)])
        .first()
    )

    def keyed(df: DataFrame) -> DataFrame:
        tie = F.pmod(F.xxhash64(*group, "__id", "__source", "__lang"), F.lit(1 << (KEY_BITS - VALUE_BITS)))
        keys = {d: _key(v, ends[f"{d}_min"] or 0.0, ends[f"{d}_max"] or 0.0, tie) for d, v in measures.items()}
        return stored(df.withColumns(keys))

    own = [*kept, "size", "text_crc32", *group, "__id"]
    whole = keyed(whole.select(*group, "weight", *inputs))
    dissolved = keyed(dissolved.select(*own, "weight", "__source", "__lang"))
    points = whole.select("weight", *DIMENSIONS).unionByName(dissolved.select("weight", *DIMENSIONS))
    shard = _shard_of(build_tree(points, room)).alias("shard")
    # A whole group gives all its documents their shard; dissolved documents find theirs alone.
    of_group = whole.select(*group, shard).unionByName(
        groups.where(F.col("dealt") >= 0).select(*group, F.col("dealt").alias("shard"))
    )
    placed = rows.join(of_group, group).select(*own, "shard").unionByName(dissolved.select(*own, shard))

    # Slots: ranks in small parts of each shard, after the sizes of the parts before.
    parts = max(8, -(-n // (shards * 50_000)))
    dealt_out = placed.withColumn("__part", F.pmod(F.xxhash64("__id", *group), F.lit(parts)))
    ranked = dealt_out.withColumn(
        "__rank", F.row_number().over(Window.partitionBy("shard", "__part").orderBy("__id", *group, *kept))
    )
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt_out.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("n"))
    bases = sizes.select("shard", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    return ranked.join(bases, ["shard", "__part"]).select(
        *kept, "size", "text_crc32", "shard", (F.col("__base") + F.col("__rank") - 1).alias("slot")
    )


def _place(docs: DataFrame, name: str | None) -> Column:
    """Metadata as a number: numbers stay in order, names get places by hash, null and absent are -1."""
    kind = dict(docs.dtypes).get(name)
    if kind is None:
        return F.lit(-1.0)
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return F.coalesce(F.col(name).cast("double"), F.lit(-1.0))
    hashed = F.pmod(F.xxhash64(F.col(name)), F.lit(1 << 20)).cast("double")
    return F.when(F.col(name).isNull(), F.lit(-1.0)).otherwise(hashed)
