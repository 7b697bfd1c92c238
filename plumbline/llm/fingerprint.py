"""Document fingerprints: a homomorphic multiset hash of the sentences of a text's paragraphs.

Every unit (a paragraph, cut after sentence ends, with the line break or white space that
ends it) is hashed to a wide vector, and a document is the sum of its units' vectors, lane
by lane modulo a power of two:

* 8 lanes of 32 bits modulo 2**32 (256 bits) decide equality;
* 62 lanes modulo 2**30, two packed in a long, count how many units have each of 62 hash
  bits set, and one lane counts the units, so ``2 * ones - units`` sums a sign for each
  unit. Products of these sums give a likeness from 0 to 1. A lane wraps only beyond a
  thousand million units.

The units of a text joined are the text again, so texts with equal fingerprints have the
same units with the same ends, in any order. ``added`` and ``removed`` insert and delete
units, or whole documents, without reading the rest again. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import DataType

from plumbline.llm.common import stored

#: Longs of two lanes, and the lanes' bits; each lane has a guard bit above it.
PACKED = 31
LANE = (1 << 30) - 1
MASK = LANE | LANE << 31
ONES = 1 | 1 << 31
WIDE = (1 << 32) - 1
#: Units end after a line break, and after white space that follows a sentence end.
UNIT_END = r"((?<=\n)|(?<=[.!?]\s))(?!\z)"
#: Ranges of ids are cut for so many bytes of text each, and at most so many are made.
RANGE_BYTES, MOST_RANGES = 2 << 20, 50_000
#: The cuts are found from about so many sampled rows for each range.
SAMPLED = 20


def units(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), UNIT_END, -1)


def _vector(h: Column) -> list[Column]:
    """What one unit adds: its count, longs of two lanes, 8 wide lanes."""
    signs = [F.shiftrightunsigned(h["h0"], k).bitwiseAND(F.lit(ONES)) for k in range(PACKED)]
    wide = [
        half for k in range(1, 5) for half in (F.shiftrightunsigned(h[f"h{k}"], 32), h[f"h{k}"].bitwiseAND(F.lit(WIDE)))
    ]
    return [F.lit(1).cast("long"), *signs, *wide]


_MASKS = [WIDE, *[MASK] * PACKED, *[WIDE] * 8]
LANES = len(_MASKS)


def multiset_hash(text: Column) -> Column:
    """The sum over a text's units as an array of ``LANES`` longs. Null counts as empty text."""
    hashes = F.transform(
        units(text), lambda u: F.struct(*[F.xxhash64(F.lit(k), u).alias(f"h{k}") for k in range(5)])
    )
    zero = F.struct(*[F.lit(0).cast("long").alias(f"v{k}") for k in range(LANES)])
    total = F.aggregate(
        hashes,
        zero,
        lambda acc, h: F.struct(
            *[
                (acc[f"v{k}"] + v).bitwiseAND(F.lit(m)).alias(f"v{k}")
                for k, (v, m) in enumerate(zip(_vector(h), _MASKS, strict=True))
            ]
        ),
        lambda acc: F.array(*[acc[f"v{k}"] for k in range(LANES)]),
    )
    return total


def added(a: Column, b: Column) -> Column:
    """The hash of the union of two multisets."""
    masks = F.array(*[F.lit(m).cast("long") for m in _MASKS])
    return F.zip_with(F.zip_with(a, b, lambda x, y: x + y), masks, lambda x, m: x.bitwiseAND(m))


def removed(a: Column, b: Column) -> Column:
    """The hash of a multiset from which the units of ``b`` are taken away."""
    # Each lane gets a power to borrow from; the mask drops it again.
    guards = 1 << 30 | 1 << 61
    loans = F.array(*[F.lit(x).cast("long") for x in (WIDE + 1, *[guards] * PACKED, *[WIDE + 1] * 8)])
    masks = F.array(*[F.lit(m).cast("long") for m in _MASKS])
    lent = F.zip_with(a, loans, lambda x, y: x.bitwiseOR(y))
    return F.zip_with(F.zip_with(lent, b, lambda x, y: x - y), masks, lambda x, m: x.bitwiseAND(m))


def likeness(a: Column, b: Column) -> Column:
    """How alike two hashed multisets are, 0 to 1; exactly 1 for equal hashes only.

    With units' signs summed in each lane, products of the lanes estimate products of the
    multisets: this is ``2 a.b / (a.a + b.b)``, where units that are repeated weigh more.
    """
    # Bound to a name, so that neither is computed again for each lane.
    both = F.array(F.struct(a.alias("a"), b.alias("b")))
    return F.get(F.transform(both, lambda s: _likeness(s["a"], s["b"])), F.lit(0))


def _likeness(a: Column, b: Column) -> Column:
    def lane(x: Column, n: Column, shift: int) -> Column:
        return (2 * F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(LANE)) - n).cast("double")

    pairs = F.zip_with(
        F.slice(a, 2, PACKED),
        F.slice(b, 2, PACKED),
        lambda x, y: F.struct(x.alias("x"), y.alias("y"), F.get(a, 0).alias("n"), F.get(b, 0).alias("m")),
    )
    sums = F.aggregate(
        pairs,
        F.struct(F.lit(0.0).alias("both"), F.lit(0.0).alias("own")),
        lambda acc, p: F.struct(
            sum((lane(p["x"], p["n"], k) * lane(p["y"], p["m"], k) for k in (0, 31)), acc["both"]).alias("both"),
            sum((F.pow(lane(p[v], p[n], k), F.lit(2.0)) for k in (0, 31) for v, n in (("x", "n"), ("y", "m"))), acc["own"]).alias("own"),
        ),
        lambda acc: acc,
    )
    guess = 2 * sums["both"] / F.greatest(sums["own"], F.lit(1.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(guess, F.lit(0.999))))


def as_string(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def fingerprint_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``, the array of longs of ``multiset_hash``; narrow, no shuffle.

    A null text counts as empty, and an empty text is one empty unit. Equal texts, and
    texts with the same units in another order, have equal fingerprints. A column named
    ``fingerprint`` is replaced; all others pass.
    """
    return docs.withColumn("fingerprint", multiset_hash(F.col(text)))


def half_edited(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Compares every document with an edited copy and with the document after it.

    The copy's last ``floor(n_chars / 2)`` code points are replaced by the first as many
    (or all) of the next document by descending id; the last document takes the first.
    Returns id, ``n_chars``, ``edited`` (text), ``fingerprint``, ``edited_fingerprint``
    (arrays), ``near_edited`` and ``near_next``.

    Ids are compared as they are, in the order Spark has for their type (strings by their
    bytes). Null ids come last, and rows of the same id are ordered by a hash of their text,
    so equal rows may stand in either order with the same result. Texts move once, dealt out
    by ranges of ids, each of about ``RANGE_BYTES`` of text, and each range looks at its
    neighbour in order; only the first row of a range is also sent to the range before it.
    The ranges' cuts are found in a sample; they decide only where work is done. A range can
    be crowded only by rows that are equal in id and text. A single document is its own next
    one. An empty table gives an empty one. Null texts count as empty.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(
        F.struct(F.col(id_col).alias("id"), F.xxhash64(body).alias("h")).alias("__key"), body.alias("__text")
    )
    cuts = _range_cuts(keyed)
    rows = keyed.select(
        "*",
        # The highest ids are in range 0.
        (len(cuts) - _cuts_below(F.col("__key"), cuts, docs.schema[id_col].dataType)).alias("__range"),
        F.lit(0).alias("__guest"),
        F.length("__text").cast("long").alias("n_chars"),
    )
    head = stored(rows.groupBy("__range").agg(F.max_by(F.struct("__key", "__text", "n_chars"), "__key").alias("x")), "range-heads")
    # The first row of each range is a guest at the end of the range before it. Only the numbers of ranges
    # are put into one order; the rows follow by a join on them.
    by_range = Window.orderBy("__range")
    before = F.coalesce(F.lag("__range").over(by_range), F.max("__range").over(Window.partitionBy(F.lit(0))))
    hosts = head.select("__range").withColumn("__host", before)
    guests = head.join(hosts, "__range").select("x.*", F.col("__host").alias("__range"), F.lit(1).alias("__guest"))
    hashed = rows.unionByName(guests).withColumn("__print", multiset_hash(F.col("__text")))
    within = Window.partitionBy("__range").orderBy("__guest", F.col("__key").desc())
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("__text"), F.lit(1), (F.col("n_chars") - half).cast("int")),
        F.substring(F.col("__next.__text"), F.lit(1), half),
    )
    return (
        hashed.withColumn("__next", F.lead(F.struct("__text", "__print")).over(within))
        .where(F.col("__guest") == 0)
        .select("__key.id", "n_chars", "__print", F.col("__next.__print").alias("__next_print"), edited.alias("edited"))
        .withColumn("edited_fingerprint", multiset_hash(F.col("edited")))
        .select(
            F.col("id").alias(id_col),
            "n_chars",
            "edited",
            F.col("__print").alias("fingerprint"),
            "edited_fingerprint",
            likeness(F.col("__print"), F.col("edited_fingerprint")).alias("near_edited"),
            likeness(F.col("__print"), F.col("__next_print")).alias("near_next"),
        )
    )


def _range_cuts(keyed: DataFrame) -> list[str]:
    """Keys, in order and as JSON, that cut all rows into ranges of about equal bytes of text."""
    n, size = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()
    ranges = min(MOST_RANGES, -(-size // RANGE_BYTES))
    if ranges < 2:
        return []
    share = min(1.0, SAMPLED * ranges / n)
    place = F.pmod(F.xxhash64(F.lit("range"), "__key.id", "__key.h"), F.lit(1_000_003)) / 1_000_003
    # At most about SAMPLED * MOST_RANGES keys.
    sample = keyed.where(place <= share).orderBy("__key").select(F.to_json("__key").alias("k"), F.octet_length("__text").alias("b")).collect()
    total, seen, cuts = sum(r["b"] for r in sample), 0, []
    for before, r in zip(sample, sample[1:], strict=False):
        seen += before["b"]
        if seen * ranges >= total * (len(cuts) + 1) and (not cuts or cuts[-1] != r["k"]):
            cuts.append(r["k"])
    return cuts


def _cuts_below(key: Column, cuts: list[str], kind: DataType) -> Column:
    """How many of the sorted cuts are at most the key, by two steps of about sqrt(cuts) comparisons."""
    if not cuts:
        return F.lit(0)
    of = T.StructType([T.StructField("id", kind), T.StructField("h", T.LongType())])
    step = max(1, int(len(cuts) ** 0.5))
    # Constants of the plan; JSON keeps them one value each, however many cuts there are.
    firsts = F.from_json(F.lit(f"[{','.join(cuts[step - 1 :: step])}]"), T.ArrayType(of))
    rows = [f"[{','.join(cuts[i : i + step])}]" for i in range(0, len(cuts), step)]
    blocks = F.from_json(F.lit(f"[{','.join(rows)}]"), T.ArrayType(T.ArrayType(of)))
    full = F.size(F.filter(firsts, lambda c: c <= key))
    rest = F.coalesce(F.size(F.filter(F.get(blocks, full), lambda c: c <= key)), F.lit(0))
    return full * step + rest
