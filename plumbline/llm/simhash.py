"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints link when they differ in at most ``radius`` bits. The 64 bits are dealt to m
partitions. If partition i has the threshold t_i >= -1 and sum(t_i + 1) = radius + 1, then
two linked fingerprints are within t_i on partition i for some i (a threshold of -1 skips
a partition). So each fingerprint is indexed once in each partition in use, under its own
value there, and probes the other values within t_i of it. Of two values each is within t_i
of the other, so only the smaller one probes. What meets in a value is verified on all 64
bits: indexed fingerprints with each other, and probes with indexed ones.

* Correlated bits share a partition: then their values repeat together in one partition
  and leave the other partitions more selective.
* Thresholds, and the number of partitions, come from dynamic programming over estimated
  numbers of candidates and probes, from counts of bits and of pairs of bits over all
  fingerprints.
* Where very many fingerprints meet in one value, they can differ in at most ``radius`` of the
  other bits: they are dealt again by ``radius + 1`` parts of these, of which one must be equal.
  What is still crowded is cut into chunks, and every pair of chunks that must meet is a
  group of its own, so no task gathers an unbounded group. Groups return links that span
  them, not all of their pairs.

Copies, and all texts of one fingerprint, are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import LOWER_BYTES, stored, with_columns
from plumbline.llm.graph import connected_components

BITS = 64
#: Fingerprints that share a value are compared in chunks of so many at most.
CHUNK = 2048

PRINT = T.StructType([T.StructField("fingerprint", T.LongType(), False)])


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint as a signed 64-bit number: bit b is set where most shingles' hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    # split() took exactly the separators of the words, so shingles are joins of neighbours.
    hashes = np.fromiter(
        (digest(b" ".join(words[i : i + shingle]), seed) for i in range(n)), dtype=np.uint64, count=n
    )
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, 1 << 16):
        part = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with ``fingerprint`` (a column of that name is replaced). Null texts have no words: zero."""
    return with_columns(
        docs, PRINT, lambda batch: [[simhash(t, shingle, seed) for t in batch.column(text).to_pylist()]]
    )


@dataclass(frozen=True)
class Scheme:
    """Partitions of the bits, and the threshold of each."""

    partitions: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def bit_counts(prints: DataFrame) -> np.ndarray:
    """For all pairs of bits, how many fingerprints have both; 64 x 64, added up in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            total += (x.T @ x).astype(np.int64)
        k = np.arange(BITS * BITS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total.ravel())], names=["k", "n"])

    rows = prints.select("fingerprint").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))
    total = np.zeros(BITS * BITS, np.int64)
    for r in rows.collect():  # 4,096 rows, whatever the input
        total[r["k"]] = r["n"]
    return total.reshape(BITS, BITS)


def correlated_partitions(both: np.ndarray, n: int, m: int) -> tuple[tuple[int, ...], ...]:
    """Deals the bits to m partitions of even size, each grown by its most correlated free bit."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        rest = sorted(free)
        sub = corr[np.ix_(rest, rest)]
        part = [rest[int(sub.sum(axis=1).argmax())]]
        free.discard(part[0])
        while len(part) < size:
            rest = sorted(free)
            best = rest[int(corr[np.ix_(part, rest)].mean(axis=0).argmax())]
            part.append(best)
            free.discard(best)
        out.append(tuple(sorted(part)))
    return tuple(out)


def estimated_candidates(both: np.ndarray, n: int, partition: tuple[int, ...], radius: int) -> np.ndarray:
    """Expected candidates of one fingerprint in a partition, for thresholds -1 to ``radius``.

    The distance of two fingerprints there is taken as a sum of independent differing bits
    of the measured frequencies; correlation inside lowers the number of effective bits.
    """
    p = np.diag(both)[list(partition)] / max(n, 1)
    cov = both[np.ix_(partition, partition)] / max(n, 1) - np.outer(p, p)
    values = np.maximum(np.linalg.eigvalsh(cov), 0)
    effective = values.sum() ** 2 / max((values**2).sum(), 1e-12)
    differ = np.full(max(1, round(effective)), float((2 * p * (1 - p)).mean()))
    chance = np.zeros(radius + 1)
    chance[0] = 1.0
    for d in differ:
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    return np.concatenate([[0.0], np.cumsum(chance)]) * n


def probes(width: int, t: int) -> float:
    """How many entries a fingerprint has in a partition of ``width`` bits: its own, and half of the values near it."""
    total, ways = 0, 1
    for k in range(t + 1):
        total += ways
        ways = ways * (width - k) // (k + 1)
    return (1 + total) / 2


#: What a probe costs (it is shuffled), in units of a candidate (which is compared).
PROBE_COST = 24.0


def choose_scheme(both: np.ndarray, n: int, radius: int = 3) -> Scheme:
    """The partitions and thresholds of least estimated cost, by dynamic programming for each m."""
    best: tuple[float, Scheme | None] = (np.inf, None)
    for m in range(1, radius + 3):
        parts = correlated_partitions(both, n, m)
        cost = []
        for part in parts:
            hits = estimated_candidates(both, n, part, radius)
            cost.append([0.0] + [hits[t + 1] / 2 + PROBE_COST * probes(len(part), t) for t in range(radius + 1)])
        # spent[k]: least cost with sum(t_i + 1) = k so far, and the thresholds that give it.
        spent: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for row in cost:
            new: dict[int, tuple[float, tuple[int, ...]]] = {}
            for k, (c, ts) in spent.items():
                for t in range(-1, radius + 1):
                    if k + t + 1 <= radius + 1:
                        x = (c + row[t + 1], (*ts, t))
                        new[k + t + 1] = min(new.get(k + t + 1, (np.inf, ())), x)
            spent = new
        c, ts = spent[radius + 1]
        if c < best[0]:
            best = (c, Scheme(parts, ts))
    return best[1]


def _masks(partition: tuple[int, ...], t: int) -> list[int]:
    """The bit flips of at most t bits inside a partition."""
    return [sum(1 << b for b in bits) for k in range(t + 1) for bits in combinations(partition, k)]


#: What an entry is in its group: compared with all, with indexed ones, or with probes only.
INDEXED, PROBE, MET = 0, 1, 2


def _spanning(values: np.ndarray, roles: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what is within the radius, directly or over others of these; probes stand last."""
    n = len(values)
    probe = int(np.searchsorted(roles == PROBE, True)) if PROBE in roles else n
    label = np.arange(n)
    links = []
    for i in range(probe):
        first = i + 1 if roles[i] == INDEXED else probe
        near = first + np.flatnonzero(np.bitwise_count(values[first:] ^ values[i]) <= radius)
        near = near[label[near] != label[i]]
        while len(near):
            j = int(near[0])
            links.append((int(values[i]), int(values[j])))
            label[label == label[j]] = label[i]
            near = near[label[near] != label[i]]
    return links


def _signed(bits: int) -> Column:
    return F.lit(bits - (1 << 64) * (bits >> 63)).cast("long")


def entries_of(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """``(fingerprint, part, value, role)``: each fingerprint once indexed and its probes, in each partition in use."""
    keys = []
    for i, (part, t) in enumerate(zip(scheme.partitions, scheme.thresholds, strict=True)):
        if t < 0:
            continue
        own = F.col("fingerprint").bitwiseAND(_signed(sum(1 << b for b in part)))
        for mask in _masks(part, t):
            value = own.bitwiseXOR(_signed(mask)) if mask else own
            entry = F.struct(F.lit(i).alias("part"), value.alias("value"), F.lit(PROBE if mask else INDEXED).alias("role"))
            keys.append(F.when(value > own, entry) if mask else entry)
    each = nodes.select("fingerprint", F.explode(F.array(*keys)).alias("k")).where(F.col("k").isNotNull())
    return each.select("fingerprint", "k.*")


def _grouped(nodes: DataFrame, scheme: Scheme, radius: int, chunk: int) -> DataFrame:
    """``(fingerprint, role, group)``: what must be compared meets in a group of a few chunks at most."""
    entries = entries_of(nodes, scheme)

    def crowded(df: DataFrame, key: list[str]) -> DataFrame:
        # Few by their size. Written before they are joined, so that the join's sides are plain shuffles.
        n = df.groupBy(*key).agg(
            F.count_if(F.col("role") == INDEXED).alias("indexed"), F.count_if(F.col("role") == PROBE).alias("probes")
        )
        return stored(n.where((F.col("indexed") > 0) & (F.col("indexed") + F.col("probes") > chunk)), "crowded")

    hot = crowded(entries, ["part", "value"]).select("part", "value")
    light = entries.join(hot, ["part", "value"], "left_anti")
    out = light.select("fingerprint", "role", F.xxhash64("part", "value").alias("group"))
    if not hot.take(1):
        return out
    # Fingerprints that met in a value differ in at most ``radius`` of the bits outside of its partition.
    again = []
    for i, part in enumerate(scheme.partitions):
        rest = [b for b in range(BITS) if b not in part]
        cuts = [rest[k :: radius + 1] for k in range(radius + 1)]
        under = [F.col("fingerprint").bitwiseAND(_signed(sum(1 << b for b in c))) for c in cuts]
        subs = F.array(*[F.xxhash64(F.lit(k), "part", "value", u) for k, u in enumerate(under)])
        again.append(F.when(F.col("part") == i, subs))
    dealt = entries.join(hot, ["part", "value"], "left_semi").select(
        "fingerprint", "role", F.explode(F.coalesce(*again)).alias("sub")
    )
    full = crowded(dealt, ["sub"])
    out = out.unionByName(dealt.join(full, "sub", "left_anti").select("fingerprint", "role", F.col("sub").alias("group")))
    # Chunks of indexed fingerprints meet each other and all chunks of probes.
    of = lambda n: F.greatest(F.ceil(F.col(n) / chunk), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("fingerprint"), F.when(F.col("role") == INDEXED, of("indexed")).otherwise(of("probes"))).cast("int")

    def meeting(kind: str, count: Column, role: int, x: object, y: object) -> Column:
        """A struct for each group of a kind that the entry takes part in."""
        return F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda c: F.struct(F.lit(kind).alias("kind"), x(c).alias("x"), y(c).alias("y"), F.lit(role).alias("as")),
        )

    own = F.col("mine")
    indexed = F.concat(
        meeting("indexed", of("indexed"), INDEXED, lambda c: F.least(c, own), lambda c: F.greatest(c, own)),
        meeting("probes", of("probes"), MET, lambda c: c, lambda c: own),
    )
    probing = meeting("probes", of("indexed"), PROBE, lambda c: own, lambda c: c)
    pairs = (
        dealt.join(full, "sub")
        .withColumn("mine", mine)
        .select("fingerprint", "sub", F.explode(F.when(F.col("role") == INDEXED, indexed).otherwise(probing)).alias("p"))
        .select("fingerprint", F.col("p.as").alias("role"), F.xxhash64("sub", "p.kind", "p.x", "p.y").alias("group"))
    )
    return out.unionByName(pairs)


def near_links(nodes: DataFrame, scheme: Scheme, radius: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Links ``(a, b)`` between the fingerprints of ``nodes``, which must be distinct.

    Two within the radius are linked, or joined by links over others. A group of more than
    eight returns fewer links than it has members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(g: np.ndarray, r: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            found: list[tuple[int, int]] = []
            edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
            length = np.diff(edge)
            for size in np.unique(length):
                starts = edge[:-1][length == size]
                if 1 < size <= 8:  # many small groups: all of one size at once
                    for i, j in combinations(range(int(size)), 2):
                        a, b = starts + i, starts + j
                        ok = ((r[a] == INDEXED) | (r[a] != r[b])) & (np.bitwise_count(v[a] ^ v[b]) <= radius)
                        found += zip(v[a[ok]].tolist(), v[b[ok]].tolist(), strict=True)
                elif size > 8:
                    for s in starts:
                        order = s + np.argsort(r[s : s + size] == PROBE, kind="stable")
                        found += _spanning(v[order], r[order], radius)
            # Keys of 64 bits may coincide: then groups are merged, which only adds comparisons.
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        kept: list[np.ndarray] | None = None
        for batch in batches:
            now = [
                batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                for c in ("group", "role", "fingerprint")
            ]
            if not len(now[0]):
                continue
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now, strict=True)]
            first = int(np.searchsorted(now[0], now[0][-1]))  # the last group may go on
            if first:
                yield flushed(*(x[:first] for x in now))
            kept = [x[first:] for x in now]
        if kept is not None:
            yield flushed(*kept)

    groups = _grouped(nodes, scheme, radius, chunk)
    return groups.repartition("group").sortWithinPartitions("group").mapInArrow(run, "a long, b long")


def near_components(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3, radius: int = 3
) -> DataFrame:
    """Id, ``fingerprint`` (long) and ``component_id``, the smallest id reachable over links, for each row.

    Texts are lower-cased in A-Z, words are cut at white space, and a text shorter than a
    shingle is one shingle. A text without words, or null, has fingerprint zero and links
    like any other. A row with a null id takes part and gets the smallest id of its
    component, or null if there is none; ids must be integers. Repeated rows stay, each with
    its result. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text).alias("__text"))
    prints = stored(with_fingerprints(rows, "__text", shingle).drop("__text"))
    # One node for each fingerprint.
    nodes = stored(prints.groupBy("fingerprint").agg(F.min("__id").alias("least")))
    n = nodes.count()
    scheme = choose_scheme(bit_counts(nodes), n, radius)
    found = connected_components(near_links(nodes, scheme, radius))
    members = found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())
    # Aggregates are kept before they are joined, so that both sides of a join are plain shuffles, which the
    # adaptive planner splits where a component or a fingerprint stands on very many rows.
    least = stored(
        members.join(nodes, F.col("id") == F.col("fingerprint")).groupBy("component").agg(F.min("least").alias("of_all")),
        "least",
    )
    named = members.join(least, "component").select(F.col("id").alias("fingerprint"), "of_all")
    known = nodes.join(named, "fingerprint", "left").select(
        "fingerprint", F.coalesce("of_all", "least").alias("component_id")
    )
    known = stored(known, "components")
    return prints.join(known, "fingerprint").select(F.col("__id").alias(id_col), "fingerprint", "component_id")


def as_string(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")
