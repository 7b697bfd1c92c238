"""Removal of long substrings that earlier documents have as well, by partitioned suffix sorting.

A *window* is a string of ``length`` bytes inside a document; it goes where an earlier document
has it too. Equal windows have equal least hashes of their grams, so neighbouring
windows of one least hash, a *segment*, only need to meet segments of the same hash:

1. Each block of documents finds its segments and sends, of each different one, the hash, a hash of
   all its bytes and its least document to the hash's range. Nothing else leaves the block.
2. A range tells blocks which segments an earlier document has in whole, and which share
   their hash with another segment. Most segments of a corpus are neither.
3. Of those that share, blocks send the bytes. Their windows are suffixes up to ``length``, and each
   part of them is put into order by deep-shallow sorting (``suffixes``): equal windows are
   neighbours then, and those of later documents go. Where very many different segments share
   one hash (a short passage of many documents), their windows are dealt by their own bytes.
4. Blocks take the covered bytes out of their texts.

Copies of whole segments inside a block, and between blocks, are one each before any bytes move. The
documents lie in a table bucketed by block, so texts aren't shuffled.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from plumbline.llm.common import shared_path, stored, texts_of
from plumbline.llm.suffixes import sorted_suffixes

U = np.uint64
#: Bytes of the grams whose least hash names a segment: shorter ones give fewer segments, longer ones fewer that share.
GRAM = 20
#: Windows of a segment, at most: their marks fit into one number.
RUN = 64
#: Rows of a block, as a power of two.
ROWS = 11
#: Bytes that are hashed at once.
SLICE = 1 << 20
#: Windows that are put into order at once.
WINDOWS = 1 << 20
#: A range has the segments of about so many bytes of text.
RANGE_BYTES = 8 << 20
#: So many different segments of one hash have their windows dealt by their bytes.
HOT = 4096

_rng = np.random.default_rng(42)
TABLE = _rng.integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` neighbours, by doubling."""
    m, s, n = h, 1, len(h) - w + 1
    while 2 * s <= w:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    return np.minimum(m[:n], m[w - s : w - s + n])


@dataclass
class Segments:
    """Segments of a block, in order of (least hash, hash of all bytes); ``entry`` numbers the different ones."""

    hash: np.ndarray
    whole: np.ndarray
    start: np.ndarray
    n: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    least: np.ndarray

    @property
    def entry(self) -> np.ndarray:
        out = np.zeros(len(self.hash), np.int64)
        out[self.first[1:]] = 1
        return np.cumsum(out)


def segments(data: np.ndarray, edges: np.ndarray, ids: np.ndarray, length: int) -> Segments:
    """All windows of a block's documents, as segments."""
    gram, w = min(GRAM, length), length - min(GRAM, length) + 1
    inverse = pow(BASE, -1, 1 << 64)
    up, down = _powers(BASE, SLICE + length + 1), _powers(inverse, SLICE + length + 1)
    found: list[tuple[np.ndarray, ...]] = []
    last = np.maximum(edges[1:] - length, edges[:-1] - 1)  # the last window of each document
    for a in range(0, len(data), SLICE):
        x = data[a : a + SLICE + length - 1]
        n = len(x) - length + 1
        if n < 1:
            break
        sums = np.zeros(len(x) + 1, U)
        np.cumsum(TABLE[x] * up[: len(x)], out=sums[1:])
        m = _least(_mixed((sums[gram:] - sums[:-gram]) * down[: len(x) - gram + 1]), w)
        # Windows that stay inside their document.
        d0, d1 = np.searchsorted(edges, a, side="right") - 1, np.searchsorted(edges, a + n, side="left")
        turns = np.zeros(n + 1, np.int32)
        np.add.at(turns, np.clip(edges[d0:d1] - a, 0, n), 1)
        np.add.at(turns, np.clip(last[d0:d1] + 1 - a, 0, n), -1)
        ok = np.cumsum(turns[:-1]) > 0
        begins = np.flatnonzero(ok & np.concatenate([[True], (m[1:] != m[:-1]) | ~ok[:-1]]))
        if not len(begins):
            continue
        # A run ends where the next begins, or where windows leave the document; long ones are cut.
        stops = np.append(np.flatnonzero(~ok), n)
        ends = np.minimum(np.append(begins[1:], n), stops[np.searchsorted(stops, begins)])
        pieces = -(-(ends - begins) // RUN)
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(begins, pieces) + k * RUN
        size = np.minimum(np.repeat(ends, pieces) - start, RUN)
        whole = _mixed((sums[start + size + length - 1] - sums[start]) * down[start] + size.astype(U))
        # Least hashes are small numbers: mixed again, they fill all ranges alike.
        found.append((_mixed(m[start]), whole, start + a, size))
    if not found:
        zero = np.zeros(0, np.int64)
        return Segments(zero.astype(U), zero.astype(U), zero, zero, zero, zero, zero)
    m, whole, start, size = (np.concatenate(c) for c in zip(*found, strict=True))
    doc = ids[np.searchsorted(edges, start, side="right") - 1]
    order = np.lexsort((whole, m))
    m, whole, start, size, doc = (c[order] for c in (m, whole, start, size, doc))
    first = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (whole[1:] != whole[:-1])]))
    return Segments(m, whole, start, size, doc, first, np.minimum.reduceat(doc, first))


def _ranges(m: np.ndarray, ranges: int) -> np.ndarray:
    return ((m >> U(32)) * U(ranges) >> U(32)).astype(np.int64)


def _cut(m: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """``(range, from, to)`` of sorted hashes."""
    at = _ranges(m, ranges)
    begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    return list(zip(at[begins].tolist(), begins.tolist(), np.append(begins[1:], len(at)).tolist(), strict=True))


def _bytes5(m: np.ndarray) -> bytes:
    return np.ascontiguousarray(m.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _numbers5(raw: bytes) -> np.ndarray:
    x = np.zeros((len(raw) // 5, 8), np.uint8)
    x[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return x.view("<u8").ravel().astype(U)


def _block(table: pa.Table, text: str, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Segments]:
    data, edges = texts_of(table.column(text))
    ids = table.column("__id").to_numpy()
    return data, edges, ids, segments(data, edges, ids, length)


SENT = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("whole", pa.binary()), ("docs", pa.binary()), ("base", pa.int64()), ("width", pa.int32())])


def _sent(ranges: int, length: int):
    def run(table: pa.Table) -> pa.Table:
        _, _, _, s = _block(table, "__text", length)
        m, whole, doc = s.hash[s.first], s.whole[s.first], s.least
        rows = []
        for r, a, b in _cut(m, ranges):
            base = int(doc[a:b].min())
            off = (doc[a:b].astype(U) - U(base & (1 << 64) - 1)).astype(U)
            kind = np.min_scalar_type(int(off.max()))
            rows.append({"range": r, "block": table.column("__block")[0].as_py(), "hashes": _bytes5(m[a:b]), "whole": whole[a:b].tobytes(), "docs": off.astype(kind).tobytes(), "base": base, "width": kind.itemsize})
        return pa.Table.from_pylist(rows, SENT)

    return run


TOLD = pa.schema([("block", pa.int64()), ("range", pa.int64()), ("state", pa.binary()), ("entries", pa.binary()), ("marks", pa.binary())])
#: What a range says of a segment: nothing, an earlier document has all of it, or its windows must be compared.
WHOLE, SHARED, CROWDED = 1, 2, 3


def _told(hot: int):
    def run(table: pa.Table) -> pa.Table:
        m = np.concatenate([_numbers5(x.as_py()) for x in table.column("hashes")])
        whole = np.concatenate([np.frombuffer(x.as_py(), U) for x in table.column("whole")])
        each = []
        for docs, base, width in zip(*(table.column(c).to_pylist() for c in ("docs", "base", "width")), strict=True):
            each.append((np.frombuffer(docs, f"<u{width}").astype(U) + U(base & (1 << 64) - 1)).astype(np.int64))
        doc = np.concatenate(each)
        order = np.lexsort((doc, whole, m))
        m, whole, doc = m[order], whole[order], doc[order]
        new_m = np.concatenate([[True], m[1:] != m[:-1]])
        new = new_m | np.concatenate([[True], whole[1:] != whole[:-1]])
        first = np.flatnonzero(new)
        least = np.repeat(doc[first], np.diff(np.append(first, len(doc))))
        groups = np.flatnonzero(new_m)
        sizes = np.diff(np.append(groups, len(m)))
        different = np.repeat(np.add.reduceat(new.astype(np.int64), groups), sizes)
        apart = np.repeat(np.maximum.reduceat(least, groups) > np.minimum.reduceat(least, groups), sizes)
        state = np.where(doc > least, WHOLE, np.where((different > 1) & apart, np.where(different > hot, CROWDED, SHARED), 0)).astype(np.uint8)
        out = np.zeros(len(m), np.uint8)
        out[order] = state
        ends = np.cumsum([len(x) for x in each])
        rows = [
            {"block": b, "range": r, "state": out[e - len(x) : e].tobytes()}
            for b, r, e, x in zip(table.column("block").to_pylist(), table.column("range").to_pylist(), ends, each, strict=True)
            if out[e - len(x) : e].any()
        ]
        return pa.Table.from_pylist(rows, TOLD)

    return run


def _states(s: Segments, told: pa.Table, ranges: int) -> np.ndarray:
    """What the ranges said of each different segment of a block."""
    state = np.zeros(len(s.first), np.uint8)
    at = {r: (a, b) for r, a, b in _cut(s.hash[s.first], ranges)}
    for r, x in zip(told.column("range").to_pylist(), told.column("state").to_pylist(), strict=True):
        if x is not None:
            a, b = at[r]
            state[a:b] = np.frombuffer(x, np.uint8)
    return state


SHOWN = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("entries", pa.binary()), ("offsets", pa.binary()), ("sizes", pa.binary()), ("docs", pa.binary()), ("bytes", pa.binary())])


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of several stretches, one after the other."""
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return data[np.repeat(start, size) + at]


def _shown(ranges: int, length: int):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows or not told.num_rows:
            return SHOWN.empty_table()
        data, _, _, s = _block(table, "__text", length)
        state = _states(s, told, ranges)
        first = s.first
        kept = np.flatnonzero(state == SHARED)
        entry, offset, start, n = kept, np.zeros(len(kept), np.int64), s.start[first[kept]], s.n[first[kept]]
        part = _ranges(s.hash[first[kept]], ranges)
        crowded = np.flatnonzero(state == CROWDED)
        if len(crowded):
            sizes = s.n[first[crowded]]
            step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.repeat(s.start[first[crowded]], sizes) + step
            windows = np.lib.stride_tricks.sliding_window_view(data, length)[at]
            own = _mixed((TABLE[windows] * _powers(BASE, length)).sum(axis=1, dtype=U))
            entry, offset = np.append(entry, np.repeat(crowded, sizes)), np.append(offset, step)
            start, n, part = np.append(start, at), np.append(n, np.ones(len(at), np.int64)), np.append(part, _ranges(own, ranges))
        order = np.argsort(part, kind="stable")
        part = part[order]
        begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
        rows = []
        for a, b in zip(begins, np.append(begins[1:], len(part)), strict=True) if len(part) else []:
            k = order[a:b]
            rows.append({
                "part": int(part[a]), "block": table.column("__block")[0].as_py(), "entries": entry[k].astype(np.int32).tobytes(), "offsets": offset[k].astype(np.uint8).tobytes(),
                "sizes": n[k].astype(np.uint8).tobytes(), "docs": s.least[entry[k]].tobytes(), "bytes": _gathered(data, start[k], n[k] + length - 1).tobytes(),
            })
        return pa.Table.from_pylist(rows, SHOWN)

    return run


def _compared(length: int):
    def run(table: pa.Table) -> pa.Table:
        read = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in table.column(c)]
        entries, blocks = read("entries", np.int32), np.array(table.column("block").to_pylist())
        block = np.repeat(blocks, [len(x) for x in entries])
        entry, offset, n, doc = (np.concatenate(x) for x in (entries, read("offsets", np.uint8), read("sizes", np.uint8), read("docs", np.int64)))
        data = np.concatenate([*read("bytes", np.uint8), np.zeros(8, np.uint8)])
        n = n.astype(np.int64)
        size = n + length - 1
        begins = np.cumsum(size) - size
        found = [np.zeros((0, 2), np.int64)]
        # Windows that begin alike are compared together, and others not: a share of them at a time.
        first = TABLE[data[: len(data) - 8]] * U(3) + TABLE[data[3 : len(data) - 5]] * U(5) + TABLE[data[7 : len(data) - 1]]
        shares = -(-int(n.sum()) // WINDOWS)
        share = (_mixed(first) >> U(40)) % U(max(shares, 1)) if shares > 1 else None
        del first
        of = np.repeat(np.arange(len(n), dtype=np.int32), n)
        at = begins[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for k in range(shares):
            some = np.flatnonzero(share[at] == k) if share is not None else np.arange(len(at))
            order, new = sorted_suffixes(data, at[some], length)
            docs, lead = doc[of[some]][order], np.flatnonzero(new)
            later = docs > np.repeat(np.minimum.reduceat(docs, lead), np.diff(np.append(lead, len(docs)))) if len(docs) else np.zeros(0, bool)
            hit = some[order[later]]
            found.append(np.column_stack([of[hit], at[hit] - begins[of[hit]]]))
        hits = np.concatenate(found)
        of, marks = hits[:, 0], U(1) << (hits[:, 1] + offset[hits[:, 0]]).astype(U)
        by = np.lexsort((entry[of], block[of]))
        of, marks = of[by], marks[by]
        rows = []
        if len(of):
            b, e = block[of], entry[of]
            one = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (e[1:] != e[:-1])]))
            b, e, marks = b[one], e[one], np.bitwise_or.reduceat(marks, one)
            cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            rows = [{"block": int(b[x]), "entries": e[x:y].tobytes(), "marks": marks[x:y].tobytes()} for x, y in zip(cut, np.append(cut[1:], len(b)), strict=True)]
        return pa.Table.from_pylist(rows, TOLD)

    return run


NEW = ("kept_bytes", "n_bytes", "n_removed", "n_spans")


def covered_bytes(data: np.ndarray, s: Segments, state: np.ndarray, marks: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of a block go. ``state`` and ``marks`` are of its different segments."""
    entry = s.entry
    whole = (s.doc > s.least[entry]) | (state[entry] == WHOLE)
    turns = np.zeros(len(data) + 1, np.int32)
    np.add.at(turns, s.start[whole], 1)
    np.add.at(turns, s.start[whole] + s.n[whole] + length - 1, -1)
    some = np.flatnonzero(~whole & (marks[entry] > 0))
    bits = np.unpackbits(marks[entry[some]].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, step = np.nonzero(bits)
    at = s.start[some[k]] + step
    np.add.at(turns, at, 1)
    np.add.at(turns, at + length, -1)
    return np.cumsum(turns[:-1]) > 0


def _emptied(text: str, ranges: int, length: int, names: list[str], schema: T.StructType):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        out = to_arrow_schema(schema)
        if not table.num_rows:
            return out.empty_table()
        data, edges, _, s = _block(table, text, length)
        gone = np.zeros(len(data), bool)
        if len(s.first):
            marks = np.zeros(len(s.first), U)
            for e, x in zip(told.column("entries").to_pylist(), told.column("marks").to_pylist(), strict=True):
                if e is not None:
                    np.bitwise_or.at(marks, np.frombuffer(e, np.int32), np.frombuffer(x, U))
            gone = covered_bytes(data, s, _states(s, told, ranges), marks, length)
        before = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        at = edges[:-1][edges[:-1] < len(data)]
        begins[at] |= gone[at]
        spans = np.concatenate([[0], np.cumsum(begins)])
        removed = np.diff(before[edges])
        kept, ends = data[~gone].tobytes(), edges - before[edges]
        new = {
            "kept_bytes": pa.array([kept[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary()),
            "n_bytes": pa.array(np.diff(edges)), "n_removed": pa.array(removed), "n_spans": pa.array(np.diff(spans[edges])),
        }
        columns = [*(table.column(f"c{k}") for k in range(len(names))), *(new[c] for c in NEW)]
        return pa.Table.from_arrays(columns, schema=pa.schema([(f.name, c.type) for f, c in zip(out, columns, strict=True)]))

    return run


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = 50, hot: int = HOT) -> DataFrame:
    """``docs`` without the bytes covered by ``length``-byte strings that start in a document of smaller id as well.

    Texts are taken as UTF-8; strings lie inside one document and are judged on the texts as they
    come. Returns all of ``docs`` with ``kept_bytes`` (what is left, which may end inside of a character),
    ``n_bytes``, ``n_removed`` and ``n_spans`` (maximal removed runs); columns of these names are replaced.

    ``id_col`` is of an integral type. A null id comes after all others; rows of one id, null included,
    don't take anything from each other. A null text is empty. Empty and short texts have no
    strings. Of equal rows with different ids the first stays whole. Very long texts are hashed
    piece by piece and may make a block of their own. An empty table gives an empty one.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of an integral type")
    if length < 8:
        raise ValueError("length must be at least 8")
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in NEW]
    kept = [docs.schema[c] for c in names]
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    own = [F.col(c).alias(f"c{k}") for k, c in enumerate(names)]
    rows = docs.select(*own, F.shiftright(F.monotonically_increasing_id(), ROWS).alias("__block"), id_.alias("__id"), F.octet_length(F.col(text)).alias("__size"))
    table, of = f"suffix_docs_{uuid.uuid4().hex[:12]}", f"c{names.index(text)}" if text in names else None
    if of is None:
        raise ValueError(f"{text} is not a column that stays")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, "__block").format("parquet").option("compression", "zstd").option("path", shared_path(spark, table)).saveAsTable(table)
    try:
        known = spark.table(table)
        total = known.agg(F.sum(F.col("__size").cast("long"))).first()[0] or 0
        ranges = max(-(-total // RANGE_BYTES), buckets)
        texts = known.select("__block", "__id", F.col(of).alias("__text"))
        sent = texts.groupBy("__block").applyInArrow(_sent(ranges, length), from_arrow_schema(SENT))
        told = stored(sent.groupBy("range").applyInArrow(_told(hot), from_arrow_schema(TOLD)), "segments-told")
        shown = texts.groupBy("__block").cogroup(told.groupBy("block")).applyInArrow(_shown(ranges, length), from_arrow_schema(SHOWN))
        marks = stored(shown.groupBy("part").applyInArrow(_compared(length), from_arrow_schema(TOLD)), "windows-marked")
        schema = T.StructType([*kept, T.StructField("kept_bytes", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in NEW[1:]]])
        answers = told.unionByName(marks).groupBy("block")
        return known.drop("__size").groupBy("__block").cogroup(answers).applyInArrow(_emptied(of, ranges, length, names, schema), schema)
    finally:  # its files stay until they are released
        spark.sql(f"DROP TABLE {table}")
