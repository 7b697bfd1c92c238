"""Packing: token sequences of a fixed window from documents of any length.

1. Documents are tokenised once, in tasks; whole windows of a document stand alone, and
   what is left of it (its *tail*, shorter than a window) is kept with its token ids.
2. The histogram of tail lengths has fewer bins than the window, whatever the input.
   Shallow combinations of two or three lengths that fill a window exactly are enumerated,
   non-negative least squares gives how often each should be used, and the counts are
   rounded down to what the histogram holds.
3. A tail's rank among those of its length, found from counts for each task, decides which
   slot of which combination it fills. Tails beyond all slots are packed greedily: laid
   end to end by length and rank, and cut at window borders. As all tails of a length are
   equally long, their places follow from the histogram and the rank alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import stored


def byte_of_char() -> dict[str, int]:
    """Byte-level BPE files write bytes as printable characters; this is the way back."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _merges(model: dict) -> list[tuple[str, str]]:
    return [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]


def same_by_rank(path: str) -> bool:
    """Whether merging by the ids of what comes out gives what the file's merges give, for every text.

    That is so for a byte-level file without options that change the splitting into words, if

    * every token of more than one byte is made by one merge, and ids rise in the order of merges;
    * every token, as a word of its own, is encoded as itself.

    For take the first time that merging by ids joins a pair x, y which is not the merge of its
    token xy. All before were merges of the file, and those inside xy happened as they do in
    the word xy by itself. That word ends as one token, so its last merge is the one of xy,
    and x, y are its pair.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(
        model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    )
    level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    added = spec.get("added_tokens", [])
    whole = not any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not (plain and level and whole) or spec.get("normalizer"):
        return False
    vocab, special = model["vocab"], {x["content"] for x in added}
    made = ["".join(m) for m in _merges(model)]
    ids = [vocab.get(x, -1) for x in made]
    if set(byte_of_char()) - set(vocab) or len(set(made)) < len(made) or any(b <= a for a, b in zip([255, *ids], ids, strict=False)):
        return False
    tokens = [x for x in vocab if x not in special]
    if {x for x in tokens if len(x) > 1} != set(made):
        return False
    words = Tokenizer.from_str(json.dumps({**spec, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}))
    return all(e.ids == [vocab[t]] for t, e in zip(tokens, words.encode_batch(tokens, add_special_tokens=False), strict=True))


class Tokens:
    """Ids as ``tokenizers`` gives them, by a faster encoder where ``by_rank``: see ``same_by_rank``.

    A text that the faster encoder refuses, and all texts otherwise, go to ``tokenizers`` itself.
    """

    def __init__(self, path: str, by_rank: bool):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(path), None
        if by_rank:
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            back = byte_of_char()
            special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
            ranks = {bytes(back[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
            # Fixed value: how the byte-level pre-tokenizer splits texts.
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("from_file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
            self.allowed = set(special)

    def ids(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode(text, allowed_special=self.allowed, disallowed_special=())
            except Exception:  # noqa: BLE001 - its matcher gives up on some very long runs
                pass
        return self.slow.encode(text, add_special_tokens=False).ids


_loaded: dict[str, Tokens] = {}


def _tokens(path: str, by_rank: bool) -> Tokens:
    if path not in _loaded:
        _loaded[path] = Tokens(path, by_rank)
    return _loaded[path]


def shallow_combinations(window: int) -> np.ndarray:
    """All pairs and triples of lengths from 1 that sum to the window, as rows padded with 0."""
    pairs = [(a, window - a, 0) for a in range(1, window // 2 + 1)]
    triples = [
        (a, b, window - a - b) for a in range(1, window // 3 + 1) for b in range(a, (window - a) // 2 + 1)
    ]
    return np.array([*pairs, *triples], dtype=np.int64).reshape(-1, 3)


def solve_counts(histogram: np.ndarray, combos: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x that minimises |A x - histogram|^2, A's columns being the combinations.

    Accelerated projected gradients on the sparse columns (at most three entries each), so
    neither time nor memory depends on how many documents there are.
    """
    n, used = len(histogram), combos > 0

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(combos[used], weights=np.repeat(x, used.sum(axis=1)), minlength=n)[:n]

    def back(r: np.ndarray) -> np.ndarray:
        return (r[combos] * used).sum(axis=1)

    probe = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue of A^T A gives the step
        probe = back(forward(probe))
        top = np.linalg.norm(probe)
        probe /= top
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - back(forward(y) - histogram) / (1.01 * top))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_slots(histogram: dict[int, int], window: int) -> tuple[list[tuple], dict[int, tuple[int, int]], int, int]:
    """Which ranks of which length fill which place.

    Returns slots ``(length, first_rank, end_rank, first_sequence, offset)``; for each length
    the ranks that slots take and where the rest begin in the greedy tape; the number of
    sequences that combinations make; the tape's length.
    """
    bins = np.zeros(window, dtype=np.float64)
    for length, count in histogram.items():
        bins[length] = count
    combos = shallow_combinations(window)
    combos = combos[(bins[combos] * (combos > 0) >= (combos > 0)).all(axis=1)]
    left = {k: int(v) for k, v in histogram.items()}
    taken = dict.fromkeys(left, 0)
    slots, sequences = [], 0
    if len(combos):
        x = solve_counts(bins, combos)
        # Rounded down; the fractions are summed in the order of combinations, of which neighbours are
        # alike, and each whole that the sum passes counts there. So the totals stay at any size.
        sums = np.floor(np.cumsum(x - np.floor(x)) + 0.5)
        rounded = (np.floor(x) + np.diff(sums, prepend=0.0)).astype(np.int64)
        for k in np.argsort(-rounded, kind="stable"):
            if not rounded[k]:
                break
            lengths = [int(v) for v in combos[k] if v]
            times = min([int(rounded[k]), *(left[v] // lengths.count(v) for v in lengths)])
            if times <= 0:
                continue
            for v, offset in zip(lengths, [0, *accumulate(lengths)], strict=False):
                slots.append((v, taken[v], taken[v] + times, sequences, offset))
                taken[v] += times
                left[v] -= times
            sequences += times
    rest, tape = {}, 0
    for v in sorted(left, reverse=True):
        rest[v] = (taken[v], tape)
        tape += left[v] * v
    return slots, rest, sequences, tape


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    text: str = "text",
    id_col: str = "doc_id",
    window: int = 1024,
    end_id: int = 0,
) -> DataFrame:
    """Cuts documents into pieces and packs these into sequences of at most ``window`` tokens.

    A document is its text's ids and then ``end_id``. Returns for each piece: id, ``start``
    (ids of its document before it), ``length``, ``ids`` (little-endian unsigned 32-bit),
    ``doc_tokens``, ``sequence_id``, ``offset`` (gapless from 0 in each sequence). Every
    sequence is full, but for the last ones, whose lengths are powers of two. Columns of
    ``docs`` other than id and text aren't returned.

    A null or empty text is one piece of one id. Each row is a document, also where an id is
    null or repeated. An empty table gives an empty one. Token ids are written once; only
    tails move, by length and task, and a length that is very common is one count for each
    task and length, so no task gets all rows of a length.
    """
    spark, by_rank = docs.sparkSession, same_by_rank(tokenizer_path)
    head = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("task", T.LongType()),
            T.StructField("wholes_before", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("tail", T.IntegerType()),
            T.StructField("tail_rank", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, wholes = TaskContext.get().partitionId(), 0
        tokens = _tokens(tokenizer_path, by_rank)
        seen = [0] * window
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                out = []
                for t in batch.column(text).to_pylist():
                    ids = np.array([*tokens.ids(t or ""), end_id], dtype="<u4")
                    tail = len(ids) % window
                    out.append((task, wholes, len(ids), tail, seen[tail], ids.tobytes()))
                    seen[tail] += 1
                    wholes += len(ids) // window
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                arrays = [pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(id_col), *arrays], names=head.fieldNames())

    rows = stored(docs.select(id_col, text).mapInArrow(tokenised, head), "token-ids")
    counts = rows.where(F.col("tail") > 0).groupBy("tail", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["tail"]: r["n"] for r in counts.groupBy("tail").agg(F.sum("n").alias("n")).collect()}
    slots, rest, sequences, tape = plan_slots(histogram, window)
    full = tape // window
    # What is left at the tape's end is cut into powers of two.
    ends = [full * window]
    for bit in reversed(range(window.bit_length())):
        if (tape - full * window) >> bit & 1:
            ends.append(ends[-1] + (1 << bit))
    first_whole = sequences + full + len(ends)

    # Whole windows stand alone; their sequences are numbered by task and place in the task.
    whole = (
        rows.where(F.col("doc_tokens") >= window)
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.expr(f"int(doc_tokens div {window}) - 1"))))
        .select(
            id_col,
            (F.col("k").cast("long") * window).alias("start"),
            F.lit(window).cast("long").alias("length"),
            F.substring("ids", F.col("k") * (4 * window) + 1, F.lit(4 * window)).alias("ids"),
            "doc_tokens",
            (F.lit(first_whole) + F.shiftleft("task", 36) + F.col("wholes_before") + F.col("k")).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        )
    )

    before = Window.partitionBy("tail").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("tail", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    columns = ("t", "first_rank", "end_rank", "first_seq", "slot_offset")
    kinds = (pa.int32(), *[pa.int64()] * 4)
    each = zip(*slots, strict=True) if slots else [[]] * 5
    slot_rows = spark.createDataFrame(pa.table({c: pa.array(v, k) for c, v, k in zip(columns, each, kinds, strict=True)}))
    rest_rows = spark.createDataFrame([(k, *v) for k, v in rest.items()], "tail int, slot_ranks long, tape_base long")
    placed = (
        rows.where(F.col("tail") > 0)
        .select(
            id_col,
            "task",
            "tail",
            "tail_rank",
            "doc_tokens",
            F.substring("ids", F.expr("int(4 * (doc_tokens - tail) + 1)"), F.expr("4 * tail")).alias("ids"),
        )
        .join(bases, ["tail", "task"])
        .withColumn("rank", F.col("base") + F.col("tail_rank"))
        # Both are bounded by the window: lengths, and three slots for each combination at most
        # (some window ** 2 / 4 rows).
        .join(F.broadcast(rest_rows), "tail")
        .join(
            F.broadcast(slot_rows),
            (F.col("tail") == F.col("t")) & F.col("rank").between(F.col("first_rank"), F.col("end_rank") - 1),
            "left",
        )
        .withColumn("at", F.col("tape_base") + (F.col("rank") - F.col("slot_ranks")) * F.col("tail"))
    )
    borders = F.array(*[F.lit(x).cast("long") for x in ends])
    size = F.col("tail").cast("long")
    cuts = F.array_sort(
        F.filter(
            F.concat(F.array(F.col("at"), F.expr(f"(at div {window} + 1) * {window}")), borders),
            lambda x: (x >= F.col("at")) & (x < F.col("at") + size),
        )
    )
    cuts = F.when(F.col("t").isNotNull(), F.array(F.col("at"))).otherwise(F.array_distinct(cuts))
    below = F.array_max(F.filter(borders, lambda x: x <= F.col("cut")))
    on_tape = F.when(F.col("cut") < full * window, F.expr(f"cut div {window}")).otherwise(
        full - 1 + F.size(F.filter(borders, lambda x: x <= F.col("cut")))
    )
    tails = (
        placed.withColumn("cuts", cuts)
        .select("*", F.posexplode("cuts").alias("n", "cut"))
        .withColumn("end", F.coalesce(F.get("cuts", F.col("n") + 1), F.col("at") + size))
        .select(
            id_col,
            (F.col("doc_tokens") - size + F.col("cut") - F.col("at")).alias("start"),
            (F.col("end") - F.col("cut")).alias("length"),
            F.substring("ids", F.expr("int(4 * (cut - at) + 1)"), F.expr("int(4 * (end - cut))")).alias("ids"),
            "doc_tokens",
            F.when(F.col("t").isNotNull(), F.col("first_seq") + F.col("rank") - F.col("first_rank"))
            .otherwise(sequences + on_tape)
            .alias("sequence_id"),
            F.when(F.col("t").isNotNull(), F.col("slot_offset"))
            .when(F.col("cut") < full * window, F.col("cut") % window)
            .otherwise(F.col("cut") - below)
            .alias("offset"),
        )
    )
    return whole.unionByName(tails)
