"""Benchmark decontamination: one Aho-Corasick automaton over the items' words.

Texts are normalised (A-Z in lower case, cut into words) and scanned once. Hits are found as
ranges of words and mapped back to code points of the original text.

A window is ``size`` consecutive words of an item. Wherever it starts, it holds one of the
item's blocks of ``(size + 1) // 2`` words that start at multiples of that length. So the
automaton has each item's words once, cut into such blocks (and whole the items shorter than a
window), not every window; a block that it finds is extended word by word to both sides, over
all places of the benchmark where the block stands, and counts where a whole window is equal.
Each word of the benchmark is spelled by a few marks, so few nodes are needed: about 55 bytes
of automaton for each of its words.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.common import stored, words_of

#: The words of ``words_of`` as they stand in the original text.
ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: An automaton has at most so many words of items, or one item. It takes about 450 MB of each Python
#: worker, and 32 MB and the vocabulary are broadcast. A larger benchmark (over some 50 MB of text)
#: needs another automaton, and another pass over the documents, for each so many words.
MOST_WORDS = 8_000_000
#: Marks for each place in the spelling of a word.
MARKS = 48

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("n_hit", T.LongType(), False),
        T.StructField("hit_items", T.ArrayType(T.StringType(), False), False),
        T.StructField(
            "hit_spans",
            T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]), False),
            False,
        ),
        T.StructField("contaminated", T.BooleanType(), False),
    ]
)


#: What passes hand on while there are more automata to come.
RAW = T.StructType(
    [
        T.StructField("__ranges", T.ArrayType(T.LongType(), False), False),
        T.StructField("__items", T.ArrayType(T.StringType(), False), False),
    ]
)
#: Stand for the end of an item, and for a word that no item has.
END, OTHER = -1, -2


@dataclass
class Part:
    """Items of the benchmark: their words by number, one after another, with ``END`` around each."""

    names: list[str | None] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    pieces: list[np.ndarray] = field(default_factory=list)
    words: int = 0

    def add(self, name: str | None, words: list[bytes]) -> None:
        number = self.vocabulary
        self.pieces.append(np.array([*(number.setdefault(w, len(number)) for w in words), END], np.int32))
        self.names.append(name)
        self.words += len(words)


def _parts(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[Part]:
    part = Part()
    for name, t in benchmark.select(item, text).toLocalIterator(prefetchPartitions=True):
        words = words_of(t)
        if part.words and part.words + len(words) > most:
            yield part
            part = Part()
        if words:
            part.add(None if name is None else str(name), words)
    yield part


class Windows:
    """Finds where texts have windows of a part's items."""

    def __init__(self, part: Part, size: int):
        self.size, self.block = size, (size + 1) // 2
        self.names, self.vocabulary = part.names, part.vocabulary
        self.words = np.concatenate([np.array([END], np.int32), *part.pieces])
        self.item_of = np.repeat(np.arange(len(part.pieces) + 1) - 1, [1, *map(len, part.pieces)])
        self.width = 1
        while MARKS**self.width < len(part.vocabulary):
            self.width += 1
        # Another set of marks for each place, so that no match begins inside a word. The last spelling is OTHER's.
        self.spelled = [
            "".join(chr(33 + MARKS * j + i // MARKS**j % MARKS) for j in range(self.width)) for i in range(len(part.vocabulary))
        ] + ["\0" * self.width]
        places: dict[str, list[int]] = {}
        start = 1
        for piece in part.pieces:
            n = len(piece) - 1
            spelled = [self.spelled[i] for i in piece[:-1].tolist()]
            for i in range(0, n - self.block + 1, self.block) if n >= size else [0]:
                end = i + self.block if n >= size else n
                places.setdefault("".join(spelled[i:end]), []).append(start + i)
            start += n + 1
        self.places = [np.array(x) for x in places.values()]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, x in enumerate(places):
            self.automaton.add_word(x, k)
        self.lengths = [len(x) // self.width for x in places]
        if places:
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges of words that windows cover, and the names of their items."""
        ranges, items, numbers = [], set(), None
        if not self.places or not words:
            return ranges, set()
        known, other, spelled = self.vocabulary.get, len(self.vocabulary), self.spelled
        for end, k in self.automaton.iter("".join([spelled[known(w, other)] for w in words])):
            if numbers is None:
                numbers = np.array([END, *(known(w, OTHER) for w in words), END - 2], np.int32)
            last = (end + 1) // self.width
            first, at = last - self.lengths[k], self.places[k]
            # Guards at both ends of the text equal nothing, and an item's END equals no word.
            left = self._equal(numbers, first, at - 1, -1)
            right = self._equal(numbers, last + 1, at + (last - first), 1)
            whole = (self.words[at - 1] == END) & (self.words[at + last - first] == END)
            hit = whole | (left + (last - first) + right >= self.size)
            if hit.any():
                # These ranges all hold the block, so they cover one run.
                reach = hit & ~whole
                a, b = (int(x[reach].max(initial=0)) for x in (left, right))
                ranges.append((first - a, last + b))
                items.update(self.item_of[at[hit]].tolist())
        return ranges, {self.names[i] for i in items if self.names[i] is not None}

    def _equal(self, numbers: np.ndarray, place: int, at: np.ndarray, step: int) -> np.ndarray:
        """How many words from a place of the text on equal those from each place of the items, as far as windows reach."""
        n = np.zeros(len(at), np.int64)
        alive = np.arange(len(at))
        for k in range(self.size - self.block):
            if not 0 < place + k * step < len(numbers) - 1:
                break
            alive = alive[self.words[at[alive] + k * step] == numbers[place + k * step]]
            if not len(alive):
                break
            n[alive] = k + 1
        return n


_built: dict[str, Windows] = {}


def _covered(text: str | None, ranges: list[tuple[int, int]]) -> tuple[int, list[dict[str, int]]]:
    """How many words the ranges cover, and where these runs stand in the original text."""
    merged: list[list[int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    spans = []
    if merged:
        places = [m.span() for m in ORIGINAL_WORD.finditer(text or "")]
        spans = [{"start": places[a][0], "end": places[b - 1][1]} for a, b in merged]
    return sum(b - a for a, b in merged), spans


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = 13,
    part: int = 20,
    most_words: int = MOST_WORDS,
) -> DataFrame:
    """``docs`` with what of each text is in the benchmark: the columns of ``HITS``.

    A window is ``size`` consecutive words of an item, or all words of a shorter item. Every
    word of a document inside an occurrence of a window is hit. ``hit_spans`` are the code
    points ``[start, end)`` of runs of hit words; ``contaminated``: at least one word in
    ``part`` is hit. One narrow pass, no shuffle.

    The words of the benchmark are read part by part and broadcast; each worker builds the
    automaton once. A benchmark of more than ``most_words`` words takes one such pass over the
    documents for each part, whose findings are kept in the shared folder; results are the same.
    Null or empty texts have no words and no hits; items without words have no windows; an
    item without id hits words but isn't listed; items that share an id are listed once.
    Columns of ``docs`` with the names of results, or of ``RAW``, are replaced; others pass.
    """
    found, waiting = docs.drop(*RAW.fieldNames()), None
    for p in _parts(benchmark, item, item_text, most_words):
        if waiting is not None:
            found = stored(_pass(found, waiting, text, size, part, last=False), "contamination")
        waiting = p
    return _pass(found, waiting, text, size, part, last=True)


def _pass(docs: DataFrame, items: Part, text: str, size: int, part: int, last: bool) -> DataFrame:
    """Scans all documents for the items of one part; the last pass adds up what all found."""
    shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    new = HITS if last else RAW
    made = {*RAW.fieldNames(), *(HITS.fieldNames() if last else ())}
    kept = [f for f in docs.schema.fields if f.name not in made]
    schema = T.StructType([*kept, *new.fields])
    more = "__ranges" in docs.columns

    def scanned(batch: pa.RecordBatch, windows: Windows) -> pa.RecordBatch:
        rows = []
        before = zip(batch.column("__ranges").to_pylist(), batch.column("__items").to_pylist(), strict=True) if more else None
        for t in batch.column(text).to_pylist():
            words = words_of(t)
            ranges, names = windows.find(words)
            if before is not None:
                flat, known = next(before)
                ranges += zip(flat[::2], flat[1::2], strict=True)
                names |= set(known)
            if last:
                hit, spans = _covered(t, ranges)
                rows.append((len(words), hit, sorted(names), spans, hit > 0 and part * hit >= len(words)))
            else:
                rows.append(([x for r in ranges for x in r], sorted(names)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(new)
        arrays = [pa.array(c, type=f.type) for c, f in zip(columns, to_arrow_schema(new), strict=True)]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(f.name) for f in kept), *arrays], names=[f.name for f in schema.fields]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = Windows(shared.value, size)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                yield scanned(b.slice(i, 256), _built[key])

    return docs.mapInArrow(run, schema)
