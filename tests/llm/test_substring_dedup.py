"""Deep-shallow sorting, and removed repeats against a plain search."""

import random

import numpy as np
import pytest

from plumbline.llm import substring_dedup, suffixes
from plumbline.llm.substring_dedup import remove_repeats


@pytest.mark.parametrize("letters, depth, shallow, blind", [(2, 21, 8, 1000), (3, 50, 16, 4), (1, 30, 8, 1000), (250, 9, 8, 2), (2, 12, 40, 9)])
def test_suffixes_are_in_order(letters, depth, shallow, blind):
    rng = np.random.default_rng(letters)
    data = rng.integers(0, letters, 3000).astype(np.uint8)
    data[1000:1400] = data[200:600]
    starts = np.arange(0, 3000 - depth - 8)
    order, new = suffixes.sorted_suffixes(data, starts, depth, shallow, blind)
    got = [data[s : s + depth].tobytes() for s in starts[order]]
    assert sorted(order.tolist()) == list(range(len(starts)))
    assert got == sorted(got)
    assert new.tolist() == [True] + [a != b for a, b in zip(got, got[1:], strict=False)]


def test_blind_tries_order_and_group():
    rnd = random.Random(5)
    tails = [bytes(rnd.choice((0, 1, 255)) for _ in range(4)) for _ in range(300)]
    got = suffixes.blind_order([int.from_bytes(t) for t in tails], 4)
    assert [tails[k] for same in got for k in same] == sorted(tails)
    assert len(got) == len(set(tails)) and all(len({tails[k] for k in same}) == 1 for same in got)


def plain(rows, length):
    first, out = {}, []
    data = [((t or "").encode(), (1 << 63) if i is None else i) for i, t in rows]
    for b, i in data:
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(i, first.get(b[p : p + length], i))
    for (b, i), (key, _) in zip(data, rows, strict=True):
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((key, bytes(x for x, g in zip(b, gone, strict=True) if not g), len(b), sum(gone), spans))
    return sorted(out, key=str)


def texts(seed):
    rnd = random.Random(seed)
    parts = ["".join(rnd.choice("abÜ. ") for _ in range(rnd.randint(1, 90))) for _ in range(12)]
    rows = [(i, "".join(rnd.choice(parts)[: rnd.randint(1, 90)] for _ in range(rnd.randint(0, 9)))) for i in rnd.sample(range(1000), 80)]
    rows += [(i + 1000, t[rnd.randint(0, 9) :]) for i, t in rows[:20]] + [(5000, None), (5001, ""), (None, rows[3][1]), (None, rows[3][1]), (rows[4][0], rows[5][1])]
    return rows + [(6000, "a" * 700), (6001, "a" * 300 + "b" + "a" * 300), (6002, "ab" * 200), (6003, "ba" * 200)]


@pytest.mark.parametrize("length, hot, rows_of_block", [(12, 4096, 3), (12, 1, 4), (50, 4096, 2), (50, 2, 5), (25, 4096, 11)])
def test_removed_bytes_are_those_of_a_plain_search(spark, monkeypatch, length, hot, rows_of_block):
    monkeypatch.setattr(substring_dedup, "ROWS", rows_of_block)
    monkeypatch.setattr(substring_dedup, "SLICE", 97)
    monkeypatch.setattr(substring_dedup, "WINDOWS", 500)
    rows = texts(length + hot)
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n_bytes int, __block string").repartition(3)
    out = remove_repeats(docs, length=length, hot=hot)
    got = [(r["doc_id"], bytes(r["kept_bytes"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in out.collect()]
    assert "__block" in out.columns and sorted(got, key=str) == plain(rows, length)


def test_odd_tables_and_long_texts(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(TypeError):
        remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    rnd = random.Random(1)
    long = "".join(rnd.choice("abcdefgh \n") for _ in range(3_000_000))
    docs = spark.createDataFrame([(2, "x" + long[100:2_500_000]), (1, long), (3, long[-80:-20])], "doc_id int, text string")
    got = {r["doc_id"]: (bytes(r["kept_bytes"]), r["n_removed"], r["n_spans"]) for r in remove_repeats(docs).collect()}
    assert got == {1: (long.encode(), 0, 0), 2: (b"x", 2_499_900, 1), 3: (b"", 60, 1)}


def test_ranges_are_alike_in_size():
    # Least hashes of grams are small numbers; a range must not have more than its share of them.
    data = np.random.default_rng(3).integers(97, 123, 400_000).astype(np.uint8)
    s = substring_dedup.segments(data, np.arange(0, 400_001, 2000), np.arange(200), 50)
    sizes = [b - a for _, a, b in substring_dedup._cut(s.hash[s.first], 64)]
    assert len(sizes) == 64 and max(sizes) < 1.5 * sum(sizes) / 64
