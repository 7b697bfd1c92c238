import zlib
from collections import Counter, defaultdict

import pytest

from plumbline.llm import queries, sharding


def judged(docs, rows, shards):
    assert Counter(r["doc_id"] for r in rows) == Counter(k for k, _ in docs)
    slots, sizes, where = defaultdict(list), Counter(dict.fromkeys(range(shards), 0)), defaultdict(set)
    texts = dict(docs)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        where[raw].add(r["shard"])
    assert set(slots) <= set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return sizes, where


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    rows = queries.op6_sharding(spark, path).collect()
    sizes, where = judged(docs, rows, 40)
    target, largest = sum(sizes.values()) / 40, max(r["size"] for r in rows)
    weight = Counter((t or "").encode() for _, t in docs)
    assert all(len(x) == 1 for t, x in where.items() if weight[t] * (len(t) + 16) <= target)
    assert max(sizes.values()) <= target + largest and min(sizes.values()) >= target - largest


def test_hot_group_is_spread_and_others_stay(spark):
    docs = [(i, "the same text") for i in range(1000)] + [(1000 + i, f"text {i // 3} of three") for i in range(2000)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, slot int")
    rows = sharding.shard_documents(df, 8).collect()
    sizes, where = judged(docs, rows, 8)
    target = sum(sizes.values()) / 8
    assert all(abs(x - target) < 0.02 * target for x in sizes.values())
    assert all(len(x) == 1 for t, x in where.items() if t != b"the same text")


def test_odd_tables(spark):
    docs = [(1, None), (2, ""), (3, "x" * 100_000), (4, "a"), (5, "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    judged(docs, sharding.shard_documents(df, 3).collect(), 3)
    assert sharding.shard_documents(df.limit(0), 3).count() == 0
    same = spark.createDataFrame([(None, "b")] * 50, "doc_id long, text string")
    rows = sharding.shard_documents(same, 4).collect()
    assert len(rows) == 50


def test_groups_of_at_most_a_shard_stay_whole(spark):
    # 60 groups of a little over half a shard: no two fit one shard.
    rows = [(g * 100 + c, f"group {g:03d} ".ljust(50, "x")) for g in range(60) for c in range(12)]
    rows += [(100_000 + i, f"s{i:03d}".ljust(10, "y")) for i in range(400)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=40).collect()
    sizes, where = judged(rows, out, 40)
    target = sum(sizes.values()) / 40
    assert all(len(s) == 1 for s in where.values())
    assert max(sizes.values()) == 2 * 12 * 66 < 1.1 * target and min(sizes.values()) > 0.85 * target


def test_three_groups_over_two_shards_are_not_split(spark):
    rows = [(i, f"text {i % 3}") for i in range(300)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=2).collect()
    assert all(len(s) == 1 for s in judged(rows, out, 2)[1].values())


def test_ties_of_all_measures_are_cut(spark):
    rows = [(7, f"{i:05d}") for i in range(800)]
    out = sharding.shard_documents(spark.createDataFrame([(*r, "s", "en") for r in rows], "doc_id long, text string, source string, lang string"), shards=8).collect()
    sizes, _ = judged_sizes(rows, out, 8)
    assert max(sizes.values()) - min(sizes.values()) <= 3 * 21


def judged_sizes(rows, out, shards):
    """Sizes where ids repeat: slots are gapless and nothing is lost."""
    assert len(out) == len(rows)
    slots, sizes = defaultdict(list), Counter(dict.fromkeys(range(shards), 0))
    for r in out:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return sizes, slots
