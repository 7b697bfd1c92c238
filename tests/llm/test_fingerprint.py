import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from plumbline.llm import fingerprint as fp
from plumbline.llm import queries


def judged(docs, rows):
    order = sorted(docs, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    for r in rows:
        text, other = docs[r["doc_id"]] or "", docs[after[r["doc_id"]]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), r["doc_id"]
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (sorted(units(text)) == sorted(units(edited)))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    prints = {}
    for r in rows:
        assert prints.setdefault(docs[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]


def units(text):
    return re.split(r"(?:(?<=\n)|(?<=[.!?]\s))(?!\Z)", text)


def plain_likeness(a, b):
    """What the units that two texts share weigh, by the products of how often they are there."""
    x, y = Counter(units(a)), Counter(units(b))
    return 2 * sum(n * y[u] for u, n in x.items()) / sum(n * n for z in (x, y) for n in z.values())


def test_query(spark):
    path = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = queries.op7_document_fingerprint(spark, path).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    judged(docs, rows)
    order = sorted(docs, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    off = []
    for r in rows:
        text, other = docs[r["doc_id"]] or "", docs[after[r["doc_id"]]] or ""
        half = len(text) // 2
        off.append(r["near_next"] - plain_likeness(text, other))
        off.append(r["near_edited"] - plain_likeness(text, text[: len(text) - half] + other[:half]))
    # The estimate has a deviation of about sqrt(1 / 62) of what differs.
    assert abs(sum(off)) / len(off) < 0.06 and (sum(x * x for x in off) / len(off)) ** 0.5 < 0.15
    near = [r["near_edited"] for r in rows]
    assert sum(near) / len(near) > 0.4
    assert sum(r["near_next"] for r in rows) / len(rows) < 0.2


def test_odd_tables(spark):
    docs = {1: None, 5: "", 9: "a. b. c", 12: "b. a. c", 13: "a.\nb. c", 20: "🙂é" * 30_000}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("fingerprint", F.lit(0))
    out = fp.half_edited(df).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                                    "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    rows = out.collect()
    judged(docs, rows)
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[9] == prints[12] and prints[1] == prints[5]
    assert prints[9] != prints[13]
    assert fp.half_edited(df.limit(0)).count() == 0
    twice = fp.half_edited(df.where("doc_id = 9").unionAll(df.where("doc_id = 9"))).collect()
    assert len(twice) == 2 and all(r["near_next"] == 1 for r in twice)
    lone = fp.half_edited(df.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long"))).first()
    assert lone["near_next"] == 1 and lone["edited"] == "a. ba. "[:7]


def test_insertion_and_deletion(spark):
    row = spark.createDataFrame([("a\nb\n", "c\nd\nd\n", "d\nb\na\nd\nc\n", "b\n")], "x string, y string, z string, w string")
    h = row.select(*[fp.multiset_hash(F.col(c)).alias(c) for c in row.columns])
    got = h.select(
        fp.added(F.col("x"), F.col("y")) == F.col("z"),
        fp.removed(F.col("z"), F.col("y")) == F.col("x"),
        fp.removed(F.col("w"), F.col("w")) == fp.removed(F.col("z"), F.col("z")),
    )
    assert tuple(got.first()) == (True, True, True)


def test_order_is_that_of_the_ids(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_BYTES", 200)
    texts = {i: f"text {i} of some. Words {i * i}." for i in range(40)}
    for ids, kind in (
        ([2**53 + i for i in range(40)], "long"),
        ([f"d{i}" for i in range(40)], "string"),
    ):
        docs = {k: texts[i] for i, k in enumerate(ids)}
        out = fp.half_edited(spark.createDataFrame(list(docs.items()), f"doc_id {kind}, text string"))
        judged(docs, out.withColumn("edited_sha256", F.sha2("edited", 256)).collect())


def test_ranges_split_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_BYTES", 500)
    df = spark.range(200).selectExpr("cast(null as long) as doc_id", "concat('text ', id) as text")
    keyed = df.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")).alias("__key"), F.col("text").alias("__text"))
    assert len(fp._range_cuts(keyed)) >= 2
    rows = fp.half_edited(df).collect()
    assert len(rows) == 200 and {r["doc_id"] for r in rows} == {None}


def test_lanes_do_not_wrap(spark):
    df = spark.createDataFrame([("a\n" * 600_000, "a\n" * 600_000 + "b\n" * 600_000)], "x string, y string")
    got = df.select(fp.likeness(fp.multiset_hash(F.col("x")), fp.multiset_hash(F.col("y"))).alias("n")).first()["n"]
    assert abs(got - 2 / 3) < 0.15


def test_no_text_goes_through_a_single_partition(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_BYTES", 500)
    df = spark.range(300).selectExpr("id as doc_id", "concat('text ', id) as text")
    plan = fp.half_edited(df)._jdf.queryExecution().executedPlan().toString()
    alone = [plan[: m.start()].rsplit("\n", 1)[1] + plan[m.start() :].split("\n", 2)[1] for m in re.finditer("Exchange SinglePartition", plan)]
    assert alone and all("__text" not in x for x in alone)
