import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from tests.llm.test_packing import judged
from tests.llm.test_simhash import plain_components, plain_print

PATH = "/root/testdata/sf0.001"


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{PATH}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect()]
    tables = []
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, PATH)
        docs = cp.stored(docs, "stage")
        tables.append(docs)
        if len(tables) < 5:
            assert docs.columns == columns
    good, lined, single, clean, packed = ({r["doc_id"]: r for r in t.collect()} for t in tables)
    kept = [k for k in labels if k in good]
    assert sum(labels[k]["quality"] for k in kept) > 0.9 * len(kept)
    # Lines of ten documents or more are gone.
    count = {}
    for r in good.values():
        for key in {x.strip(" \t\n\v\f\r").lower() for x in r["text"].split("\n")} - {""}:
            count[key] = count.get(key, 0) + 1
    assert {k: r["text"] for k, r in lined.items()} == {
        k: "\n".join(x for x in r["text"].split("\n") if count.get(x.strip(" \t\n\v\f\r").lower(), 0) < 10)
        for k, r in good.items()
    }
    assert all(r["n_chars"] == len(r["text"]) for r in lined.values())
    comps = plain_components({k: plain_print(r["text"]) for k, r in lined.items()})
    assert set(single) == set(comps.values())
    windows = {" ".join(w[i : i + 13]) for t in items for w in [words(t)] for i in range(max(1, len(w) - 12))}
    for k, r in single.items():
        w = words(r["text"])
        hit = {p for i in range(len(w)) if " ".join(w[i : i + 13]) in windows for p in range(i, i + 13)}
        assert (k in clean) == (not hit or 20 * len(hit) < len(w))
    assert judged({k: r["text"] for k, r in clean.items()}, tables[-1].collect()) == 0


def words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES], ids=[n for n, _ in cp.STAGES])
def test_stages_take_odd_rows(spark, stage):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", "en", "s", 5), (None, "a b c", None, "s", 5), (3, "a b c", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, docs, PATH)
    assert out.count() >= 2
    assert stage(spark, docs.limit(0), PATH).count() == 0
    if stage is cp.near_dedup:
        assert sorted(r["doc_id"] for r in out.collect()) == [1, 3]
        alone = cp.near_dedup(spark, docs.where(F.col("doc_id").isNull()), PATH)
        assert alone.count() == 1
