import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def judged(texts, pieces, window=1024):
    """Every id in exactly one piece, sequences gapless; returns the padding."""
    exact = Tokenizer.from_file(PATH)
    ids = {k: np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for k, t in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["doc_tokens"] == len(ids[p["doc_id"]])
        assert p["ids_crc32"] == zlib.crc32(part.tobytes())
    assert set(by_doc) == set(ids)
    for k, ps in by_doc.items():
        ps.sort(key=lambda p: p["start"])
        assert [p["start"] for p in ps] == [0, *np.cumsum([p["length"] for p in ps])[:-1]]
        assert sum(p["length"] for p in ps) == len(ids[k])
    padding = 0
    for ps in by_seq.values():
        ps.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in ps] == [0, *np.cumsum([p["length"] for p in ps])[:-1]]
        n = sum(p["length"] for p in ps)
        assert 0 < n <= window
        padding += 0 if n & (n - 1) == 0 else window - n
    return padding


def test_query_packs_all_documents(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    out = queries.op5_packing(spark, path).collect()
    assert judged({d["doc_id"]: d["text"] for d in docs}, out) == 0


def test_odd_texts(spark):
    texts = {1: None, 2: "", 3: "a <|endoftext|> b", 4: "x" * 40_000, 5: "é🙂\n\n  " * 900, 6: "same", 7: "same"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = packing.pack_documents(docs, PATH)
    from pyspark.sql import functions as F

    assert judged(texts, out.withColumn("ids_crc32", F.crc32("ids")).collect()) == 0


def test_empty_table_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, task string")
    assert packing.pack_documents(none, PATH).count() == 0
    twice = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, None)], "doc_id long, text string")
    assert packing.pack_documents(twice, PATH).agg({"length": "sum"}).first()[0] == 4 + 4 + 1


@pytest.mark.parametrize("window", [8, 16])
def test_slots_hold_what_the_histogram_has(window):
    rng = np.random.default_rng(1)
    histogram = {k: int(rng.integers(0, 50)) for k in range(1, window)}
    slots, rest, sequences, tape = packing.plan_slots(histogram, window)
    filled = defaultdict(int)
    for length, first, end, seq, _ in slots:
        for r in range(first, end):
            filled[seq + r - first] += length
    assert set(filled.values()) == {window} and len(filled) == sequences
    assert tape + sequences * window == sum(k * v for k, v in histogram.items())
    assert all(rest[k][0] <= v for k, v in histogram.items())


def test_combinations_are_used_at_any_size():
    rng = np.random.default_rng(2)
    for n in (2_000, 300_000, 10**9):
        histogram = {k: int(v) for k, v in enumerate(rng.multinomial(n, np.full(1023, 1 / 1023)), 1) if v}
        slots, _, sequences, tape = packing.plan_slots(histogram, 1024)
        assert sequences * 1024 > 0.7 * sum(k * v for k, v in histogram.items())
        assert tape + sequences * 1024 == sum(k * v for k, v in histogram.items())


def test_ids_are_those_of_tokenizers_for_all_code_points():
    assert packing.same_by_rank(PATH)
    tokens, rng = packing.Tokens(PATH, True), np.random.default_rng(4)
    exact = Tokenizer.from_file(PATH)
    points = [chr(c) for c in [*range(0x3000), *range(0xA000, 0xD800), *range(0xE000, 0x11000), *range(0x1D400, 0x1FB00)]]
    texts = ["".join(f"a{c} {c}1{c}{c}! {c}" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    texts += ["".join(rng.choice(points[:0x500], 300)) for _ in range(300)]
    texts += ["".join(rng.choice(list("etaoin shrdlu'.\n"), 200)) for _ in range(300)]
    for t, e in zip(texts, exact.encode_batch(texts, add_special_tokens=False), strict=True):
        assert tokens.ids(t) == e.ids


def test_other_files_go_to_tokenizers_itself(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    a, b = spec["model"]["merges"][300:302]
    spec["model"]["merges"][300:302] = [b, a]  # ids no longer rise in the order of merges
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    assert not packing.same_by_rank(str(other))
    assert packing.Tokens(str(other), False).fast is None
