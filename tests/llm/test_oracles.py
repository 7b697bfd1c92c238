"""Queries with SQL twins, held against them; and the odd tables of their operators."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, licenses, line_dedup, queries

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels"):
        con.sql(f"create view {name} as select * from read_parquet('{PATH}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, db, name):
    got = queries.QUERIES[name](spark, PATH)
    want = db.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    assert sorted(rows, key=str) == sorted((tuple(r) for r in want.select(", ".join(columns)).fetchall()), key=str)


ODD = [(1, None), (2, ""), (3, "\n\n"), (4, "\x0b Same LINE \t\nown É"), (5, "same line\nx"), (6, "same line\nx"), (None, "same line"), (None, "same line")]


def test_lines_of_odd_texts(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("key", F.lit(1))
    out = line_dedup.dedup_lines(docs, min_docs=3, batches=2)
    rows = sorted((r["doc_id"] or 0, r["kept_text"], r["n_lines"], r["n_dropped"]) for r in out.collect())
    assert rows == [(0, "", 1, 1), (0, "", 1, 1), (1, "", 1, 0), (2, "", 1, 0), (3, "\n\n", 3, 0),
                    (4, "own É", 2, 1), (5, "x", 2, 1), (6, "x", 2, 1)]
    assert "key" in out.columns and line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_lines_of_very_long_and_repeated_texts(spark):
    """A text of very many lines, most of them repeated in it, counts once for a key; equal rows are documents of their own."""
    long = "\n".join(["again", "Again "] * 40_000 + [f"own {i}" for i in range(20_000)] + ["shared"])
    rows = [(1, long)] + [(i, "shared\nonly") for i in range(2, 6)] * 2 + [(9, "again")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3)
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], len(r["kept_text"])) for r in out.collect())
    # "again" is in two documents only, however often; "shared" and "only" are in eight and more.
    assert got == [(1, 100_001, 1, len(long) - 7)] + [(i, 2, 2, 0) for i in range(2, 6) for _ in (0, 1)] + [(9, 1, 0, 5)]


@pytest.mark.parametrize("batches", [1, 2, 7, 12])
def test_runs_count_over_all_batches(spark, batches):
    texts = [(i, "\n".join(f"line {k}" for k in range(12) if i % (k + 1) == 0)) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kept = {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(docs, batches=batches).collect()}
    # line k is in 60 / (k + 1) documents.
    assert kept == {i: "\n".join(x for x in t.split("\n") if x and 60 / (int(x[5:]) + 1) < 10) for i, t in texts}


def test_contamination_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "The QUICK, brown fox."), (4, "x " * 200 + "Quick-brown fox"), (4, "quick brown")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "quick brown FOX"), (7, "fox"), (None, "brown"), (8, None), (9, "!")], "item_id long, text string")
    want = [(1, 0, 0, [], False), (2, 0, 0, [], False), (3, 4, 3, ["7"], True), (4, 2, 1, [], True), (4, 203, 3, ["7"], False)]
    clash = docs.withColumn("n_words", F.lit("clash")).withColumn("__items", F.lit(0))
    for given, most in ((docs, decontaminate.MOST_WORDS), (docs, 1), (clash, 3)):
        out = decontaminate.find_contamination(given, items, most_words=most).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["hit_items"], r["contaminated"]) for r in out) == want
        spans = {r["n_words"]: r["hit_spans"] for r in out}
        assert [tuple(s) for s in spans[4]] == [(4, 20)] and [tuple(s) for s in spans[203]] == [(400, 415)]
    assert decontaminate.find_contamination(docs.limit(0), items).count() == 0
    assert decontaminate.find_contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0


def plain_hits(text, items, size):
    """Hit words and items of a text, by looking at each window of each item at each word."""
    w = [bytes(x) for x in licenses.words_of(text)]
    hit, names = set(), set()
    for name, t in items:
        v = [bytes(x) for x in licenses.words_of(t)]
        n = min(size, len(v))
        for i in range(len(v) - n + 1 if v else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit.update(range(j, j + n))
                    names.add(str(name))
    return len(hit), sorted(names)


@pytest.mark.parametrize("size", [1, 2, 5, 6, 13])
def test_contamination_is_brute_force(spark, size):
    rng = random.Random(size)
    word = lambda: rng.choice("abcdé") + rng.choice(["", "1", "x"])
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 4 * size)))) for i in range(30)]
    pieces = [t.split()[a:] for _, t in items for a in (0, 1, 3)]
    docs = [(i, " ".join(x for _ in range(5) for x in [word(), *rng.choice(pieces)])) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (10**6, 40):
        out = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, size=size, most_words=most)
        got = {r["doc_id"]: (r["n_hit"], r["hit_items"]) for r in out.collect()}
        assert got == {k: plain_hits(t, items, size) for k, t in docs}


def test_a_large_benchmark_is_one_automaton(spark):
    """Twenty million characters, items that share their first words, and a very long text."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(50_000)]
    lead = "which of the following statements is true about"
    items = [(i, f"{lead} " + " ".join(rng.choices(vocabulary, k=700))) for i in range(4000)]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    cut = items[77][1].split()
    texts = [(1, " ".join(cut[100:113])), (2, " ".join(cut[100:112])), (3, f"{lead} nothing " * 1000), (4, " ".join(rng.choices(vocabulary, k=200_000)) + " " + " ".join(cut[5:40]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    out = decontaminate.find_contamination(docs, bench)
    got = {r["doc_id"]: (r["n_hit"], r["hit_items"], r["contaminated"]) for r in out.collect()}
    assert got == {1: (13, ["77"], True), 2: (0, [], False), 3: (0, [], False), 4: (35, ["77"], False)}


def plain_blocks(text, threshold):
    """Blocks of every template at every place, joined where they overlap."""
    w, out = [bytes(x) for x in licenses.words_of(text)], set()
    for label, t in licenses.TEMPLATES:
        own = [bytes(x) for x in licenses.words_of(t)]
        length, runs = -(-len(own) // threshold), []
        for i in range(len(w)):
            block = w[i : int(i + length)]
            share = len(set(block) & set(own)) / len(set(own))
            if w[i] in own and share >= threshold - 1e-12:
                if runs and i < runs[-1][1]:
                    runs[-1] = (runs[-1][0], i + len(block), max(share, runs[-1][2]))
                else:
                    runs.append((i, i + len(block), share))
        out |= {(a, b, label, c) for a, b, c in runs}
    return out


def test_licenses_by_brute_force(spark):
    lines = [t for _, t in licenses.TEMPLATES] + ["nothing here", "", "cc by nc cc by nc", "licensed under the Apache thing version two"]
    texts = [(1, None), (2, ""), (3, "\n".join(lines)), (3, "\n".join(lines))]
    texts += [(10 + i, " ".join(t.split()[k:])) for i, t in enumerate(lines) for k in range(4)]
    texts += [(60 + i, "of the license " * 9 + t.replace(" ", " and the ", 3) + " x" * 40 + t) for i, t in enumerate(lines)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("score", F.lit("clash"))
    for threshold in (0.5, 0.8, 1.0):
        for r in licenses.find_licenses(docs, threshold=threshold).collect():
            got = {(b["start_word"], b["end_word"], b["label"], b["containment"]) for b in r["blocks"]}
            assert got == plain_blocks(r["text"], threshold)
    assert licenses.find_licenses(docs.limit(0)).count() == 0


#: Notices as they stand in files, wrapped and marked as comments.
WRAPPED = {
    "bsd": " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that",
    "mpl-2": "# This Source Code Form is subject to the terms of the Mozilla\n# Public License, v. 2.0. If a copy",
    "gpl-3": "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
}


def test_notices_over_lines_and_in_very_long_texts(spark):
    long = "word of the license " * 60_000
    texts = [(label, f"{lead}\n{t}\n{lead}") for label, t in WRAPPED.items() for lead in ("some text", long)] + [("", long)]
    docs = spark.createDataFrame(texts, "want string, text string")
    for r in licenses.find_licenses(docs).collect():
        assert (r["want"] in r["labels"]) if r["want"] else not r["labels"]


def test_empty_sha(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit("").cast("binary"), 256)).first()[0]
