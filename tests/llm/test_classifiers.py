import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumbline.llm import langid, quality, queries
from plumbline.llm.common import WORD_BYTES

PATH = "/root/testdata/sf0.1"


def test_languages_of_held_out_documents(spark):
    path = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = queries.op10_language_id(spark, path).collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_texts_have_a_language_or_und(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", None), (4, "the", None), (5, "x" * 300_000, "en")]
    rows += [(10 + i, f"the cat and the dog {i}", "en") for i in range(9)] + [(30 + i, f"der hund und die katze {i}", "de") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit_languages(docs)
    got = {r["doc_id"]: r for r in langid.predict_languages(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] == "en"
    assert [got[i]["lang_pred"] for i in (10, 30)] == ["en", "de"]
    assert langid.fit_languages(docs.where("lang is null")) is None
    assert {r["lang_pred"] for r in langid.predict_languages(docs, None).collect()} == {"und"}
    assert langid.predict_languages(docs.limit(0), model).count() == 0


def test_a_language_with_many_copies_has_a_full_sample(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(langid, "fit", lambda texts, langs: fitted.append(list(zip(langs, texts, strict=True))))
    different = spark.range(1001).selectExpr("concat('the text ', id) as text", "'en' as lang")
    copies = spark.range(300_000).selectExpr("'one text of very many copies' as text", "'en' as lang")
    others = spark.range(400).selectExpr("concat('der text ', id) as text", "'de' as lang")
    langid.fit_languages(different.union(copies).union(others))
    for lang in ("en", "de"):
        texts = [t for x, t in fitted[0] if x == lang]
        assert len(texts) == len(set(texts)) == langid.SAMPLE


def grams(text):
    t = langid.letters_of(text)
    return {t[i : i + n] for n in langid.GRAMS for i in range(len(t) - n + 1)}


def test_presence_and_kernel_are_exact():
    rng = np.random.default_rng(0)
    texts = [" ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(n)) for n in (1, 7, 300, 20_000)]
    assert [len(langid.presence(langid.letters_of(t))) for t in texts] == [len(grams(t)) for t in texts]
    rows = [langid.presence(langid.letters_of(t)) for t in texts]
    want = [[len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5 for b in texts[:3]] for a in texts]
    assert np.allclose(langid.Landmarks(rows[:3]).kernel(rows), want)


def test_scores_are_kernel_ridge_regression(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null and length(text) > 20")
    pairs = [(r["text"], r["lang"]) for r in docs.orderBy("doc_id").limit(60).collect()]
    texts, langs = [t for t, _ in pairs], [x for _, x in pairs]
    model = langid.fit(texts, langs, landmarks=1000)  # every text is a landmark: no approximation is left
    assert model.landmarks.n == len(texts)
    k = np.array([[len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5 for b in texts] for a in texts])
    names = sorted(set(langs))
    n, w = len(langs), np.array([len(langs) / len(names) / langs.count(x) for x in langs])
    for j, name in enumerate(names):
        y = np.array([1.0 if x == name else -1.0 for x in langs])
        # Weighted ridge in the dual: centred kernel, (K W + ridge n I) a = y, f = K W a.
        c = np.eye(n) - np.outer(np.ones(n), w / w.sum())
        kc = c @ k @ c.T
        mid = (w * y).sum() / w.sum()
        f = kc @ (w * np.linalg.solve(kc * w[None, :] + langid.RIDGE * n * np.eye(n), y - mid)) + mid
        got = model.scores([langid.presence(langid.letters_of(t)) for t in texts])[:, j]
        assert np.allclose(got, f, atol=1e-3)


def test_every_language_is_learned(spark):
    rows = [(f"wort{k:03d} " * 5 + f"n{chr(97 + i)}", f"l{k:03d}") for k in range(130) for i in range(3)]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = langid.fit_languages(df.withColumn("text", F.translate("text", "0123456789", "abcdefghij")))
    assert len(model.languages) == 130 and model.landmarks.n <= langid.ALL_LANDMARKS
    assert len(langid.choose_landmarks(["x"] * 3000, [f"l{i % 1500}" for i in range(3000)])) <= langid.ALL_LANDMARKS


def test_numerals_are_not_letters_and_ties_have_a_result(spark):
    rows = [(i, t, "en") for i, t in enumerate(["½ ² ①", "Ⅷ", "१२३", "the dog", "the dog"])]
    rows += [(10 + i, "same words here", x) for i, x in enumerate(["en", "de", "en", "de"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict_languages(docs, langid.fit_languages(docs)).collect()}
    assert [got[i] for i in (0, 1, 2)] == ["und"] * 3
    assert got[3] == got[4] == "en" and len({got[i] for i in range(10, 14)}) == 1


def test_quality_of_documents_outside_the_fit(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{PATH}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    models = quality.fit_quality(docs, labels.where(~held))
    rows = quality.judge_quality(docs, models).join(labels.where(held), "doc_id").collect()
    bad = [r for r in rows if not r["quality"] or r["toxic"]]
    good = [r for r in rows if r["quality"] and not r["toxic"]]
    assert np.mean([not r["keep"] for r in bad]) > 0.75
    assert np.mean([r["keep"] for r in good]) > 0.96
    assert all(abs(r["score"] - r["p_quality"] * (1 - r["p_toxic"])) < 1e-12 for r in rows)


def test_quality_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "s"), (None, "a", "s"), (2, "b", "s")], "doc_id long, text string, keep string")
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 0), (2, 1, 0), (2, 0, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    models = quality.fit_quality(docs, labels)
    assert models == {}
    assert [r["keep"] for r in quality.judge_quality(docs, models).collect()] == [True] * 4
    assert quality.fit_quality(docs.limit(0), labels.limit(0)) == {}
    assert quality.judge_quality(docs.limit(0), {}).count() == 0


def test_probabilities_follow_the_shares_of_all_labels_when_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "LABELLED", 100)
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.integers(0, 30, 8)), "s") for i in range(1500)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(1200)], "doc_id long, quality int, toxic int")
    rows = quality.judge_quality(docs, quality.fit_quality(docs, labels)).collect()
    assert abs(np.mean([r["p_quality"] for r in rows]) - 0.9) < 0.05
    assert np.mean([r["keep"] for r in rows]) > 0.95


def test_each_target_learns_from_its_own_labels(spark):
    docs = spark.createDataFrame([(i, f"{'good calm' if i % 2 else 'poor'} {'vile' if i % 3 else 'kind'} text", "s") for i in range(240)], "doc_id long, text string, source string")
    schema = "doc_id long, quality int, toxic int"
    models = quality.fit_quality(docs, spark.createDataFrame([(i, i % 2, None) for i in range(120)], schema))
    assert set(models) == {"quality"}
    rows = quality.judge_quality(docs, models).collect()
    assert all(r["keep"] == (r["doc_id"] % 2 == 1) and r["p_toxic"] == 0 for r in rows)
    # Half of the ids have one label, half the other; the odd ones have both, in two rows.
    labels = [(i, i % 2, None) for i in range(120)] + [(i, None, int(i % 3 > 0)) for i in range(120, 240)] + [(i, None, int(i % 3 > 0)) for i in range(1, 60, 2)]
    models = quality.fit_quality(docs, spark.createDataFrame(labels, schema))
    assert set(models) == {"quality", "toxic"}
    rows = quality.judge_quality(docs, models).collect()
    assert all((r["p_quality"] > 0.5) == (r["doc_id"] % 2 == 1) for r in rows)
    assert all((r["p_toxic"] > 0.5) == (r["doc_id"] % 3 > 0) for r in rows)


def views_of(y, rng):
    return [[int(v) * 50 + int(rng.integers(50))] for v in y]


def test_views_teach_each_other():
    """Both views see few features in the labelled rows; documents that the other is sure of have the rest."""
    rng = np.random.default_rng(0)
    y, hidden, test = rng.integers(0, 2, 40), rng.integers(0, 2, 3000), rng.integers(0, 2, 400)
    co = quality.CoTraining(views_of(y, rng), [[int(v)] for v in y], y)
    pool = [quality.Rows(v, n) for v, n in zip((views_of(hidden, rng), [[int(v)] for v in hidden]), quality.WIDTHS, strict=True)]
    right = []
    tested = quality.Rows(views_of(test, rng), quality.CONTENT_PLACES)
    for _ in range(quality.ROUNDS + 1):
        right.append(np.mean((tested.dot(co.betas[0][:-1]) + co.betas[0][-1] > 0) == test))
        told = [quality.Told(n) for n in quality.WIDTHS]
        quality.tell(co.betas, pool, told)
        for t in told:
            t.sums *= quality.UNIT
        co.learn(told)
    assert right[0] < 0.8 and right[-1] > 0.98


def test_what_views_are_told_is_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(rng.choice(words[: 20 + 20 * (i % 2)], 12)) if i % 17 else None, f"s{i % 4}", "en") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5)
    betas = {"quality": [np.append(rng.normal(0, 9, n), 0.1) for n in quality.WIDTHS]}
    got = quality.told_by_all(docs, betas, {0, 5}, ("doc_id", "text", "source", "lang"))["quality"]
    want = [np.zeros((2, n)) for n in quality.WIDTHS]
    n = np.zeros((2, 2))
    for i, text, source, lang in rows:
        features = quality.content_features(text), quality.metadata_features(text, source, lang)
        for view in (0, 1):
            beta = betas["quality"][view]
            p = 1 / (1 + np.exp(-(sum(beta[f] for f in features[view]) / len(features[view]) ** 0.5 + beta[-1])))
            side = 1 if p >= 0.9 else 0 if p <= 0.1 else None
            if side is not None and i not in (0, 5):
                n[1 - view][side] += 1
                want[1 - view][side][features[1 - view]] += len(features[1 - view]) ** -0.5
    for view in (0, 1):
        assert (got[view].n == n[view]).all() and n[view].sum() > 50
        assert np.allclose(got[view].sums, want[view], atol=1e-3)


def test_scores_are_the_two_views_combined(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 30, 8)), f"s{i % 3}", None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int("w3 " in rows[i][1]), 0) for i in range(250)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)["quality"]
    for r in quality.judge_quality(docs, {"quality": model}).collect():
        logits = []
        for beta, (a, b), f in (
            (model.content, model.calibration[0], quality.content_features(r["text"])),
            (model.metadata, model.calibration[1], quality.metadata_features(r["text"], r["source"], r["lang"])),
        ):
            logits.append(a * (sum(beta[x] for x in f) / len(f) ** 0.5 + beta[-1]) + b)
        p = 1 / (1 + np.exp(-(model.combined[:2] @ logits + model.combined[2])))
        assert abs(r["p_quality"] - p) < 1e-6 and r["p_toxic"] == 0 and abs(r["score"] - p) < 1e-6
        assert r["keep"] == (r["p_quality"] >= quality.LEAST_QUALITY)


def test_long_and_repeated_rows_of_quality(spark):
    docs = spark.createDataFrame([(i // 2, ("good " if i % 2 else "bad ") * (200_000 if i < 2 else 3), "s") for i in range(60)], "doc_id long, text string, p_toxic string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    rows = quality.judge_quality(docs, quality.fit_quality(docs, labels)).collect()
    assert len(rows) == 60 and all(0 <= r["p_quality"] <= 1 and r["p_toxic"] == 0 for r in rows)


def test_blocks_of_a_text_have_the_n_grams_of_the_whole(monkeypatch):
    text = langid.letters_of("Alpha beta, gamma \u0434\u043e\u043c delta alphabet " * 9)
    whole = langid.presence(text)
    for size in (1, 2, 5, len(text) - 1, len(text)):
        monkeypatch.setattr(langid, "BLOCK", size)
        assert np.array_equal(langid.presence(text), whole)
    assert len(langid.presence("")) == 0


def test_a_language_of_long_texts_is_learned_from_its_shortest(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(langid, "fit", lambda texts, langs: fitted.append(list(zip(langs, texts, strict=True))))
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 20)
    rows = [("a", "short one"), ("a", "short two"), ("a", "long " * 9), ("b", "very long " * 9), ("b", "long " * 8), ("b", "long " * 8), ("c", "12345"), (None, "text"), ("d", None)]
    langid.fit_languages(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    assert sorted(fitted[0]) == [("a", "short one"), ("a", "short two"), ("b", "long " * 8)]


def test_the_sample_is_bounded_in_code_points(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(langid, "fit", lambda texts, langs: fitted.append(list(zip(langs, texts, strict=True))))
    monkeypatch.setattr(langid, "ALL_CHARS", 200)
    rows = [("a", f"word{i} " + "x" * 33) for i in range(60)] + [("b", "y" * 1000)]
    langid.fit_languages(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    langs = [lang for lang, _ in fitted[0]]
    # A hundred code points each, and the one that passes the limit is whole.
    assert (langs.count("a"), langs.count("b")) == (3, 1)


def plain_features(text):
    raw = (text or "").encode()
    crc = lambda w: zlib.crc32(w) % (quality.CONTENT_PLACES - quality.SHARES)
    places = {crc(x) for w in set(raw.translate(WORD_BYTES).split()) for x in (w, *(w[:k] + b"-" for k in quality.BEGINNINGS if len(w) > k))}
    n = max(len(raw), 1)
    for k, chars in enumerate(quality._CLASSES.values()):
        level = min(quality._level((n - len(raw.translate(None, chars))) / n), 31)
        first = quality.CONTENT_PLACES - quality.SHARES + (32 * k + level) * quality.COPIES
        places.update(range(first, first + quality.COPIES))
    return sorted(places)


@pytest.mark.parametrize("piece, texts_of_piece", [(1 << 20, 1 << 13), (500, 7), (1, 2)])
def test_features_of_many_texts_are_those_of_each(monkeypatch, piece, texts_of_piece):
    monkeypatch.setattr(quality, "PIECE", piece)
    monkeypatch.setattr(quality, "PIECE_TEXTS", texts_of_piece)
    real = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()[:60]
    texts = [None, "", " ", "  a  ", "four fours fourteen fourteens", "Ünïcødé 漢字漢字漢字 😀", "a" * 3000, "\n\t!?", "x-y_z 0 00 A a", None, *real, ""]
    places, n = quality.content_places(pa.chunked_array([pa.array([*texts, "cut off"])]).slice(0, len(texts)))
    got = [x.tolist() for x in np.split(places, np.cumsum(n)[:-1])]
    assert got == [plain_features(t) for t in texts]
    assert [quality.content_features(t) for t in texts] == got
    assert quality.content_places(pa.chunked_array([], pa.string()))[0].tolist() == []


def test_features_take_less_time_than_word_by_word():
    column = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").slice(0, 1500)
    texts, took = column.to_pylist(), {}
    for name, run in {"plain": lambda: [plain_features(t) for t in texts], "all": lambda: quality.content_places(column)}.items():
        each = []
        for _ in range(3):
            began = time.process_time()
            run()
            each.append(time.process_time() - began)
        took[name] = min(each)
    assert took["all"] < 0.7 * took["plain"]
