"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import alignment, collocations, decontaminate, fingerprint, langid, licenses, line_dedup, packing, pii, quality, sharding, simhash, substring_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash.near_components(docs)
    return out.select("doc_id", simhash.as_string(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.find_licenses(docs).select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The columns of packed pieces.
PACKED = (
    "doc_id",
    "start",
    "length",
    "ids_crc32",
    "doc_tokens",
    "sequence_id",
    "offset",
)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.pack_documents(docs, tokenizer_file())
    return out.withColumn("ids_crc32", F.crc32("ids")).select(*PACKED)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return sharding.shard_documents(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op7_document_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprint.half_edited(docs).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint.as_string(F.col("fingerprint")).alias("fingerprint"),
        fingerprint.as_string(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs)

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [counted(kind) for kind in pii.BASE_KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    models = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.judge_quality(docs, models).select("doc_id", "p_quality", "p_toxic", "score", "keep")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.where(~langid.held_out()).select("text", "lang"))
    out = langid.predict_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_phrases(table(spark, sf_dir, "documents").select("text", "lang"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align_tokens(docs, tokenizer_file(), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_sharding": op6_sharding,
    "op7_document_fingerprint": op7_document_fingerprint,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_language_id": op10_language_id,
    "op11_collocations": op11_collocations,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_alignment": op13_alignment,
    "pipeline": pipeline,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _license_sql() -> str:
    words = _WORDS.format(_LOWER.format("text"))
    base = " UNION ALL ".join(f"SELECT '{label}' AS label, string_split('{p}', ' ') AS p" for p, label in licenses.PHRASES.items())
    templates = ", ".join(f"({k}, '{label}', '{t}')" for k, (label, t) in enumerate(licenses.TEMPLATES))
    return f"""
WITH d AS (SELECT doc_id, coalesce({words}, []) AS w FROM documents),
places AS (
  SELECT doc_id, i - 1 AS pos, label
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), ({base})
  WHERE w[i:i + len(p) - 1] = p),
base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY doc_id),
template AS (
  SELECT k, label, list_distinct(w) AS t, ceil(len(w) / {licenses.THRESHOLD} - 1e-9) AS length
  FROM (SELECT k, label, {words} AS w FROM (VALUES {templates}) AS v(k, label, text))),
word AS (SELECT k, label, length, len(t) AS m, unnest(t) AS x FROM template),
hit AS (
  SELECT doc_id, k, label, length, m, i AS pos, x
  FROM (SELECT doc_id, w[i] AS x, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)) JOIN word USING (x)),
contained AS (
  SELECT doc_id, label, max(n / m) AS share
  FROM (SELECT a.doc_id, a.k, a.label, a.m, a.pos, CAST(count(DISTINCT b.x) AS DOUBLE) AS n
        FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.k = b.k AND b.pos >= a.pos AND b.pos < a.pos + a.length
        GROUP BY ALL)
  WHERE n >= ceil({licenses.THRESHOLD} * m - 1e-9) GROUP BY doc_id, label),
both_labels AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM contained UNION ALL SELECT doc_id, label FROM places) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM contained GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(share, 0.0)) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN both_labels USING (doc_id) LEFT JOIN best USING (doc_id)"""


ORACLES = {
    "op2_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format(_LOWER.format("text"))}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, p.n FROM places p JOIN win USING (n, s)),
covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_license_scan": _license_sql(),
    "op4_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (key) GROUP BY doc_id""",
    "op11_collocations": f"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
gram AS (
  SELECT lang, s, array_to_string(w[i:i + s - 1], ' ') AS p
  FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM piece, (SELECT unnest([1, 2, 3, 4]) AS s) WHERE len(w) >= s)),
total AS (SELECT lang, count(*) AS n FROM gram WHERE s = 1 GROUP BY lang),
often AS (SELECT lang, s, p, count(*) AS a FROM gram GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT *, string_split(p, ' ') AS w FROM often WHERE s > 1),
cut AS (
  SELECT c.lang, c.s, c.p, c.a, k, x.a AS l, y.a AS r, CAST(2000000::HUGEINT * c.a // (x.a + y.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, s)) AS k FROM cand) c
  JOIN often x ON x.lang = c.lang AND x.s = k AND x.p = array_to_string(c.w[1:k], ' ')
  JOIN often y ON y.lang = c.lang AND y.s = c.s - k AND y.p = array_to_string(c.w[k + 1:], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
part AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS p, max(a) AS longer
  FROM (SELECT *, unnest(range(1, s - m + 2)) AS i FROM cand, (SELECT unnest([2, 3]) AS m) WHERE m < s) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN part USING (lang, p) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000""",
    # Two hexadecimal digits a byte: a string of 50 bytes has 100 of them.
    "op12_substring_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, p, substring(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d)),
least AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, p FROM win JOIN least USING (s) WHERE doc_id > first),
run AS (
  SELECT doc_id, p, sum(CASE WHEN p <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS k
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM hit)),
span AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY doc_id, k),
gap AS (
  SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM span
  UNION ALL SELECT doc_id, 0, min(a) FROM span GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substring(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (coalesce(b, len(h) // 2) - a) AS BIGINT)), '' ORDER BY a) AS h
  FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
removed AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT doc_id, len(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
