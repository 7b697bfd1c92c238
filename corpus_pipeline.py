"""The text pipeline: five stages over the table ``documents``, each on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, line_dedup, packing, quality, simhash
from plumbline.llm.common import kept_now, released, stored
from plumbline.llm.queries import PACKED, table, tokenizer_file

#: The rows of ``run`` can't be written in SQL: a classifier and a tokenizer are in it.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of low quality and toxic ones, as learned from ``labels``."""
    models = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.judge_quality(docs, models).where("keep").select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that ten documents or more share; a null text stays null."""
    out = line_dedup.dedup_lines(docs)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    out = out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near copies.

    Rows of one id are one document and stay together. Rows without an id stay where their
    group has no id at all.
    """
    groups = simhash.near_components(docs)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi")
    nameless = docs.where(F.col("doc_id").isNull())
    if nameless.take(1):
        with_id = groups.where(F.col("component_id").isNotNull()).select("fingerprint").distinct()
        alone = simhash.with_fingerprints(nameless).join(with_id, "fingerprint", "left_anti")
        kept = kept.unionByName(alone.dropDuplicates(["fingerprint"]).select(*docs.columns))
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which at least a word in twenty is inside a passage of ``benchmark``."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1,024 tokens."""
    pieces = packing.pack_documents(docs, tokenizer_file())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select(*PACKED)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", drop_common_lines),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; each result is written, read by the next stage, and then deleted."""
    docs, since = table(spark, sf_dir, "documents"), kept_now()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
            # What the stage kept, and its input, are done with.
            released(since, but=1)
    return docs
