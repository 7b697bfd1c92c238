"""Line dedup: levelled sorted runs of line hashes, merged and anti-joined batch by batch.

A *run* is a bucketed, sorted table ``(key, n)``: line-key hashes and the number of
documents of one or more batches that hold the line. Every new batch is merge-joined
against the runs: keys that are already known to be common are anti-joined away, and
what is left becomes a run of level 0. When a level has ``fanout`` runs they are merged
into one run of the next level, so a store of B batches has O(fanout * log B) runs.
Bucketing and sorting on the key let Spark's sort-merge join read runs without a shuffle.
Runs lie in the shared folder.

Only DataFrame functions are used; no Python runs on the executors.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, shared_path, stored

#: What a line key loses at both ends: space, and the controls from tab to return.
STRIPPED = "\t\n\v\f\r "


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(STRIPPED)))


def key_hash(key: Column) -> Column:
    """128 bits of a key as a struct of two longs; equal keys only, for any real corpus."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key, F.length(key)).alias("b"))


class LineRuns:
    """The store of runs. ``add`` takes a batch of ``(a, b, n)``: keys, and documents that hold them."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 3):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.prefix = f"line_runs_{uuid.uuid4().hex[:12]}"
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, counts: DataFrame, level: int) -> None:
        name = f"{self.prefix}_{self.made}"
        self.made += 1
        sorted_runs = counts.write.bucketBy(self.buckets, "a", "b").sortBy("a", "b").format("parquet")
        sorted_runs.option("path", shared_path(self.spark, name)).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _merged(self, names: list[str]) -> DataFrame:
        def merge(x: DataFrame, y: DataFrame) -> DataFrame:
            both = x.join(y.withColumnRenamed("n", "m").hint("merge"), ["a", "b"], "full")
            return both.select("a", "b", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

        # Runs are sorted and bucketed on their unique keys: a merge join, no shuffle or sort.
        return reduce(merge, [self.spark.table(x) for x in names])

    def runs(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def common(self) -> DataFrame:
        """The keys that the batches so far hold in at least ``min_docs`` documents."""
        return self._merged(self.runs()).where(F.col("n") >= self.min_docs).select("a", "b")

    def add(self, batch: DataFrame) -> None:
        counts = batch.groupBy("a", "b").agg(F.sum("n").alias("n"))
        if self.runs():
            # Keys over the mark need no further counting.
            counts = counts.join(self.common().hint("merge"), ["a", "b"], "left_anti")
        self._write(counts, 0)
        self.compact()

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            names = self.levels[level]
            if len(names) >= self.fanout:
                self._write(self._merged(names), level + 1)
                self.levels[level] = []
                for x in names:
                    self.spark.sql(f"DROP TABLE {x}")
            level += 1

    def drop(self) -> None:
        for x in self.runs():
            self.spark.sql(f"DROP TABLE {x}")
        self.levels = []


def dedup_lines(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    min_docs: int = 10,
    min_key: int = 1,
    batches: int = 4,
) -> DataFrame:
    """Drops from every document the lines whose key is in ``min_docs`` documents or more.

    A key is the line without white space at its ends and with A-Z in lower case; keys of
    fewer than ``min_key`` code points stay. Returns all of ``docs`` with ``kept_text``,
    ``n_lines`` and ``n_dropped``.

    Null or empty texts are one empty line and stay as they are (a null text gives an empty
    ``kept_text``). Each row is a document, also where an id is null or repeated. An empty
    table gives an empty one. Names in ``docs`` that clash with the results are replaced;
    other columns pass unchanged. Nothing is capped: a line that all documents hold is
    counted by partial sums, and its join partition can be split by the adaptive planner.
    """
    spark = docs.sparkSession
    of = lambda c: F.coalesce(c, F.lit(""))
    lines = F.split(of(F.col(text)), "\n", -1)
    # Which lines go depends on the text alone, so rows are known by two hashes of id and text.
    row = F.struct(
        F.xxhash64(F.col(id_col).cast("string"), F.col(text)).alias("r1"),
        F.xxhash64(F.col(text), F.lit("row"), F.col(id_col).cast("string")).alias("r2"),
    ).alias("__row")
    # Keys are hashed once, in one pass over the texts; null stands for a key that is too short.
    hashed = F.transform(F.transform(lines, line_key), lambda k: F.when(F.length(k) >= max(1, min_key), key_hash(k)))
    keys = stored(
        docs.where(F.length(F.col(text)) > 0).select(row, hashed.alias("h")).select("__row.r1", "__row.r2", "h"), "line-keys"
    )
    each = keys.select("r1", "r2", F.posexplode("h").alias("pos", "h")).where(F.col("h").isNotNull()).select("r1", "r2", "pos", "h.a", "h.b")
    # A document counts once for a key: of its sorted keys, those unlike the one before.
    first_ones = F.transform(
        F.array(F.array_sort(F.array_compact("h"))),
        lambda s: F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1))),
    )
    once = (
        keys.select(F.pmod("r1", F.lit(batches)).cast("int").alias("batch"), F.explode(F.get(first_ones, 0)).alias("h"))
        .select("batch", "h.a", "h.b")
        # Added up before anything moves.
        .groupBy("batch", "a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    staged = stored(once, "line-counts")
    store = LineRuns(spark, min_docs)
    try:
        for k in range(batches):
            store.add(staged.where(F.col("batch") == k).select("a", "b", "n"))
        common = stored(store.common(), "common-lines")
    finally:
        store.drop()
    gone = (
        each.join(common.hint("merge"), ["a", "b"], "left_semi")
        .groupBy("r1", "r2")
        .agg(F.collect_set("pos").alias("__gone"))
    )
    kept = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped", "__lines", "__row", "__gone")]
    return (
        docs.select(*kept, row, lines.alias("__lines"))
        .select(*kept, "__lines", F.col("__row.r1").alias("__r1"), F.col("__row.r2").alias("__r2"))
        .join(gone.withColumnsRenamed({"r1": "__r1", "r2": "__r2"}), ["__r1", "__r2"], "left")
        .select(
            *kept,
            F.when(F.col("__gone").isNull(), F.array_join("__lines", "\n"))
            .otherwise(
                F.array_join(
                    F.transform(
                        F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone"),
                        lambda p: F.get("__lines", p),
                    ),
                    "\n",
                )
            )
            .alias("kept_text"),
            F.size("__lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
        )
    )
