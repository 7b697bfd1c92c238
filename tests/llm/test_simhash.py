import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import graph, queries, simhash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(prints):
    """Smallest id reachable, by comparing all pairs of fingerprints."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_query_is_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    prints = {k: plain_print(t) for k, t in docs.items()}
    comps = plain_components(prints)
    out = queries.op1_simhash_near_dedup(spark, path).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in out} == {
        k: (f"{prints[k]:016x}", comps[k]) for k in docs
    }


def test_links_join_dense_groups_in_chunks(spark):
    rng = np.random.default_rng(3)
    centre = [int(x) for x in rng.integers(0, 2**63, 4)]
    prints = {int(x) for x in rng.integers(0, 2**63, 300)}
    for c in centre:
        for _ in range(150):
            v = c
            for b in rng.choice(63, rng.integers(0, 5), replace=False):
                v ^= 1 << int(b)
            prints.add(v)
    nodes = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    want = plain_components({p: p for p in prints})
    for scheme in (
        simhash.choose_scheme(simhash.bit_counts(nodes), len(prints)),
        simhash.Scheme(simhash.correlated_partitions(np.eye(64), 1, 2), (1, 1)),
        simhash.Scheme(simhash.correlated_partitions(np.eye(64), 1, 3), (1, 0, 0)),
        simhash.Scheme(simhash.correlated_partitions(np.eye(64), 1, 3), (2, -1, 0)),
    ):
        assert sum(t + 1 for t in scheme.thresholds) == 4
        links = simhash.near_links(nodes, scheme, chunk=16)
        got = {r["id"]: r["component"] for r in graph.connected_components(links).collect()}
        assert {p: got.get(p, p) for p in prints} == want


def test_probes_meet_indexed_values_within_the_threshold(spark):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    prints = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (60, 2))}
    nodes = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    scheme = simhash.Scheme(simhash.correlated_partitions(np.eye(64), 1, 2), (1, 1))
    rows = simhash.entries_of(nodes, scheme).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r["part"], r["value"]), ([], []))[r["role"]].append(r["fingerprint"])
    met = []
    for (part, _), (indexed, probing) in groups.items():
        own = sum(1 << b for b in scheme.partitions[part])
        pairs = [*combinations(indexed, 2), *((a, b) for a in indexed for b in probing)]
        assert all(((a ^ b) & own).bit_count() <= 1 for a, b in pairs)
        met += [(part, *sorted(p)) for p in pairs]
    assert len(met) == len(set(met))  # two meet in a partition once at most


def test_roles_of_a_crowded_group_are_kept():
    values, roles = np.array([0, 1, 2, 3]), np.array([simhash.MET, simhash.MET, simhash.PROBE, simhash.PROBE])
    links = simhash._spanning(values, roles, 3)
    assert all({a, b} & {0, 1} and {a, b} & {2, 3} for a, b in links) and len(links) == 3


def test_large_inputs_get_wider_partitions():
    both = np.full((64, 64), 0.25)
    np.fill_diagonal(both, 0.5)
    few, many = (simhash.choose_scheme(both * n, n) for n in (10**5, 10**10))
    assert len(many.partitions) < len(few.partitions)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (None, "one"), (None, "quite alone here"), (7, "É é")]
    rows += [(8, "w " * 50_000), (8, "w " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("x"))
    out = sorted(map(tuple, simhash.near_components(docs).collect()), key=str)
    prints = {t: plain_print(t) for _, t in rows}
    assert len(out) == len(rows)
    assert {r[2] for r in out if r[0] in (1, 2, 3)} == {1}
    assert {r[2] for r in out if r[0] in (4, 5)} == {4}
    assert sorted((r[2] for r in out if r[0] is None), key=str) == [4, None]
    assert {r[1] % 2**64 for r in out} == set(prints.values())
    assert simhash.near_components(docs.limit(0)).count() == 0


def test_a_hub_of_very_many_links_is_split(spark):
    """The joins of a star's rounds have plain shuffles on both sides; the planner can split these."""
    links = spark.range(1, 200_000).selectExpr("id as a", "0L as b").union(spark.range(300_000, 300_100).selectExpr("id as a", "id + 1 as b"))
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        found = graph.connected_components(links)
        least = graph.stored(found.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
        joined = found.repartition(16).join(least, "component")
        joined.write.format("noop").mode("overwrite").save()
        assert found.where("component = 0").count() == 199_999
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
