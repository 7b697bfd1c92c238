"""Registered queries of the table, spatial, raster and point operators, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import crs
from plumbline.functions import geometry as g
from plumbline.functions.expression import compile_expression
from plumbline.operators import boreholes, components, edits, fidelity, planar, points, raster, rules, spatial, survey, vector
from plumbline.operators import table as tab
from plumbline.plans import layers
from plumbline.plans.layers import table
from plumbline.plans.registry import ORACLES, QUERIES, query
from plumbline.sources import binary_vector, detect, splittable, tables, text_vector
from plumbline.storage import shared_path

# Attribute tables and the field calculator.


@query("""
SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part
WHERE p_size > 20 AND p_retailprice <= 1500 AND contains(lower(concat_ws('|', p_partkey, p_name, p_brand, p_type, p_size)), 'brand#1')
ORDER BY p_retailprice DESC, p_partkey LIMIT 100""")
def table_filter_search_sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    out = tab.build_table(part, "p_size > 20 and [p_retailprice] <= 1500", "brand#1", "p_retailprice", True, 100, "p_partkey")
    return out.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 AS net,
       CASE WHEN l_returnflag = 'R' THEN 'back' ELSE 'kept' END AS state,
       CAST(l_quantity AS BIGINT) || ' of ' || l_linenumber AS label
FROM lineitem WHERE l_quantity % 7 = 3 OR l_shipdate IS NULL""")
def table_calculate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tab.build_table(table(spark, sf_dir, "lineitem"), "l_quantity % 7 = 3 or isnull(l_shipdate)", limit=None)
    df = tab.calculate(df, "net", "round(l_extendedprice * (1 - l_discount), 2)")
    df = tab.calculate(df, "state", "if(l_returnflag = 'R', 'back', 'kept')")
    df = tab.calculate(df, "label", "concat(l_quantity, ' of ', l_linenumber)")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "net", "state", "label")


@query("""
SELECT c_custkey, floor(c_acctbal + 0.5) AS a_round, floor(c_acctbal) AS a_floor, ceil(c_acctbal) AS a_ceil, abs(c_acctbal) AS a_abs,
  CASE WHEN c_acctbal >= 0 THEN floor(sqrt(c_acctbal) * 1000 + 0.5) / 1000 END AS a_sqrt,
  least(c_acctbal, 100.0, c_custkey) AS a_min, greatest(c_acctbal, 100.0) AS a_max,
  upper(c_mktsegment) AS b_upper, lower(c_name) AS b_lower, CAST(length(c_name) AS DOUBLE) AS b_len, substr(c_name, 10, 4) AS b_substr,
  replace(c_name, '#', '-') AS b_replace, c_acctbal IS NULL AS b_null, coalesce(nullif(c_mktsegment, ''), 'none') AS b_coalesce,
  TRY_CAST(substr(c_name, 10) AS DOUBLE) AS b_number, CAST(c_nationkey AS VARCHAR) AS b_text,
  trim(' ' || c_name || '  ') AS b_trim, c_nationkey + 0.0 AS c_plus, NULL AS c_zero
FROM customer""".replace("NULL AS c_zero", "CAST(NULL AS DOUBLE) AS c_zero"))
def expression_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    made = {
        "a_round": "round(c_acctbal)", "a_floor": "floor(c_acctbal)", "a_ceil": "ceil(c_acctbal)", "a_abs": "abs(c_acctbal)",
        "a_sqrt": "round(sqrt(c_acctbal), 3)", "a_min": "min(c_acctbal, 100, c_custkey)", "a_max": "MAX(c_acctbal, 100)",
        "b_upper": "upper(c_mktsegment)", "b_lower": "Lower(c_name)", "b_len": "len(c_name)", "b_substr": "substr(c_name, 10, 4)",
        "b_replace": "replace(c_name, '#', '-')", "b_null": "isnull(c_acctbal)", "b_coalesce": 'coalesce(c_mktsegment, "none")',
        "b_number": "number(substr(c_name, 10))", "b_text": "text(c_nationkey)", "b_trim": "trim(concat(' ', c_name, '  '))",
        "c_plus": "c_nationkey + 0", "c_zero": "c_acctbal / (c_nationkey - c_nationkey)",
    }
    return df.select("c_custkey", *[compile_expression(e, df.schema).column.alias(k) for k, e in made.items()])


@query("""
SELECT o_orderkey, o_orderkey = 7 AND o_orderstatus <> 'F' OR o_totalprice > 1000 AS a_logic, true AS b_nulls, false AS c_null_value,
  substr(o_orderpriority, 1, 1) = '2' AS d_as_number, 10 < 9 AS e_numbers, '3' AS f_plus,
  o_orderstatus || '1' AS g_joined, true AS h_not_null, -(o_orderkey % 5) + 0.0 AS i_minus
FROM orders""")
def expression_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    made = {
        "a_logic": "o_orderkey = 7 and o_orderstatus <> 'F' or o_totalprice > 1000", "b_nulls": "null = null",
        "c_null_value": "null = o_orderkey", "d_as_number": "substr(o_orderpriority, 1, 1) = 2", "e_numbers": "'10' < '9'",
        "f_plus": "'1' + 2", "g_joined": "o_orderstatus + 1", "h_not_null": "not null", "i_minus": "-(o_orderkey % 5)",
    }
    return df.select("o_orderkey", *[compile_expression(e, df.schema).column.alias(k) for k, e in made.items()])


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'large' ELSE o_orderpriority END AS o_orderpriority,
  o_orderstatus AS status, 'new' AS flag FROM orders""")
def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tab.set_value(table(spark, sf_dir, "orders"), "o_orderpriority", "large", "o_totalprice > 100000")
    df = tab.rename_field(tab.add_field(df, "flag", "string", "new"), "o_orderstatus", "status")
    for name in ("o_custkey", "o_totalprice", "o_orderdate"):
        df = tab.delete_field(df, name)
    return df


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'large' END AS new_value, o_orderpriority AS old_value
FROM orders WHERE o_totalprice > 100000 AND o_orderpriority <> 'large'""")
def table_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "orders")
    after = tab.set_value(before, "o_orderpriority", "large", "o_totalprice > 100000")
    return tab.changes(before, after, "o_orderpriority", ["o_orderkey"])


@query("""
SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(p_retailprice AS BIGINT) END AS p_retailprice
FROM part""")
def table_retype(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tab.retype_field(table(spark, sf_dir, "part"), "p_size", "string")
    return tab.retype_field(df, "p_retailprice", "integer", force=True).select("p_partkey", "p_size", "p_retailprice")


@query("""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE l_quantity IS NULL) AS n_empty, count(DISTINCT l_quantity) AS n_distinct,
  min(l_quantity) AS min_value, max(l_quantity) AS max_value, round(avg(l_quantity), 6) AS mean_value, 0 AS n_not_numeric FROM lineitem""")
def table_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, _ = tab.summarise_field(table(spark, sf_dir, "lineitem"), "l_quantity", "l_orderkey")
    return facts.withColumn("mean_value", F.round("mean_value", 6))


@query("""
SELECT event_type AS value, count(*) AS n, min(event_id) AS first_row FROM events GROUP BY 1 ORDER BY n DESC, first_row LIMIT 20""")
def table_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab.summarise_field(table(spark, sf_dir, "events"), "event_type", "event_id")[1]


@query("""
SELECT field, n_empty, n_rows, n_empty / n_rows AS share_empty FROM (
  SELECT unnest(['doc_id', 'text', 'lang']) AS field, unnest([
    count(*) FILTER (WHERE doc_id IS NULL), count(*) FILTER (WHERE text IS NULL OR text = ''), count(*) FILTER (WHERE lang IS NULL OR lang = '')]) AS n_empty,
    count(*) AS n_rows FROM documents)""")
def table_field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab.field_profile(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query("""
SELECT c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment, 'customers' AS source_layer FROM customer
UNION ALL SELECT s_nationkey, s_acctbal, NULL, 'suppliers' FROM supplier""")
def layers_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("c_nationkey nation", "c_acctbal balance", "c_mktsegment segment")
    s = table(spark, sf_dir, "supplier").selectExpr("s_nationkey nation", "s_acctbal balance")
    return tab.merge_layers({"customers": c, "suppliers": s})


@query("SELECT event_type AS layer, count(*) AS n_features FROM events WHERE contains(lower(event_type), 'c') GROUP BY 1")
def layers_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab.list_layers(table(spark, sf_dir, "events").withColumnRenamed("event_type", "layer"), "C")


@query("""
SELECT c_custkey, c_mktsegment || CASE WHEN r = 1 THEN '' ELSE '-' || r END AS unique_path
FROM (SELECT *, row_number() OVER (PARTITION BY lower(c_mktsegment || c_nationkey) ORDER BY c_custkey) AS r FROM customer)""".replace("c_mktsegment || CASE", "c_mktsegment || c_nationkey || CASE"))
def paths_made_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", "c_nationkey").alias("path"))
    return tab.deduplicate_paths(df, "path", "c_custkey").select("c_custkey", "unique_path")


@query("""
SELECT event_type AS code, CAST(user_id % 3 AS VARCHAR) AS message, CAST(sum(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS count,
  arg_min(CASE WHEN value > 50 THEN 'warning' ELSE 'info' END, event_id) AS severity
FROM events GROUP BY 1, 2""")
def warnings_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("code"), (F.col("user_id") % 3).cast("string").alias("message"),
        F.when(F.col("value") > 50, "warning").otherwise("info").alias("severity"), F.when(F.col("event_id") % 2 == 0, 2).alias("count"), "event_id",
    )
    return tab.collapse_warnings(df, "event_id")


@query("""
SELECT event_type, user_id, round(1 - exp(sum(ln(1 - least(greatest(value / 5000, 0), 0.99)))), 9) AS confidence FROM events GROUP BY 1, 2""")
def evidence_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("weight", F.col("value") / 5000)
    return tab.combine_evidence(df, ["event_type", "user_id"]).withColumn("confidence", F.round("confidence", 9))


@query("""
SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 200000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'""")
def rows_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.where("o_totalprice > 200000").select("o_custkey").subtract(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def grouped_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


# Spatial joins.

_PARCEL = "(SELECT p_partkey AS idx, p_brand, p_size, p_retailprice, (p_partkey % 50) * 10.0 AS minx, floor(p_partkey / 50) * 10.0 AS miny FROM part) p"


@query(f"""
SELECT event_id, idx FROM events JOIN {_PARCEL} ON value >= minx AND value < minx + 10 AND user_id + 0.5 >= miny AND user_id + 0.5 < miny + 10""")
def points_in_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = layers.observations(spark, sf_dir).select(F.col("idx").alias("event_id"), "x", "y")
    return spatial.contained(obs, layers.parcels(spark, sf_dir), 50.0).select("event_id", "idx")


@query(f"""
SELECT event_id FROM events WHERE NOT EXISTS (SELECT 1 FROM {_PARCEL} WHERE value >= minx AND value < minx + 6 AND user_id + 0.5 >= miny AND user_id + 0.5 < miny + 6)""")
def points_outside_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = layers.observations(spark, sf_dir).select(F.col("idx").alias("event_id"), "x", "y")
    return spatial.orphans(obs, layers.parcels(spark, sf_dir, 6.0), 50.0, "event_id").select("event_id")


_INSIDE = f"{_PARCEL} LEFT JOIN events ON value >= minx AND value < minx + 10 AND user_id + 0.5 >= miny AND user_id + 0.5 < miny + 10"


@query(f"""
SELECT idx, string_agg(DISTINCT event_type, ' / ' ORDER BY event_type) AS burnt FROM {_INSIDE} GROUP BY idx""")
def burn_in_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.burn_in(layers.parcels(spark, sf_dir), layers.observations(spark, sf_dir), 50.0, "event_type", "concatenate").select("idx", "burnt")


@query(f"""
SELECT idx, CAST(burnt AS BIGINT) AS burnt FROM (
  SELECT idx, CAST(event_id AS VARCHAR) AS burnt,
    row_number() OVER (PARTITION BY idx ORDER BY sqrt((value - minx - 5) * (value - minx - 5) + (user_id + 0.5 - miny - 5) * (user_id + 0.5 - miny - 5)), event_id) AS r
  FROM {_INSIDE}) WHERE r = 1""")
def burn_in_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = layers.observations(spark, sf_dir).withColumnRenamed("idx", "event_id")
    return spatial.burn_in(layers.parcels(spark, sf_dir), obs, 50.0, "event_id").select("idx", "burnt")


@query(f"""
SELECT a.idx AS a, b.idx AS b FROM {_PARCEL.replace(") p", ") a")} JOIN {_PARCEL.replace(") p", ") b")}
ON a.idx < b.idx AND abs(a.minx - b.minx) <= 10 AND abs(a.miny - b.miny) <= 10""")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.candidate_pairs(layers.parcels(spark, sf_dir), 40.0).select("a", "b")


@query(f"""
SELECT a.idx AS a, b.idx AS b, 'overlap' AS relation FROM {_PARCEL.replace(") p", ") a")} JOIN {_PARCEL.replace(") p", ") b")}
ON a.idx < b.idx AND abs(a.minx - b.minx) = 10 AND abs(a.miny - b.miny) = 10""")
def overlapping_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spatial.candidate_pairs(layers.parcels(spark, sf_dir, 14.0), 40.0)
    return spatial.overlapping(pairs).select("a", "b", "relation")


def _balances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("lx"), (F.col("c_nationkey") * 1.0).alias("ly"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rkey"), (F.col("s_acctbal") / 100).alias("rx"), (F.col("s_nationkey") * 1.0).alias("ry"))
    return c, s


_GAP = "sqrt((c_acctbal / 100 - s_acctbal / 100) * (c_acctbal / 100 - s_acctbal / 100) + (c_nationkey - s_nationkey) * (c_nationkey - s_nationkey))"


@query(f"SELECT c_custkey, s_suppkey AS rkey, round({_GAP}, 6) AS distance FROM customer, supplier WHERE {_GAP} <= 2.5")
def points_within_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.within_distance(*_balances(spark, sf_dir), 2.5).select("c_custkey", "rkey", F.round("distance", 6).alias("distance"))


@query(f"""
SELECT c_custkey, s_suppkey AS rkey, round(gap, 6) AS distance FROM (
  SELECT c_custkey, s_suppkey, {_GAP} AS gap, row_number() OVER (PARTITION BY c_custkey ORDER BY {_GAP}, s_suppkey) AS r FROM customer, supplier) WHERE r = 1""")
def nearest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest(*_balances(spark, sf_dir), "c_custkey", 2.0).select("c_custkey", "rkey", F.round("distance", 6).alias("distance"))


# Boreholes.

_LOGS = "(SELECT l_orderkey AS hole_id, l_linenumber * 10.0 AS f, l_linenumber * 10.0 + l_quantity / 5 AS t, l_returnflag AS lithology FROM lineitem) i"


@query(f"""
SELECT o_orderkey AS hole_id, round(o_totalprice / 1000, 6) AS depth, coalesce(n, 0) AS n_intervals, top, bottom, round(logged, 6) AS logged
FROM orders LEFT JOIN (SELECT hole_id, count(*) AS n, min(f) AS top, max(t) AS bottom, sum(t - f) AS logged FROM {_LOGS} GROUP BY 1) ON hole_id = o_orderkey""")
def borehole_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = boreholes.hole_summary(layers.collars(spark, sf_dir), layers.intervals(spark, sf_dir))
    return out.withColumn("depth", F.round("depth", 6)).withColumn("logged", F.round("logged", 6))


@query("SELECT o_orderkey AS hole_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def boreholes_without_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boreholes.without_log(layers.collars(spark, sf_dir), layers.intervals(spark, sf_dir)).select("hole_id")


@query(f"SELECT hole_id, f AS from_depth FROM {_LOGS} WHERE hole_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0)")
def borehole_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    collars = layers.collars(spark, sf_dir).where("hole_id % 10 <> 0")
    return boreholes.orphan_intervals(collars, layers.intervals(spark, sf_dir)).select("hole_id", "from_depth")


@query(f"""
WITH s AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY hole_id ORDER BY f, t, lithology), 0.0) AS p FROM {_LOGS}),
e AS (SELECT hole_id, max_by(t, f * 1000 + t) AS t FROM {_LOGS} GROUP BY 1)
SELECT hole_id, CASE WHEN f - p > 1e-6 THEN 'gap' ELSE 'overlap' END AS kind, round(least(p, f), 6) AS at_from, round(greatest(p, f), 6) AS at_to FROM s WHERE abs(f - p) > 1e-6
UNION ALL SELECT hole_id, 'trailing gap', round(t, 6), round(o_totalprice / 1000, 6) FROM e JOIN orders ON o_orderkey = hole_id WHERE o_totalprice / 1000 > t + 1e-6""")
def borehole_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = boreholes.log_continuity(layers.intervals(spark, sf_dir), layers.collars(spark, sf_dir))
    return out.withColumn("at_from", F.round("at_from", 6)).withColumn("at_to", F.round("at_to", 6))


# Versions and quality.


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'removed' WHEN o_orderkey % 13 = 0 THEN 'added' ELSE 'changed' END AS change,
  CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN '' ELSE 'o_orderpriority' END AS fields
FROM orders WHERE ((o_orderkey % 11 = 0) <> (o_orderkey % 13 = 0)) OR (o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_totalprice > 150000)""")
def versions_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    before = o.where("o_orderkey % 13 <> 0")
    after = tab.set_value(o.where("o_orderkey % 11 <> 0"), "o_orderpriority", "x", "o_totalprice > 150000")
    return fidelity.difference(before, after, ["o_orderkey"])


@query("""
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'removed' WHEN event_id % 7 = 0 THEN 'added' WHEN value > 400 THEN 'moved' ELSE 'unchanged' END AS state,
  CASE WHEN event_id % 9 = 0 OR event_id % 7 = 0 THEN NULL WHEN value > 400 THEN 5.0 ELSE 0.0 END AS moved_by
FROM events WHERE NOT (event_id % 9 = 0 AND event_id % 7 = 0)""")
def versions_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = layers.observations(spark, sf_dir).select(F.col("idx").alias("event_id"), "x", "y", "value")
    shift = F.when(F.col("value") > 400, 1.0).otherwise(0.0)
    after = e.where("event_id % 9 <> 0").select("event_id", (F.col("x") + 3 * shift).alias("x"), (F.col("y") + 4 * shift).alias("y"))
    out = fidelity.overlay(e.where("event_id % 7 <> 0"), after, ["event_id"], 0.01)
    return out.withColumn("moved_by", F.round("moved_by", 6))


@query("""
SELECT v.* FROM (SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey % 100 <> 0) AS m, sum(p_size) AS s, sum(p_size) FILTER (WHERE p_partkey % 100 <> 0) AS t FROM part),
LATERAL (SELECT 'features' AS "check", CAST(n AS DOUBLE) AS source_value, CAST(m AS DOUBLE) AS output_value, CASE WHEN n = m THEN 'PASS' ELSE 'FAILED' END AS verdict
  UNION ALL SELECT 'size', CAST(s AS DOUBLE), CAST(t AS DOUBLE), CASE WHEN s - t <= 1e9 THEN 'PASS' ELSE 'FAILED' END) v""")
def versions_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    checks = {"features": (F.count(F.lit(1)), 0.0), "size": (F.sum("p_size"), 1e9)}
    return fidelity.compare(part, part.where("p_partkey % 100 <> 0"), checks)


@query("""
WITH k AS (SELECT l_orderkey, l_linenumber, min(l_partkey * 100000 + l_suppkey) AS f, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, l_partkey * 100000 + l_suppkey AS row_id FROM lineitem JOIN k USING (l_orderkey, l_linenumber) WHERE n > 1 AND l_partkey * 100000 + l_suppkey > f""")
def duplicate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("row_id", F.col("l_partkey") * 100000 + F.col("l_suppkey"))
    return fidelity.duplicate_features(df, fidelity.coordinate_key("l_orderkey", "l_linenumber"), "row_id").select("l_orderkey", "l_linenumber", "row_id")


@query("""
SELECT round((25 * 100 + 20 * 80 + 12 * (1 - least(1, sqrt(d / n))) * 100) / 57, 6) AS score, 'good' AS grade, 57 AS covered
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE c_acctbal < -990) AS d FROM customer)""")
def layer_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = fidelity.deduction(F.count_if(F.col("c_acctbal") < -990), F.count(F.lit(1)), 100.0)
    facts = table(spark, sf_dir, "customer").agg(share.alias("off"))
    rows = [("geometry", F.lit(100.0)), ("topology", F.lit(80.0)), ("duplicates", 100 - F.col("off")), ("crs", F.lit(None).cast("double"))]
    parts = facts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("part"), c.alias("score")) for k, c in rows])))
    return fidelity.health(parts).withColumn("score", F.round("score", 6))


# Geometry.


#: Plots: squares without a corner of n x n, and with a hole of 1 x 1 (see ``layers.plots``).
_PLOT = "(SELECT p_partkey AS idx, p_brand, p_size, 1.0 + p_size % 4 AS n, (p_partkey % 50) * 10.0 AS minx, floor(p_partkey / 50) * 10.0 AS miny FROM part) p"


@query(f"""
SELECT idx, 99 - n * n AS area, 44.0 AS perimeter, 12 AS vertices, round(4 * pi() * (99 - n * n) / (44 * 44), 9) AS thinness,
  round(minx + (500 - n * n * n / 2 - 6.5) / (99 - n * n), 6) AS cx, round(miny + (500 - n * n * (10 - n / 2) - 3.5) / (99 - n * n), 6) AS cy
FROM {_PLOT}""")
def plot_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    geom = F.col("geom")
    c = g.centroid(geom)
    return layers.plots(spark, sf_dir).select(
        "idx", g.area(geom).alias("area"), g.length(geom).alias("perimeter"), g.vertex_count(geom).alias("vertices"),
        F.round(g.thinness(geom), 9).alias("thinness"), F.round(c[0], 6).alias("cx"), F.round(c[1], 6).alias("cy"),
    )


@query(f"""
SELECT idx, 100.0 AS area, 40.0 AS perimeter, minx + 5 AS cx, miny + 5 AS cy, 5 AS vertices, round(pi() / 4, 9) AS thinness,
  'POLYGON ((' || CAST(minx AS BIGINT) || ' ' || CAST(miny AS BIGINT) || ', ' || CAST(minx + 10 AS BIGINT) || ' ' || CAST(miny AS BIGINT) || ', ' || CAST(minx + 10 AS BIGINT) || ' ' || CAST(miny + 10 AS BIGINT) || ', ' || CAST(minx AS BIGINT) || ' ' || CAST(miny + 10 AS BIGINT) || ', ' || CAST(minx AS BIGINT) || ' ' || CAST(miny AS BIGINT) || '))' AS wkt
FROM {_PARCEL}""")
def parcel_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    geom = F.col("geom")
    c = g.centroid(geom)
    return layers.parcels(spark, sf_dir).select(
        "idx", g.area(geom).alias("area"), g.length(geom).alias("perimeter"), c[0].alias("cx"), c[1].alias("cy"),
        g.vertex_count(geom).alias("vertices"), F.round(g.thinness(geom), 9).alias("thinness"), g.to_wkt(geom).alias("wkt"),
    )


_STEPS = """(SELECT user_id, event_id, ts, value AS x, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS y,
  lag(value) OVER w AS px, lag(extract(hour FROM ts) * 60 + extract(minute FROM ts)) OVER w AS py FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) s"""


@query(f"""
SELECT user_id, count(*) AS vertices, round(coalesce(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 0), 4) AS length,
  min(x) AS minx, CAST(min(y) AS DOUBLE) AS miny, max(x) AS maxx, CAST(max(y) AS DOUBLE) AS maxy FROM {_STEPS} GROUP BY 1""")
def track_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = g.bounds(F.col("geom"))
    return layers.tracks(spark, sf_dir).select(
        "user_id", g.vertex_count(F.col("geom")).cast("bigint").alias("vertices"), F.round(g.length(F.col("geom")), 4).alias("length"),
        *[b[k].alias(k) for k in spatial.BOX],
    )


@query(f"""
SELECT idx, minx + 100 AS tx, miny - 50 AS ty, minx - 5 AS sx, miny - 5 AS sy, minx AS rx, miny + 10 AS ry FROM {_PARCEL}""")
def parcels_transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    geom, x, y = F.col("geom"), F.col("minx") + 5, F.col("miny") + 5
    moved = {"t": g.translated(geom, 100, -50), "s": g.scaled(geom, 2.0, x, y), "r": g.rotated(geom, 90.0, x, y)}
    first = {k: g.positions(v)[0] for k, v in moved.items()}
    return layers.parcels(spark, sf_dir).select("idx", *[F.round(p[i], 6).alias(f"{k}{'xy'[i]}") for k, p in first.items() for i in (0, 1)])


@query(f"""
SELECT user_id, count(*) FILTER (WHERE px IS NULL OR abs(x - px) > 0 OR abs(y - py) > 0) AS kept, min(n) * 2 - 1 AS dense
FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM {_STEPS}) GROUP BY 1""".replace("min(n) * 2 - 1 AS dense", "CAST(sum(CASE WHEN px IS NULL THEN 1 ELSE greatest(ceil(sqrt((x - px) * (x - px) + (y - py) * (y - py)) / 25), 1) END) AS BIGINT) AS dense"))
def tracks_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return layers.tracks(spark, sf_dir).select(
        "user_id", F.size(g.without_repeats(path, 0.0)).cast("bigint").alias("kept"), F.size(g.densified(path, 25.0)).cast("bigint").alias("dense")
    )


@query(f"""
SELECT p_brand, count(*) AS parts, count(*) * 100.0 AS area, min(minx) AS minx, max(miny) + 10 AS maxy FROM {_PARCEL} GROUP BY 1""")
def parcels_multipart(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("idx", F.col("geom.parts").alias("parts"))
    parts = F.flatten(F.transform(F.array_sort(F.collect_list(at)), lambda s: s["parts"]))
    multi = layers.parcels(spark, sf_dir).groupBy("p_brand").agg(g.geometry("MultiPolygon", parts).alias("geom"))
    geom, b = F.col("geom"), g.bounds(F.col("geom"))
    return multi.select("p_brand", F.size(g.exploded(geom)).cast("bigint").alias("parts"), g.area(geom).alias("area"), b["minx"].alias("minx"), b["maxy"].alias("maxy"))


@query(f"""
SELECT idx, '[' || minx || ',' || miny || ']' AS first, true AS same FROM {_PARCEL}""")
def geojson_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = layers.parcels(spark, sf_dir).select("idx", "geom", g.to_geojson(F.col("geom")).alias("json"))
    back = g.from_geojson(F.col("json"))
    return df.select("idx", F.to_json(g.positions(back)[0]).alias("first"), (back == F.col("geom")).alias("same"))


# Coordinate reference systems.


def _places() -> tuple[Column, Column]:
    return (F.col("c_custkey") * 37 % 3600) / 10.0 - 180, (F.col("c_custkey") * 53 % 1600) / 10.0 - 80


_PLACE = "(SELECT c_custkey, (c_custkey * 37 % 3600) / 10.0 - 180 AS lon, (c_custkey * 53 % 1600) / 10.0 - 80 AS lat FROM customer) c"


_TM = f"""(SELECT *, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta FROM (
  SELECT *, sinh(atanh(sin(radians(lat))) - 2 * sqrt(n) / (1 + n) * atanh(2 * sqrt(n) / (1 + n) * sin(radians(lat)))) AS t, radians(lon - (zone * 6 - 183)) AS l
  FROM (SELECT *, CAST(least(greatest(floor((lon + 180) / 6) + 1, 1), 60) AS INTEGER) AS zone, 1 / (2 * 298.257223563 - 1) AS n FROM {_PLACE})))"""
_ALPHA = ("(n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16)", "(13 * n * n / 48 - 3 * n * n * n / 5)", "(61 * n * n * n / 240)")
_EAST = "eta + " + " + ".join(f"{a} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1))
_NORTH = "xi + " + " + ".join(f"{a} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1))
_SCALED = "0.9996 * 6378137 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64)"


@query(f"""
SELECT c_custkey, zone, round({_SCALED} * ({_EAST}) + 500000, 3) AS east, round({_SCALED} * ({_NORTH}) + CASE WHEN lat < 0 THEN 1e7 ELSE 0 END, 3) AS north,
  round(lon, 7) AS lon, round(lat, 7) AS lat FROM {_TM}""")
def utm_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = _places()
    df = table(spark, sf_dir, "customer").select("c_custkey", lon.alias("lon"), lat.alias("lat"))
    df = df.withColumn("zone", crs.utm_zone(F.col("lon")))
    east, north = crs.to_utm(F.col("lon"), F.col("lat"), F.col("zone"))
    df = df.withColumns({"east": east, "north": north})
    lon2, lat2 = crs.from_utm(F.col("east"), F.col("north"), F.col("zone"), F.col("lat") < 0)
    return df.select("c_custkey", "zone", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"), (F.round(lon2, 7) + 0.0).alias("lon"), (F.round(lat2, 7) + 0.0).alias("lat"))


@query(f"SELECT c_custkey, CAST(least(greatest(floor((lon + 180) / 6) + 1, 1), 60) AS INTEGER) AS zone, true AS returns FROM {_PLACE}")
def utm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = _places()
    df = table(spark, sf_dir, "customer").select("c_custkey", lon.alias("lon"), lat.alias("lat"))
    df = df.withColumn("zone", crs.utm_zone(F.col("lon")))
    east, north = crs.to_utm(F.col("lon"), F.col("lat"), F.col("zone"))
    df = df.withColumns({"east": east, "north": north})
    lon2, lat2 = crs.from_utm(F.col("east"), F.col("north"), F.col("zone"), F.col("lat") < 0)
    return df.select("c_custkey", "zone", ((F.abs(lon2 - F.col("lon")) < 1e-7) & (F.abs(lat2 - F.col("lat")) < 1e-7)).alias("returns"))


@query(f"""
SELECT c_custkey, round(6378137 * radians(lon), 3) AS x, round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) + 0.0 AS y,
  round(2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(10 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(20 - lon) / 2), 2)))), 2) AS distance
FROM {_PLACE}""")
def web_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = _places()
    x, y = crs.to_web_mercator(lon, lat)
    far = crs.great_circle(lon, lat, F.lit(20.0), F.lit(10.0))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(x, 3).alias("x"), (F.round(y, 3) + 0.0).alias("y"), F.round(far, 2).alias("distance"))


@query(f"SELECT c_custkey, true AS geocentric_returns, 100.0 AS moved, round((lon + 180) * 1000 / 0.3048, 3) AS feet FROM {_PLACE}")
def datum_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = _places()
    df = table(spark, sf_dir, "customer").select("c_custkey", lon.alias("lon"), lat.alias("lat"))
    x, y, z = crs.to_geocentric(F.col("lon"), F.col("lat"), F.lit(50.0))
    df = df.withColumns({"x": x, "y": y, "z": z})
    lon2, lat2, h = crs.from_geocentric(F.col("x"), F.col("y"), F.col("z"))
    u, v, w = crs.helmert(F.col("x"), F.col("y"), F.col("z"), (60.0, 0.0, 80.0))
    moved = F.sqrt(F.pow(u - F.col("x"), F.lit(2)) + F.pow(v - F.col("y"), F.lit(2)) + F.pow(w - F.col("z"), F.lit(2)))
    same = (F.abs(lon2 - F.col("lon")) < 1e-9) & (F.abs(lat2 - F.col("lat")) < 1e-9) & (F.abs(h - 50) < 1e-3)
    feet = crs.convert_length((F.col("lon") + 180), "kilometre", "foot")
    return df.select("c_custkey", same.alias("geocentric_returns"), F.round(moved, 6).alias("moved"), F.round(feet, 3).alias("feet"))


# Rasters.

_DEM = "(SELECT event_id // 64 AS row, event_id % 64 AS col, value FROM events) d"


@query(f"""
SELECT 1 AS band, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, round(avg(value), 6) AS mean_value, count(*) AS n_valid, 0 AS n_blank FROM {_DEM}""")
def raster_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.band_statistics(layers.dem(spark, sf_dir), -9999.0)
    return out.select("band", *[F.round(c, 6).alias(c) for c in ("min_value", "max_value", "mean_value")], "n_valid", "n_blank")


@query(f"""
SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(CASE WHEN s_suppkey IS NOT NULL THEN value ELSE -9999 END, 6) AS value
FROM {_DEM} LEFT JOIN supplier ON s_suppkey = row AND col >= s_suppkey % 5 * 11 AND col < s_suppkey % 5 * 11 + 10""")
def raster_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept where a supplier's box is: ten columns and one row for each."""
    x, y = (F.col("s_suppkey") % 5 * 11.0), -F.col("s_suppkey") * 1.0
    corners = [x, y - 1, x + 10, y]
    shapes = table(spark, sf_dir, "supplier").select(
        *[c.alias(k) for c, k in zip(corners, spatial.BOX, strict=True)], g.polygon(g.box(*corners)).alias("geom")
    )
    out = raster.clip_raster(layers.dem(spark, sf_dir), shapes, -9999.0)
    return out.select("row", "col", F.round("value", 6).alias("value"))


@query(f"""
SELECT CAST(row * 2 + i AS INTEGER) AS row, CAST(col * 2 + j AS INTEGER) AS col, round(value, 6) AS value FROM {_DEM}, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)""")
def raster_warped(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c: (F.col(c) + 0.5) / 2 - 0.5
    out = raster.warp(layers.dem(spark, sf_dir), 128, 2 * layers.dem_rows(spark, sf_dir), (at("col"), at("row")))
    return out.select("row", "col", F.round("value", 6).alias("value"))


@query(f"""
WITH d AS (SELECT row, col, value FROM {_DEM})
SELECT a.row AS row, a.col AS col, round(0.25 * (a.value + b.value + c.value + e.value), 10) AS value
FROM d a JOIN d b ON b.row = a.row AND b.col = a.col + 1 JOIN d c ON c.row = a.row + 1 AND c.col = a.col JOIN d e ON e.row = a.row + 1 AND e.col = a.col + 1""".replace("SELECT a.row AS row, a.col AS col", "SELECT CAST(a.row AS INTEGER) AS row, CAST(a.col AS INTEGER) AS col"))
def raster_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.warp(layers.dem(spark, sf_dir), 64, layers.dem_rows(spark, sf_dir), (F.col("col") + 0.5, F.col("row") + 0.5), "bilinear")
    return out.select("row", "col", F.round("value", 10).alias("value"))


@query(f"""
WITH d AS (SELECT row, col, value FROM {_DEM}),
q AS (SELECT a.value AS a, b.value AS b, c.value AS c, e.value AS e FROM d a JOIN d b ON b.row = a.row AND b.col = a.col + 1 JOIN d c ON c.row = a.row + 1 AND c.col = a.col JOIN d e ON e.row = a.row + 1 AND e.col = a.col + 1),
k AS (SELECT q.*, l * 50.0 AS level FROM q, range(0, 12) r(l)),
u AS (SELECT level, CAST(a >= level AS INTEGER) AS a, CAST(b >= level AS INTEGER) AS b, CAST(c >= level AS INTEGER) AS c, CAST(e >= level AS INTEGER) AS e FROM k)
SELECT level, CAST(sum(CASE WHEN a = e AND b = c AND a <> b THEN 2 WHEN a = b AND b = c AND c = e THEN 0 ELSE 1 END) AS BIGINT) AS segments FROM u GROUP BY 1
HAVING sum(CASE WHEN a = e AND b = c AND a <> b THEN 2 WHEN a = b AND b = c AND c = e THEN 0 ELSE 1 END) > 0""")
def raster_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.contour_segments(layers.dem(spark, sf_dir), 50.0).groupBy("level").agg(F.count(F.lit(1)).alias("segments"))


@query(f"""
WITH d AS (SELECT row, col, floor(value / 100) AS v FROM {_DEM}),
s AS (SELECT *, CASE WHEN lag(v) OVER w = v AND lag(col) OVER w = col - 1 THEN 0 ELSE 1 END AS n FROM d WINDOW w AS (PARTITION BY row ORDER BY col))
SELECT CAST(row AS INTEGER) AS row, CAST(v AS BIGINT) AS value, CAST(sum(n) AS BIGINT) AS runs FROM s GROUP BY 1, 2""")
def raster_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = layers.dem(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 100))
    return raster.runs_of_value(df).groupBy("row", "value").agg(F.count(F.lit(1)).alias("runs"))


@query(f"""
SELECT CAST(floor((miny) / 5) AS INTEGER) + i AS row, CAST(floor(minx / 5) AS INTEGER) + j AS col, p_size AS value FROM {_PARCEL}, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)""")
def parcels_rasterized(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = (0.0, 5.0, 0.0, 0.0, 0.0, 5.0)
    return raster.rasterize(layers.parcels(spark, sf_dir), 100, 1_000_000, "p_size", t)


# Point clouds.


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE l_linenumber IN (2, 3) AND l_quantity BETWEEN 10 AND 30 AND l_discount * 100 BETWEEN 2 AND 6 AND l_extendedprice >= 20000 AND l_partkey % 65536 <= 1000""")
def cloud_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = points.PointFilter((2, 3), (10, 2, 30, 6), min_z=20000, max_intensity=1000)
    return points.filter_points(layers.cloud(spark, sf_dir), f).select("idx.*")


@query("SELECT event_id, value FROM events WHERE event_id % 10 = 0 AND value >= 50")
def cloud_every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = layers.observations(spark, sf_dir).withColumnRenamed("value", "z")
    return points.every_nth(obs, 10.7, points.PointFilter(min_z=50)).select(F.col("idx").alias("event_id"), F.col("z").alias("value"))


@query("""
SELECT min(event_id) AS event_id FROM events GROUP BY floor(value / 25), floor((user_id + 0.5) / 25)""")
def cloud_grid_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.thin(layers.observations(spark, sf_dir).select("idx", "x", "y"), 25.0).select(F.col("idx").alias("event_id"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY floor(l_quantity / 500), floor(l_discount * 100 / 500), floor(l_extendedprice / 500) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1""")
def cloud_voxel_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.thin(layers.cloud(spark, sf_dir), 500.0, three_d=True).select("idx.*")


@query("""
SELECT count(*) AS n_points, min(l_quantity) AS min_x, max(l_quantity) AS max_x, min(l_discount * 100) AS min_y, max(l_discount * 100) AS max_y,
  min(l_extendedprice) AS min_z, max(l_extendedprice) AS max_z FROM lineitem""")
def cloud_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.cloud_summary(layers.cloud(spark, sf_dir))


@query("""
WITH m AS (SELECT event_type, median(value) AS md FROM events GROUP BY 1 HAVING count(*) >= 8),
o AS (SELECT event_id, e.event_type, abs(value - md) AS d FROM events e JOIN m USING (event_type)),
s AS (SELECT event_type, median(d) AS mad FROM o GROUP BY 1)
SELECT event_id FROM o JOIN s USING (event_type) WHERE mad > 0 AND 0.6745 * d / mad >= 1.5""")
def cloud_z_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = layers.observations(spark, sf_dir).withColumnRenamed("value", "z")
    return points.z_anomalies(obs, ["event_type"], 1.5).select(F.col("idx").alias("event_id"))


# Polygon algebra, rules and repairs.


@query(f"""
SELECT p_size, sum(99 - n * n) AS area FROM {_PLOT} GROUP BY 1""")
def parcels_dissolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = planar.dissolve(layers.plots(spark, sf_dir), "p_size", 10.0)
    return out.select("p_size", F.round(g.area(F.col("geom")), 6).alias("area"))


@query(f"""
SELECT p.minx AS x, p.miny + 10 - p.n AS y, p.n * p.n AS area FROM {_PLOT} JOIN part l ON l.p_partkey = p.idx - 1 AND p.minx > 0 JOIN part t ON t.p_partkey = p.idx + 50
UNION ALL SELECT minx + 6, miny + 3, 1.0 FROM {_PLOT}""")
def plot_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the whole layer of plots leaves open inside: cut corners between neighbours, and holes."""
    at = lambda k: F.array_min(F.transform("ring", lambda p: p[k]))
    found = planar.coverage_gaps(layers.plots(spark, sf_dir), 10.0, 0.5)
    return found.select(at(0).alias("x"), at(1).alias("y"), F.round("area", 6).alias("area"))


@query("""
WITH p AS (SELECT p_partkey AS idx, p_partkey // 3 AS grp, (p_partkey % 50) * 10 AS x, p_partkey // 50 * 10 AS y, 10 + p_size % 5 * 2 AS s FROM part),
pix AS (SELECT grp, idx, px, py FROM (SELECT *, unnest(range(x, x + s, 2)) AS px FROM p), LATERAL (SELECT unnest(range(y, y + s, 2)) AS py)),
n AS (SELECT grp, count(*) AS n, min(idx) AS lead FROM p GROUP BY 1),
cover AS (SELECT grp, px, py, count(*) AS k, bool_or(idx = lead) AS own FROM pix JOIN n USING (grp) GROUP BY ALL)
SELECT grp, 4.0 * count(*) AS either, 4.0 * count(*) FILTER (WHERE k = n) AS every, 4.0 * count(*) FILTER (WHERE own AND k = 1) AS lead_only, 4.0 * count(*) FILTER (WHERE k % 2 = 1) AS odd
FROM cover JOIN n USING (grp) GROUP BY grp""")
def parcels_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of ten to eighteen, three neighbours to a group, folded by each self-boolean."""
    df = layers.parcels(spark, sf_dir)
    side = 10.0 + F.col("p_size") % 5 * 2
    x, y = F.col("minx"), F.col("miny")
    df = df.select("idx", F.expr("idx div 3").alias("grp"), g.polygon(g.box(x, y, x + side, y + side)).alias("geom"))
    names = {"union": "either", "intersection": "every", "difference": "lead_only", "symmetric-difference": "odd"}
    out = df.select("grp").distinct()
    for op, name in names.items():
        made = planar.self_boolean(df, op, 12.0, ["grp"]).groupBy("grp").agg(F.round(F.sum(g.area(F.col("geom"))), 6).alias(name))
        out = out.join(made, "grp", "left")
    return out.fillna(0.0)


@query(f"""
WITH c AS (SELECT *, 1.5 + floor(miny / 10) % 7 AS c FROM {_PLOT}),
b AS (SELECT idx, 99 - n * n AS whole, 10 * c - n * greatest(c + n - 10, 0) - greatest(least(c, 4) - 3, 0) AS below FROM c)
SELECT idx, 0 AS part, greatest(below, whole - below) AS area FROM b UNION ALL SELECT idx, 1, least(below, whole - below) FROM b""")
def plots_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plots cut by a level line through each row of them, some of which run through the holes."""
    df = layers.plots(spark, sf_dir)
    row = F.floor(F.col("miny") / 10)
    y = F.col("miny") + 1.5 + row % 7
    lines = df.select(y.alias("y")).distinct().select(F.array(F.array(F.lit(-1.0), F.col("y")), F.array(F.lit(501.0), F.col("y"))).alias("path"))
    out = planar.split_by_lines(df, lines, 10.0)
    return out.select("idx", F.col("part").cast("int").alias("part"), F.round(g.area(F.col("geom")), 6).alias("area"))


@query("""
SELECT event_type, count(*) AS points_inside FROM events GROUP BY 1""")
def event_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = layers.observations(spark, sf_dir)
    hulls = vector.convex_hulls(obs, ["event_type"])
    # A hull holds all its points: those on its edge count by a small tolerance.
    edges = F.zip_with(F.slice("ring", 1, F.size("ring") - 1), F.slice("ring", 2, F.size("ring") - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    left = F.forall(edges, lambda e: (e["q"][0] - e["p"][0]) * (F.col("y") - e["p"][1]) - (e["q"][1] - e["p"][1]) * (F.col("x") - e["p"][0]) >= -1e-6)
    return obs.join(hulls, "event_type").where(left).groupBy("event_type").agg(F.count(F.lit(1)).alias("points_inside"))


@query(f"""
SELECT idx, w AS both, 199 - n * n - w AS either, 99 - n * n - w AS less, 199 - n * n - 2 * w AS one,
  round(139 - n * n + 5 * pi() / 4, 1) AS grown
FROM (SELECT *, 63 - greatest(n - 2, 0) * n AS w FROM {_PLOT})""")
def plots_overlaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plot with a square that begins two further east and north; and grown by one."""
    df = layers.plots(spark, sf_dir)
    x, y = F.col("minx") + 2, F.col("miny") + 2
    other = df.select("idx", g.polygon(g.box(x, y, x + 10, y + 10)).alias("geom"))
    names = {"intersection": "both", "union": "either", "difference": "less", "symmetric-difference": "one"}
    made = planar.overlaid(df, other, "idx", list(names), 10.0)
    area = F.round(g.area(F.col("geom")), 6)
    wide = made.groupBy("idx").agg(*[F.max(F.when(F.col("operation") == op, area)).alias(k) for op, k in names.items()])
    grown = vector.spread(df, "idx").select("idx", F.round(g.area(vector.buffer_column(F.col("geom"), 1.0, 0.002)), 1).alias("grown"))
    return wide.join(grown, "idx")


@query(f"""
SELECT idx, 25.0 AS both, 175.0 AS either, 75.0 AS less, 150.0 AS one FROM {_PARCEL}""")
def parcels_overlaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each parcel with itself moved by half its side."""
    df = vector.spread(layers.parcels(spark, sf_dir), "idx")
    a = F.col("geom")
    moved = g.translated(a, 5, 5)
    ops = {"both": "intersection", "either": "union", "less": "difference", "one": "symmetric-difference"}
    return df.select("idx", *[F.round(g.area(vector.overlay_columns(a, moved, op)), 6).alias(k) for k, op in ops.items()])


@query(f"""
SELECT idx, unnest(CASE p_size % 5 WHEN 0 THEN ['wrong orientation'] WHEN 1 THEN ['repeated vertices'] WHEN 2 THEN ['open ring']
  WHEN 3 THEN ['hole outside shell'] ELSE ['self-intersection'] END) AS issue FROM {_PLOT}""")
def topology_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every plot is spoilt in one of five ways, by its size."""
    shell, hole, kind = F.get(F.get("geom.parts", 0), 0), F.get(F.get("geom.parts", 0), 1), F.col("p_size") % 5
    n = F.size(shell)
    # The third and the fifth vertex change places: two edges cross.
    swapped = F.transform(shell, lambda p, i: F.when(i == 2, F.get(shell, 4)).when(i == 4, F.get(shell, 2)).otherwise(p))
    outside = F.transform(hole, lambda p: F.array(p[0] + 100, p[1]))
    spoilt = (
        F.when(kind == 0, F.array(F.reverse(shell), hole))
        .when(kind == 1, F.array(F.concat(F.slice(shell, 1, 2), F.slice(shell, 2, n)), hole))
        .when(kind == 2, F.array(F.slice(shell, 1, n - 1), hole))
        .when(kind == 3, F.array(shell, outside))
        .otherwise(F.array(swapped))
    )
    df = layers.plots(spark, sf_dir).withColumn("geom", g.geometry("Polygon", F.array(spoilt)))
    return rules.topology_issues(df)


@query(f"""
SELECT idx, 100 - n * n AS area, 12 AS vertices, true AS closed FROM {_PLOT}""")
def parcels_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = g.map_rings(F.col("geom"), lambda r, _: F.reverse(F.concat(F.slice(r, 1, 2), F.slice(r, 2, F.size(r) - 2))))
    geom = F.col("fixed")
    df = layers.plots(spark, sf_dir).withColumn("fixed", rules.repaired(broken))
    ring = g.rings(geom)[0]
    return df.select("idx", g.signed_area(ring).alias("area"), g.vertex_count(geom).alias("vertices"), g.is_closed(ring).alias("closed"))


@query(f"""
SELECT idx FROM {_PARCEL} WHERE NOT EXISTS (SELECT 1 FROM events WHERE value >= minx AND value < minx + 10 AND user_id + 0.5 >= miny AND user_id + 0.5 < miny + 10)""")
def rule_must_contain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.must_contain(layers.parcels(spark, sf_dir), layers.observations(spark, sf_dir), 50.0).select("idx")


@query("""
SELECT 'parcels must not overlap' AS rule, (SELECT count(*) FROM part) AS subjects, count(*) AS violations, CASE WHEN count(*) = 0 THEN 'passed' ELSE 'failed' END AS verdict
FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND abs(a.p_partkey % 50 - b.p_partkey % 50) = 1 AND abs(a.p_partkey // 50 - b.p_partkey // 50) = 1""")
def rule_must_not_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels of 14 by 14 on a grid of 10: those that meet at a corner cross properly."""
    parcels = layers.parcels(spark, sf_dir, 14.0)
    return rules.evaluated("parcels must not overlap", parcels, rules.must_not_overlap(parcels, 40.0))


@query(f"""
SELECT 'Polygon' AS type, count(*) AS features, count(*) * 5 AS vertices, min(minx) AS minx, max(miny) + 10 AS maxy FROM {_PARCEL}""")
def layer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.profile(layers.parcels(spark, sf_dir))


@query(f"""
SELECT user_id, count(*) AS vertices, true AS ends_stay FROM events GROUP BY 1""")
def tracks_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, smooth = F.col("path"), F.col("smooth")
    df = layers.tracks(spark, sf_dir).withColumn("smooth", g.smoothed(F.col("path")))
    same = (F.get(smooth, F.lit(0)) == F.get(path, F.lit(0))) & (F.element_at(smooth, -1) == F.element_at(path, -1))
    # Two vertices for each edge; the outer two become the line's ends.
    n = F.when(F.size(path) > 1, F.floor(F.size(smooth) / 2) + 1).otherwise(F.lit(1))
    return df.select("user_id", n.cast("bigint").alias("vertices"), F.when(F.size(path) > 1, same).otherwise(F.lit(True)).alias("ends_stay"))


# Files: written by Spark to the shared folder, and read again.


def _folder(spark: SparkSession) -> str:
    return shared_path(spark, "files")


@query("SELECT p_partkey AS idx, p_brand, (p_partkey % 50) * 10.0 + 5 AS cx FROM part")
def files_geojson_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    text_vector.write_geojsonl(layers.parcels(spark, sf_dir).select("idx", "geom", "p_brand"), path, id_col="idx")
    back = text_vector.read_geojsonl(spark, path)
    return back.select(F.col("id").cast("bigint").alias("idx"), F.col("properties")["p_brand"].alias("p_brand"), g.centroid(F.col("geom"))[0].alias("cx"))


@query("SELECT count(*) AS features, sum((p_partkey % 50) * 10.0) AS minx, count(*) * 100.0 AS area FROM part")
def files_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    text_vector.write_wkt(layers.parcels(spark, sf_dir), path)
    geom = F.col("geom")
    return text_vector.read_wkt(spark, path).agg(F.count(F.lit(1)).alias("features"), F.sum(g.bounds(geom)["minx"]).alias("minx"), F.sum(g.area(geom)).alias("area"))


@query("SELECT p_partkey AS idx, p_retailprice, 100.0 AS area FROM part")
def files_geoparquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    binary_vector.write_geoparquet(layers.parcels(spark, sf_dir), path)
    return binary_vector.read_geoparquet(spark, path).select("idx", "p_retailprice", g.area(F.col("geom")).alias("area"))


@query("SELECT c_custkey AS id, c_acctbal AS easting, CAST(c_nationkey AS DOUBLE) AS northing, c_mktsegment AS code, 'easting,northing,id,code' AS roles FROM customer")
def files_csv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    c = table(spark, sf_dir, "customer")
    # Each part has the header; the reader drops it wherever it stands.
    c.select(F.col("c_custkey").alias("Pt"), F.col("c_acctbal").alias("Easting"), F.col("c_nationkey").alias("Northing"), F.col("c_mktsegment").alias("Code")).write.option("header", True).csv(path)
    df, roles = tables.read_csv_table(spark, path)
    named = ",".join({"x": "easting", "y": "northing", "id": "id", "code": "code"}[r] for r in ("x", "y", "id", "code") if r in roles)
    return df.select(
        F.col(roles["id"]).cast("bigint").alias("id"), F.col(roles["x"]).alias("easting"), F.col(roles["y"]).alias("northing"), F.col(roles["code"]).alias("code"), F.lit(named).alias("roles")
    )


@query("SELECT count(*) AS points, sum(l_quantity) AS x, round(sum(l_extendedprice), 2) AS z FROM lineitem")
def files_xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    tables.write_xyz(layers.cloud(spark, sf_dir), path)
    return tables.read_xyz(spark, path).agg(F.count(F.lit(1)).alias("points"), F.sum("x").alias("x"), F.round(F.sum("z"), 2).alias("z"))


@query("SELECT CAST(l_linenumber AS INTEGER) AS classification, count(*) AS points, sum(CAST(l_partkey % 65536 AS BIGINT)) AS intensity, round(sum(l_quantity), 1) AS x FROM lineitem GROUP BY 1".replace("sum(CAST(l_partkey % 65536 AS BIGINT))", "CAST(sum(l_partkey % 65536) AS BIGINT)"))
def files_las(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    splittable.write_las(layers.cloud(spark, sf_dir), path, 100_000)
    # A file of a hundred thousand points is read by several tasks; the filter reaches the files' headers.
    back = splittable.read_las(spark, path, 30_000).where("z >= 0")
    return back.groupBy("classification").agg(F.count(F.lit(1)).alias("points"), F.sum("intensity").alias("intensity"), F.round(F.sum("x"), 1).alias("x"))


@query(f"SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(value, 6) AS value FROM {_DEM}")
def files_ascii_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    tables.write_ascii_grid(layers.dem(spark, sf_dir), path, tables.Grid(64, layers.dem_rows(spark, sf_dir), 1.0, 0.0, 0.0, -9999.0))
    back, _ = tables.read_ascii_grid(spark, path)
    return back.where("value <> -9999").select("row", F.col("col").cast("int").alias("col"), F.round("value", 6).alias("value"))


@query(f"SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, value FROM {_DEM} WHERE row >= 5")
def files_geotiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster as a mosaic of files of twenty rows, read back strip by strip below its fifth row."""
    path = _folder(spark)
    splittable.write_geotiff(layers.dem(spark, sf_dir), path, 64, layers.dem_rows(spark, sf_dir), (0.0, 1.0, 0.0, 0.0, 0.0, -1.0), 20)
    back = splittable.read_geotiff(spark, path, 64 * 20)
    # Each file begins at the row that its name says.
    top = F.regexp_extract("path", r"rows-(\d+)-", 1).cast("int")
    return back.withColumn("row", top + F.col("row")).where("row >= 5 and value <> -9999").select("row", "col", "value")


# Components, programs and detection.


@query(f"""
WITH RECURSIVE d AS (SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CAST(floor(value / 40) AS INTEGER) AS v FROM {_DEM}),
r(row, col, v, root) AS (
  SELECT row, col, v, row * 1000 + col FROM d
  UNION SELECT d.row, d.col, d.v, r.root FROM r JOIN d ON d.v = r.v AND abs(d.row - r.row) + abs(d.col - r.col) = 1),
m AS (SELECT row, col, v, min(root) AS root FROM r GROUP BY 1, 2, 3)
SELECT CAST(v AS BIGINT) AS value, count(*) AS cells, root // 1000 AS row0 FROM m GROUP BY v, root""")
def raster_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = layers.dem(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 40))
    return components.raster_regions(df).select("value", "cells", F.col("row0").cast("int").alias("row0"))


@query(f"""
SELECT min(idx) OVER (PARTITION BY idx % 50 // 10) AS component, idx FROM {_PARCEL}""")
def adjacent_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth column is narrower, so blocks of ten columns share edges."""
    df = layers.parcels(spark, sf_dir)
    x1 = F.col("maxx") - F.when(F.col("idx") % 10 == 9, 1.0).otherwise(0.0)
    df = df.withColumn("geom", g.polygon(g.box(F.col("minx"), F.col("miny"), x1, F.col("maxy"))))
    return components.adjacent_groups(df, 40.0).select("idx", "component")


@query("""
SELECT o_orderkey, upper(o_orderstatus) || '-' || CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS label,
  'orders-' || o_orderpriority AS layer FROM orders WHERE o_totalprice > 1000""")
def edits_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("layer", F.lit("orders"))
    flow = edits.Workflow("labels", [
        {"kind": "filter", "expression": "o_totalprice > 1000"},
        {"kind": "add-field", "field": "size", "type": "string", "initial": "small"},
        {"kind": "set-value", "field": "size", "value": "big", "scope": "o_totalprice > 100000"},
        {"kind": "calculate", "field": "label", "expression": "concat(upper(o_orderstatus), '-', size)"},
        {"kind": "split-layer", "layer": "orders", "field": "o_orderpriority"},
    ])
    again = edits.Workflow.from_json(flow.to_json())
    return again.run(df, confirmed={0}).select("o_orderkey", "label", "layer")


@query("""
SELECT doc_id AS path, CASE WHEN doc_id % 3 = 2 THEN 'missing' WHEN doc_id % 3 = 1 THEN 'changed' ELSE 'matched' END AS state FROM documents""".replace("doc_id AS path", "CAST(doc_id AS VARCHAR) AS path"))
def sources_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("File"), "doc_id").alias("name"), F.sha2(F.concat_ws("|", "doc_id", "text"), 256).alias("sha256"), "doc_id"
    )
    supplied = docs.where("doc_id % 3 <> 2").select("path", F.upper("name").alias("name"), F.when(F.col("doc_id") % 3 == 0, F.col("sha256")).otherwise(F.lit("x")).alias("sha256"))
    return edits.match_sources(docs.drop("doc_id"), supplied).select("path", "state")


_KIND = "['html', 'geojson', 'txt', 'kml', 'gpx', 'las'][1 + CAST(page_id % 6 AS INTEGER)]"


@query(f"""
SELECT id, format, round(confidence, 9) AS confidence, coalesce(confidence < 0.6, true) AS needs_confirmation FROM (
  SELECT page_id AS id, CASE {_KIND} WHEN 'html' THEN NULL WHEN 'txt' THEN 'csv' ELSE {_KIND} END AS format,
    CASE {_KIND} WHEN 'html' THEN NULL WHEN 'txt' THEN 0.35 WHEN 'las' THEN 1 - 0.65 * 0.5 WHEN 'geojson' THEN 1 - 0.65 * 0.15 ELSE 1 - 0.65 * 0.2 END AS confidence FROM pages)""")
def formats_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's bytes, as they are or inside of another format, under a name of that format."""
    k = F.col("page_id") % 6
    html = F.col("html")
    quoted = F.to_json(F.struct(html.alias("html")))
    name = F.element_at(F.array(*[F.lit(x) for x in ("html", "geojson", "txt", "kml", "gpx", "las")]), (k + 1).cast("int"))
    body = (
        F.when(k == 1, F.concat(F.lit('{"type": "FeatureCollection", "features": [], "page": '), quoted, F.lit("}")))
        .when(k == 3, F.concat(F.lit('<kml xmlns="x"><!--'), F.replace(html, F.lit("-->"), F.lit("")), F.lit("--></kml>")))
        .when(k == 4, F.concat(F.lit('<gpx version="1.1"><desc>'), F.replace(F.replace(html, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</desc></gpx>")))
        .when(k == 5, F.concat(F.lit("LASF"), html))
        .otherwise(html)
    )
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("in/"), "page_id", F.lit("."), name).alias("path"), body.cast("binary").alias("content"))
    out = detect.detected(files)
    return out.select(F.regexp_extract("path", r"(\d+)\.", 1).cast("bigint").alias("id"), "format", F.round("confidence", 9).alias("confidence"), "needs_confirmation")


# Surveying.


#: The third flattening of WGS 84, and the length of the meridian from the equator to a latitude (in radians).
_N = "(1 / (2 * 298.257223563 - 1))"
_ARC = "(6378137.0 / (1 + n) * ((1 + n * n / 4 + n * n * n * n / 64) * p - 3.0 / 2 * (n - n * n * n / 8) * sin(2 * p) + 15.0 / 16 * (n * n - n * n * n * n / 4) * sin(4 * p) - 35.0 / 48 * n * n * n * sin(6 * p) + 315.0 / 512 * n * n * n * n * sin(8 * p)))"


@query(f"""
SELECT c_custkey, CASE WHEN abs(lon) < 179 THEN round(6378137 * abs(radians(lon)), 3) END AS on_equator,
  round(abs({_ARC.replace("p)", "radians(lat))").replace("* p -", "* radians(lat) -")} - {_ARC.replace("p)", "radians(10))").replace("* p -", "* radians(10) -")}), 3) AS on_meridian
FROM {_PLACE}, (SELECT {_N} AS n)""")
def geodesic_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Along the equator, where the distance is the radius times the angle, and along a meridian, whose length has a series."""
    lon, lat = _places()
    df = table(spark, sf_dir, "customer").select("c_custkey", lon.alias("lon"), lat.alias("lat"))
    zero, ten = F.lit(0.0), F.lit(10.0)
    df = df.withColumns({"e": survey.geodesic(F.col("lon"), zero, zero, zero), "m": survey.geodesic(F.col("lon"), F.col("lat"), F.col("lon"), ten)})
    return df.select("c_custkey", F.when(F.abs("lon") < 179, F.round("e.distance", 3)).alias("on_equator"), F.round("m.distance", 3).alias("on_meridian"))


@query(f"SELECT idx, minx + 5 AS x, miny + 5 AS y, 5.0 AS clearance, length(p_brand) * 0.6 <= 5 AS fits FROM {_PARCEL}")
def parcel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vector.spread(layers.parcels(spark, sf_dir), "idx").withColumn("at", survey.label_places(F.col("geom")))
    return df.select("idx", *[F.round(f"at.{c}", 6).alias(c) for c in ("x", "y", "clearance")], survey.fits(F.col("p_brand"), 2.0, F.col("at.clearance")).alias("fits"))


@query(f"""
WITH p AS (SELECT c_custkey, s_suppkey, {_GAP} AS gap, s_acctbal / 100 AS sx, row_number() OVER (PARTITION BY c_custkey ORDER BY {_GAP}, s_suppkey) AS r FROM customer, supplier WHERE {_GAP} <= 1.5)
SELECT c_custkey, round(coalesce(sx, c_acctbal / 100), 6) AS x, round(coalesce(gap, 0), 6) AS moved_by FROM customer LEFT JOIN (SELECT * FROM p WHERE r = 1) USING (c_custkey)""")
def points_snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _balances(spark, sf_dir)
    out = survey.snapped(c.withColumnsRenamed({"lx": "x", "ly": "y"}), s, 1.5, "c_custkey")
    return out.select("c_custkey", F.round("x", 6).alias("x"), F.round("moved_by", 6).alias("moved_by"))


@query("""
SELECT o_orderpriority AS layer, regexp_replace(o_orderpriority, '[^\\w-]+', '_', 'g') AS file, count(*) AS features, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS parts FROM orders GROUP BY 1""")
def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.manifest(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "layer"), units=1000)


@query("""
SELECT * FROM (VALUES ('geojson', 'coordinates are reprojected', 'adapted'), ('shapefile', 'field names are cut', 'adapted'), ('kml', 'coordinates are reprojected', 'adapted'),
  ('gpx', 'attributes are dropped; coordinates are reprojected', 'lossy'), ('wkt', 'attributes are dropped', 'lossy'), ('dxf', 'attributes are dropped', 'lossy'),
  ('csv', '', 'full'), ('xyz', 'attributes are dropped', 'lossy'), ('flatgeobuf', '', 'full')) v(format, losses, grade)""")
def export_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    parcels = layers.parcels(spark, sf_dir)
    names = [c for c in parcels.columns if c != "geom"]
    profile = parcels.agg(
        F.count_distinct("geom.type").alias("n_types"), F.lit(len(names)).alias("n_fields"), F.lit(max(map(len, names))).alias("longest_name")
    )
    return survey.predicted_losses(profile)


# The queries of surveying and of exchange formats register themselves, too.
from plumbline.plans import exchange, land  # noqa: E402

__all__ = ["ORACLES", "QUERIES", "exchange", "land"]
