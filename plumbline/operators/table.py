"""Attribute tables: query, columns, values, layers and their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.expression import TEXT, Value, compile_expression, filtered, kind_of, to_number, to_text


class Refused(ValueError):
    """An operation that would lose data or be ambiguous, and why."""


def value_of(df: DataFrame, name: str) -> Value:
    f = df.schema[name]
    kind = kind_of(f.dataType)
    return Value(F.col(name).cast("string") if kind == TEXT else F.col(name), kind)


def searched(df: DataFrame, needle: str, columns: list[str] | None = None) -> DataFrame:
    """Rows in which any column's text has the needle, in either case."""
    named = columns or df.columns
    low = F.lit(needle.lower())
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(to_text(value_of(df, c))), low), F.lit(False)) for c in named]))


def sort_keys(df: DataFrame, name: str, descending: bool = False) -> list[Column]:
    """Empty values last either way; numbers, and text that reads as one, by value; then text."""
    v = value_of(df, name)
    number, text = to_number(v), to_text(v)
    empty = v.col.isNull() | (text == "")
    keys = [number, F.lower(text), text]
    return [empty, number.isNull(), *[k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys]]


def build_table(
    df: DataFrame,
    filter: str | None = None,  # noqa: A002
    search: str | None = None,
    sort_by: str | None = None,
    descending: bool = False,
    limit: int | None = 2000,
    row_id: str = "idx",
) -> DataFrame:
    """Filter, search, sort, limit, in this order. An expression that can't be read matches nothing.

    A sort with a limit is one ``TakeOrderedAndProject``: each task passes on ``limit`` rows.
    Without a limit all rows stay, and without a sort as well nothing moves.
    """
    out = filtered(df, filter) if filter else df
    out = searched(out, search) if search else out
    keys = sort_keys(out, sort_by, descending) if sort_by else []
    ids = [F.col(row_id)] if row_id in df.columns else []
    if limit is None:
        return out.orderBy(*keys, *ids) if keys else out
    order = [*keys, *ids]
    return (out.orderBy(*order) if order else out).limit(limit)


def set_value(df: DataFrame, name: str, value: object, scope: str | None = None) -> DataFrame:
    """A constant for the rows in scope (an expression; all rows without one)."""
    where = compile_expression(scope, df.schema).condition if scope else F.lit(True)
    return df.withColumn(name, F.when(where, F.lit(value).cast(df.schema[name].dataType)).otherwise(F.col(name)))


def calculate(df: DataFrame, name: str, source: str, scope: str | None = None) -> DataFrame:
    """The field calculator; a new field gets the expression's type."""
    made = compile_expression(source, df.schema).column
    if name not in df.columns:
        return df.withColumn(name, made)
    where = compile_expression(scope, df.schema).condition if scope else F.lit(True)
    return df.withColumn(name, F.when(where, made.try_cast(df.schema[name].dataType)).otherwise(F.col(name)))


def changes(before: DataFrame, after: DataFrame, name: str, key: list[str]) -> DataFrame:
    """The change log of one column: rows of which the value differs."""
    b = before.select(*key, F.col(name).cast("string").alias("old_value"))
    a = after.select(*key, F.col(name).cast("string").alias("new_value"))
    return b.join(a, key).where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def add_field(df: DataFrame, name: str, kind: str, initial: object = None) -> DataFrame:
    if not name.strip():
        raise Refused("a field needs a name")
    if name in df.columns:
        raise Refused(f"there is a field {name!r} already")
    return df.withColumn(name, F.lit(initial).cast(kind))


def delete_field(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise Refused(f"there is no field {name!r}")
    return df.drop(name)


def rename_field(df: DataFrame, name: str, to: str) -> DataFrame:
    """The old name stays as metadata of the column."""
    if to in df.columns and to != name:
        raise Refused(f"there is a field {to!r} already")
    return df.withColumn(name, F.col(name).alias(name, metadata={"source_name": name})).withColumnRenamed(name, to)


#: What reads as true and as false.
TRUE, FALSE = ("true", "yes", "y", "1", "t"), ("false", "no", "n", "0", "f")


def converted(v: Value, kind: str) -> Column:
    """A value as ``string``, ``number``, ``integer`` (no fraction is cut off), ``boolean`` or ``date``."""
    text, number = to_text(v), to_number(v)
    if kind == "string":
        return text
    if kind == "number":
        return number
    if kind == "integer":
        return F.when(number == F.floor(number), number.cast("bigint"))
    if kind == "boolean":
        low = F.lower(F.trim(text))
        return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    return text.try_cast("date")


def retype_field(df: DataFrame, name: str, kind: str, force: bool = False) -> DataFrame:
    """Refused if any value would be lost, which costs one pass over the column; forced, these become null."""
    made = converted(value_of(df, name), kind)
    if not force:
        filled = F.col(name).isNotNull() & (F.col(name).cast("string") != "")
        lost = df.where(filled & made.isNull()).limit(1).count()
        if lost:
            raise Refused(f"not every value of {name!r} is a {kind}")
    return df.withColumn(name, made)


def summarise_field(df: DataFrame, name: str, row_id: str = "idx", top: int = 20) -> tuple[DataFrame, DataFrame]:
    """One row of counts and number statistics; and the commonest values, ties by first row."""
    v = value_of(df, name)
    text, number = to_text(v), to_number(v)
    filled = v.col.isNotNull() & (text != "")
    facts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~filled | v.col.isNull()).alias("n_empty"),
        F.count_distinct(F.when(filled, text)).alias("n_distinct"),
        F.min(number).alias("min_value"),
        F.max(number).alias("max_value"),
        F.avg(number).alias("mean_value"),
        F.count_if(filled & number.isNull()).alias("n_not_numeric"),
    )
    common = (
        df.where(filled)
        .groupBy(text.alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("first_row"))
        .orderBy(F.desc("n"), "first_row")
        .limit(top)
    )
    return facts, common


def field_profile(df: DataFrame) -> DataFrame:
    """For each field, how many values are empty, and their share; one pass."""
    parts = [
        F.struct(F.lit(c).alias("field"), F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias("n_empty"), F.count(F.lit(1)).alias("n_rows"))
        for c in df.columns
    ]
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x")).withColumn("share_empty", F.try_divide("n_empty", "n_rows"))


def merge_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """All rows by field name, missing fields null, each with its ``source_layer``."""
    named = [df.withColumn("source_layer", F.lit(k)) for k, df in layers.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def list_layers(df: DataFrame, search: str = "", layer: str = "layer") -> DataFrame:
    return df.where(F.contains(F.lower(layer), F.lit(search.lower()))).groupBy(layer).agg(F.count(F.lit(1)).alias("n_features"))


def deduplicate_paths(df: DataFrame, path: str, row_id: str = "idx") -> DataFrame:
    """A suffix for every later row of a path that differs in case only or not at all."""
    rank = F.row_number().over(Window.partitionBy(F.lower(path)).orderBy(row_id))
    return df.withColumn("unique_path", F.when(rank == 1, F.col(path)).otherwise(F.concat(path, F.lit("-"), rank)))


def collapse_warnings(warnings: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each code and message; missing counts are 1; the severity is that of the first by ``order`` (or the least)."""
    severity = F.min_by("severity", order) if order else F.min("severity")
    return warnings.groupBy("code", "message").agg(F.sum(F.coalesce("count", F.lit(1))).alias("count"), severity.alias("severity"))


def combine_evidence(df: DataFrame, by: list[str], weight: str = "weight") -> DataFrame:
    """Noisy-or: the share by which at least one piece of evidence holds, weights within 0 and 0.99."""
    w = F.least(F.greatest(F.col(weight), F.lit(0.0)), F.lit(0.99))
    return df.groupBy(*by).agg((1 - F.exp(F.sum(F.log1p(-w)))).alias("confidence"))


def derive_types(df: DataFrame) -> T.StructType:
    """The schema as the table model names it: string, number, integer, boolean, date."""
    names = {"bigint": "integer", "int": "integer", "smallint": "integer", "double": "number", "float": "number", "boolean": "boolean", "date": "date"}
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {"kind": names.get(f.dataType.simpleString(), "string")}) for f in df.schema.fields])
