"""How sides of joins are dealt out."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join on equal columns that both sides are shuffled and sorted for.

    Spark guesses sizes from files, and its guess is far too low where files are compressed well, where shapes are
    made of a few numbers, and where rows are exploded. It would send such a side through the driver to every executor.
    """
    return df.hint("merge")
