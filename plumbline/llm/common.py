"""What several operators of this subpackage share: words, columns made from Arrow batches, storage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.storage import kept_now, released, shared_path, stored

__all__ = ["ascii_lower", "kept_now", "released", "shared_path", "stored", "texts_of", "with_columns", "words_of"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Byte tables for ``bytes.translate``. The word rule of the contracts is
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: ASCII digits and
#: letters, and every byte of a multi-byte UTF-8 sequence. All else separates.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: Lower-cases A-Z and leaves other bytes.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def texts_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and where each row begins and ends; null is empty."""
    joined = column.cast(pa.large_string()).fill_null("").combine_chunks()
    if isinstance(joined, pa.ChunkedArray):
        joined = pa.concat_arrays(joined.chunks) if joined.num_chunks else pa.array([], pa.large_string())
    edges = np.frombuffer(joined.buffers()[1] or b"\0" * 8, np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` is the quick way where a text is all ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def with_columns(docs: DataFrame, new: T.StructType, make: Callable[[pa.RecordBatch], list], rows: int = 256) -> DataFrame:
    """``docs`` with the columns ``new``, which ``make`` computes from Arrow batches of few rows.

    Columns of ``docs`` with the same names are replaced; all others pass unchanged.
    """
    names = set(new.fieldNames())
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(new)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                made = make(batch)
                arrays = [pa.array(v, type=f.type) for v, f in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(f.name) for f in kept), *arrays], names=[f.name for f in schema.fields]
                )

    return docs.mapInArrow(run, schema)
