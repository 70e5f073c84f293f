"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """The whole row as one struct ``_row`` beside ``keys``, so that no column name can clash."""
    return df.select(*[c.alias(name) for name, c in keys.items()], F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"))


def word_count(text: str | Column) -> Column:
    """Number of words of a text column; 0 for null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: str | Column) -> Column:
    """Rows no model may learn from: crc32 of the id's text leaves 2 when divided by 4.

    A null id is not held out, and :func:`may_learn` excludes it from training as well.
    """
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(column.cast("string")), F.lit(4)) == 2, F.lit(False))


def may_learn(doc_id: str | Column) -> Column:
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return column.isNotNull() & ~held_out(column)


def text_slices(batch: pa.RecordBatch, max_chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``max_chars`` bytes of ``text`` each.

    Rows are never cut: one longer text is a slice of its own.
    """
    column = batch.column(batch.schema.get_field_index("text"))
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0))
    if len(sizes) == 0:
        return
    slot = (np.cumsum(sizes, dtype=np.int64) - 1).clip(0) // max_chars
    edges = np.flatnonzero(np.diff(slot)) + 1
    for start, stop in zip([0, *edges], [*edges, len(sizes)], strict=True):
        yield batch.slice(start, stop - start)
