"""Shared helpers: input rows, bounded chunks inside a task, one row id per written row."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from flowlens.session import cut_dir, ship

CHUNK_BYTES = 4 << 20
#: Text that is encoded at once; numpy holds some fifteen times as much meanwhile.
ENCODE_BYTES = 2 << 20


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", null_text: str | None = "") -> DataFrame:
    """Only (doc_id, text), so no other column of the input can clash. A null text becomes ``null_text``."""
    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       (text if null_text is None else F.coalesce(text, F.lit(null_text))).alias("text"))


def content_key(text: Column) -> Column:
    """Second half of a row's key: rows equal in id and text are interchangeable, others differ here."""
    return F.xxhash64(text)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def ranges(sizes: Iterable[int], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``size`` bytes each; a longer row is a range of its own."""
    start = held = end = 0
    for i, own in enumerate(sizes):
        if held and held + own > size:
            yield start, i
            start, held = i, 0
        held += own
        end = i + 1
    if start < end:
        yield start, end


def chunks(texts: list[bytes], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``size`` bytes each; a longer text is a range of its own."""
    return ranges(map(len, texts), size)


def pieces(batch: pa.RecordBatch, size: int = CHUNK_BYTES, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of text, so that Python holds no more of it at once."""
    for a, b in ranges(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(), size):
        yield batch.slice(a, b - a)


def row_numbers() -> Iterator[int]:
    """Ids that no other task gives; stable only once written."""
    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 36
    i = 0
    while True:
        yield base + i
        i += 1


def cut_observed(df: DataFrame, measures: dict[str, str]) -> tuple[DataFrame, dict]:
    """Write the rows to the shared folder and read them back, with aggregates taken while they were written."""
    path = f"{cut_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, *[F.expr(sql).alias(name) for name, sql in measures.items()]).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), dict(seen.get)
