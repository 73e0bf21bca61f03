"""What the text operators share: tables, folds, Arrow batches in small slices."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

TOKENIZERS = None  # the folder of the public vocabulary files; None asks the installed package, where the task runs
SLICE = 512  # documents held as Python objects at a time
BLANKS = r"\x20\x09-\x0D"  # what separates words
WORD = rf"[^{BLANKS}]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(doc_id: str, k: int) -> Column:
    """crc32 of the id written as text, mod k (NULL for a NULL id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % k


def lower(raw: bytes | None) -> bytes:
    """A-Z lower-cased, every other byte as it is."""
    return (raw or b"").lower()


@contextmanager
def steady() -> Iterator[None]:
    """No search for reference cycles meanwhile: caches of many small objects would be walked again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def over_batches(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict | None], start: Callable[[], Callable] | None = None) -> DataFrame:
    """``fn`` on slices of at most ``SLICE`` rows; it returns columns by name.

    ``start`` builds ``fn`` once per task where it needs a model or a cache.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start() if start else fn
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                with steady():
                    got = work(b.slice(i, SLICE))
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def raw(b: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    return b.column(name).cast(pa.binary()).to_pylist()
