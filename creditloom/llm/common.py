"""Helpers shared by the training-text operators."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Null document ids sort after every other id: such a row is never the
#: smaller one of a pair. The value is turned back into null on output.
NULL_ID = np.iinfo(np.int64).max
#: Upper bound of text handled at once inside a task, in bytes.
SLICE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) of any table, and the ``keep`` columns under names of their
    own (``keep_0``, ...), so they clash with nothing; whatever else it holds is pruned from the scan."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])


def kept_schema(docs: DataFrame, keep: tuple[str, ...]) -> str:
    """The ``keep`` columns as the end of a schema string."""
    return "".join(f", keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))


def named_back(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return df.withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(keep)})


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def single_threaded() -> None:
    """One thread per task: Spark already runs a task per core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def texts_of(column: pa.Array) -> list[str]:
    """Texts with null read as empty."""
    return [t if t is not None else "" for t in column.to_pylist()]


def give_back() -> None:
    """Freed memory goes back to the system: a worker outlives its task, and would keep the most it ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``limit`` bytes of text (one
    row at least), which bounds a task's memory whatever the row count of a batch. After the last one freed memory is given back."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()
