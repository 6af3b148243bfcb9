"""What several of the operators share: words, digests, batches, shared checkpoints."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.session import scratch_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes to bytes: A-Z to a-z.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes to bytes: A-Z to a-z, other ASCII characters that are no letter or digit to a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32
    for b in range(256)
)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters, as UTF-8; none for null."""
    return text.encode().translate(WORD_BYTES).split() if text else []


def spaced_words(text: str | None) -> list[bytes]:
    """Lower-cased words between space, tab, line feed, vertical tab, form feed and return."""
    return text.encode().translate(LOWER).split() if text else []


def sha256(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def give_back() -> None:
    """Return this worker's freed memory to the system; Spark reuses workers, and they never shrink else."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows, so that work memory stays small.

    What earlier tasks of the worker have left is given back first.
    """
    give_back()
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    give_back()


def text_column(table: DataFrame, text_col: str, kept: tuple[str, ...] | list[str]) -> list[Column]:
    """The text as a column ``text``, unless a struct of the kept columns holds it as a string already."""
    if text_col in kept and table.schema[text_col].dataType.simpleString() == "string":
        return []
    return [F.col(text_col).cast("string").alias("text")]


def texts_of(batch: pa.RecordBatch, text_col: str, *path: str) -> list[str | None]:
    """The texts of a batch whose columns ``text_column`` has chosen; ``path`` leads to the struct."""
    if "text" in batch.schema.names:
        return batch["text"].to_pylist()
    column = batch[path[0]]
    for name in (*path[1:], text_col):
        column = column.field(name)
    return column.to_pylist()


def settled(table: DataFrame) -> DataFrame:
    """The table computed once and kept in the shared folder that the session names.

    Uses ``checkpoint()``: later plans start from files that outlive any executor, and Spark's
    cleaner removes them with the DataFrame where the session asks for that.
    """
    spark = table.sparkSession
    _checkpoint_folder(spark)
    return table.checkpoint()


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner see which shuffles and checkpoints nothing refers to any more.

    It follows the driver's garbage collection, which a loop of small jobs does not cause by itself.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _checkpoint_folder(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    context.setCheckpointDir(scratch_folder(spark))


def with_columns(schema: str, table: DataFrame, *names: str) -> str:
    """A schema text that starts with the named columns of the table, with their types."""
    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    return ", ".join([*(f"`{n}` {kinds[n]}" for n in names), schema])
