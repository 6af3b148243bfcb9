"""Objects of JSON arrays in files of any size, whatever the line breaks, read by many tasks.

The text source splits files at closing braces, wherever they stand. Whether a brace closes an object or
is part of a string depends on all text before it. A file that lies in one split starts outside of strings and
objects and is cut at once. The splits of the other files are first summed up under both
assumptions about their start: the parity of their quotes and how far their braces go up and down. A few
numbers per split, added up over the file, then say how each split really starts; with that every
split is cut into objects on its own. Objects that cross a border are put together from the last piece
of one split and the first pieces of the next ones.

The text is never shuffled, but for the pieces of objects that cross a border, at most two a split: a task reads the rows of
a split one after another and carries the few numbers along. Quotes and braces are looked for in the bytes of a whole batch of
rows. Text of files in one split passes through Python once, that of other files three times. The table of splits of
the latter, one short row each, goes to every task; a join by shuffle would lose the order of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiretide.session import scratch_folder, written

_QUOTE, _ESCAPE, _OPEN = b'"\\{'
_SPLIT = ("file", "block")
_GROWTH = 16
_SUMS = pa.schema(
    [("file", pa.string()), ("name", pa.string()), *[(n, pa.int64()) for n in ("block", "odd", "step0", "step1")]]
)
_PARTS = pa.schema([("split", pa.int64()), ("number", pa.int64()), ("done", pa.int32()), ("value", pa.string())])
_OBJECTS = pa.schema([(n, pa.string()) for n in ("file", "value")])


def _before(*keys: str, order: tuple[str, ...]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _so_far(name: str, window: Window) -> Column:
    return F.coalesce(F.sum(name).over(window), F.lit(0))


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)


def _runs(columns: list[pa.Array]) -> Iterator[tuple[int, int]]:
    """Where the rows of one split stand together in a batch."""
    rows = len(columns[0])
    new = np.zeros(max(rows - 1, 0), bool)
    for column in columns:
        new |= pc.not_equal(column.slice(1), column.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
    bounds = [0, *(np.flatnonzero(new) + 1).tolist(), rows]
    return ((a, b) for a, b in zip(bounds, bounds[1:], strict=False) if a < b)


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each text starts and the last one ends."""
    width = np.int64 if pa.types.is_large_string(values.type) else np.int32
    _, bounds, data = values.buffers()
    bounds = np.frombuffer(bounds, width)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data or b"", np.uint8), bounds


def _plain(data: np.ndarray, sign: int) -> np.ndarray:
    """Where a sign stands that no backslash escapes; fragments end with a brace, so none looks at the next one."""
    found = np.flatnonzero(data == sign)
    back = np.flatnonzero(data == _ESCAPE)
    if not len(back) or not len(found):
        return found
    past = np.append(np.flatnonzero(np.diff(back) != 1) + 1, len(back))  # where runs of backslashes end
    odd = np.diff(past, prepend=0) % 2 == 1
    return np.setdiff1d(found, back[past - 1][odd] + 1, assume_unique=True)


def _depths(data: np.ndarray, ends: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Of fragments that each end with a brace: the quotes of all, and of each the parity of the quotes up to its last brace and
    the depth after it, if the first fragment starts outside a string and if it starts inside one."""
    quotes, opens = _plain(data, _QUOTE), _plain(data, _OPEN)
    odd = np.searchsorted(quotes, ends) % 2
    opened = np.searchsorted(opens, ends)
    inside = np.append(0, np.cumsum(np.searchsorted(quotes, opens) % 2))[opened]
    return len(quotes), odd, opened - inside - np.cumsum(1 - odd), inside - np.cumsum(odd)


def _sum_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parity of the quotes and sum of the steps of each split, for both assumptions about its start."""
    split, sums = None, [0, 0, 0]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(_SUMS.names, (*split, *sums), strict=True))], _SUMS)

    for batch in _filled(batches):
        data, bounds = _bytes(batch.column("value"))
        for start, end in _runs([batch.column(n) for n in _SPLIT]):
            key = tuple(batch.column(n)[start].as_py() for n in ("file", "name", "block"))
            if key != split:
                if split is not None:
                    yield row()
                split, sums = key, [0, 0, 0]
            base = bounds[start]
            quotes, _, *after = _depths(data[base : bounds[end]], bounds[start + 1 : end + 1] - base - 1)
            sums[1] += int(after[sums[0]][-1])
            sums[2] += int(after[1 - sums[0]][-1])
            sums[0] = (sums[0] + quotes) % 2
    if split is not None:
        yield row()


class _Cutter:
    """Cuts the fragments of one split, batch by batch, into objects."""

    def __init__(self, inside: int = 0, depth: int = 0):
        self.inside, self.depth, self.crosses = inside, depth, depth != 0
        self.held: list[bytes] = []

    def cut(self, data: np.ndarray, bounds: np.ndarray) -> tuple[bytes | None, np.ndarray]:
        """The object that earlier batches began, if it ends here, and where the objects after it begin and the last one ends."""
        base = bounds[0]
        quotes, odd, *after = _depths(data[base : bounds[-1]], bounds[1:] - base - 1)
        depths = self.depth + after[self.inside]
        ends = bounds[1:][(odd == self.inside) & (depths == 0)]
        self.inside, self.depth = (self.inside + quotes) % 2, int(depths[-1])
        first = None
        if len(ends) and (self.held or self.crosses):
            first, self.held = b"".join([*self.held, data[base : ends[0]].tobytes()]), []
        elif len(ends):
            ends = np.append(base, ends)
        rest = data[ends[-1] if len(ends) else base : bounds[-1]]
        if len(rest):
            self.held.append(rest.tobytes())
        return first, ends


def _texts(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    """Texts that stand one after another among the bytes of others."""
    kind = values.type
    width = np.int64 if pa.types.is_large_string(kind) else np.int32
    place = pa.py_buffer(np.ascontiguousarray(bounds, width))
    return pa.Array.from_buffers(kind, len(bounds) - 1, [None, place, values.buffers()[2]]).cast(pa.string())


def _strings(texts: list[bytes]) -> pa.Array:
    return pa.array(texts, pa.binary()).view(pa.string())


def _cut_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The objects of files that lie in one split each. Rows with an opening brace, so one of every object at least, name the file."""
    split, file, cutter = None, None, _Cutter()
    for batch in _filled(batches):
        values, files = batch.column("value"), batch.column("file")
        data, bounds = _bytes(values)
        naming = np.flatnonzero(files.is_valid().to_numpy(zero_copy_only=False))
        found: list[pa.Array] = []
        names: list[tuple[str, int]] = []
        for start, end in _runs([batch.column("split")]):
            own = batch.column("split")[start].as_py()
            if own != split:
                split, file, cutter = own, None, _Cutter()
            at = int(np.searchsorted(naming, start))
            if file is None and at < len(naming) and naming[at] < end:
                file = files[int(naming[at])].as_py()
            first, ends = cutter.cut(data, bounds[start : end + 1])
            if first is not None:
                found.append(_strings([first]))
            if len(ends) > 1:
                found.append(_texts(values, ends))
            names.append((file, (first is not None) + max(len(ends) - 1, 0)))
        if found:
            paths = pa.concat_arrays([pa.repeat(pa.scalar(path, pa.string()), n) for path, n in names if n])
            yield pa.RecordBatch.from_arrays([paths, pa.concat_arrays(found)], schema=_OBJECTS)


def _cutter(whole: bool):
    """A function that cuts splits into the objects that lie ``whole`` in them, or into the parts of the others."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number, cutter = None, 0, _Cutter()

        def rows(numbers: list[int] | np.ndarray, done: int, values: pa.Array) -> pa.RecordBatch:
            size = len(values)
            return pa.RecordBatch.from_arrays(
                [pa.array([split] * size, pa.int64()), pa.array(numbers, pa.int64()), pa.array([done] * size, pa.int32()), values],
                schema=_PARTS,
            )

        def rest() -> Iterator[pa.RecordBatch]:
            if cutter.held and not whole:
                yield rows([number], 0, _strings([b"".join(cutter.held)]))

        for batch in _filled(batches):
            values = batch.column("value")
            data, bounds = _bytes(values)
            for start, end in _runs([batch.column("split")]):
                own, inside, depth = (batch.column(n)[start].as_py() for n in ("split", "inside", "depth"))
                if own != split:
                    yield from rest()
                    split, number, cutter = own, 0, _Cutter(inside, depth)
                first, ends = cutter.cut(data, bounds[start : end + 1])
                if first is not None:
                    if whole != cutter.crosses:
                        yield rows([number], 1, _strings([first]))
                    number, cutter.crosses = number + 1, False
                if len(ends) > 1:
                    if whole:
                        yield rows(np.arange(number, number + len(ends) - 1), 1, _texts(values, ends))
                    number += len(ends) - 1
        yield from rest()

    return cut


def _never_split(spark: SparkSession, text: DataFrame) -> int:
    """A size up to which no file of the scan is split, with room for a cluster that grows to ``_GROWTH`` times its cores."""
    sizes = spark._jsparkSession.sessionState().conf()
    total = int(text._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) / sizes.fileCompressionFactor()
    set_cores = [int(sizes.getConfString(f"spark.sql.{n}", "1")) for n in ("files.minPartitionNum", "leafNodeDefaultParallelism")]
    cores = max(spark.sparkContext.defaultParallelism * _GROWTH, *set_cores)
    return min(sizes.filesMaxPartitionBytes(), max(sizes.filesOpenCostInBytes(), int(total / cores)))


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """``file`` (path), its ``name`` and ``value``, one row per outermost object of each file, as text, in no order.

    Files hold arrays of objects, or objects one after another, in any layout. What follows an object
    that never closes is lost with it, up to the end of the file. One scan runs at once.
    """
    text = spark.read.option("lineSep", "}").text(path)
    fields = ("file_path", "file_name", "file_block_start", "file_block_length", "file_size")
    meta = {n: F.col(f"_metadata.{n}") for n in fields}
    whole = (meta["file_block_start"] == 0) & (meta["file_block_length"] == meta["file_size"])
    small = meta["file_size"] <= _never_split(spark, text)
    broken = F.raise_error(F.lit("a small file was split: the cluster grew too much since the scan was planned")).cast("boolean")
    value = F.concat("value", F.lit("}")).alias("value")
    file, name = meta["file_path"].alias("file"), F.substring_index("file", "/", -1).alias("name")
    # paths are long and fragments short: most rows go without
    lean = [F.xxhash64(meta["file_path"]).alias("split"), F.when(F.contains(F.col("value"), F.lit("{")), meta["file_path"]).alias("file")]
    objects = text.where(F.when(whole, True).when(small, broken).otherwise(False)).select(*lean, value).mapInArrow(_cut_files, "file string, value string").select("file", name, "value")
    plain = F.regexp_replace("value", r"^[\s,\[\]]+", "").alias("value")
    # small files are not even listed for this scan
    pieces = text.where(~small & ~whole).select(file, meta["file_name"].alias("name"), meta["file_block_start"].alias("block"), value)
    splits = pieces.mapInArrow(
        _sum_splits, "file string, name string, block bigint, odd bigint, step0 bigint, step1 bigint"
    )
    earlier = _before("file", order=("block",))
    starts = (
        splits.withColumn("inside", _so_far("odd", earlier) % 2)
        .withColumn("step", F.when(F.col("inside") == 1, F.col("step1")).otherwise(F.col("step0")))
        .withColumn("depth", _so_far("step", earlier))
        .select("file", "name", "block", "inside", "depth", F.monotonically_increasing_id().alias("split"))
    )
    starts, _ = written(starts, scratch_folder(spark))
    known = pieces.join(F.broadcast(starts.drop("name")), list(_SPLIT)).select("split", "inside", "depth", "value")

    def cut(whole: bool) -> DataFrame:
        parts = known.mapInArrow(_cutter(whole), "split bigint, number bigint, done int, value string")
        return parts.join(F.broadcast(starts.select("split", "file", "name", "block")), "split")

    crossing = _so_far("done", _before("file", order=("block", "number")))
    parts = cut(False).withColumn("object", crossing)
    crossed = parts.groupBy("file", "object").agg(
        F.array_sort(F.collect_list(F.struct("block", "number", "value"))).alias("parts"),
        F.any_value("name").alias("name"),
        F.max("done").alias("done"),
    )
    joined = F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value")
    found = [cut(True).select("file", "name", "value"), crossed.where("done = 1").select("file", "name", joined)]
    return reduce(DataFrame.unionByName, [objects, *found]).withColumn("value", plain)
