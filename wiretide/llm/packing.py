"""Packing of token ids into rows of fixed length, by best fit decreasing.

Documents are encoded, closed with an end token, and cut losslessly where they are longer than a
row: full pieces are rows of their own, the rest joins the other documents. Pieces are then taken
from longest to shortest, each to the open row with the least room that still holds it; a segment
tree over the rooms (how many open rows have each) finds that row in logarithmic time.

A row is written as one binary id vector (little-endian, padded), so that a file or partition of rows is a packed
matrix, with ``cu_seqlens`` (cumulative lengths of its segments, from 0), the document and offset of each
segment, and ``position_ids``, which start again at 0 with each segment.

Scale: packing is done inside each input partition, over at most ``group_tokens`` tokens at a time,
so nothing is shuffled and memory is bounded; thousands of documents share a group, and the room
lost to the end of a group is at most one open row per group beyond what best fit leaves. A lost
task packs its own partition again with the same result.

Defined results: null and empty texts have no tokens and give no segment, unless the end token is
asked for them too (``close_empty``). Repeated rows are packed each. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretide.llm.bpe import chunks, read_ranks
from wiretide.llm.common import slices


class Rooms:
    """How many open rows have room for exactly so many tokens, with search for the least that fits."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, room: int, change: int) -> None:
        at = room + self.leaves
        while at:
            self.counts[at] += change
            at >>= 1

    def least(self, size: int) -> int:
        """The least room of at least that size that an open row has; -1 if none."""
        at = size + self.leaves
        if self.counts[at]:
            return size
        while at > 1:
            if not at & 1 and self.counts[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.counts[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Numbers of the given sizes (each from 1 to ``room``) by row, in the order in which they came."""
    rows: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = Rooms(room)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[k]
        found = rooms.least(size)
        if found < 0:
            row, left = len(rows), room - size
            rows.append([k])
        else:
            row, left = by_room[found].pop(), found - size
            rooms.add(found, -1)
            rows[row].append(k)
        if left:
            by_room.setdefault(left, []).append(row)
            rooms.add(left, 1)
    return rows


class Encoder:
    """Ids of texts as little-endian bytes, each distinct word of a task encoded once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = 200_000):
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.kind = np.dtype("<u2") if max(ranks.values(), default=0) < 65_535 else np.dtype("<u4")
        self.sizes = np.zeros(max(ranks.values(), default=0) + 1, np.int64)  # bytes of each token
        self.sizes[list(ranks.values())] = list(map(len, ranks))
        self.ids: dict[str, bytes] = {}
        self.keep = keep

    def __call__(self, text: str) -> bytes:
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; new words of all of them are encoded together."""
        cut = [chunks(text) for text in texts]
        if len(self.ids) > self.keep:
            self.ids = {}
        self.learn(list(set().union(*cut).difference(self.ids)))
        return [b"".join(map(self.ids.__getitem__, text)) for text in cut]

    def learn(self, new: list[str]) -> None:
        # chunks that begin with a space before a non-space are, one behind the other, a text that is cut into these chunks
        joined = [c for c in new if c[0] == " " and not c[1:2].isspace() and len(c) > 1]
        for chunk in set(new).difference(joined):
            self.ids[chunk] = np.array(self.encoding.encode_ordinary(chunk), self.kind).tobytes()
        for start in range(0, len(joined), 20_000):
            part = joined[start : start + 20_000]
            ids = np.array(self.encoding.encode_ordinary("".join(part)), self.kind)
            ends = np.cumsum(self.sizes[ids])
            places = np.searchsorted(ends, np.cumsum([len(c.encode()) for c in part])) + 1
            raw, places = ids.tobytes(), [0, *(places * self.kind.itemsize).tolist()]
            self.ids.update(zip(part, [raw[a:b] for a, b in zip(places, places[1:])]))


_SCHEMA = (
    "tokens int, ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<{kind}>, starts array<long>"
)


def pack(
    docs: DataFrame,
    path: str,
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 2048,
    end_id: int = 50_256,
    close_empty: bool = False,
    group_tokens: int = 4_000_000,
) -> DataFrame:
    """One record per packed row: ``tokens`` (without padding), ``ids`` and ``position_ids``
    (``length`` little-endian numbers each, padded with ``end_id`` and 0), ``cu_seqlens``,
    ``doc_ids`` and ``starts`` (where in its document's ids each segment begins).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ranks = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    wide = np.dtype("<u2") if max(end_id, *ranks.values(), length) <= 65_535 else np.dtype("<u4")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        end = np.array([end_id], wide).tobytes()
        pieces: list[tuple[object, int, bytes]] = []
        held = 0
        id_type = None
        for batch in slices(batches):
            id_type = batch["id"].type
            texts = [text or "" for text in batch["text"].to_pylist()]
            for doc, text, raw in zip(batch["id"].to_pylist(), texts, encoder.batch(texts)):
                if not text and not close_empty:
                    continue
                if encoder.kind != wide:
                    raw = np.frombuffer(raw, encoder.kind).astype(wide).tobytes()
                raw += end
                step = length * wide.itemsize
                for start in range(0, len(raw), step):
                    pieces.append((doc, start // wide.itemsize, raw[start : start + step]))
                held += len(raw) // wide.itemsize
                if held >= group_tokens:
                    yield from _packed(pieces, length, wide, end_id, id_type)
                    pieces, held = [], 0
        if pieces:
            yield from _packed(pieces, length, wide, end_id, id_type)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, _SCHEMA.format(kind=kind))


def _packed(pieces, length: int, wide: np.dtype, end_id: int, id_type) -> Iterator[pa.RecordBatch]:
    sizes = [len(raw) // wide.itemsize for _, _, raw in pieces]
    rows = best_fit_decreasing(sizes, length)
    pad = np.full(length, end_id, wide).tobytes()
    steps = np.arange(length, dtype=wide)
    for start in range(0, len(rows), 256):
        columns: list[list] = [[] for _ in range(6)]
        for row in rows[start : start + 256]:
            own = [pieces[k] for k in row]
            ends = np.cumsum([0, *(sizes[k] for k in row)])
            raw = b"".join([p[2] for p in own])
            place = np.zeros(length, wide)
            for a, b in zip(ends[:-1], ends[1:]):
                place[a:b] = steps[: b - a]
            values = int(ends[-1]), raw + pad[len(raw) :], place.tobytes(), ends.tolist(), [p[0] for p in own], [p[1] for p in own]
            for column, value in zip(columns, values):
                column.append(value)
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(id_type), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            ["tokens", "ids", "position_ids", "cu_seqlens", "doc_ids", "starts"],
        )


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet; each file's ``ids`` column is a matrix of equal rows."""
    packed.write.mode("overwrite").parquet(path)
