"""Byte-level BPE by recursive DuckDB queries inside each partition.

A text is split by the tokenizer's pattern; each distinct piece is encoded once per task. New
pieces of some documents go to DuckDB together: one row per piece holds its token ids, the rows
are unnested to token positions, adjacent pairs join the merge table, and the pair of least rank
(the leftmost of equals) is contracted, again and again until no pair of any piece merges. The
ids of whole documents are decoded by joining the vocabulary and aggregating bytes in order of position.

Ranks are token ids, as in tiktoken rank files, and a piece that is itself a token is that token.
Memory is bounded: a task keeps two tables of ids, of about ``keep_chunks`` chunks and 8 million
characters each and what one portion of texts adds, and a DuckDB call gets at most
``call_pieces`` pieces, fewer where they are long. A piece longer than
``long_piece`` bytes would take as many recursion steps as it has merges over all its positions;
it goes through a heap of pairs instead, by the same rule and with the same result.

Null and empty texts have no tokens. Repeated rows are encoded alike. Only the named columns are
read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import accumulate

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.llm.common import slices

#: Hex digits of one token id in a row of ids; two bytes hold any id below 65,536.
WIDTH = 4
#: Ids that are decoded together.
DECODE_IDS = 500_000

#: Sum of the squared bytes of the pieces of one DuckDB call; the recursion holds some two bytes for each.
CALL_HELD = 8_000_000

#: Characters of the texts that are encoded together; what a portion needs in memory is some 25 bytes each.
PORTION_CHARS = 2_000_000

ENCODE_SQL = f"""
WITH RECURSIVE state(piece, ids) AS (
  SELECT piece, ids FROM new_pieces
  UNION ALL
  SELECT piece, left(ids, pos * {WIDTH}) || merged || substr(ids, (pos + 2) * {WIDTH} + 1)
  FROM (
    SELECT piece, ids, printf('%0{WIDTH}x', least >> 20) AS merged, CAST(least & 1048575 AS INTEGER) AS pos
    FROM (
      SELECT piece, ids, min((m.rank << 20) + pos) AS least
      FROM (SELECT piece, ids, unnest(range(len(ids) // {WIDTH} - 1)) AS pos FROM state) p
      JOIN merges m ON m.pair = substr(p.ids, p.pos * {WIDTH} + 1, 2 * {WIDTH})
      GROUP BY piece, ids
    )
  )
)
SELECT piece, min_by(ids, len(ids)) FROM state GROUP BY piece
"""

# sorted once below the aggregate, which one thread reads in that order: a third of the time of an ORDER BY inside it
DECODE_SQL = """
SELECT string_agg(bytes, '')
FROM (SELECT v.bytes FROM coded JOIN vocabulary v USING (id) ORDER BY pos)
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file of base64 text and number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


def chunks(text: str) -> list[str]:
    """The text cut before each space that a non-space follows.

    No piece of the pattern reaches over such a place and none of its alternatives looks back, so
    pieces of a chunk are the pieces of the text.
    """
    parts = text.split(" ")
    if "" in parts or _ODD.search(text):
        return [c for c in _CUT.split(text) if c]
    return [parts[0], *[" " + p for p in parts[1:]]] if len(parts) > 1 else parts


_CUT = re.compile(r"(?= \S)")
_ODD = re.compile(r" (?!\S)")


def contract(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece by a heap of adjacent pairs, least rank and then leftmost first."""
    ends = list(range(1, len(piece) + 1))
    before = list(range(-1, len(piece) - 1))
    alive = [True] * len(piece)

    def pair(a: int) -> None:
        b = ends[a]
        if b < len(piece) and (rank := ranks.get(piece[a : ends[b]])) is not None:
            heapq.heappush(heap, (rank, a, b, ends[b]))

    heap: list[tuple[int, int, int, int]] = []
    for a in range(len(piece)):
        pair(a)
    while heap:
        _, a, b, end = heapq.heappop(heap)
        if not alive[a] or ends[a] != b or ends[b] != end:
            continue
        alive[b], ends[a] = False, end
        if end < len(piece):
            before[end] = a
        pair(a)
        if before[a] >= 0:
            pair(before[a])
    out, a = [], 0
    while a < len(piece):
        out.append(ranks[piece[a : ends[a]]])
        a = ends[a]
    return out


def portions(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in turn, in lists of about ``PORTION_CHARS`` characters."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text) if text else 0
        if held >= PORTION_CHARS:
            yield part
            part, held = [], 0
    if part:
        yield part


@contextmanager
def collector_paused() -> Iterator[None]:
    """No garbage collection meanwhile: many new lists, none of them in a cycle, would set it off again and again."""
    was_on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was_on:
            gc.enable()


class Codec:
    """Encodes and decodes inside one task, with DuckDB tables of merges and vocabulary."""

    def __init__(self, ranks, pattern, keep_chunks=300_000, call_pieces=64_000, long_piece=128):
        if max(ranks.values(), default=0) >= 16**WIDTH - 1:
            raise ValueError(f"token ids must be below {16**WIDTH - 1}")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.keep_chunks, self.call_pieces, self.long_piece = keep_chunks, call_pieces, long_piece
        self.hexes = np.array([f"{ranks[bytes([b])]:0{WIDTH}x}".encode() for b in range(256)])
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes of each token
        self.sizes[list(ranks.values())] = list(map(len, ranks))
        self.decimal = [b"%d" % i for i in range(len(self.sizes))]
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "120MB", "temp_directory": ""})
        merges = {
            f"{ranks[a]:0{WIDTH}x}{ranks[b]:0{WIDTH}x}": rank
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if (a := token[:k]) in ranks and (b := token[k:]) in ranks
        }
        self._table("merges", pair=list(merges), rank=pa.array(merges.values(), pa.int64()))
        self._table(
            "vocabulary",
            id=pa.array(ranks.values(), pa.int32()),
            bytes=[t.hex() for t in ranks],
        )

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _query(self, sql: str, name: str, **columns) -> list[tuple]:
        self.db.register(name, pa.table(columns))
        rows = self.db.execute(sql).fetchall()
        self.db.unregister(name)
        return rows

    def encode_pieces(self, pieces: list[str]) -> dict[str, str]:
        """Each piece's ids as hex text of ``WIDTH`` digits each."""
        known, new = {}, []
        for piece in pieces:
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                known[piece] = f"{rank:0{WIDTH}x}"
            elif len(raw) > self.long_piece:
                known[piece] = "".join(f"{i:0{WIDTH}x}" for i in contract(raw, self.ranks))
            else:
                new.append((piece, raw))
        for part in self._calls(new):
            ids = self.hexes[np.frombuffer(b"".join([raw for _, raw in part]), np.uint8)].tobytes().decode()
            ends = [0, *accumulate([len(raw) * WIDTH for _, raw in part])]
            rows = [ids[a:b] for a, b in zip(ends, ends[1:])]
            numbered = pa.array(range(len(part)), pa.int32())
            for k, coded in self._query(ENCODE_SQL, "new_pieces", piece=numbered, ids=rows):
                known[part[k][0]] = coded
        return known

    def _calls(self, new: list[tuple[str, bytes]]) -> Iterator[list[tuple[str, bytes]]]:
        """The pieces in lists for one DuckDB call each, bounded by number and by what the recursion holds of them."""
        start = held = 0
        for k, (_, raw) in enumerate(new):
            held += len(raw) ** 2
            if held > CALL_HELD or k - start == self.call_pieces:
                yield new[start:k]
                start, held = k, len(raw) ** 2
        if new:
            yield new[start:]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all the ids in turn."""
        parts = []
        for start in range(0, len(ids), DECODE_IDS):
            part = ids[start : start + DECODE_IDS].astype(np.int32)
            [(found,)] = self._query(DECODE_SQL, "coded", pos=np.arange(len(part), dtype=np.int32), id=part)
            parts.append(bytes.fromhex(found))
        return b"".join(parts)

    def decode_rows(self, rows: list[np.ndarray]) -> list[bytes]:
        """The bytes of each row of ids."""
        ids = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        raw = memoryview(self.decode(ids))
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[[0, *accumulate(map(len, rows))]].tolist()
        return [bytes(raw[a:b]) for a, b in zip(ends, ends[1:])]

    def numbers(self, ids: np.ndarray) -> bytes:
        """Ids as decimal numbers, comma-joined."""
        return b",".join(map(self.decimal.__getitem__, ids.tolist()))

    def learn(self, texts: list[list[str]]) -> None:
        """Encode and decode what the given chunked texts hold and the young table lacks.

        Two generations: a full young table becomes the old one, which is dropped at the next
        change; what is met again moves to the young one, so that frequent chunks stay.
        """
        if len(self.ids) > self.keep_chunks or self.held > 8_000_000:
            self.old, self.ids, self.held = self.ids, {}, 0
        missing = set().union(*texts).difference(self.ids)
        again = missing.intersection(self.old)
        self.ids.update(zip(again, map(self.old.__getitem__, again)))
        missing.difference_update(again)
        # letters behind at most one space are a piece
        whole = [c for c in missing if c[c[0] == " " :].isalpha()]
        split = {c: self.pattern.findall(c) for c in missing.difference(whole)}
        known = self.encode_pieces(list(set(whole).union(*split.values())))
        coded = [known[c] for c in whole]
        coded += ["".join([known[p] for p in pieces]) for pieces in split.values()]
        whole += split
        self.held += sum(map(len, whole))
        flat = bytes.fromhex("".join(coded))
        ends = [0, *accumulate([len(ids) // 2 for ids in coded])]
        self.ids.update(zip(whole, [flat[a:b] for a, b in zip(ends, ends[1:])]))

    def __enter__(self) -> Codec:
        return self

    def __exit__(self, *_) -> None:
        """Give all memory back: the worker goes on to other tasks."""
        self.db.close()
        self.__dict__.clear()

    def coded(self, texts: list[str | None]) -> list[tuple[np.ndarray, bytes]]:
        """For each text of a portion its ids and the bytes that these ids decode to."""
        with collector_paused():
            cut = [chunks(t) if t else [] for t in texts]
            self.learn(cut)
        rows = [np.frombuffer(b"".join(map(self.ids.__getitem__, text)), f">u{WIDTH // 2}") for text in cut]
        return list(zip(rows, self.decode_rows(rows)))

    def batch(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids (decimal, comma-joined) and the bytes that these ids decode to."""
        for part in portions(texts):
            for ids, raw in self.coded(part):
                yield self.numbers(ids), raw


def _shared(spark: SparkSession, path: str, pattern: str):
    """The rank table as a broadcast; its size is that of the vocabulary, at most 65,535 tokens."""
    ranks = read_ranks(path)
    return spark.sparkContext.broadcast((ranks, pattern))


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    out: tuple[str, ...] = ("ids", "decoded"),
) -> DataFrame:
    """The id column with the asked columns, one row per document.

    ``out`` may name ``ids`` (array of int), ``decoded`` (the bytes that the ids decode to),
    ``n_tokens``, ``ids_sha256`` (of decimal ids joined by commas), ``decoded_sha256``. Null or
    empty texts give no ids. Nothing is shuffled.
    """
    kinds = {
        "ids": ("array<int>", pa.list_(pa.int32())),
        "decoded": ("binary", pa.binary()),
        "n_tokens": ("long", pa.int64()),
        "ids_sha256": ("string", pa.string()),
        "decoded_sha256": ("string", pa.string()),
    }
    make = {
        "ids": lambda codec, ids, raw: ids.astype(np.int32),
        "decoded": lambda codec, ids, raw: raw,
        "n_tokens": lambda codec, ids, raw: len(ids),
        "ids_sha256": lambda codec, ids, raw: hashlib.sha256(codec.numbers(ids)).hexdigest(),
        "decoded_sha256": lambda codec, ids, raw: hashlib.sha256(raw).hexdigest(),
    }
    shared = _shared(docs.sparkSession, path, pattern)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Codec(*shared.value) as codec:
            for batch in slices(batches, 4096):
                start = 0
                for part in portions(batch["text"].to_pylist()):
                    columns = [[] for _ in out]
                    for ids, raw in codec.coded(part):
                        for name, column in zip(out, columns):
                            column.append(make[name](codec, ids, raw))
                    arrays = [pa.array(c, kinds[n][1]) for n, c in zip(out, columns)]
                    yield pa.RecordBatch.from_arrays([batch["id"].slice(start, len(part)), *arrays], ["id", *out])
                    start += len(part)

    schema = ", ".join([f"id {id_type}", *(f"{n} {kinds[n][0]}" for n in out)])
    return source.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def decode(coded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id column and ``decoded``, the bytes of each array of ids; empty for null or no ids."""
    shared = _shared(coded.sparkSession, path, ".")
    source = coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    id_type = source.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Codec(*shared.value) as codec:
            for batch in slices(batches, 64):
                top = len(codec.sizes)
                rows = [np.array([i for i in ids or [] if 0 <= i < top], np.int32) for ids in batch["ids"].to_pylist()]
                raw = pa.array(codec.decode_rows(rows), pa.binary())
                yield pa.RecordBatch.from_arrays([batch["id"], raw], ["id", "decoded"])

    return source.mapInArrow(work, f"id {id_type}, decoded binary").withColumnRenamed("id", id_col)
