"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

The items' words are numbered and fed to one automaton per block of items; each document's words
then stream through it, and at every word the automaton knows the longest run of words, ending
there, that occurs in some item. A window is ``window`` consecutive words of an item (a shorter
item is one window). A document word inside an occurrence of a window is hit, and spans of hit
words are what decontamination removes.

Blocks: the items are cut, by a running sum of their words, into blocks of at most ``block_words``
words, so that one automaton has a fixed size whatever the size of the item table; every document
meets every block (a stated query set against all rows, in blocks). One block is the common case,
and then nothing is shuffled; with more, partial results per document row are combined. Only
items' words are collected, block by block, and sent to the executors.

Defined results: null texts have no words and no hits. Items with null id or without words are
left out; repeated items count once. Repeated document rows are judged one by one. Only the named
columns are read from either table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretide.llm.common import WORD_BYTES, alnum_words, slices, text_column, texts_of


class Automaton:
    """Suffix automaton of several word sequences, with the items behind each window."""

    def __init__(self, items: list[tuple[int | str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self._owners(items)

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, state: int, target: int, word: bytes) -> int:
        """The state for the words of ``state`` and ``word``, apart from longer runs of ``target``."""
        copy = self._state(self.length[state] + 1)
        self.next[copy] = dict(self.next[target])
        self.link[copy], self.link[target] = self.link[target], copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        target = self.next[last].get(word)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, target, word)
        new, state = self._state(self.length[last] + 1), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            same = self.length[target] == self.length[state] + 1
            self.link[new] = target if same else self._split(state, target, word)
        return new

    def _owners(self, items) -> None:
        """For each state the items one of whose windows ends a run of that state."""
        long: list[set] = [set() for _ in self.next]
        short: list[set] = [set() for _ in self.next]
        for item, words in items:
            least, state = min(self.window, len(words)), 0
            for k, word in enumerate(words, 1):
                state = self.next[state][word]
                if k < least:
                    continue
                at = state
                while self.length[self.link[at]] >= least:
                    at = self.link[at]
                (long if least == self.window else short)[at].add((item, least))
        # a short item ends every run that has its last state among the suffix links
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for state in order:
            if short[self.link[state]]:
                short[state] = short[state] | short[self.link[state]]
        self.short = [tuple(s) for s in short]
        self.long = [tuple(item for item, _ in s) for s in long]
        self.entry = [0] * len(self.next)
        for state in order:
            up = self.link[state]
            self.entry[state] = self.entry[up] if self.length[up] >= self.window else state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of hit words (start, end past it) in order, and the items with windows there."""
        follow, link, length = self.next, self.link, self.length
        window, short, long, entry = self.window, self.short, self.long, self.entry
        any_short = any(short)
        spans: list[tuple[int, int]] = []
        items: set = set()
        state = run = 0
        known = follow[0]
        for at, word in enumerate(words, 1):
            if word not in known:
                state = run = 0
                continue
            to = follow[state].get(word)
            if to is None:
                while to is None:
                    state = link[state]
                    to = follow[state].get(word)
                run = length[state]
            state, run = to, run + 1
            if run >= window:
                items.update(long[entry[state]])
                start = at - run
            elif any_short and short[state]:
                start = at
            else:
                continue
            if any_short:
                for item, size in short[state]:
                    if size <= run:
                        items.add(item)
                        start = min(start, at - size)
            if start == at:
                continue
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, at))
        return spans, items


def item_blocks(
    items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", block_words: int = 1_000_000
) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items' ids and words in blocks of at most that many words (at least one item each).

    The rows come to the driver partition by partition, never all at once, in order of id and text.
    """
    rows = (
        items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
        .where("item IS NOT NULL AND text IS NOT NULL")
        .distinct()
        .orderBy("item", "text")
    )
    block, size = [], 0
    for row in rows.toLocalIterator():
        words = alnum_words(row["text"])
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row["item"], words))
        size += len(words)
    yield block


_MATCH = "n_words long, spans array<struct<first:int,past:int>>, items array<string>"


def matches(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """The id with ``n_words``, hit ``spans`` (in words, end past it) and ``items``.

    Takes the keyword arguments of ``matched_rows``.
    """
    return matched_rows(docs, items, keep=(id_col,), **how).select("row.*", "n_words", "spans", "items")


def matched_rows(
    docs: DataFrame,
    items: DataFrame,
    *,
    keep: tuple[str, ...],
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_words: int = 1_000_000,
) -> DataFrame:
    """As ``matches``, with the kept columns in a struct ``row``."""
    context = docs.sparkSession.sparkContext
    blocks = list(
        context.broadcast(b)
        for b in item_blocks(items, item_col=item_col, text_col=item_text_col, block_words=block_words)
    )
    source = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *text_column(docs, text_col, keep)
    )
    kind = source.schema["row"].dataType.simpleString()
    found_type = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = None
        for batch in slices(batches):
            if automata is None:
                # one at a time where there are several: each block is one fixed-size automaton
                automata = [Automaton(b.value, window) for b in blocks] if len(blocks) == 1 else []
            counts, spans, items_found = [], [], []
            texts = [alnum_words(t) for t in texts_of(batch, text_col, "row")]
            found = [([], set()) for _ in texts]
            for automaton in automata or (Automaton(b.value, window) for b in blocks):
                for (old_spans, old_items), words in zip(found, texts):
                    more, names = automaton.scan(words)
                    old_spans += more
                    old_items |= names
            for (hit, names), words in zip(found, texts):
                counts.append(len(words))
                spans.append([{"first": a, "past": b} for a, b in _merged(hit)])
                items_found.append(sorted(names))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["row"],
                    pa.array(counts, pa.int64()),
                    pa.array(spans, found_type),
                    pa.array(items_found, pa.list_(pa.string())),
                ],
                ["row", "n_words", "spans", "items"],
            )

    return source.mapInArrow(work, f"row {kind}, {_MATCH}")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, past in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(past, out[-1][1])
        else:
            out.append((first, past))
    return out


def report(matched: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Per document the counts, the digest of its items and whether any word is hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["past"] - s["first"])
    return matched.select(
        id_col,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def cut(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    count_col: str | None = "n_chars",
    max_share: float = 0.5,
    **how,
) -> DataFrame:
    """The documents without hit spans; a document goes where more than that share of it is hit.

    A removed span goes with the characters between its words; the text around it stays as it is.
    A column ``count_col``, if there is one, gets the new length in characters. Documents without
    hits, null texts among them, stay unchanged. Takes the keyword arguments of ``matched_rows``.
    """
    names = tuple(docs.columns)
    found = matched_rows(docs, items, keep=names, text_col=text_col, **how)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["past"] - s["first"])
    kept = found.where((F.size("spans") == 0) | (hit <= max_share * F.col("n_words")))
    kept = kept.select("row", "spans")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pa.array(
                remove_words(t, s) if s else t
                for t, s in zip(batch["row"].field(text_col).to_pylist(), batch["spans"].to_pylist())
            )
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["spans"], texts.cast(pa.string())], ["row", "spans", "left"]
            )

    done = kept.mapInArrow(work, f"{kinds}, left string")
    columns = []
    for name in names:
        old = F.col("row")[name]
        new = {text_col: F.col("left"), count_col: F.length("left")}.get(name, old)
        columns.append(F.when(F.size("spans") > 0, new.cast(docs.schema[name].dataType)).otherwise(old).alias(name))
    return done.select(*columns)


def remove_words(text: str, spans) -> str:
    """The text without the characters from each span's first to its last word."""
    raw = text.encode()
    plain = raw.translate(WORD_BYTES)
    starts, past, words = [], 0, plain.split()
    ends = []
    for word in words:
        at = plain.index(word, past)
        past = at + len(word)
        starts.append(at)
        ends.append(past)
    out, at = [], 0
    for span in spans:
        out.append(raw[at : starts[span["first"]]])
        at = ends[span["past"] - 1]
    return b"".join([*out, raw[at:]]).decode()
