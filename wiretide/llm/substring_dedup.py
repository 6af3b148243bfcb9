"""Duplicate passages by hashing of lines, paragraphs or sentences.

A text is cut into units: paragraphs (at empty lines), lines, or sentences. Sentences find passages
that stand inside a line: a unit then is a sentence of at least ``MIN_SENTENCE`` words and the
shorter ones before it, so where units end depends on the words there alone. A unit is
normalised (A-Z lower-cased, white space made one space) and digested to 128 bits. Digests are
grouped over the whole corpus; the occurrence that is first by (rank, id, place) is kept, the rest is
removed. Neighbouring units to remove are one span, with its offsets in the original text; a span of
fewer than ``min_words`` words is no passage and stays.

A passage seldom begins and ends with whole units. With ``extend``, a run of repeated units first grows
over the words before and after it that its kept occurrence has there too; runs that meet are one
span, and ``min_words`` holds for the whole passage. The words of a run's sides lie in the two units
before and the one after: where units end is settled by the first whole sentence of ``MIN_SENTENCE``
words, so a longer common side would itself be a repeated unit.

Scale: texts are not shuffled for the decision. A unit is a row of its digest, document and place.
Counts and first occurrences are combined per task before the shuffle, so a passage in a third of
all documents is one row per task there; repeated units are then joined to their first occurrence
by digest, where Spark splits hot digests. Only repeated units are grouped by document, and a group
is at most the units of one text. ``extend`` reads the texts a second time, joined to the places whose sides are asked
for; texts repeated as a whole have no sides. Only the sides are then joined to those of the kept
occurrence.

Defined results: null and empty texts have no units. Rows equal in id and text are one document.
Ranks default to ids; null ranks and ids come first. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretide.llm.common import LOWER, settled, slices

MIN_SENTENCE = 4
_CUTS = {
    "paragraph": re.compile(r"(?:[^\n]|\n(?![ \t\r]*\n))+"),
    "line": re.compile(r"[^\n]+"),
    "sentence": re.compile(r"[^.!?\n]+[.!?]*|[.!?]+"),
}
_UNITS = "array<struct<at:int,first:int,past:int,words:int,last:boolean,digest:binary>>"
_TYPE = pa.list_(
    pa.struct(
        [
            ("at", pa.int32()), ("first", pa.int32()), ("past", pa.int32()), ("words", pa.int32()), ("last", pa.bool_()),
            ("digest", pa.binary()),
        ]
    )
)
_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_SIDES = "array<struct<at:int,before:boolean,base:int,nth:int,side:string>>"
_SIDE_TYPE = pa.list_(
    pa.struct([("at", pa.int32()), ("before", pa.bool_()), ("base", pa.int32()), ("nth", pa.int32()), ("side", pa.string())])
)


def text_units(text: str, unit: str) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, normalised bytes) of each unit in order."""
    out: list[tuple[int, int, int, bytes]] = []
    start, held = None, []
    for match in _CUTS[unit].finditer(text):
        words = match[0].encode().translate(LOWER).split()
        if not words:
            continue
        start = match.start() if start is None else start
        held += words
        if unit != "sentence" or len(words) >= MIN_SENTENCE:
            out.append((start, match.end(), len(held), b" ".join(held)))
            start, held = None, []
        past = match.end()
    if held:
        out.append((start, past, len(held), b" ".join(held)))
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str, rank_col: str) -> DataFrame:
    return docs.select(
        F.struct(F.col(rank_col).alias("rank"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("code")).alias("row"),
        F.col(text_col).cast("string").alias("text"),
    )


def _units(rows: DataFrame, unit: str) -> DataFrame:
    kind = rows.schema["row"].dataType.simpleString()

    def places(text: str) -> list[dict]:
        units = text_units(text, unit)
        return [
            {"at": k, "first": a, "past": b, "words": n, "last": k + 1 == len(units), "digest": xxhash.xxh3_128_digest(plain)}
            for k, (a, b, n, plain) in enumerate(units)
        ]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            units = [places(text or "") for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(units, _TYPE)], ["row", "units"])

    return rows.mapInArrow(work, f"row {kind}, units {_UNITS}").select("row", F.inline("units"))


def _side_words(side: str, unit: str) -> list[tuple[int, int, bytes]]:
    """(start, end, normalised bytes) of each word, cut where units are cut."""
    return [
        (piece.start() + word.start(), piece.start() + word.end(), word[0].encode().translate(LOWER))
        for piece in _CUTS[unit].finditer(side)
        for word in _WORD.finditer(piece[0])
    ]


def shared_side(own: str, other: str, before: bool, unit: str) -> tuple[int, int]:
    """The words that two sides share next to their units, and the offset in ``own`` where these begin or end."""
    mine, theirs = _side_words(own, unit), _side_words(other, unit)
    step, count = -1 if before else 1, 0
    for a, b in zip(mine[::step], theirs[::step]):
        if a[2] != b[2]:
            break
        count += 1
    if not count:
        return 0, 0
    return count, mine[-count][0] if before else mine[count - 1][1]


def _sides(rows: DataFrame, wanted: DataFrame, unit: str) -> DataFrame:
    """``row``, ``at``, ``before``, the text ``side`` before or after that unit, its offset ``base`` and
    the number ``nth`` of words before the unit.
    """
    asked = wanted.groupBy("row").agg(F.collect_set(F.struct("at", "before")).alias("asked"))
    found = rows.join(asked, "row").select("row", "text", "asked")
    kind = found.schema["row"].dataType.simpleString()

    def sides(text: str, asked: list[dict]) -> list[dict]:
        units, out = text_units(text, unit), []
        nth = [0]
        for u in units:
            nth.append(nth[-1] + u[2])
        for at, before in sorted((x["at"], x["before"]) for x in asked):
            near = units[max(0, at - 2) : at] if before else units[at + 1 : at + 2]
            base, past = (near[0][0], near[-1][1]) if near else (0, 0)
            out.append({"at": at, "before": before, "base": base, "nth": nth[at], "side": text[base:past]})
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [sides(t, a) for t, a in zip(batch["text"].to_pylist(), batch["asked"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(out, _SIDE_TYPE)], ["row", "sides"])

    return found.mapInArrow(work, f"row {kind}, sides {_SIDES}").select("row", F.inline("sides"))


def _extended(rows: DataFrame, runs: DataFrame, unit: str) -> DataFrame:
    """The runs grown over what their sides share with the kept occurrence; those that meet are one."""
    runs = settled(runs)
    edge = lambda before, at, kept, there: runs.where(there).select(
        "row", "run", F.lit(before).alias("before"), F.col(at).alias("at"), F.col(kept).alias("kept")
    )
    edges = edge(True, "low", "low_kept", F.col("low") > 0).union(edge(False, "high", "high_kept", ~F.col("last")))
    wanted = edges.select("row", "at", "before").union(edges.select("kept.row", "kept.at", "before")).distinct()
    sides = settled(_sides(rows, wanted, unit).dropDuplicates(["row", "at", "before"]))
    other = sides.select(
        F.struct("row", "at").alias("kept"), "before", F.col("side").alias("other")
    )
    pairs = edges.join(sides, ["row", "at", "before"]).join(other, ["kept", "before"])
    pairs = pairs.select("row", "run", "before", "base", "nth", "side", "other")
    kind = pairs.schema["row"].dataType.simpleString()
    names = ["row", "run", "before", "base", "nth"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own, other, before = (batch[n].to_pylist() for n in ("side", "other", "before"))
            shared = [shared_side(*x, unit) for x in zip(own, other, before)]
            counts, ends = (pa.array([x[k] for x in shared], pa.int32()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), counts, ends], [*names, "more", "to"])

    grown = pairs.mapInArrow(work, f"row {kind}, run int, before boolean, base int, nth int, more int, to int")
    at = lambda before, value: F.max(F.when(F.col("before") == before, F.col(value)))
    offset = F.when(F.col("more") > 0, F.col("base") + F.col("to"))
    grown = grown.withColumn("to", offset).groupBy("row", "run").agg(
        at(True, "to").alias("from"), at(False, "to").alias("to"), at(True, "nth").alias("nth"),
        at(True, "more").alias("less"), at(False, "more").alias("more"),
    )
    nth = F.coalesce("nth", F.lit(0))
    wide = runs.join(grown, ["row", "run"], "left").select(
        "row", "low", "n_units", "first_id",
        F.coalesce("from", "start").alias("start"), F.coalesce("to", "end").alias("end"),
        (nth - F.coalesce("less", F.lit(0))).alias("w0"), (nth + F.col("n_words") + F.coalesce("more", F.lit(0))).alias("w1"),
    )
    order = Window.partitionBy("row").orderBy("low")
    reach = F.max("w1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(reach >= F.col("w0"), 0).otherwise(1)
    return (
        wide.withColumn("apart", apart)
        .withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "run")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            (F.max("w1") - F.min("w0")).alias("n_words"),
            F.sum("n_units").alias("n_units"),
            F.min_by("first_id", "low").alias("first_id"),
        )
    )


def duplicate_spans(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    rank_col: str | None = None,
    unit: str = "sentence",
    min_words: int = 20,
    extend: bool = False,
) -> DataFrame:
    """The spans to remove: the id, ``code`` (hash of the text), ``start``, ``end``, ``n_words``,
    ``n_units`` and ``first_id``, the document that keeps the first unit of the span.

    With ``extend``, spans are whole passages and ``n_words`` counts all their words.
    """
    rows = _rows(docs, id_col, text_col, rank_col or id_col)
    units = _units(rows, unit)
    first = (
        units.groupBy("digest")
        .agg(F.min(F.struct("row", "at")).alias("kept"), F.count(F.lit(1)).alias("times"))
        .where("times > 1")
        .select("digest", "kept")
    )
    again = units.join(first, "digest").where(F.struct("row", "at") > F.col("kept"))
    # equal rows have equal units, which count once
    again = again.groupBy("row", "at").agg(
        F.first("first").alias("first"), F.first("past").alias("past"), F.first("words").alias("words"),
        F.first("last").alias("last"), F.first("kept").alias("kept"),
    )
    run = F.col("at") - F.row_number().over(Window.partitionBy("row").orderBy("at"))
    runs = (
        again.withColumn("run", run)
        .groupBy("row", "run")
        .agg(
            F.min("first").alias("start"),
            F.max("past").alias("end"),
            F.sum("words").alias("n_words"),
            F.count(F.lit(1)).alias("n_units"),
            F.min_by("kept.row.id", "at").alias("first_id"),
            F.min("at").alias("low"),
            F.max("at").alias("high"),
            F.max("last").alias("last"),
            F.min_by("kept", "at").alias("low_kept"),
            F.max_by("kept", "at").alias("high_kept"),
        )
    )
    spans = _extended(rows, runs, unit) if extend else runs
    return spans.where(F.col("n_words") >= min_words).select(
        F.col("row.id").alias(id_col), "row.code", "start", "end", "n_words", "n_units", "first_id"
    )


def remove_spans(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the given spans of ``duplicate_spans``; others are unchanged."""
    gone = (
        spans.groupBy(F.col(id_col).alias("_id"), F.col("code").alias("_code"))
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    )
    same = docs[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(docs[text_col]) == gone["_code"])
    text = F.col(text_col)
    left = F.aggregate(
        "_spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.struct(
            F.concat(s["out"], F.substr(text, s["at"] + 1, x["start"] - s["at"])).alias("out"), x["end"].alias("at")
        ),
        lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))),
    )
    joined = docs.join(gone, same, "left").withColumn(text_col, F.when(F.col("_spans").isNull(), text).otherwise(left))
    return joined.select(*docs.columns)
