"""Secret scan with corpus-wide ownership frequency.

One pass over the texts finds candidates: three fixed kinds (an assignment to a telling name, an
access key id, a long run of hex digits) and a fourth, ``mixed``, of long tokens that mix capital
and small letters and digits. A candidate value is then judged by who holds it: values are counted
by distinct repository and distinct owner over the whole corpus. A value that many owners hold is
a copied example; one that belongs to few owners looks like a live credential. The fixed kinds are
always reported; ``mixed`` spans are reported where they look live.

Scale: the counts shuffle one row per distinct (value digest, owner) and task, so a value in a
third of all rows is one row per owner and task before the shuffle. The candidates, a small
fraction of the texts, are kept in the shared folder and joined by digest; texts are never shuffled.

Defined results: null texts are empty. A null owner is an owner of its own, a null repository a
repository of its own. Offsets are code points, ends exclusive. Repeated rows are judged one by
one. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretide.llm.common import settled, slices, text_column, texts_of

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "mixed")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
MIXED = re.compile(r"[A-Za-z0-9+/_-]{24,}")
_SMALL, _CAPITAL, _DIGIT = re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]")

_CANDIDATES = "array<struct<kind:int,first:int,past:int,digest:long>>"
_TYPE = pa.list_(
    pa.struct([("kind", pa.int32()), ("first", pa.int32()), ("past", pa.int32()), ("digest", pa.int64())])
)


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind number, start, end, value) of all candidates, by start and then kind."""
    out = [
        (0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8
    ]
    out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    for m in MIXED.finditer(text):
        if all(p.search(m[0]) for p in (_SMALL, _CAPITAL, _DIGIT)):
            out.append((3, m.start(), m.end(), m[0]))
    return sorted(out, key=lambda c: (c[1], c[0]))


def _scan(rows: DataFrame, text_col: str) -> DataFrame:
    """``row`` and ``found`` (the candidates, values as digests) of what ``_rows`` returns."""
    kind = rows.schema["row"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [
                [
                    {"kind": k, "first": a, "past": b, "digest": xxhash.xxh3_64_intdigest(v.encode()) - 2**63}
                    for k, a, b, v in candidates(text or "")
                ]
                for text in texts_of(batch, text_col, "row", "kept")
            ]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(found, _TYPE)], ["row", "found"])

    return rows.mapInArrow(work, f"row {kind}, found {_CANDIDATES}")


def ownership(found: DataFrame) -> DataFrame:
    """Per value digest the number of distinct owners and of distinct repositories.

    Takes ``digest``, ``owner``, ``repo``. Both counts are two-step groupings, so each step shuffles
    one row per distinct key and task.
    """
    by = lambda name: (
        found.select("digest", name).distinct().groupBy("digest").agg(F.count(F.lit(1)).alias(f"{name}s"))
    )
    return by("owner").join(by("repo"), "digest")


def _rows(docs: DataFrame, kept: list[str], text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    return docs.select(
        F.struct(
            F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept"),
            F.col(owner_col).cast("string").alias("owner"),
            F.col(repo_col).cast("string").alias("repo"),
        ).alias("row"),
        *text_column(docs, text_col, kept),
    )


def _numbered(scanned: DataFrame) -> DataFrame:
    """Settled with a number for each row: equal rows stay apart, and the number cannot change."""
    return settled(scanned.withColumn("number", F.monotonically_increasing_id()))


def _judged(rich: DataFrame, max_owners: int) -> DataFrame:
    """``number`` and ``spans`` of numbered rows with candidates."""
    each = rich.select("number", "row.owner", "row.repo", F.inline("found"))
    return (
        each.join(ownership(each), "digest", "left")
        .withColumn("live", F.col("owners") <= max_owners)
        .where((F.col("kind") < len(KINDS) - 1) | F.col("live"))
        .groupBy("number")
        .agg(F.array_sort(F.collect_list(F.struct("first", "kind", "past", "owners", "repos", "live"))).alias("spans"))
    )


def scan(
    docs: DataFrame,
    *,
    keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
    max_owners: int = 2,
) -> DataFrame:
    """``row`` (struct of the kept columns) and ``spans``, one row per document row.

    ``spans`` is an array, by start and then kind, of start, kind number, end, ``owners``,
    ``repos`` and ``live`` (at most ``max_owners`` owners hold the value). It holds all candidates
    of the fixed kinds and the live ones of the fourth.
    """
    scanned = _numbered(_scan(_rows(docs, list(keep), text_col, owner_col, repo_col), text_col))
    spans = _judged(scanned.where(F.size("found") > 0), max_owners)
    none = F.array().cast(spans.schema["spans"].dataType)
    return scanned.join(spans, "number", "left").select(
        F.col("row.kept").alias("row"), F.coalesce("spans", none).alias("spans")
    )


def mask(
    docs: DataFrame,
    *,
    text_col: str = "text",
    count_col: str | None = "n_chars",
    owner_col: str = "source",
    repo_col: str = "doc_id",
    max_owners: int = 2,
    mark: str = "[secret]",
) -> DataFrame:
    """The documents with each live span replaced by ``mark``; copied examples stay.

    Spans that overlap are replaced as one. All documents are kept, those without live spans
    unchanged. A column ``count_col``, if there is one, gets the new length. The few documents with
    candidates are kept in the shared folder; the others are only read.
    """
    scanned = _scan(_rows(docs, docs.columns, text_col, owner_col, repo_col), text_col)
    plain = scanned.where(F.size("found") == 0).select("row.kept.*")
    rich = _numbered(scanned.where(F.size("found") > 0))
    spans = _judged(rich, max_owners).select("number", F.filter("spans", lambda s: s["live"]).alias("spans"))
    held = rich.join(spans, "number", "left").select(F.col("row.kept").alias("row"), "spans")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema.fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pa.array(
                (
                    masked(t, [(s["first"], s["past"]) for s in spans or ()], mark)
                    for t, spans in zip(batch["row"].field(text_col).to_pylist(), batch["spans"].to_pylist())
                ),
                pa.string(),
            )
            yield pa.RecordBatch.from_arrays([batch["row"], batch["spans"], texts], ["row", "spans", "left"])

    done = held.mapInArrow(work, f"{kinds}, left string")
    columns = []
    for name in docs.columns:
        old = F.col("row")[name]
        new = {text_col: F.col("left"), count_col: F.length("left")}.get(name, old)
        columns.append(F.when(F.size("spans") > 0, new.cast(docs.schema[name].dataType)).otherwise(old).alias(name))
    return plain.select(*docs.columns).union(done.select(*columns))


def masked(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, at = [], 0
    for first, past in sorted(spans):
        if first >= at:
            out += [text[at:first], mark]
        at = max(at, past)
    return "".join([*out, text[at:]])


def _texts(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(
        ",",
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["first"].cast("string"), s["past"].cast("string")),
        ),
    )


def report(scanned: DataFrame) -> DataFrame:
    """The kept columns with counts of the fixed kinds, their digest, all spans, and live spans."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS) - 1)
    return scanned.select(
        "row.*",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_texts(base), 256).alias("base_sha256"),
        _texts(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )
