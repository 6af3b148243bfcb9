"""Personal data in plain and in disguised form, reported in offsets of the text as it came.

Four kinds are detected: e-mail addresses, IP addresses, payment cards (Luhn) and phone numbers.
Each text is read twice. First as it is: these are the base spans. Then deobfuscated, by transducers
that rewrite it piece by piece and remember where each piece came from:

* characters that look like ASCII ones (``GLYPHS``; full-width forms; decimal digits of all scripts);
* invisible characters, which go;
* three or more digits spelled out in a row (``DIGITS``), also after ``plus`` and with ``dot`` between;
* ``at`` and ``dot`` in brackets, `` dot `` between words, and `` at `` where a disguised dot follows.

The same detectors run on the rewritten text. What they find there maps back to the source: a span
starts where the source piece of its first character starts and ends where that of its last ends.
It is added if it holds rewritten text and lies in no base span of its kind; base spans always stay.

Scale: one pass over the texts without a shuffle; a task holds a slice of rows. All detectors take time
in proportion to the text, also on very long runs of one character class.

Defined results: a null text is empty. Offsets are code points, ends exclusive. Repeated rows are judged
one by one. Only the named columns are read, so further columns may have any names.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretide.llm.common import slices, text_column, texts_of

#: Kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# an address lies in a run of digits and dots, and starts where digits start
_NUMBERS = re.compile(r"[0-9][0-9.]{6,}")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

#: Characters that look like ASCII ones, by the ASCII character.
GLYPHS = {
    "a": "аα", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "іı", "j": "ј",
    "o": "оο", "p": "рρ", "q": "ԛ", "s": "ѕſ", "v": "ν", "w": "ԝ", "x": "х",
    "y": "у", "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ",
    "I": "ІΙİ", "J": "Ј", "K": "КΚ\u212a", "M": "МΜ", "N": "Ν", "O": "ОΟ",
    "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "@": "﹫", ".": "․。﹒", "+": "﹢", "-": "‐‑‒–−﹣",
    " ": "\u00a0\u2007\u2009\u202f",
}
_PLAIN = {glyph: plain for plain, glyphs in GLYPHS.items() for glyph in glyphs}
# full-width forms lie at a fixed distance from ASCII; decimal digits of other scripts have their value
_PLAIN |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
_PLAIN |= {
    chr(c): str(unicodedata.decimal(chr(c))) for c in range(0x80, sys.maxunicode + 1) if chr(c).isdecimal()
}
_GLYPHS = frozenset(_PLAIN)
_TO_PLAIN = str.maketrans(_PLAIN)
#: Characters that show nothing.
_UNSEEN = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")

#: Digits spelled out in English, French, German and Spanish.
DIGITS = (
    "zero zéro null cero",
    "one un eins uno",
    "two deux zwei dos",
    "three trois drei tres",
    "four quatre vier cuatro",
    "five cinq fünf cinco",
    "six sechs seis",
    "seven sept sieben siete",
    "eight huit acht ocho",
    "nine neuf neun nueve",
)
_VALUE = {word: str(k) for k, words in enumerate(DIGITS) for word in words.split()}
_WORD = "(?:" + "|".join(sorted(_VALUE, key=len, reverse=True)) + ")"
_DOT = r"(?:\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?|\x20dot\x20)"
_UNIT = re.compile(
    rf"""(?P<digits>\b(?:plus\x20)?{_WORD}(?:(?:\x20dot\x20|[\x20-]){_WORD}){{2,}}\b)
    |(?P<at>\x20?[\[({{<]\x20?(?:at|@)\x20?[\])}}>]\x20?|(?<=[a-z0-9])\x20at\x20(?=[a-z0-9-]{{1,63}}{_DOT}[a-z0-9]))
    |(?P<dot>(?<=[a-z0-9]){_DOT}(?=[a-z0-9]))
    |(?P<none>[{"".join(sorted(_UNSEEN))}]+)""",
    re.VERBOSE,
)
_SPELLED = re.compile(rf"(?P<plus>plus\x20)|(?P<word>{_WORD})|(?P<dot>\x20dot\x20)|[\x20-]")
# of three or more digits spelled out in a row some stand between separators
_BETWEEN = [f" {word} " for word in _VALUE]
_BRACKETED = re.compile(r"[\[({<]\x20?(?:at|@|dot|\.)\x20?[\])}>]")

_SPANS = "array<struct<first:int,kind:int,past:int,base:boolean>>"
_TYPE = pa.list_(
    pa.struct([("first", pa.int32()), ("kind", pa.int32()), ("past", pa.int32()), ("base", pa.bool_())])
)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # from each @ to the left: trying every start of a long run would take its square
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        domain = _DOMAIN.match(text, at + 1) if first < at else None
        if domain:
            yield first, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: list[str]) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[::2] + [v * 2 - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def detected(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of plain personal data, by start and then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for run in _NUMBERS.finditer(text):
        for m in _IP.finditer(text, run.start(), run.end()):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) < 3 or (len(p) == 3 and p <= "255") for p in parts):
                out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 13:
            digits = _DIGIT.findall(m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


class Rewritten:
    """A text with its disguises taken off, and the way back.

    ``text`` is the concatenation of pieces; piece k starts at ``places[k]`` there and stands for the
    source from ``firsts[k]`` to ``pasts[k]``. A piece is one that was copied or one that was rewritten.
    """

    def __init__(self, source: str) -> None:
        self.touched: list[int] = []
        odd = frozenset() if source.isascii() else frozenset(source)
        if not odd.isdisjoint(_GLYPHS):
            self.touched = [k for k, c in enumerate(source) if c in _GLYPHS]
            source = source.translate(_TO_PLAIN)
        low = source.lower()  # as long as the source: the one letter for which it is not is a glyph
        self.places, self.firsts, self.pasts = [], [], []
        self.copied: list[bool] = []
        self._parts: list[str] = []
        self._size = at = 0
        for unit in _UNIT.finditer(low) if self._hidden(low, odd) else ():
            self._add(source[at : unit.start()], at, unit.start(), True)
            at = unit.end()
            self.touched.append(unit.start())
            if unit.lastgroup != "digits":
                self._add({"at": "@", "dot": ".", "none": ""}[unit.lastgroup], unit.start(), at, False)
                continue
            for m in _SPELLED.finditer(low, unit.start(), at):
                plain = _VALUE[m[0]] if m["word"] else "+" if m["plus"] else "." if m["dot"] else ""
                self._add(plain, m.start(), m.end(), False)
        if self._parts or self.touched:
            self._add(source[at:], at, len(source), True)
        self.touched.sort()
        self.text = "".join(self._parts)

    @staticmethod
    def _hidden(low: str, odd: frozenset[str]) -> bool:
        """Can there be a unit at all? Much faster than looking for one."""
        if not odd.isdisjoint(_UNSEEN) or " dot " in low or _BRACKETED.search(low):
            return True
        spaced = low.replace("-", " ")
        return any(word in spaced for word in _BETWEEN)

    def _add(self, text: str, first: int, past: int, copied: bool) -> None:
        if text:
            self.places.append(self._size)
            self.firsts.append(first)
            self.pasts.append(past)
            self.copied.append(copied)
            self._parts.append(text)
            self._size += len(text)

    def source_span(self, first: int, past: int) -> tuple[int, int]:
        """The span of the source that a span of ``text`` stands for."""
        k = bisect_right(self.places, first) - 1
        start = self.firsts[k] + (first - self.places[k] if self.copied[k] else 0)
        k = bisect_right(self.places, past - 1) - 1
        return start, self.firsts[k] + past - self.places[k] if self.copied[k] else self.pasts[k]

    def changed(self, first: int, past: int) -> bool:
        """Does the source span hold rewritten text?"""
        return bisect_left(self.touched, past) > bisect_left(self.touched, first)


def spans_of(text: str | None) -> list[tuple[int, int, int, bool]]:
    """(start, kind number, end, is it a base span) of all spans, by start, kind and end."""
    if not text:
        return []
    base = detected(text)
    out = {(*span, True) for span in base}
    plain = Rewritten(text)
    if plain.touched:
        for a, kind, b in detected(plain.text):
            first, past = plain.source_span(a, b)
            inside = any(k == kind and x <= first and past <= y for x, k, y in base)
            if plain.changed(first, past) and not inside:
                out.add((first, kind, past, False))
    return sorted(out)


def scan(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``row`` (struct of the kept columns) and ``spans``, one row per document row.

    ``spans`` is an array, by start, kind and end, of start, kind number, end and ``base``.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *text_column(docs, text_col, keep))
    kind = rows.schema["row"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [
                [{"first": a, "kind": k, "past": b, "base": base} for a, k, b, base in spans_of(text)]
                for text in texts_of(batch, text_col, "row")
            ]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(found, _TYPE)], ["row", "spans"])

    return rows.mapInArrow(work, f"row {kind}, spans {_SPANS}")


def masked(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap as one, by the first."""
    out, at = [], 0
    for first, kind, past, _ in spans:
        if first >= at:
            out += [text[at:first], f"[{KINDS[kind]}]"]
        at = max(at, past)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, *, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """The documents with personal data replaced by its kind in brackets, all columns in place.

    A column ``count_col``, if there is one, gets the new length where a text changed.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch["row"].field(text_col).to_pylist()
            left = [masked(t, spans) if (spans := spans_of(t)) else None for t in texts]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(left, pa.string())], ["row", "left"])

    done = rows.mapInArrow(work, f"row {kind}, left string")
    columns = []
    for name in docs.columns:
        old = F.col("row")[name]
        new = {text_col: F.col("left"), count_col: F.length("left")}.get(name)
        if new is not None:
            old = F.when(F.col("left").isNotNull(), new.cast(docs.schema[name].dataType)).otherwise(old)
        columns.append(old.alias(name))
    return done.select(*columns)


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
    """The kept columns with the counts of base spans, their digest, all spans, and the number added."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return scanned.select(
        "row.*",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(_texts(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        _texts(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
