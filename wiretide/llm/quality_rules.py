"""Quality rules as a learned decision list, in DataFrame functions only.

Counts per text (words, characters in words, symbols, repeated lines, words in repeated windows)
are built-in expressions over arrays of one row; shares derived from them are the features of a
decision list. The list is learned by sequential covering: a rule, a conjunction of thresholds,
grows by the condition of best gain on one part of the labelled documents, is pruned back on the
other part, and is taken if it is precise there; what it covers is set aside and the next rule
grows. The rules come out as one ordered conditional expression that Spark evaluates per row.

Learning needs counts only: features are coded by thresholds and the labelled documents are grouped
to cells of equal codes, at most 9 ^ (number of features) a part, whatever the number of
documents. Those cells go to the driver. Thresholds are zero, quartiles of the values above zero,
of bad and of good documents apart, and the largest value of a good one: a feature that is zero
in most documents has as many thresholds as any other.

Scale: texts are read once, nothing of them is shuffled; a row's work is proportional to its words
(windows are compared through a hash set, and sorted only in a text with repeats). The table of
counts is kept in the shared folder, for learning and for judging.

Defined results: a null text has no words and so fails the base rule. Without labels there are no
learned rules. Of several labels of a document the worst counts; a null id has none. Repeated rows
are judged one by one. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretide.llm.common import settled

SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
#: Shares of the values above zero at which thresholds lie, for bad and for good documents.
BAD_SHARES, GOOD_SHARES = (0.25, 0.5, 0.75), (0.25, 0.5, 0.75, 1.0)
#: Features of the list: name and expression over the counts.
FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "n_words": "cast(n_words as double)",
}


@dataclass(frozen=True)
class Condition:
    """Feature above (or not above) a threshold; ``code`` is the threshold's number."""

    feature: str
    above: bool
    threshold: float
    code: int

    def holds(self, codes: dict[str, int]) -> bool:
        return (codes[self.feature] > self.code) == self.above

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Cell:
    codes: dict[str, int]
    part: int
    bad: int
    good: int


def counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = F.btrim(text, F.lit(SPACES))
    words = F.when(F.length(plain) > 0, F.split(plain, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    # each step uses an array of the step before more than once, so that Spark keeps them apart
    first = docs.select(
        F.col(id_col).alias("id"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        words.alias("words"),
        lines.alias("lines"),
    )
    second = first.select(
        "id",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("codes"),
    )
    starts = F.when(
        F.size("codes") >= WINDOW, F.sequence(F.lit(0), F.size("codes") - WINDOW)
    ).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.xxhash64(*[F.get("codes", i + k) for k in range(WINDOW)])
    third = second.withColumn("windows", F.transform(starts, window))
    repeats = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _covered(F.col("windows")))
    return third.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(repeats, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _covered(windows: Column) -> Column:
    """How many words windows that occur twice or more cover."""
    ordered = F.array_sort(F.transform(windows, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, j, d: F.coalesce(F.get(s, j + d)["k"] == x["k"], F.lit(False))
        twice = F.filter(s, lambda x, j: F.when(j > 0, same(x, j, -1)).otherwise(F.lit(False)) | same(x, j, 1))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def total(at: Column) -> Column:
        gaps = F.transform(at, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda n, g: n + g)

    return _let(ordered, lambda s: _let(repeated(s), total))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def learn(
    counted: DataFrame,
    labels: DataFrame,
    *,
    label_id: str = "doc_id",
    label_col: str = "quality",
    most_rules: int = 8,
    most_conditions: int = 3,
    precision: float = 0.9,
    support: float = 0.002,
) -> list[list[Condition]]:
    """The rules, each a conjunction that says "bad", in order.

    ``counted`` has the counts per document; a label of 0 is bad. One part in three of the labelled
    documents, by CRC of the id, prunes; the rest grows.
    """
    worst = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(
        F.min(label_col).alias("label")
    )
    known = counted.join(worst, "id").where(~base_failed()).select(
        (F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 0).cast("int").alias("part"),
        (F.col("label") == 0).cast("int").alias("bad"),
        *(F.expr(e).alias(n) for n, e in FEATURES.items()),
    )
    at = lambda n, bad, shares: F.percentile_approx(
        F.when((F.col("bad") == bad) & (F.col(n) > 0), F.col(n)), list(shares), 10_000
    )
    found = known.agg(
        *(at(n, 1, BAD_SHARES).alias(f"{n}_bad") for n in FEATURES),
        *(at(n, 0, GOOD_SHARES).alias(f"{n}_good") for n in FEATURES),
    ).first()
    cuts = {n: sorted({0.0, *(found[f"{n}_bad"] or ()), *(found[f"{n}_good"] or ())}) for n in FEATURES}
    code = lambda n: sum((F.col(n) > t).cast("int") for t in cuts[n])
    rows = (
        known.select("part", "bad", *(code(n).alias(n) for n in FEATURES))
        .groupBy("part", *FEATURES)
        .agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
        .collect()
    )
    cells = [Cell({n: r[n] for n in FEATURES}, r["part"], r["bad"], r["good"]) for r in rows]
    every = [
        Condition(n, above, t, k) for n in FEATURES for k, t in enumerate(cuts[n]) for above in (True, False)
    ]
    return cover(cells, every, most_rules, most_conditions, precision, support)


def cover(
    cells: Sequence[Cell], every: list[Condition], most_rules: int, most_conditions: int, precision: float, support: float
) -> list[list[Condition]]:
    """Sequential covering over cells: grow on part 0, prune on part 1, keep precise rules."""
    left, rules = list(cells), []
    least = max(1.0, support * sum(c.bad + c.good for c in cells if c.part == 0))
    while len(rules) < most_rules:
        rule = _pruned(_grown([c for c in left if c.part == 0], every, most_conditions), [c for c in left if c.part == 1])
        covered = [c for c in left if _all(rule, c)] if rule else []
        bad, good = sum(c.bad for c in covered), sum(c.good for c in covered)
        if bad < least or bad < precision * (bad + good):
            break
        rules.append(rule)
        left = [c for c in left if not _all(rule, c)]
    return rules


def _all(rule: list[Condition], cell: Cell) -> bool:
    return all(c.holds(cell.codes) for c in rule)


def _grown(cells: list[Cell], every: list[Condition], most: int) -> list[Condition]:
    """Add the condition of greatest gain (log odds of bad, times the bad covered) until none gains."""
    from math import log2

    rule: list[Condition] = []
    while len(rule) < most:
        bad, good = sum(c.bad for c in cells), sum(c.good for c in cells)
        if not bad or not good:
            break
        best, gain = None, 0.0
        for condition in every:
            held = [c for c in cells if condition.holds(c.codes)]
            b, g = sum(c.bad for c in held), sum(c.good for c in held)
            if b and b * (log2((b + 0.5) / (b + g + 1)) - log2((bad + 0.5) / (bad + good + 1))) > gain:
                best, gain = condition, b * (log2((b + 0.5) / (b + g + 1)) - log2((bad + 0.5) / (bad + good + 1)))
        if best is None:
            break
        rule.append(best)
        cells = [c for c in cells if best.holds(c.codes)]
    return rule


def _pruned(rule: list[Condition], cells: list[Cell]) -> list[Condition]:
    """The beginning of the rule that is worth most on cells it has not seen: (bad - good) / covered."""

    def worth(size: int) -> float:
        held = [c for c in cells if _all(rule[:size], c)]
        bad, good = sum(c.bad for c in held), sum(c.good for c in held)
        return (bad - good) / (bad + good) if bad + good else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda n: (worth(n), -n))] if rule else []


def verdict(rules: list[list[Condition]]) -> Column:
    """False where a rule holds, the rules tried in order, else true."""
    out = None
    for rule in rules:
        holds = rule[0].column()
        for condition in rule[1:]:
            holds = holds & condition.column()
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per document row the id, the counts, ``base_failed`` and ``kept``."""
    counted = settled(counts(docs, id_col=id_col, text_col=text_col))
    rules = learn(counted, labels, **how)
    return counted.select(
        F.col("id").alias(id_col),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & verdict(rules)).alias("kept"),
    )
