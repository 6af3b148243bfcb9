"""Language identification with a string kernel, Nystroem landmarks and kernel ridge regression.

The kernel is a blended spectrum: two texts are compared by the character n-grams, n from 1 to
``MAX_N``, that occur in both (presence, not count), normalised by the geometric mean of their
numbers. N-grams are hashed to ``BUCKETS`` places, so a text is one row of bits whatever its
length. A bounded sample of labelled texts gives the landmarks; the Nystroem map takes a text to
kernel values against them, times the inverse root of their kernel matrix; one ridge regression per
language (one versus the rest) is solved in that space. Scoring is three matrix products per batch.

The model is fitted on the driver from at most ``per_language`` texts per language, of which
``landmarks`` in all are landmarks; both are parameters, and the sample is drawn by hash of id and
text, so it is the same at any partitioning. Scoring reads every text once, whole, without a
shuffle; a task holds the model (landmarks x buckets) and one block of texts.

The best of k scores is never below 1/k, whatever the text, so scores alone cannot reject. Two other
figures can: the share of a text's n-grams that the sample of its best language holds, and the
share of its characters that are letters. Their thresholds are fitted on the same sample (``fit_limits``).

Defined results: a null text or one without a letter is ``und`` with score 0; so is every text if
no labelled text is left to learn from. Equal texts get equal results. Only text is used to
predict.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretide.llm.common import slices, text_column, texts_of

UNKNOWN = "und"
MAX_N = 3
BUCKETS = 1 << 15
#: Bytes to bytes: ASCII characters that are no letter to a space.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Multipliers of the n-gram hash, odd 64-bit numbers.
_MIX = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x1F3D5B79A1C3E5F7 * k & (2**64 - 1)) for k in range(MAX_N)]


def presence(text: str, out: np.ndarray) -> int:
    """Set the places of the n-grams of the text's lower-cased letters to 1; all else is one space.

    Returns the number of letters.
    """
    plain = " ".join(text.lower().encode().translate(_LETTERS).decode().split())
    codes = np.frombuffer(plain.encode("utf-32-le"), np.uint32).astype(np.uint64)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    gram = np.zeros(len(codes), np.uint64)
    for n in range(min(MAX_N, len(codes))):
        size = len(codes) - n
        gram = gram[:size] * _MIX[0] + codes[n:] + np.uint64(1)
        out[(gram * _MIX[n] ^ (gram >> np.uint64(29)) * _MIX[0]) >> shift] = 1
    return len(plain) - plain.count(" ")


def presences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One row of bits per text, and the roots of their numbers of ones (at least 1)."""
    bits = np.zeros((len(texts), BUCKETS), np.float32)
    for row, text in zip(bits, texts):
        presence(text, row)
    return bits, np.sqrt(np.maximum(bits.sum(1), 1))


def letter_share(text: str, letters: int) -> float:
    """The share of letters among the characters that are no ASCII white space."""
    return letters / max(letters, 1, len(text) - sum(map(text.count, " \t\n\r\x0b\x0c")))


@dataclass(frozen=True)
class Model:
    """Languages, landmark rows (normalised), and the map from kernel values to one score each.

    ``seen`` are the n-grams of each language's sample, ``least_seen`` and ``least_letters`` the
    shares that a text in the language has at least.
    """

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    seen: np.ndarray
    least_seen: np.ndarray
    least_letters: np.ndarray

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One score per language, and whether the text is in its best language."""
        bits = np.zeros((len(texts), BUCKETS), np.float32)
        letters = np.array([letter_share(text, presence(text, row)) for text, row in zip(texts, bits)])
        ones = np.maximum(bits.sum(1), 1)
        scores = bits @ self.landmarks.T / np.sqrt(ones)[:, None] @ self.weights + self.bias
        best = scores.argmax(1)
        seen = (bits @ self.seen.T)[np.arange(len(texts)), best] / ones
        least = self.least_seen[best]
        # a word of a few n-grams says little: one standard deviation is allowed for
        least = least - np.sqrt(least * (1 - least) / ones)
        return scores, (seen >= least) & (letters >= self.least_letters[best])


def fit_limits(bits: list[np.ndarray], letters: list[float], languages: list[str]) -> tuple[np.ndarray, ...]:
    """``seen``, ``least_seen`` and ``least_letters`` of each language, from the packed bits of the sample.

    The least share of seen n-grams is midway between what all but a hundredth of a language's
    texts reach, each against the others of its language, and the median of the texts in other
    languages, which stand for unlearned ones (for one language: what chance would hit). The least
    share of letters is half of what all but a hundredth of the texts reach.
    """
    names = sorted(set(languages))
    counts = {n: np.zeros(BUCKETS, np.int32) for n in names}
    for row, x in zip(bits, languages):
        counts[x] += np.unpackbits(row)
    own, other = {n: [] for n in names}, {n: [] for n in names}
    for row, x in zip(bits, languages):
        on = np.flatnonzero(np.unpackbits(row))
        for n in names:
            (own if n == x else other)[n].append(float((counts[n][on] > (n == x)).mean()))
    seen = np.array([counts[n] > 0 for n in names], np.float32)
    least_seen = [
        (np.quantile(own[n], 0.01) + (np.median(other[n]) if other[n] else hit.mean())) / 2 for n, hit in zip(names, seen)
    ]
    least_letters = [np.quantile([v for v, x in zip(letters, languages) if x == n], 0.01) / 2 for n in names]
    return seen, np.array(least_seen), np.array(least_letters)


def fit_model(texts: list[str], languages: list[str], landmarks: int = 128, ridge: float = 1e-2) -> Model:
    """Nystroem map on evenly drawn landmarks, then one ridge regression per language."""
    names = sorted(set(languages))
    wanted = np.array([[1.0 if x == n else -1.0 for n in names] for x in languages])
    turn = {n: 0 for n in names}
    order = []
    for k, x in enumerate(languages):
        order.append((turn[x], k))
        turn[x] += 1
    chosen = [k for _, k in sorted(order)[:landmarks]]
    bits, norms = presences([texts[k] for k in chosen])
    rows = (bits / norms[:, None]).astype(np.float32)
    inner = rows @ rows.T
    values, vectors = np.linalg.eigh(inner.astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    features, packed, letters = [], [], []
    for start in range(0, len(texts), 64):
        part = texts[start : start + 64]
        bits = np.zeros((len(part), BUCKETS), np.float32)
        letters += [letter_share(text, presence(text, row)) for text, row in zip(part, bits)]
        norms = np.sqrt(np.maximum(bits.sum(1), 1))
        features.append(bits @ rows.T / norms[:, None] @ root)
        packed += list(np.packbits(bits > 0, axis=1))
    mapped = np.vstack(features)
    centre = mapped.mean(0)
    # each language weighs the same, however many texts it has
    counts = {n: languages.count(n) for n in names}
    weight = np.array([1 / counts[x] for x in languages])[:, None] / len(names)
    moved = mapped - centre
    solved = np.linalg.solve(moved.T @ (weight * moved) + ridge / len(texts) * np.eye(moved.shape[1]), moved.T @ (weight * wanted))
    mean = (weight * wanted).sum(0)
    weights = root @ solved
    bias = (mean - centre @ solved).astype(np.float32)
    return Model(names, rows, weights.astype(np.float32), bias, *fit_limits(packed, letters, languages))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(
    labelled: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 300,
    landmarks: int = 128,
) -> Model | None:
    """The model of a sample of at most ``per_language`` texts of each language; None without any.

    The sample is ranked by hash, first on ids alone (Spark keeps only the best of each task before
    the shuffle), and texts are read for the chosen ids only.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & has_letter(F.col(text_col))).select(
        F.xxhash64(F.col(id_col).cast("string")).alias("draw"),
        F.col(text_col).alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    )
    best = Window.partitionBy("lang").orderBy("draw")
    ranked = usable.select("lang", "draw").withColumn("rank", F.row_number().over(best))
    limits = ranked.where(F.col("rank") <= per_language).groupBy("lang").agg(F.max("draw").alias("limit"))
    chosen = usable.join(F.broadcast(limits), "lang").where("draw <= limit").drop("limit")
    again = Window.partitionBy("lang").orderBy("draw", F.xxhash64("text"))
    sample = chosen.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= per_language)
    rows = sorted(sample.select("lang", "draw", "text").collect())
    if not rows:
        return None
    return fit_model([r["text"] for r in rows], [r["lang"] for r in rows], landmarks)


def predict(docs: DataFrame, model: Model | None, *, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``row`` (struct of the kept columns), ``lang_pred``, ``score`` from 0 to 1, and ``known``: whether
    the text is in that language, by the fitted limits.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        has_letter(F.col(text_col)).alias("letters"),
        *text_column(docs, text_col, keep),
    )
    if model is None:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("known"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["row"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            texts = texts_of(batch, text_col, "row")
            names, scores, known = [UNKNOWN] * len(texts), np.zeros(len(texts)), [False] * len(texts)
            given = [k for k, letters in enumerate(batch["letters"].to_pylist()) if letters]
            if given:
                found, sure = shared.value.judge([texts[k] for k in given])
                for k, best, value, is_known in zip(given, found.argmax(1), found.max(1), sure):
                    names[k] = shared.value.languages[best]
                    scores[k] = min(1.0, max(0.0, (float(value) + 1) / 2))
                    known[k] = bool(is_known)
            columns = [batch["row"], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "lang_pred", "score", "known"])

    return rows.mapInArrow(work, f"row {kind}, lang_pred string, score double, known boolean")


def held_out(id_col: Column) -> Column:
    """Whether the document is kept from learning: one in five by CRC of its id; not with a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))
