"""License scan by an exact set-similarity join between text blocks and license templates.

A text's words are cut into overlapping blocks (``BLOCK`` words, a new one every half block), so
that any run of half a block's words lies whole in some block. A block meets a template when it
holds at least ``threshold`` of the template's distinct words (containment). The join is exact and
filtered three ways, on tokens in one global order from rare to frequent, counted over the blocks
of all documents:

* length: a block with fewer template words than the smallest template needs is never a row;
* prefix: a block that meets a template of n words, k of them needed, holds one of its n - k + 1
  rarest words, so only those are join keys;
* position: from the positions of the shared word in both ordered token lists follows how many
  more can be shared; too few ends the pair.

Beside it stand the phrases: places where a phrase's words stand consecutively.

Scale: one pass over the texts; documents are never shuffled. Its output (counts, phrase places,
blocks with enough template words) is kept in the shared folder. Frequencies are added up per
partition before they are grouped. The prefix table has at most as many rows as the templates have
words, so it may be broadcast whatever the size of the corpus.

Defined results: null texts are empty. Repeated rows are judged one by one. Only the named columns
are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretide.llm.common import alnum_words, settled, slices

#: Phrases (lower-case words) and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Templates, well-known sentences of licenses, and their labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)
BLOCK = 64
THRESHOLD = 0.9


def _sets(templates) -> list[tuple[str, frozenset[bytes]]]:
    for label, text in templates:
        if (size := len(alnum_words(text))) > BLOCK // 2:
            raise ValueError(f"a template of {label} has {size} words; only {BLOCK // 2} lie whole in some block")
    return [(label, frozenset(alnum_words(text))) for label, text in templates]


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def _places(words: list[bytes], phrases: list[list[bytes]], firsts: frozenset) -> list[tuple[int, int]]:
    """(word number, phrase number) of all places."""
    out = []
    for at, word in enumerate(words) if not firsts.isdisjoint(words) else ():
        if word in firsts:
            out += [(at, k) for k, p in enumerate(phrases) if words[at : at + len(p)] == p]
    return out


_FIELDS = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("phrases", pa.list_(pa.int32())),
    ("blocks", pa.list_(pa.struct([("block", pa.int32()), ("tokens", pa.list_(pa.int32()))]))),
    ("counts", pa.list_(pa.struct([("token", pa.int32()), ("n", pa.int64())]))),
]
_SCHEMA = (
    "id {kind}, n_words long, n_base long, first_word long, last_word long, phrases array<int>, "
    "blocks array<struct<block:int,tokens:array<int>>>, counts array<struct<token:int,n:long>>"
)


def _scan(rows: DataFrame, sets, phrases: list[str], threshold: float) -> DataFrame:
    """A row per document, and one more per task with the number of blocks that hold each token."""
    vocabulary = {w: k for k, w in enumerate(sorted(set().union(*(s for _, s in sets))))}
    least = min((needed(len(s), threshold) for _, s in sets), default=1)
    split = [p.encode().split() for p in phrases]
    firsts, known = frozenset(p[0] for p in split), frozenset(vocabulary)
    kind = rows.schema["id"].dataType.simpleString()

    def judge(text: str | None, seen: Counter) -> dict:
        words = alnum_words(text)
        found = _places(words, split, firsts)
        places = [p for p, _ in found]
        blocks = []
        for number, start in enumerate(range(0, max(len(words) - BLOCK // 2, 1), BLOCK // 2)):
            held = known.intersection(words[start : start + BLOCK])
            seen.update(held)
            if len(held) >= least:
                blocks.append({"block": number, "tokens": [vocabulary[w] for w in held]})
        return {
            "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None),
            "last_word": max(places, default=None), "phrases": sorted({p for _, p in found}), "blocks": blocks,
        }

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            schema = pa.schema([("id", batch["id"].type), *_FIELDS])
            out = [judge(text, seen) for text in batch["text"].to_pylist()]
            columns = [pa.array([row.get(f) for row in out], kind) for f, kind in _FIELDS]
            yield pa.RecordBatch.from_arrays([batch["id"], *columns], schema=schema)
        if seen:
            counts = [{"token": vocabulary[w], "n": n} for w, n in seen.items()]
            columns = [pa.array([counts if f.name == "counts" else None], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.mapInArrow(work, _SCHEMA.format(kind=kind))


def _pairs(scanned: DataFrame, sets, threshold: float) -> DataFrame:
    """``number`` (document row), ``block``, ``label``, ``share`` of blocks that meet a template."""
    spark = scanned.sparkSession
    vocabulary = {w: k for k, w in enumerate(sorted(set().union(*(s for _, s in sets))))}
    counts = scanned.where("counts IS NOT NULL").select(F.inline("counts")).groupBy("token").agg(F.sum("n"))
    frequency = {t: n for t, n in counts.collect()}  # one row per template word
    order = {t: k for k, t in enumerate(sorted(vocabulary.values(), key=lambda t: (frequency.get(t, 0), t)))}
    prefix, sizes = [], []
    for k, (label, words) in enumerate(sets):
        ranks, need = sorted(order[vocabulary[w]] for w in words), needed(len(words), threshold)
        sizes.append((k, label, len(words), need, ranks))
        prefix += [(rank, k, at) for at, rank in enumerate(ranks[: len(words) - need + 1])]
    keys = F.broadcast(spark.createDataFrame(prefix, "rank int, template int, template_at int"))
    heads = F.broadcast(
        spark.createDataFrame(sizes, "template int, label string, size int, need int, words array<int>")
    )
    ranks = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    blocks = scanned.where(F.size("blocks") > 0).select("number", F.inline("blocks"))
    blocks = blocks.withColumn("tokens", F.array_sort(F.transform("tokens", lambda t: ranks[t])))
    candidates = (
        blocks.select("number", "block", "tokens", F.posexplode("tokens").alias("block_at", "rank"))
        .join(keys, "rank")
        .join(heads, "template")
        .where(F.size("tokens") >= F.col("need"))
        # both lists are ordered: beside this word, at most the words after it and those before it
        .where(
            F.least(F.size("tokens") - F.col("block_at"), F.col("size") - F.col("template_at"))
            + F.least(F.col("block_at"), F.col("template_at"))
            >= F.col("need")
        )
    )
    shared = F.size(F.array_intersect("tokens", "words"))
    return (
        candidates.withColumn("shared", shared)
        .where(F.col("shared") >= F.col("need"))
        .select("number", "block", "label", (F.col("shared") / F.col("size")).alias("share"))
        .distinct()
    )


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates=TEMPLATES,
    phrases: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per document row: word and phrase counts, labels of phrases and of both, and a score.

    Columns: the id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels``, ``score`` (1 with a phrase, else the greatest containment met, else 0), ``n_blocks``
    (blocks that meet a template).
    """
    phrases = PHRASES if phrases is None else phrases
    sets = _sets(templates)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scanned = _scan(source, sets, list(phrases), threshold)
    scanned = settled(scanned.withColumn("number", F.monotonically_increasing_id()))
    found = (
        _pairs(scanned, sets, threshold)
        .groupBy("number")
        .agg(
            F.collect_set("label").alias("more"),
            F.max("share").alias("share"),
            F.countDistinct("block").alias("n_blocks"),
        )
    )
    labels = F.array(*[F.lit(v) for v in phrases.values()])
    rows = scanned.where("counts IS NULL").join(found, "number", "left")
    rows = rows.withColumn("base", F.array_sort(F.array_distinct(F.transform("phrases", lambda k: F.get(labels, k)))))
    both = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", both).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )
