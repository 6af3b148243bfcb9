"""Scores adapted to each rule's recent history.

A rule's baseline is its last ``window_size`` recorded scores from earlier flushes. Scores above
the baseline are boosted and scores below it damped, in proportion to their distance in standard
deviations.

* ``record="adapted"`` records the adapted score, as the live engine does. Each score then depends
  on all earlier ones. Blocks of flushes are folded at once, each from a guess: the window that the rows
  before it lead to, folded from nothing. Where the guess is not the window that the block before
  really ends with, the block is folded again from that; influence fades with every window, so
  few blocks are. What a few rounds do not settle is walked through in order, by session and rule,
  holding ``window_size`` numbers and never a whole history. The result is the walk's, to the bit.
* ``record="original"`` records the raw score. Nothing is recursive; built-in windows do it, over
  blocks of flushes that each carry a copy of the ``window_size`` scores before them, so a rule
  with most of the findings is spread over tasks.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from wiretide.functions.scoring import risk_score, severity_code, severity_name
from wiretide.session import scratch_folder, written


# Flushes per block.
BLOCK_FLUSHES = 10_000
#: Windows of rows before a block that its first guess is folded from.
LEAD_WINDOWS = 20
#: How often blocks are folded again before what is left is walked through in order.
ROUNDS = 5


@dataclass(frozen=True)
class AdaptiveConfig:
    """Defaults of the adaptation."""

    window_size: int = 100
    min_samples: int = 10
    z_boost: float = 0.15
    z_suppress: float = 0.15
    z_cap: float = 3.0
    min_deviation: float = 1e-9
    enabled: bool = True
    disabled_rules: tuple[str, ...] = field(default=())


def adapt_value(
    raw: float, samples: int, mean: float, deviation: float, config: AdaptiveConfig
) -> float:
    """Adapted form of one score, already cut to 0..1, against one baseline."""
    if samples < config.min_samples:
        return raw
    if deviation > config.min_deviation:
        distance = min(max((raw - mean) / deviation, -config.z_cap), config.z_cap)
    else:
        distance = config.z_cap * ((raw > mean) - (raw < mean))
    slope = config.z_boost if distance > 0 else config.z_suppress
    return min(max(raw * max(1.0 + distance * slope, 0.0), 0.0), 1.0)


def adapt_column(
    raw: Column, samples: Column, mean: Column, deviation: Column, config: AdaptiveConfig
) -> Column:
    """``adapt_value`` as a Column expression."""
    raw = F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
    cap = F.lit(config.z_cap)
    distance = F.when(
        deviation > config.min_deviation,
        F.greatest(F.least((raw - mean) / deviation, cap), -cap),
    ).otherwise(F.signum(raw - mean) * cap)
    slope = F.when(distance > 0, F.lit(config.z_boost)).otherwise(F.lit(config.z_suppress))
    factor = F.greatest(1.0 + distance * slope, F.lit(0.0))
    moved = F.least(F.greatest(raw * factor, F.lit(0.0)), F.lit(1.0))
    return F.when(samples >= config.min_samples, moved).otherwise(raw)


class _Fold:
    """Running baseline of the (group, rule) being read."""

    def __init__(self, config: AdaptiveConfig) -> None:
        self.config = config
        self.key: tuple | None = None
        self.flush: object = None
        self.adapting = False
        self.history: deque[float] = deque(maxlen=config.window_size)
        self.pending: deque[float] = deque(maxlen=config.window_size)
        self.base = (0, 0.0, 0.0)

    def score(self, key: tuple, flush: object, raw: float) -> float:
        if key != self.key or flush != self.flush:
            self._open(key, flush)
        adapted = min(max(raw, 0.0), 1.0)
        if self.adapting:
            adapted = adapt_value(adapted, *self.base, self.config)
        self.pending.append(adapted)
        return adapted

    def _open(self, key: tuple, flush: object) -> None:
        if key == self.key:
            self.history.extend(self.pending)
        else:
            self.key = key
            self.adapting = self.config.enabled and key[1] not in self.config.disabled_rules
            self.history.clear()
        self.pending.clear()
        self.flush = flush
        n = len(self.history)
        if n:
            mean = sum(self.history) / n
            self.base = (n, mean, math.sqrt(sum((x - mean) ** 2 for x in self.history) / n))
        else:
            self.base = (0, 0.0, 0.0)


def _fold_batches(
    batches: Iterator[pd.DataFrame], by: str, config: AdaptiveConfig
) -> Iterator[pd.DataFrame]:
    """Fold rows that arrive sorted by (group, rule, flush, seq)."""
    fold = _Fold(config)
    for batch in batches:
        adapted, samples = np.empty(len(batch)), np.empty(len(batch), dtype="int64")
        columns = (batch[c].tolist() for c in (by, "rule_id", "flush_id", "raw_score"))
        for place, (group, rule, flush, raw) in enumerate(zip(*columns)):
            adapted[place] = fold.score((group, rule), flush, raw)
            samples[place] = fold.base[0]
        yield batch.assign(baseline_samples=samples, adapted_score=adapted)


def _fold_block(rows: pd.DataFrame, key: tuple, start: list[float], config: AdaptiveConfig):
    """Adapted scores, baseline sizes and the window at the end of sorted rows that ``start`` precedes."""
    fold = _Fold(config)
    fold.key = key
    fold.adapting = config.enabled and key[1] not in config.disabled_rules
    fold.history.extend(start)
    adapted, samples = np.empty(len(rows)), np.empty(len(rows), dtype="int64")
    for place, (flush, raw) in enumerate(zip(rows["flush_id"].tolist(), rows["raw_score"].tolist())):
        adapted[place] = fold.score(key, flush, raw)
        samples[place] = fold.base[0]
    fold.history.extend(fold.pending)
    return adapted, samples, list(fold.history)


def _folded(rows: pd.DataFrame, by: str, start: list[float], config: AdaptiveConfig) -> pd.DataFrame:
    """A block's rows with their scores, and one more row with its windows at start and end."""
    adapted, samples, end = _fold_block(rows, (rows[by].iat[0], rows["rule_id"].iat[0]), start, config)
    done = rows.assign(baseline_samples=pd.array(samples, "Int64"), adapted_score=adapted)
    border = done.iloc[:1].assign(_start=[start], _end=[end])
    return pd.concat([done.assign(_start=None, _end=None), border], ignore_index=True)


def _adapted_in_blocks(scores: DataFrame, config: AdaptiveConfig, by: str, flushes: int) -> DataFrame:
    """``record="adapted"``: blocks from guessed windows, until every guess is right."""
    key, spark = [by, "rule_id"], scores.sparkSession
    place = [*key, "_block"]
    blocked = _blocks_with_lead(scores, key, int(LEAD_WINDOWS * config.window_size), flushes)
    schema = T.StructType([*scores.schema.fields, T.StructField("_block", T.LongType())])
    schema = schema.add("baseline_samples", T.LongType()).add("adapted_score", T.DoubleType())
    for name in ("_start", "_end"):
        schema = schema.add(name, T.ArrayType(T.DoubleType()))

    def guess(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["flush_id", "seq"])
        lead = frame["_lead"].to_numpy(bool)
        rows, before = frame[~lead].drop(columns="_lead"), frame[lead]
        start = _fold_block(before, (rows[by].iat[0], rows["rule_id"].iat[0]), [], config)[2] if len(before) else []
        return _folded(rows, by, start, config)

    def again(frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return _folded(frame.sort_values(["flush_id", "seq"]), by, np.asarray(known["_true"].iat[0]).tolist(), config)

    def kept(table: DataFrame) -> DataFrame:
        return written(table, scratch_folder(spark))[0]

    parts = [kept(blocked.groupBy(*place).applyInPandas(guess, schema))]
    rows = blocked.where("NOT _lead").drop("_lead")
    empty = F.array().cast("array<double>")
    before = F.coalesce(F.lag("_end").over(Window.partitionBy(*key).orderBy("_block")), empty)
    borders = parts[0].where("_end IS NOT NULL").select(*place, "_start", "_end", F.lit(0).alias("_round"))
    for turn in range(1, ROUNDS + 1):
        wrong = kept(borders.withColumn("_true", before).where("_start <> _true").select(*place, "_true"))
        if not wrong.limit(1).count():
            break
        told = rows.join(wrong, place, "left_semi").groupBy(*place).cogroup(wrong.groupBy(*place))
        parts.append(kept(told.applyInPandas(again, schema)))
        new = parts[-1].where("_end IS NOT NULL").select(*place, "_start", "_end", F.lit(turn).alias("_round"))
        borders = kept(borders.join(wrong, place, "left_anti").unionByName(new))
    late = borders.withColumn("_true", before).where("_start <> _true").select(*key).distinct()
    valid = borders.join(late, key, "left_anti").select(*place, "_round")
    done = [
        part.where("_end IS NULL").withColumn("_round", F.lit(turn)).join(valid, [*place, "_round"], "left_semi")
        for turn, part in enumerate(parts)
    ]
    columns = [*scores.columns, "baseline_samples", "adapted_score"]
    settled = reduce(DataFrame.unionByName, (part.select(*columns) for part in done))
    return settled.unionByName(_walked(scores.join(late, key, "left_semi"), config, by))


def _walked(scores: DataFrame, config: AdaptiveConfig, by: str) -> DataFrame:
    """``record="adapted"`` in order, one task per (group, rule) at a time."""
    schema = T.StructType(scores.schema.fields[:])
    schema = schema.add("baseline_samples", T.LongType()).add("adapted_score", T.DoubleType())
    ordered = scores.repartition(by, "rule_id").sortWithinPartitions(by, "rule_id", "flush_id", "seq")
    return ordered.mapInPandas(lambda batches: _fold_batches(batches, by, config), schema)


def _blocks(scores: DataFrame, key: list[str], rows: int, flushes: int) -> DataFrame:
    """Rows with the ``_block`` of ``flushes`` flushes they belong to; blocks that hold few rows of a rule
    are put together up to about ``rows``, so that copies made for each block stay in proportion."""
    place = [*key, "_block"]
    blocked = scores.withColumn("_block", F.call_function("div", F.col("flush_id"), F.lit(flushes)))
    cells = blocked.groupBy(*place).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    runs = cells.select(
        *(F.col(c).alias(f"{c}_") for c in place), F.call_function("div", so_far, F.lit(max(1, rows))).alias("_run")
    )
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"{c}_")) for c in place))
    return blocked.join(runs, same).select(*scores.columns, F.col("_run").alias("_block"))


def _blocks_with_lead(scores: DataFrame, key: list[str], size: int, flushes: int) -> DataFrame:
    """Rows with their ``_block`` of flushes, plus copies (``_lead``) of the ``size`` rows before
    each block.

    Only the last ``size`` rows of a block can matter to later blocks. Numbered through per key,
    the rows before a block are the ``size`` numbers below its first one; joining on number
    ranges of that width finds them without comparing all pairs.
    """
    blocked = _blocks(scores, key, size // 2, flushes).withColumn("_lead", F.lit(False))
    newest = Window.partitionBy(*key, "_block").orderBy(F.desc("flush_id"), F.desc("seq"))
    tails = (
        blocked.withColumn("_place", F.row_number().over(newest))
        .where(F.col("_place") <= size)
        .withColumn(
            "_number",
            F.row_number().over(Window.partitionBy(*key).orderBy("_block", F.desc("_place"))),
        )
    )
    starts = (
        tails.groupBy(*key, "_block")
        .agg(F.min("_number").alias("_start"))
        .select(
            *key,
            F.col("_block").alias("_to"),
            "_start",
            F.explode(
                F.array_distinct(
                    F.transform(
                        F.array(F.col("_start") - size, F.col("_start") - 1),
                        lambda n: F.floor(n / size),
                    )
                )
            ).alias("_range"),
        )
    )
    lead = (
        tails.withColumn("_range", F.floor(F.col("_number") / size))
        .join(starts, [*key, "_range"])
        .where(F.col("_number").between(F.col("_start") - size, F.col("_start") - 1))
        .withColumns({"_block": F.col("_to"), "_lead": F.lit(True)})
        .select(*blocked.columns)
    )
    return blocked.unionByName(lead)


def adaptive_scores(
    scores: DataFrame,
    config: AdaptiveConfig | None = None,
    *,
    record: str = "adapted",
    by: str = "session_id",
    block_flushes: int = BLOCK_FLUSHES,
) -> DataFrame:
    """Add ``baseline_samples`` and ``adapted_score``.

    ``scores``: ``by``, rule_id, flush_id (increasing), seq (order inside a flush), raw_score.
    ``block_flushes`` says how many flushes, at least, one task handles of a rule; it has no bearing on the result.
    """
    config = config or AdaptiveConfig()
    if record == "adapted":
        return _adapted_in_blocks(scores, config, by, block_flushes)
    if record != "original":
        raise ValueError(f"record must be 'adapted' or 'original', not {record!r}")

    key = [by, "rule_id"]
    earlier = (
        Window.partitionBy(*key, "_block")
        .orderBy("flush_id", "seq")
        .rowsBetween(-config.window_size, -1)
    )
    flush_start = (
        Window.partitionBy(*key, "_block", "flush_id")
        .orderBy("seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    with_base = _blocks_with_lead(scores, key, config.window_size, block_flushes).withColumns(
        {
            "_n": F.count("raw_score").over(earlier),
            "_mean": F.avg("raw_score").over(earlier),
            "_std": F.stddev_pop("raw_score").over(earlier),
        }
    )
    # the baseline before a flush's first row holds exactly the rows of earlier flushes
    first = with_base.withColumns(
        {
            "baseline_samples": F.first("_n").over(flush_start),
            "_mean": F.first("_mean").over(flush_start),
            "_std": F.first("_std").over(flush_start),
        }
    )
    adapted = adapt_column(
        F.col("raw_score"), F.col("baseline_samples"), F.col("_mean"), F.col("_std"), config
    )
    if not config.enabled:
        adapted = F.least(F.greatest("raw_score", F.lit(0.0)), F.lit(1.0))
    elif config.disabled_rules:
        adapted = F.when(
            F.col("rule_id").isin(*config.disabled_rules),
            F.least(F.greatest("raw_score", F.lit(0.0)), F.lit(1.0)),
        ).otherwise(adapted)
    return (
        first.where(~F.col("_lead"))
        .withColumn("adapted_score", adapted)
        .drop("_n", "_mean", "_std", "_block", "_lead")
    )


def baseline_stats(
    scores: DataFrame,
    config: AdaptiveConfig | None = None,
    by: str = "session_id",
    column: str = "raw_score",
) -> DataFrame:
    """Mean, population deviation and size of each rule's latest window."""
    config = config or AdaptiveConfig()
    newest = Window.partitionBy(by, "rule_id").orderBy(F.desc("flush_id"), F.desc("seq"))
    return (
        scores.withColumn("place", F.row_number().over(newest))
        .where(F.col("place") <= config.window_size)
        .groupBy(by, "rule_id")
        .agg(
            F.avg(column).alias("mean"),
            F.stddev_pop(column).alias("std_dev"),
            F.count(column).alias("samples"),
        )
        .withColumn("window_size", F.lit(config.window_size))
    )


def rescore(findings: DataFrame, adapted: str = "adapted_score") -> DataFrame:
    """Findings with raw score, risk score and severity taken from the adapted score."""
    raw = F.least(F.greatest(F.col(adapted), F.lit(0.0)), F.lit(1.0))
    score = risk_score(raw)
    return findings.withColumns(
        {
            "raw_score": raw,
            "risk_score": score,
            "severity_code": severity_code(score),
            "severity": severity_name(severity_code(score)),
        }
    ).drop(adapted)


STATE_SCHEMA = T.StructType([T.StructField("history", T.ArrayType(T.DoubleType()))])


def stream_adaptive_scores(
    scores: DataFrame,
    config: AdaptiveConfig | None = None,
    by: Sequence[str] = ("session_id",),
    keep_seconds: float | None = None,
) -> DataFrame:
    """Stateful twin of ``adaptive_scores`` for a stream: a micro-batch holds one or more flushes.

    Flushes arrive in the order of ``flush_id``; one that two micro-batches share counts as two.
    The state of a key is its last ``window_size`` adapted scores. With ``keep_seconds`` it ends so much
    wall-clock time after the key's last score; Spark then goes on making micro-batches without data, so a
    stream that is to drain its source and end (``availableNow``) must do without.
    """
    config = config or AdaptiveConfig()
    schema = T.StructType(scores.schema.fields[:])
    schema = schema.add("baseline_samples", T.LongType()).add("adapted_score", T.DoubleType())
    rule_at = len(by)

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        fold = _Fold(config)
        fold.key = (key[:rule_at], key[rule_at])
        fold.pending.extend(state.get[0] if state.exists else ())
        fold.adapting = config.enabled and key[rule_at] not in config.disabled_rules
        # a rule's part of one micro-batch, flush after flush
        frame = pd.concat(batches).sort_values(["flush_id", "seq"], kind="stable")
        flushes = pd.factorize(frame["flush_id"], use_na_sentinel=False)[0].tolist()
        adapted, samples = [], []
        for flush, raw in zip(flushes, frame["raw_score"].tolist()):
            adapted.append(fold.score(fold.key, flush, raw))
            samples.append(fold.base[0])
        fold.history.extend(fold.pending)
        yield frame.assign(baseline_samples=samples, adapted_score=adapted)
        state.update((list(fold.history),))
        if keep_seconds is not None:
            state.setTimeoutDuration(max(1, int(keep_seconds * 1000)))

    timeout = GroupStateTimeout.NoTimeout if keep_seconds is None else GroupStateTimeout.ProcessingTimeTimeout
    return scores.groupBy(*by, "rule_id").applyInPandasWithState(step, schema, STATE_SCHEMA, "append", timeout)
