"""Time-windowed flows: sliding windows and idle expiry. Work on batch and streaming events."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretide.operators.flows import FLOW_KEY, _keys, event_flows, event_rows

WATERMARK = "10 seconds"

#: Buckets per window up to which a window's sums are taken from the rows beside its first one.
MOST_BESIDE = 16
#: Slides per slice of time: the most windows of one flow that one task walks through together.
SLICE_SLIDES = 3600


def _micros(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def _width(seconds: float) -> str:
    return f"{_micros(seconds)} microseconds"


def check_window(size: float, slide: float) -> None:
    """Same argument rules for every sliding window."""
    if size <= 0:
        raise ValueError("window size must be positive")
    if slide <= 0:
        raise ValueError("slide must be positive")
    if slide > size:
        raise ValueError("slide must not exceed the window size")


def _endpoint_rows(events: DataFrame, by: str | Sequence[str], watermark: str) -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", watermark)
    keep = events.select("*", F.col("ts").alias("event_time"))
    return event_rows(keep, [*_keys(by), "event_time"])


def _sums(rows_from_left: Column) -> list[Column]:
    return [
        F.sum("packets").alias("packets"),
        F.sum("bytes").alias("bytes"),
        F.sum(F.when(rows_from_left, F.col("bytes")).otherwise(0)).alias("left_bytes"),
        F.sum("syn").alias("syn"),
        F.sum("rst").alias("rst"),
        F.sum("ack").alias("ack"),
        F.min(F.col("seq") * 2 + F.when(rows_from_left, 0).otherwise(1)).alias("opener"),
        F.min("event_time").alias("start_time"),
        F.max("event_time").alias("end_time"),
    ]


def sliding_flow_counts(
    events: DataFrame,
    size: float = 5.0,
    slide: float = 1.0,
    by: str | Sequence[str] = "session_id",
    watermark: str = WATERMARK,
) -> DataFrame:
    """Flow totals per sliding event-time window, with fixed-size state.

    The end that opened the flow is ``left`` when ``opener`` is even. At rest, events are first added
    up in buckets of the common divisor of size and slide, so that a busy flow meets its windows as
    a few buckets; the windows are then read off the sorted buckets, which are neither hashed nor shuffled once per window (but
    with more than ``MOST_BESIDE`` buckets a window they are). A stream keeps the sums of its windows as state anyway.
    """
    check_window(size, slide)
    rows, sums = _endpoint_rows(events, by, watermark), _sums(F.col("from_left"))
    if not events.isStreaming:
        bucket = math.gcd(_micros(size), _micros(slide))
        at = F.window("event_time", f"{bucket} microseconds")["start"]
        rows = rows.groupBy(at.alias("event_time"), *_keys(by), *FLOW_KEY).agg(*sums)
        if _micros(size) // bucket <= MOST_BESIDE:
            return _windows_of_buckets(rows, [*_keys(by), *FLOW_KEY], _micros(size), _micros(slide), bucket)
        sums = _merged()
    span = F.window("event_time", _width(size), _width(slide))
    return (
        rows.groupBy(span.alias("w"), *_keys(by), *FLOW_KEY)
        .agg(*sums)
        .withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")})
        .drop("w")
    )


def _windows_of_buckets(rows: DataFrame, key: list[str], size: int, slide: int, bucket: int) -> DataFrame:
    """The sums of every window from one row per flow and ``bucket`` microseconds (``event_time``).

    A window belongs to its first bucket, which gives all windows since the flow's bucket before; the others of the window are
    among the next rows. Flows are cut into slices of time, to which the buckets just behind their last windows are added.
    """
    values = ("packets", "bytes", "left_bytes", "syn", "rst", "ack", "opener", "start_time", "end_time")
    width = slide * SLICE_SLIDES

    def floor(us: Column, to: int) -> Column:
        return us - F.pmod(us, F.lit(to))

    at = F.unix_micros("event_time")
    earliest = floor(at - size + bucket + slide - 1, slide)  # start of the first window with the bucket
    slices = F.array_distinct(F.array(floor(earliest, width), floor(at, width)))
    spread = rows.select(*key, at.alias("at"), earliest.alias("earliest"), *values, F.explode(slices).alias("slice"))
    order = Window.partitionBy(*key, "slice").orderBy("at")
    row = F.struct("at", *values)
    beside = [f"next{i}" for i in range(1, size // bucket)]
    known = spread.withColumns(
        {
            "last": F.lag("at").over(order),
            **{name: F.lead(row, i).over(order) for i, name in enumerate(beside, 1)},
        }
    )
    first = F.greatest("earliest", "slice", floor(F.col("last"), slide) + slide)
    final = F.least(floor(F.col("at"), slide), F.col("slice") + width - slide)
    owned = known.where(first <= final).withColumn("w", F.explode(F.sequence(first, final, F.lit(slide))))

    def inside(name: str, value: str) -> Column:
        return F.when(F.col(f"{name}.at") < F.col("w") + size, F.col(f"{name}.{value}"))

    def total(value: str) -> Column:
        return reduce(add, [F.coalesce(inside(n, value), F.lit(0)) for n in beside], F.col(value))

    def end(pick, value: str) -> Column:
        return pick(F.col(value), *[inside(n, value) for n in beside]) if beside else F.col(value)

    return owned.select(
        *key,
        *[total(v).alias(v) for v in values[:6]],
        end(F.least, "opener").alias("opener"),
        end(F.least, "start_time").alias("start_time"),
        end(F.greatest, "end_time").alias("end_time"),
        F.timestamp_micros("w").alias("window_start"),
        F.timestamp_micros(F.col("w") + size).alias("window_end"),
    )


def sliding_flows(
    events: DataFrame, size: float = 5.0, slide: float = 1.0, by: str = "session_id"
) -> DataFrame:
    """Full flow records, interval statistics included, per sliding window (batch events)."""
    check_window(size, slide)
    spread = events.withColumn("w", F.window("ts", _width(size), _width(slide))).withColumn(
        "window_start", F.col("w.start")
    )
    return event_flows(spread.drop("w"), [by, "window_start"])


def _merged() -> list[Column]:
    names = ("packets", "bytes", "left_bytes", "syn", "rst", "ack")
    return [
        *[F.sum(n).alias(n) for n in names],
        F.min("opener").alias("opener"),
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
    ]


def _idle_batch(rows: DataFrame, key: list[str], gap_us: int) -> DataFrame:
    """Idle expiry over data at rest.

    Events are cut into flows inside time slices first, so a busy flow is spread over tasks; the
    pieces, few per flow, are then joined across slice borders by the same rule.
    """
    slice_us = max(gap_us, 60_000_000)
    us = F.unix_micros("event_time")
    in_slice = Window.partitionBy(*key, "slice").orderBy("us")
    so_far = in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = (F.col("us") - F.lag("us").over(in_slice) >= gap_us).cast("int")
    pieces = (
        rows.where(F.col("event_time").isNotNull())
        .withColumn("us", us)
        .withColumn("slice", F.call_function("div", F.col("us"), F.lit(slice_us)))
        .withColumn("opens", F.coalesce(opens, F.lit(1)))
        .withColumn("piece", F.sum("opens").over(so_far))
        .groupBy(*key, "slice", "piece")
        .agg(*_sums(F.col("from_left")))
    )
    in_flow = Window.partitionBy(*key).orderBy("start_time")
    to_here = in_flow.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    idle = F.unix_micros("start_time") - F.unix_micros(F.lag("end_time").over(in_flow))
    return (
        pieces.withColumn("opens", F.coalesce((idle >= gap_us).cast("int"), F.lit(1)))
        .withColumn("piece", F.sum("opens").over(to_here))
        .groupBy(*key, "piece")
        .agg(*_merged())
        .drop("piece")
    )


def idle_flows(
    events: DataFrame,
    gap_seconds: float,
    by: str | Sequence[str] = "session_id",
    watermark: str = WATERMARK,
) -> DataFrame:
    """Flows closed after ``gap_seconds`` without an event."""
    if gap_seconds <= 0:
        raise ValueError("gap must be positive")
    rows = _endpoint_rows(events, by, watermark)
    if not events.isStreaming:
        return _idle_batch(rows, [*_keys(by), *FLOW_KEY], round(gap_seconds * 1_000_000))
    return (
        rows.groupBy(
            F.session_window("event_time", _width(gap_seconds)).alias("w"), *_keys(by), *FLOW_KEY
        )
        .agg(*_sums(F.col("from_left")))
        .drop("w")
    )
