"""Active flow expiry: a flow is closed a fixed time after its first event, however busy it is.

Closing restarts the flow: the first event at or after the end of one opens the next. Borders depend
on earlier borders; idle expiry is ``windows.idle_flows`` and needs no walk.

At rest, the events of an ordinary key are shuffled once and one task cuts them and adds them up, as
the flows of a key need nothing from other keys. Keys are counted first, by hash; a key with more
events than a task should hold is busy. Its life is cut into time slices. For each slice a task works
out, for every moment a flow may still have been open at its start, which flow is open at its end; that is
a step function, as later openings never overtake earlier ones. A walk over these functions, a few steps
per slice, gives the flow open at each slice's start, and then all slices are cut at once. So one busy
flow is spread over as many tasks as it has slices, and only its steps meet in one. Busy flows shorter
than the expiry time need none of this. Busy keys are few, at most one for so many events, and their hashes go
to every task.

On a stream the open flow of a key is state: the numbers of ``flows.flow_state``, which merge. A
micro-batch is cut by binary searches and added up by segments.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wiretide.operators.flows import _SHORT_GAP, FLOW_KEY, _gap_squares, event_rows, flow_state, flows_from_state
from wiretide.streaming.windows import WATERMARK

#: Seconds per time slice of a flow at rest; no bearing on the result.
SLICE_SECONDS = 3600.0
#: The most events of one key that one task holds; keys with more are cut in time slices. No bearing on the result.
BUSY_ROWS = 200_000

_SUMS = ("left_packets", "left_bytes", "right_packets", "right_bytes", "syn", "rst", "ack", "stamps")
_LEAST = ("opener", "left_first", "right_first")
_MOST = ("left_last", "right_last")
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: What is kept per open flow. Squares of gaps are text, as they outgrow 64 bits.
_STATE = T.StructType(
    [
        *[T.StructField(n, T.LongType()) for n in ("opened_us", *_SUMS, *_LEAST, *_MOST, "first_stamp", "last_stamp")],
        T.StructField("gap_squares", T.StringType()),
    ]
)


def active_flows(
    events: DataFrame,
    seconds: float,
    by: str = "session_id",
    watermark: str = WATERMARK,
    slice_seconds: float = SLICE_SECONDS,
    busy_rows: int = BUSY_ROWS,
) -> DataFrame:
    """Flow records (as ``flows.event_flows``) cut ``seconds`` after they opened; the rest opens the next.

    Events without a time belong to no flow. On a stream an event that is older than the open flow,
    but not older than the watermark, counts for it.
    """
    if seconds <= 0 or slice_seconds <= 0:
        raise ValueError("expiry and slice time must be positive")
    width = round(seconds * 1_000_000)
    timed = events.where(F.col("ts").isNotNull())
    if not events.isStreaming:
        key = [by, *FLOW_KEY]
        rows = event_rows(timed, by).select(*key, "ts_us", "from_left", "seq", "bytes", "packets", "syn", "rst", "ack")
        name = F.xxhash64(*key)
        counted = rows.groupBy(name.alias("_busy")).agg(F.count(F.lit(1)).alias("_rows"))
        busy = F.broadcast(counted.where(F.col("_rows") > busy_rows).select("_busy"))
        some = lambda how: rows.join(busy, name == F.col("_busy"), how)
        ordinary = _cut_keys(some("left_anti"), key, width)
        cut = _opened(some("left_semi"), key, width, round(slice_seconds * 1_000_000))
        return flows_from_state(ordinary.unionByName(flow_state(cut, [by, "opened_us"]).drop("opened_us")), by)
    keep = timed.withWatermark("ts", watermark).select("*", F.col("ts").alias("event_time"))
    return flows_from_state(_streamed(event_rows(keep, [by, "event_time"]), [by, *FLOW_KEY], width), by)


# -- at rest -----------------------------------------------------------------------------------
def _starts(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Where, among sorted rows, the columns take other values; null is a value."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for name in columns:
        codes = pc.dictionary_encode(table[name].combine_chunks(), null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Sorted rows, cut only where the columns take other values."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        last = int(_starts(table, columns)[-1])
        if last:
            yield pa.concat_tables([*held, table.slice(0, last)])
            held = []
        elif held and len(_starts(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), table.slice(0, 1)]), columns)) > 1:
            yield pa.concat_tables(held)
            held = []
        held.append(table.slice(last))
    if held:
        yield pa.concat_tables(held)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().to_numpy(zero_copy_only=False)


def _flow_starts(stamps: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Where flows start among the sorted stamps of many keys; ``starts`` says where the keys do."""
    found, times = [], stamps.tolist()
    for at, past in zip(starts.tolist(), [*starts[1:].tolist(), len(times)]):
        while at < past:
            found.append(at)
            at = bisect_left(times, times[at] + width, at + 1, past)
    return np.array(found, np.int64)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the segments that start at ``at``, in numbers without bound where 64 bits may not do."""
    most = max(-int(values.min()), int(values.max()))
    return np.add.reduceat(values if most * len(values) < 2**63 else values.astype(object), at)


def _states(table: pa.Table, key: list[str], width: int) -> pa.Table:
    """Of whole keys, the numbers of ``flows.flow_state`` of all their flows; the opener and squares of gaps in parts."""
    codes = [pc.dictionary_encode(table[n].combine_chunks(), null_encoding="encode").indices.to_numpy() for n in key]
    stamps, left = _numbers(table, "ts_us"), _numbers(table, "from_left")
    # rows without a number come first, as in an ordered window
    known, seq = table["seq"].combine_chunks().is_valid().to_numpy(zero_copy_only=False), table["seq"].fill_null(_LOW).to_numpy()
    order = np.lexsort((stamps, *codes))
    new = np.append(True, np.zeros(len(order) - 1, bool))
    for code in codes:
        new[1:] |= np.diff(code[order]) != 0
    at = _flow_starts(stamps[order], np.flatnonzero(new), width)
    flow = np.repeat(np.arange(len(at)), np.diff(at, append=len(order)))
    order = order[np.lexsort((~left[order], seq[order], flow))]
    stamps, left, known, seq = stamps[order], left[order], known[order], seq[order]
    last = np.append(at[1:], len(order)) - 1
    unknown = np.add.reduceat(~known, at, dtype=np.int64)
    first, none = np.minimum(at + unknown, last), unknown > last - at

    gaps = np.diff(stamps, prepend=stamps[:1])
    gaps[1:][known[1:] & ~known[:-1]] = 0
    gaps[at] = 0
    short = np.abs(gaps) <= _SHORT_GAP
    squares = np.where(short, gaps, 0) ** 2
    found = {
        "first_seq": (seq[first], none),
        "first_right": (~left[first], none),
        "stamps": (last - at + 1, None),
        "first_stamp": (stamps[first], none),
        "last_stamp": (stamps[last], none),
        "squares_high": (np.add.reduceat(squares >> 32, at), None),
        "squares_low": (np.add.reduceat(squares & (2**32 - 1), at), None),
    }
    value = {n: _numbers(table, n)[order] for n in ("packets", "bytes", "syn", "rst", "ack")}
    found |= {n: (_sums(value[n], at), None) for n in ("syn", "rst", "ack")}
    for side, mine in (("left", left), ("right", ~left)):
        found |= {f"{side}_{n}": (_sums(np.where(mine, value[n], 0), at), None) for n in ("packets", "bytes")}
        missing = ~np.logical_or.reduceat(mine, at)
        found[f"{side}_first"] = np.minimum.reduceat(np.where(mine, stamps, _HIGH), at), missing
        found[f"{side}_last"] = np.maximum.reduceat(np.where(mine, stamps, _LOW), at), missing
    long = [None] * len(at)
    if not short.all():
        long = [str(x) if x else None for x in np.add.reduceat(np.where(short, 0, gaps).astype(object) ** 2, at)]
    out = table.select(key).take(pa.array(order[at])).append_column("long_squares", pa.array(long, pa.string()))
    for n, (numbers, missing) in found.items():
        out = out.append_column(n, pa.array(numbers.astype(np.int64) if numbers.dtype == bool else numbers, pa.int64(), mask=missing))
    return out


def _cut_keys(rows: DataFrame, key: list[str], width: int) -> DataFrame:
    """The state of the flows of keys that one task can hold, one shuffle away from their rows."""
    name = F.xxhash64(*key)
    # named behind the shuffle: hashes do not compress
    placed = rows.repartition(name).withColumn("_key", name).sortWithinPartitions("_key")
    parts = ["first_seq", "first_right", "squares_high", "squares_low"]
    names = [*_SUMS, *(n for n in _LEAST if n != "opener"), *_MOST, "first_stamp", "last_stamp"]
    own = [f for f in rows.schema.fields if f.name in key]
    schema = T.StructType(
        [*own, T.StructField("long_squares", T.StringType()), *[T.StructField(n, T.LongType()) for n in [*parts, *names]]]
    )

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["_key"]):
            yield from _states(table, key, width).select(schema.names).to_batches()

    found = placed.mapInArrow(states, schema).withColumn("long_squares", F.col("long_squares").cast("decimal(38,0)"))
    opener = (F.col("first_seq") * 2 + F.col("first_right")).alias("opener")
    return found.select(*key, opener, *names, _gap_squares().alias("gap_squares"))


def _steps(stamps: np.ndarray, slices: np.ndarray, starts: np.ndarray, width: int, slice_us: int):
    """Step functions of many slices at once: where among the sorted stamps a step ends, and where it leads.

    ``starts`` says where the slices begin. If the flow open at a slice's start ends by the stamp where a
    step ends, and after the step before, the flow open at the slice's end has opened at the
    stamp that the step leads to; if it ends after the last, it is still open then.
    """
    here = np.arange(len(stamps))
    group = np.searchsorted(starts, here, side="right") - 1
    # one scale for all slices, too wide for a step to lead from one into the next
    scale = group * (slice_us + width) + (stamps - slices * slice_us)
    after = np.searchsorted(scale, scale + width)
    to = np.where(after < np.append(starts[1:], len(stamps))[group], after, here)
    while not np.array_equal(to, to[to]):  # twice as many flows a turn
        to = to[to]
    last = np.append(np.flatnonzero(np.diff(to)), len(stamps) - 1)
    return last, to[last]


def _openings(stamps: np.ndarray, carried: int | None, width: int) -> np.ndarray:
    """The moments at which flows open, the carried one first."""
    opened = [] if carried is None else [carried]
    at = 0 if carried is None else int(np.searchsorted(stamps, carried + width))
    while at < len(stamps):
        opened.append(int(stamps[at]))
        at = int(np.searchsorted(stamps, stamps[at] + width))
    return np.array(opened, np.int64)


def _same(rows: DataFrame, table: DataFrame, key: list[str], how: str) -> DataFrame:
    """``rows`` joined with ``table`` on equal keys, nulls too; its key columns are left out."""
    other = table.select(*(F.col(c).alias(f"{c}_") for c in key), *(c for c in table.columns if c not in key))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"{c}_")) for c in key))
    return rows.join(other, same, how).drop(*(f"{c}_" for c in key))


def _opened(rows: DataFrame, key: list[str], width: int, slice_us: int) -> DataFrame:
    """The rows with ``opened_us``, when the flow they belong to opened."""
    spans = rows.groupBy(*key).agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    long_keys = spans.where(F.col("last_us") - F.col("first_us") >= width).select(*key, F.lit(True).alias("long"))
    marked = _same(rows, long_keys, key, "left")
    # a short flow is one, whenever it opened
    whole = marked.where(F.col("long").isNull()).select(*rows.columns, F.lit(None).cast("long").alias("opened_us"))
    long = marked.where("long").select(*rows.columns)
    long = long.withColumn("slice", F.floor(F.col("ts_us") / slice_us))
    place, columns = [*key, "slice"], rows.columns
    fields = {f.name: f for f in long.schema.fields}
    number = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    # many slices are cut at once: most hold few events
    gathered = lambda table, by, order: table.repartition(*by).sortWithinPartitions(*place, order)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, place):
            stamps = _numbers(table, "ts_us")
            last, to = _steps(stamps, _numbers(table, "slice"), _starts(table, place), width, slice_us)
            own = table.select(place).take(pa.array(last))
            yield from own.append_column("upto", pa.array(stamps[last])).append_column("opened", pa.array(stamps[to])).to_batches()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, key):
            starts = _starts(table, place)
            first = np.isin(starts, _starts(table, key))
            upto, opened = _numbers(table, "upto").tolist(), _numbers(table, "opened").tolist()
            out: list[int | None] = []
            carried = None
            for start, past, new in zip(starts.tolist(), [*starts[1:].tolist(), len(upto)], first.tolist()):
                carried = None if new else carried
                out.append(carried)
                at = start if carried is None else bisect_left(upto, carried + width, start, past)
                if at < past:
                    carried = opened[at]
            yield from table.select(place).take(pa.array(starts)).append_column("carried", pa.array(out, pa.int64())).to_batches()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, place):
            starts = _starts(table, place).tolist()
            known = table["ts_us"].is_valid().to_numpy()
            carried = table["carried"].to_pylist() if not known.all() else None
            stamps = table["ts_us"].fill_null(0).to_pylist()
            found = np.empty(len(stamps), np.int64)
            for at, past in zip(starts, [*starts[1:], len(stamps)]):
                opened = None
                if not known[at]:  # the slice's first row names the flow open at its start
                    opened, at = carried[at], at + 1
                while at < past:
                    if opened is None or stamps[at] >= opened + width:
                        opened = stamps[at]
                    to = bisect_left(stamps, opened + width, at, past)
                    found[at:to] = opened
                    at = to
            done = table.select(columns).append_column("opened_us", pa.array(found))
            yield from done.filter(pa.array(known)).to_batches()

    stamps = gathered(long.select(*place, "ts_us").distinct(), place, "ts_us")
    made = stamps.mapInArrow(steps, T.StructType([*[fields[c] for c in place], *number("upto", "opened")]))
    walked = gathered(made, key, "upto").mapInArrow(walk, T.StructType([*[fields[c] for c in place], *number("carried")]))
    ready = long.unionByName(walked.where("carried IS NOT NULL"), allowMissingColumns=True)
    schema = T.StructType([*[fields[c] for c in columns], *number("opened_us")])
    # nulls, the carried flows, come first
    return whole.unionByName(gathered(ready, place, "ts_us").mapInArrow(cut, schema))


# -- stream ------------------------------------------------------------------------------------
def _segments(frame: pd.DataFrame, opened: int | None, width: int) -> list[dict]:
    """The numbers of ``_STATE`` of each flow that a key's sorted events are cut into.

    The first continues the flow that opened at ``opened``, if one is open and not over.
    """
    stamps = frame["ts_us"].to_numpy()
    starts = _openings(stamps, opened, width)
    at = np.searchsorted(stamps, starts) if opened is None else np.append(0, np.searchsorted(stamps, starts[1:]))
    # a carried flow without events of its own has nothing to add
    some = np.append(at[1:], len(stamps)) > at
    starts, at = starts[some], at[some]
    left = frame["from_left"].to_numpy()
    number = {c: frame[c].to_numpy(np.int64) for c in ("packets", "bytes", "syn", "rst", "ack", "seq")}
    high, low = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    sums = {n: number[n] for n in ("syn", "rst", "ack")} | {"stamps": np.ones(len(stamps), np.int64)}
    least, most = {"opener": number["seq"] * 2 + ~left}, {}
    for side, mine in (("left", left), ("right", ~left)):
        for name in ("packets", "bytes"):
            sums[f"{side}_{name}"] = np.where(mine, number[name], 0)
        least[f"{side}_first"] = np.where(mine, stamps, high)
        most[f"{side}_last"] = np.where(mine, stamps, low)
    gaps = np.diff(stamps, prepend=stamps[:1]).astype(object)
    gaps[at] = 0
    found = {n: np.add.reduceat(v, at) for n, v in sums.items()}
    found |= {n: np.minimum.reduceat(v, at) for n, v in least.items()}
    found |= {n: np.maximum.reduceat(v, at) for n, v in most.items()}
    found["gap_squares"] = np.add.reduceat(gaps * gaps, at)
    found |= {"opened_us": starts, "first_stamp": stamps[at], "last_stamp": stamps[np.append(at[1:], len(stamps)) - 1]}
    none = {high, low}
    return [
        {n: None if (x := int(v[k])) in none and n.startswith(("left_", "right_")) else x for n, v in found.items()}
        for k in range(len(at))
    ]


def _merged(a: dict, b: dict) -> dict:
    """One flow of an earlier and a later part."""
    some = lambda pick, x, y: x if y is None else y if x is None else pick(x, y)
    gap = b["first_stamp"] - a["last_stamp"]
    return (
        {n: a[n] + b[n] for n in _SUMS}
        | {n: some(min, a[n], b[n]) for n in _LEAST}
        | {n: some(max, a[n], b[n]) for n in _MOST}
        | {"opened_us": a["opened_us"], "first_stamp": a["first_stamp"], "last_stamp": b["last_stamp"]}
        | {"gap_squares": a["gap_squares"] + b["gap_squares"] + gap * gap}
    )


def _streamed(rows: DataFrame, key: list[str], width: int) -> DataFrame:
    """Closed flows of a stream as ``flows.flow_state`` rows."""
    out = T.StructType([*[rows.schema[c] for c in key], *_STATE.fields])
    names = _STATE.fieldNames()

    def emit(own: tuple, closed: list[dict]) -> pd.DataFrame:
        frame = pd.DataFrame([[*own, *(flow[n] for n in names)] for flow in closed], columns=out.fieldNames())
        frame["gap_squares"] = frame["gap_squares"].map(str)
        for n in names[:-1]:
            frame[n] = frame[n].astype("Int64")
        return frame

    def step(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = dict(zip(names, state.get)) if state.exists else None
        if current is not None:
            current["gap_squares"] = int(current["gap_squares"])
        if state.hasTimedOut:
            state.remove()
            yield emit(own, [current])
            return
        closed = []
        # a flow's part of one micro-batch, in time order
        frame = pd.concat(batches).sort_values(["ts_us", "seq"], kind="stable")
        for flow in _segments(frame, current and current["opened_us"], width):
            if current is not None and flow["opened_us"] == current["opened_us"]:
                current = _merged(current, flow)
                continue
            if current is not None:
                closed.append(current)
            current = flow
        state.update(tuple(current[n] if n != "gap_squares" else str(current[n]) for n in names))
        due = (current["opened_us"] + width) // 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if closed:
            yield emit(own, closed)

    cut = rows.groupBy(*key).applyInPandasWithState(step, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return cut.withColumn("gap_squares", F.col("gap_squares").cast("decimal(38,0)"))
