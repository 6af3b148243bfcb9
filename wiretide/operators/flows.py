"""Bidirectional flows from packets or flow events.

The raw rows are shuffled once, on (group, flow, arrival chunk). A chunk is a fixed range of
arrival numbers, so a flow that holds a third of a capture is spread over many tasks; each chunk
is reduced to one row of mergeable numbers, and only those rows are brought together per flow.
Inter-arrival statistics stay exact across chunk borders because every chunk keeps its first and
last stamp. All aggregates are fixed-width numbers, so Spark hashes instead of sorting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretide.functions.flags import (
    ACK_BIT,
    RST_BIT,
    SYN_BIT,
    bit_set,
    hex_flag_bits,
    text_has_flag,
)
from wiretide.schemas import TRANSPORTS

# Fixed value: a reset TCP flow of at most this many bytes never carried data.
FAILED_FLOW_MAX_BYTES = 200

# Arrival numbers per chunk: the most rows of one flow that one task sorts together.
CHUNK_ROWS = 1_000_000

FLOW_KEY = ("protocol", "left_ip", "left_port", "right_ip", "right_port")
_EXACT = "decimal(38,0)"
# Fixed value: the square of a gap of up to this many microseconds fits a long.
_SHORT_GAP = 3_000_000_000


def _keys(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _with_endpoints(rows: DataFrame, directed: Column) -> DataFrame:
    """Name the two ends of a row independently of direction, unless directed."""
    src = F.struct(F.col("src_ip"), F.coalesce("src_port", F.lit(0)))
    dst = F.struct(F.col("dst_ip"), F.coalesce("dst_port", F.lit(0)))
    rows = rows.withColumn("from_left", directed | (src <= dst))

    def side(a: str, b: str) -> Column:
        return F.when(F.col("from_left"), F.col(a)).otherwise(F.col(b))

    return rows.withColumns(
        {
            "left_ip": side("src_ip", "dst_ip"),
            "left_port": side("src_port", "dst_port"),
            "right_ip": side("dst_ip", "src_ip"),
            "right_port": side("dst_port", "src_port"),
        }
    )


def packet_rows(packets: DataFrame, by: str | Sequence[str] = "capture_id") -> DataFrame:
    """Packets as flow input. ICMP has no ports and is kept per direction."""
    bits = hex_flag_bits(F.col("tcp_flags"))
    icmp = F.col("protocol") == "ICMP"
    rows = packets.where(F.col("protocol").isin(*TRANSPORTS)).select(
        *_keys(by),
        F.col("packet_number").cast("bigint").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        "src_ip",
        "dst_ip",
        F.when(~icmp, F.col("src_port")).alias("src_port"),
        F.when(~icmp, F.col("dst_port")).alias("dst_port"),
        "protocol",
        F.coalesce(F.col("length"), F.lit(0)).cast("bigint").alias("bytes"),
        F.lit(1).cast("bigint").alias("packets"),
        bit_set(bits, SYN_BIT).alias("syn"),
        bit_set(bits, RST_BIT).alias("rst"),
        bit_set(bits, ACK_BIT).alias("ack"),
    )
    return _with_endpoints(rows, icmp)


def event_rows(events: DataFrame, by: str | Sequence[str] = "session_id") -> DataFrame:
    """Flow events as flow input: each stands for ``packets`` packets, flags are text."""
    flags, weight = F.col("flags"), F.coalesce(F.col("packets"), F.lit(1)).cast("bigint")
    rows = events.select(
        *_keys(by),
        F.col("seq").cast("bigint").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        "src_ip",
        "dst_ip",
        F.coalesce("src_port", F.lit(0)).alias("src_port"),
        F.coalesce("dst_port", F.lit(0)).alias("dst_port"),
        "protocol",
        F.coalesce(F.col("bytes"), F.lit(0)).cast("bigint").alias("bytes"),
        weight.alias("packets"),
        (text_has_flag(flags, "SYN") * weight).alias("syn"),
        (text_has_flag(flags, "RST") * weight).alias("rst"),
        (text_has_flag(flags, "ACK") * weight).alias("ack"),
    )
    return _with_endpoints(rows, F.lit(False))


def flow_state(
    rows: DataFrame, by: str | Sequence[str] = "capture_id", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """One row of direction-neutral, mergeable numbers per flow.

    Everything the later operators need about packets (per direction bytes, packets and stamps,
    flag counts, interval sums) is in here, so raw rows are read once.
    """
    key = [*_keys(by), *FLOW_KEY]
    left = F.col("from_left")
    in_chunk = Window.partitionBy(*key, "chunk").orderBy("seq")
    before = in_chunk.rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("ts_us") - F.last("ts_us", ignorenulls=True).over(before)
    stamped_seq = F.when(F.col("ts_us").isNotNull(), F.col("seq"))
    # Squares of short gaps are summed as longs in halves of 32 bits, exact for up to 2^31 rows a chunk.
    short = F.col("gap").between(-_SHORT_GAP, _SHORT_GAP)
    square = F.when(short, F.col("gap") * F.col("gap"))
    long_gap = F.when(~short, F.col("gap")).cast("decimal(19,0)")
    chunks = (
        rows.withColumn("chunk", F.call_function("div", F.col("seq"), F.lit(chunk_rows)))
        .withColumn("gap", gap)
        .groupBy(*key, "chunk")
        .agg(
            # lowest arrival number, doubled, plus 1 when that row came from the right end
            F.min(F.col("seq") * 2 + F.when(left, 0).otherwise(1)).alias("opener"),
            F.sum(F.when(left, F.col("packets"))).alias("left_packets"),
            F.sum(F.when(left, F.col("bytes"))).alias("left_bytes"),
            F.min(F.when(left, F.col("ts_us"))).alias("left_first"),
            F.max(F.when(left, F.col("ts_us"))).alias("left_last"),
            F.sum(F.when(~left, F.col("packets"))).alias("right_packets"),
            F.sum(F.when(~left, F.col("bytes"))).alias("right_bytes"),
            F.min(F.when(~left, F.col("ts_us"))).alias("right_first"),
            F.max(F.when(~left, F.col("ts_us"))).alias("right_last"),
            F.sum("syn").alias("syn"),
            F.sum("rst").alias("rst"),
            F.sum("ack").alias("ack"),
            F.count("ts_us").alias("stamps"),
            F.min_by("ts_us", stamped_seq).alias("first_stamp"),
            F.max_by("ts_us", stamped_seq).alias("last_stamp"),
            F.sum(F.shiftright(square, 32)).alias("squares_high"),
            F.sum(square.bitwiseAND(F.lit(2**32 - 1))).alias("squares_low"),
            F.sum(long_gap * long_gap).cast(_EXACT).alias("long_squares"),
        )
        .withColumn("gap_squares", _gap_squares())
        .drop("squares_high", "squares_low", "long_squares")
    )
    in_flow = Window.partitionBy(*key).orderBy("chunk")
    earlier = in_flow.rowsBetween(Window.unboundedPreceding, -1)
    border = (
        F.col("first_stamp") - F.last("last_stamp", ignorenulls=True).over(earlier)
    ).cast("decimal(19,0)")
    stamped_chunk = F.when(F.col("first_stamp").isNotNull(), F.col("chunk"))
    zero = F.lit(0).cast(_EXACT)
    return (
        chunks.withColumn("border", border)
        .groupBy(*key)
        .agg(
            F.min("opener").alias("opener"),
            *[
                F.coalesce(F.sum(name), F.lit(0)).alias(name)
                for name in ("left_packets", "left_bytes", "right_packets", "right_bytes")
            ],
            *[
                (F.min if name.endswith("first") else F.max)(name).alias(name)
                for name in ("left_first", "left_last", "right_first", "right_last")
            ],
            *[F.sum(name).alias(name) for name in ("syn", "rst", "ack", "stamps")],
            F.min_by("first_stamp", stamped_chunk).alias("first_stamp"),
            F.max_by("last_stamp", stamped_chunk).alias("last_stamp"),
            (
                F.coalesce(F.sum("gap_squares"), zero)
                + F.coalesce(F.sum((F.col("border") * F.col("border")).cast(_EXACT)), zero)
            )
            .cast(_EXACT)
            .alias("gap_squares"),
        )
    )


def _gap_squares() -> Column:
    """The sum of squares from its halves and the squares that no long holds."""
    zero = F.lit(0).cast(_EXACT)
    high, low = (F.coalesce(F.col(f"squares_{n}"), F.lit(0)).cast("decimal(19,0)") for n in ("high", "low"))
    short = (high * F.lit(2**32).cast("decimal(10,0)") + low).cast(_EXACT)
    return (short + F.coalesce("long_squares", zero)).cast(_EXACT)


def _interval_columns() -> tuple[Column, Column]:
    """Mean and sample variance of inter-arrival times in ms, four decimals.

    The sum of gaps telescopes to last minus first stamp. The variance is computed on whole
    microseconds and rounded as a ratio of integers, so the result does not depend on the order
    in which partial sums were merged. Values too wide for that use doubles, where the fourth
    decimal is beyond double precision anyway.
    """
    gaps = F.col("stamps") - 1
    total = F.col("last_stamp") - F.col("first_stamp")
    mean = F.when(gaps > 0, F.round(total / gaps / 1000.0, 4)).otherwise(F.lit(0.0))

    n = gaps.cast("decimal(18,0)")
    span = total.cast("decimal(19,0)")
    spread = F.try_subtract(
        F.try_multiply(n, F.col("gap_squares")), (span * span).cast(_EXACT)
    ).cast(_EXACT)
    pairs = (n * (n - 1)).cast(_EXACT)
    rough = (
        F.col("gap_squares").cast("double") - total.cast("double") * total.cast("double") / gaps
    ) / (gaps - 1) / 1e6
    scaled = F.call_function(
        "div", (spread + pairs * 50).cast(_EXACT), (pairs * 100).cast(_EXACT)
    )
    exact = F.when(spread.isNotNull() & (rough < 1e13), scaled) / 1e4
    variance = F.when(gaps > 1, F.coalesce(exact, F.round(rough, 4))).otherwise(F.lit(0.0))
    return mean, variance


def flows_from_state(state: DataFrame, by: str | Sequence[str] = "capture_id") -> DataFrame:
    """Flow records seen from the end that sent the first packet."""
    reverse = F.col("opener") % 2 == 1

    def ends(left: str, right: str) -> tuple[Column, Column]:
        a, b = F.col(left), F.col(right)
        return F.when(reverse, b).otherwise(a), F.when(reverse, a).otherwise(b)

    src_ip, dst_ip = ends("left_ip", "right_ip")
    src_port, dst_port = ends("left_port", "right_port")
    src_bytes, dst_bytes = ends("left_bytes", "right_bytes")
    start = F.least("left_first", "right_first")
    end = F.greatest("left_last", "right_last")
    bytes_total = F.col("left_bytes") + F.col("right_bytes")
    mean, variance = _interval_columns()
    return state.select(
        *_keys(by),
        src_ip.alias("src_ip"),
        dst_ip.alias("dst_ip"),
        F.coalesce(src_port, F.lit(0)).alias("src_port"),
        F.coalesce(dst_port, F.lit(0)).alias("dst_port"),
        "protocol",
        (F.col("left_packets") + F.col("right_packets")).alias("packets_total"),
        bytes_total.alias("bytes_total"),
        F.coalesce((end - start) / 1000.0, F.lit(0.0)).alias("duration_ms"),
        F.timestamp_micros(start).alias("start_time"),
        F.timestamp_micros(end).alias("end_time"),
        src_bytes.alias("src_bytes"),
        dst_bytes.alias("dst_bytes"),
        F.col("syn").alias("syn_count"),
        F.col("rst").alias("rst_count"),
        F.col("ack").alias("ack_count"),
        mean.alias("inter_packet_interval_ms"),
        variance.alias("inter_packet_interval_variance_ms"),
        (
            (F.col("protocol") == "TCP")
            & (F.col("rst") > 0)
            & (bytes_total <= FAILED_FLOW_MAX_BYTES)
        ).alias("is_failed_flow"),
        F.floor(F.col("opener") / 2).alias("first_seq"),
    )


def flows(
    packets: DataFrame, by: str | Sequence[str] = "capture_id", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Bidirectional flows of dissected packets (TCP, UDP, ICMP)."""
    return flows_from_state(flow_state(packet_rows(packets, by), by, chunk_rows), by)


def event_flows(
    events: DataFrame, by: str | Sequence[str] = "session_id", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Bidirectional flows of live flow events (any protocol)."""
    return flows_from_state(flow_state(event_rows(events, by), by, chunk_rows), by)


def failed_flow_counts(flow_table: DataFrame, by: str | Sequence[str] = "capture_id") -> DataFrame:
    """Total and failed flows per group."""
    return flow_table.groupBy(*_keys(by)).agg(
        F.count(F.lit(1)).alias("total_flows"),
        F.count_if("is_failed_flow").alias("failed_flows"),
    )


def directed_traffic(packets: DataFrame, by: str | Sequence[str] = "capture_id") -> DataFrame:
    """Packets pre-aggregated per (source, destination, destination port, protocol).

    Map-side combine does the work: no raw row is shuffled.
    """
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    return packets.groupBy(*_keys(by), "src_ip", "dst_ip", "dst_port", "protocol").agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum(F.coalesce(F.col("length"), F.lit(0))).cast("bigint").alias("bytes"),
        F.min(ts).alias("first_us"),
        F.max(ts).alias("last_us"),
    )


def directed_from_state(state: DataFrame, by: str | Sequence[str] = "capture_id") -> DataFrame:
    """The same summary taken from flow state, without reading packets again."""

    def half(a: str, b: str) -> Column:
        return F.struct(
            F.col(f"{a}_ip").alias("src_ip"),
            F.col(f"{b}_ip").alias("dst_ip"),
            F.col(f"{b}_port").alias("dst_port"),
            F.col(f"{a}_packets").alias("packets"),
            F.col(f"{a}_bytes").alias("bytes"),
            F.col(f"{a}_first").alias("first_us"),
            F.col(f"{a}_last").alias("last_us"),
        )

    return (
        state.select(
            *_keys(by), "protocol", F.inline(F.array(half("left", "right"), half("right", "left")))
        )
        .where(F.col("packets") > 0)
        .select(
            *_keys(by), "src_ip", "dst_ip", "dst_port", "protocol", "packets", "bytes",
            "first_us", "last_us",
        )
    )


def stored_flows(flow_table: DataFrame, by: str | Sequence[str] = "capture_id") -> DataFrame:
    """Flow rows as stored: zero ports and zero intervals become NULL, protocol upper-cased."""

    def nonzero(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(0).cast(flow_table.schema[name].dataType)).alias(name)

    return flow_table.select(
        *_keys(by),
        "src_ip",
        "dst_ip",
        nonzero("src_port"),
        nonzero("dst_port"),
        F.upper("protocol").alias("protocol"),
        F.col("src_bytes").alias("bytes_sent"),
        F.col("dst_bytes").alias("bytes_recv"),
        F.col("packets_total").alias("packets_count"),
        "start_time",
        "end_time",
        "duration_ms",
        nonzero("inter_packet_interval_ms"),
        nonzero("inter_packet_interval_variance_ms"),
        "ack_count",
    )
