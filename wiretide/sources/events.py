"""Live flow events: reading, validation, typing, and the HTTP and DNS records inside them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.functions.addresses import canonical_ip, is_valid_ip
from wiretide.operators.flows import _keys
from wiretide.schemas import FLOW_EVENTS, RAW_EVENTS

# Accepted ranges and the shape of a session id.
MAX_PORT = 65535
HTTP_STATUS_RANGE = (100, 599)
UUID_REGEX = (
    r"^(?i)(?:urn:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"
)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines events at rest, unknown fields ignored."""
    return spark.read.schema(RAW_EVENTS).json(path)


def stream_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON-lines events as a stream over files arriving in a folder."""
    return (
        spark.readStream.schema(RAW_EVENTS)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )


def kafka_events(stream: DataFrame) -> DataFrame:
    """Events in the ``value`` of a Kafka source the caller has configured."""
    return stream.select(F.from_json(F.col("value").cast("string"), RAW_EVENTS).alias("e")).select(
        "e.*"
    )


#: The session of events that name none: a value, so that they group and join like any other.
NO_SESSION = "none"


def _whole(name: str) -> Column:
    return F.col(name).cast("string").try_cast("bigint")


def _problems() -> Column:
    """Reasons to reject an event; each entry is NULL when the field is fine."""

    def reason(name: str, bad: Column) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), F.lit(name))

    def optional(name: str, bad: Column) -> Column:
        return F.when(F.col(name).isNotNull() & F.coalesce(bad, F.lit(True)), F.lit(name))

    return F.filter(
        F.array(
            reason("src_ip", ~is_valid_ip(F.col("src_ip"))),
            reason("dst_ip", ~is_valid_ip(F.col("dst_ip"))),
            reason("src_port", ~_whole("src_port").between(0, MAX_PORT)),
            reason("dst_port", ~_whole("dst_port").between(0, MAX_PORT)),
            reason("protocol", F.trim("protocol") == ""),
            optional("ts", F.col("ts").try_cast("timestamp").isNull()),
            optional("bytes", _whole("bytes").isNull()),
            optional("packets", _whole("packets") < 1),
            optional("http_status", ~_whole("http_status").between(*HTTP_STATUS_RANGE)),
            optional("session_id", ~F.col("session_id").rlike(UUID_REGEX)),
        ),
        lambda r: r.isNotNull(),
    )


def check_events(raw: DataFrame) -> DataFrame:
    """Raw events with ``rejected_for``: names of the fields that failed validation."""
    missing = [
        F.lit(None).cast(f.dataType).alias(f.name)
        for f in RAW_EVENTS.fields
        if f.name not in raw.columns
    ]
    return raw.select("*", *missing).withColumn("rejected_for", _problems())


def valid_events(checked: DataFrame, arrival: Column | None = None) -> DataFrame:
    """Typed events of accepted rows, in the shape of ``schemas.FLOW_EVENTS``.

    ``ts`` may be ISO text or a timestamp; an event without one gets ``arrival``, by default the
    time of the batch. An event without a session belongs to ``NO_SESSION``. Without a ``seq``
    column, arrival order falls back to the event time in microseconds.
    """
    accepted = checked.where(F.size("rejected_for") == 0)
    late = F.current_timestamp() if arrival is None else arrival
    ts = F.coalesce(F.col("ts").try_cast("timestamp"), late)
    typed = {
        "seq": F.col("seq").cast("bigint") if "seq" in checked.columns else F.unix_micros(ts),
        "ts": ts,
        "src_ip": canonical_ip(F.col("src_ip")),
        "dst_ip": canonical_ip(F.col("dst_ip")),
        "src_port": _whole("src_port").cast("int"),
        "dst_port": _whole("dst_port").cast("int"),
        "protocol": F.upper(F.trim("protocol")),
        "bytes": F.coalesce(_whole("bytes"), F.lit(0)),
        "packets": F.coalesce(_whole("packets"), F.lit(1)),
        "http_status": _whole("http_status").cast("int"),
        "session_id": F.coalesce(F.col("session_id").cast("string"), F.lit(NO_SESSION)),
    }
    return accepted.select(
        *[
            typed.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in FLOW_EVENTS.fields
        ]
    )


def rejected_events(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("rejected_for") > 0)


def event_http(events: DataFrame, by: str | Sequence[str] = "session_id") -> DataFrame:
    """HTTP records of events that carry a method."""
    return events.where(F.col("http_method") != "").select(
        *_keys(by),
        "seq",
        "ts",
        "src_ip",
        "dst_ip",
        F.col("http_method").alias("method"),
        F.coalesce(F.nullif("http_host", F.lit("")), "dst_ip").alias("host"),
        F.coalesce(F.nullif("http_uri", F.lit("")), F.lit("/")).alias("uri"),
        F.col("http_status").alias("status_code"),
        F.col("http_user_agent").alias("user_agent"),
    )


def event_dns(events: DataFrame, by: str | Sequence[str] = "session_id") -> DataFrame:
    """DNS records of events that carry a query name; they have no answer and no size."""
    return events.where(F.col("dns_qname") != "").select(
        *_keys(by),
        "seq",
        "ts",
        "src_ip",
        "dst_ip",
        F.col("dns_qname").alias("qname"),
        F.coalesce(F.nullif("dns_qtype", F.lit("")), F.lit("A")).alias("qtype"),
        F.lit(None).cast("string").alias("response_code"),
        F.array().cast("array<string>").alias("answers"),
        F.lit(None).cast("bigint").alias("query_size_bytes"),
    )
