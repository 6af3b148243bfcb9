"""Feature tables of many captures (or live sessions) at once.

A table is planned when first asked for. Packets or events are read once: they become flow state,
which is written to the cluster's checkpoint folder because flows, profiles, baseline and totals
all start from it. Use ``with extract_features(...) as features:`` and write the results inside: what
was held is dropped at the end. ``keep=False`` holds nothing and plans everything from the records.
"""

from __future__ import annotations

from copy import copy
from dataclasses import dataclass, fields
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretide.operators import applications, baseline, dns, flows, profiles
from wiretide.rules.thresholds import HTTP_SCANNER_AGENTS, LOGIN_KEYWORDS
from wiretide.session import drop_written, scratch_folder, written
from wiretide.sources.events import event_dns, event_http


@dataclass(frozen=True)
class Tables:
    """Parsed records of many captures; a protocol that was not captured is None."""

    packets: DataFrame
    dns: DataFrame | None = None
    http: DataFrame | None = None
    ftp: DataFrame | None = None
    smtp: DataFrame | None = None


class Features:
    """Batch features keyed by ``by``."""

    def __init__(
        self,
        tables: Tables,
        by: str = "capture_id",
        *,
        keep: bool = True,
        chunk_rows: int = flows.CHUNK_ROWS,
        count_failures: bool = True,
        initiator_only: bool = False,
    ) -> None:
        self.tables = tables
        self.by = by
        self.chunk_rows = chunk_rows
        self._keep = keep
        self._kept: list[str] = []
        self._profile_options = {
            "count_failures": count_failures,
            "initiator_only": initiator_only,
        }

    def hold(self, table: DataFrame) -> DataFrame:
        """A table that several results read, computed once."""
        if not self._keep:
            return table
        table, path = written(table, scratch_folder(table.sparkSession))
        self._kept.append(path)
        return table

    def release(self) -> None:
        """Drop held tables; call after the results are written."""
        for path in self._kept:
            drop_written(self.tables.packets.sparkSession, path)
        self._kept.clear()

    def keep_until_release(self, path: str) -> None:
        """Count a folder made by ``session.written`` among what ``release`` drops."""
        self._kept.append(path)

    def only(self, groups: Column) -> Features:
        """The same features of those groups for which a condition on ``by`` holds; holds nothing itself."""
        part = copy(self)
        for kind in type(self).__mro__:
            for name, value in vars(kind).items():
                if isinstance(value, cached_property):
                    part.__dict__.pop(name, None)
        part._keep, part._kept = False, []
        tables = {f.name: getattr(self.tables, f.name) for f in fields(Tables)}
        part.tables = Tables(**{n: None if t is None else t.where(groups) for n, t in tables.items()})
        part.flow_state = self.flow_state.where(groups)
        if self.dns_cells is not None:
            part.dns_cells = self.dns_cells.where(groups)
        return part

    def __enter__(self) -> Features:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    # -- traffic -----------------------------------------------------------------------------
    def _flow_rows(self) -> DataFrame:
        return flows.packet_rows(self.tables.packets, self.by)

    @cached_property
    def flow_state(self) -> DataFrame:
        return self.hold(flows.flow_state(self._flow_rows(), self.by, self.chunk_rows))

    @cached_property
    def flows(self) -> DataFrame:
        return flows.flows_from_state(self.flow_state, self.by)

    @cached_property
    def directed(self) -> DataFrame:
        return flows.directed_from_state(self.flow_state, self.by)

    @cached_property
    def profiles(self) -> DataFrame:
        return profiles.connection_profiles(
            self.directed, self.flows, self.by, **self._profile_options
        )

    @cached_property
    def baseline(self) -> DataFrame:
        return baseline.traffic_baseline(self.directed, self.by)

    @cached_property
    def deviations(self) -> DataFrame:
        return baseline.traffic_deviations(self.flows, self.baseline, self.by)

    def _seconds(self, span):
        return F.when(span > 0, span).otherwise(F.lit(1.0))

    @cached_property
    def totals(self) -> DataFrame:
        """Bytes, packets, time window and length of each group, one row per group."""
        first = F.min(F.least("left_first", "right_first"))
        last = F.max(F.greatest("left_last", "right_last"))
        raw = self.flow_state.groupBy(self.by).agg(
            F.sum(F.col("left_bytes") + F.col("right_bytes")).alias("group_bytes"),
            F.sum(F.col("left_packets") + F.col("right_packets")).alias("group_packets"),
            F.count(F.lit(1)).alias("group_flows"),
            first.alias("first_us"),
            last.alias("last_us"),
        )
        span = F.coalesce((F.col("last_us") - F.col("first_us")) / 1e6, F.lit(0.0))
        seconds = self._seconds(span)
        return raw.select(
            self.by,
            "group_bytes",
            "group_packets",
            "group_flows",
            F.round(seconds, 4).alias("group_seconds"),
            F.round(F.col("group_bytes") / seconds, 2).alias("group_rate"),
            F.timestamp_micros("first_us").alias("window_start"),
            F.timestamp_micros("last_us").alias("window_end"),
            F.round(span, 4).alias("capture_duration_seconds"),
        )

    @cached_property
    def _windows(self) -> DataFrame:
        return self.totals.select(self.by, "window_start", "window_end")

    # -- applications ------------------------------------------------------------------------
    def _records(self, name: str) -> DataFrame | None:
        return getattr(self.tables, name)

    @cached_property
    def dns_cells(self) -> DataFrame | None:
        records = self._records("dns")
        return None if records is None else self.hold(dns.dns_cells(records, self.by))

    @cached_property
    def dns_profiles(self) -> DataFrame | None:
        return None if self.dns_cells is None else dns.dns_profiles(self.dns_cells, self.by)

    @cached_property
    def ftp_summary(self) -> DataFrame | None:
        records = self._records("ftp")
        return None if records is None else applications.ftp_summary(records, self.by)

    @cached_property
    def smtp_summary(self) -> DataFrame | None:
        records = self._records("smtp")
        return None if records is None else applications.smtp_summary(records, self.by)

    @cached_property
    def http_overview(self) -> DataFrame | None:
        """Counts behind the HTTP rule, one row per group that has any listed path."""
        records = self._records("http")
        if records is None:
            return None
        statuses = applications.http_statuses(records, self.by)
        paths = applications.http_top_paths(records, self.by)
        agent = F.lower("user_agent")
        scanner = F.lit(False)
        for name in HTTP_SCANNER_AGENTS:
            scanner = scanner | F.contains(agent, F.lit(name))
        stacked = (
            statuses.select(
                self.by,
                "responses",
                F.when(F.col("status_code") >= 400, F.col("responses")).alias("error_responses"),
            )
            .unionByName(
                paths.select(
                    self.by,
                    F.col("requests").alias("listed_requests"),
                    F.when(F.col("place") == 1, F.col("requests")).alias("top_requests"),
                ),
                allowMissingColumns=True,
            )
            .unionByName(
                applications.http_agents(records, self.by)
                .where(scanner)
                .select(self.by, F.lit(1).alias("scanner_agents")),
                allowMissingColumns=True,
            )
        )
        names = (
            "responses", "error_responses", "listed_requests", "top_requests", "scanner_agents",
        )
        return stacked.groupBy(self.by).agg(
            *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]
        )

    @cached_property
    def logins(self) -> DataFrame | None:
        """Clear-text login attempts per (source, destination)."""
        parts = []
        http, ftp = self._records("http"), self._records("ftp")
        if http is not None:
            uri = F.lower("uri")
            asked = F.lit(False)
            for word in LOGIN_KEYWORDS:
                asked = asked | F.contains(uri, F.lit(word))
            parts.append(
                http.where(asked).select(
                    self.by, "src_ip", "dst_ip", "ts", F.lit(1).alias("web"), F.lit(0).alias("ftp")
                )
            )
        if ftp is not None:
            parts.append(
                ftp.where(F.upper("command") == "PASS").select(
                    self.by, "src_ip", "dst_ip", "ts", F.lit(0).alias("web"), F.lit(1).alias("ftp")
                )
            )
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return rows.groupBy(self.by, "src_ip", "dst_ip").agg(
            F.sum("web").alias("web_logins"),
            F.sum("ftp").alias("ftp_passwords"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )

    # -- rule input --------------------------------------------------------------------------
    def _in_window(self, table: DataFrame | None) -> DataFrame | None:
        return None if table is None else table.join(self._windows, self.by, "left")

    def _spread(self, table: DataFrame | None) -> DataFrame | None:
        """The table dealt out to all cores: rows of few bytes and much work, which Spark puts into one task by size."""
        if table is None:
            return None
        cores = table.sparkSession.sparkContext.defaultParallelism
        return table.repartition(cores)

    def table(self, name: str) -> DataFrame | None:
        """Feature table a rule names as its source."""
        if name == "flows":
            context = self.totals.select(self.by, "group_bytes", "group_seconds", "group_rate")
            return self.flows.join(context, self.by)
        if name == "profiles":
            return self.profiles
        if name == "dns":
            return self._spread(self._in_window(self.dns_profiles))
        if name == "ftp":
            return self._in_window(self.ftp_summary)
        if name == "smtp":
            return self._in_window(self.smtp_summary)
        if name == "http":
            return self._in_window(self.http_overview)
        if name == "logins":
            return self.logins
        raise KeyError(f"no feature table {name!r}")


class EventFeatures(Features):
    """Features of live flow events, keyed by session.

    There are no FTP or SMTP records on a stream; HTTP and DNS records come from event fields.
    """

    def __init__(self, events: DataFrame, by: str = "session_id", **options) -> None:
        super().__init__(Tables(packets=events), by, **options)

    def _flow_rows(self) -> DataFrame:
        return flows.event_rows(self.tables.packets, self.by)

    @cached_property
    def profiles(self) -> DataFrame:
        return profiles.event_connection_profiles(self.flows, self.by)

    @cached_property
    def baseline(self) -> DataFrame:
        return baseline.event_traffic_baseline(self.flows, self.by)

    def _seconds(self, span):
        return F.greatest(span, F.lit(0.001))

    def _records(self, name: str) -> DataFrame | None:
        if name == "http":
            return event_http(self.tables.packets, self.by)
        if name == "dns":
            return event_dns(self.tables.packets, self.by)
        return None


def extract_features(tables: Tables, by: str = "capture_id", **options) -> Features:
    """Features of parsed records."""
    return Features(tables, by, **options)


def feature_bundle(features: Features) -> DataFrame:
    """One nested row per group: window, baseline, and the lists the analyser itself limits.

    Lists without a limit (flows, profiles, names, agents) stay tables of their own.
    """
    by = features.by
    base = features.baseline.select(
        by, F.struct(*[c for c in features.baseline.columns if c != by]).alias("traffic_baseline")
    )
    worst = features.deviations.groupBy(by).agg(
        F.array_sort(
            F.collect_list(F.struct(*[c for c in features.deviations.columns if c != by]))
        ).alias("traffic_deviations")
    )
    bundle = features.totals.join(base, by).join(worst, by, "left")
    records = features._records("http")
    if records is not None:
        methods = applications.http_methods(records, by)
        statuses = applications.http_statuses(records, by)
        paths = applications.http_top_paths(records, by)
        parts = (
            methods.groupBy(by).agg(
                F.map_from_entries(F.collect_list(F.struct("method", "requests"))).alias(
                    "http_method_counts"
                )
            ),
            statuses.groupBy(by).agg(
                F.map_from_entries(F.collect_list(F.struct("status_code", "responses"))).alias(
                    "http_status_counts"
                )
            ),
            paths.groupBy(by).agg(
                F.array_sort(F.collect_list(F.struct("place", "path", "requests"))).alias(
                    "http_top_uris"
                )
            ),
        )
        for part in parts:
            bundle = bundle.join(part, by, "left")
    return bundle
