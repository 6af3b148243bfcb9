"""Upkeep of stored flows: whole days go, first into hourly sums, later for good.

Flows lie by day (``sinks.tables.write_flows``). A day that is older than the detail limit is summed up by hour
in one job that reads only its own partition, a marker says that its sums are complete, and then its
partition is dropped. Sums older than their own limit are dropped likewise. A run that ends in between is
simply run again: a day without a marker is summed up anew, replacing its sums; a marked one is only dropped.
Flows written to a day after that come too late: they are in no sums and go with the next run.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days that flows and their hourly sums are kept.
KEEP_FLOWS_DAYS = 7
KEEP_SUMS_DAYS = 90

_MARK = "_complete"


def hourly_sums(stored: DataFrame, by: str = "capture_id") -> DataFrame:
    """Stored flows (with ``day``) added up per group, ends, service, protocol and hour of flow start."""
    return stored.groupBy(
        by, "src_ip", "dst_ip", "dst_port", "protocol", F.date_trunc("hour", "start_time").alias("hour"), "day"
    ).agg(
        F.count(F.lit(1)).alias("flows"),
        F.sum("packets_count").alias("packets"),
        F.sum("bytes_sent").alias("bytes_sent"),
        F.sum("bytes_recv").alias("bytes_recv"),
        F.sum("duration_ms").alias("duration_ms"),
    )


class FlowStore:
    """Stored flows under ``flows`` and their hourly sums under ``sums``, both folders by day."""

    def __init__(self, spark: SparkSession, flows: str, sums: str, by: str = "capture_id") -> None:
        self.spark, self.flows, self.sums, self.by = spark, flows.rstrip("/"), sums.rstrip("/"), by

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _files(self, folder: str):
        return self._path(folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _days(self, folder: str, before: date) -> list[date]:
        files = self._files(folder)
        if not files.exists(self._path(folder)):
            return []
        names = [s.getPath().getName() for s in files.listStatus(self._path(folder))]
        days = [date.fromisoformat(n.removeprefix("day=")) for n in names if n.startswith("day=") and n[4:5].isdigit()]
        return sorted(d for d in days if d < before)

    def _mark(self, day: date):
        return self._path(f"{self.sums}/{_MARK}/{day.isoformat()}")

    def _drop(self, folder: str, day: date) -> None:
        self._files(folder).delete(self._path(f"{folder}/day={day.isoformat()}"), True)

    def maintain(
        self, today: date, keep_flows: int = KEEP_FLOWS_DAYS, keep_sums: int = KEEP_SUMS_DAYS
    ) -> tuple[list[date], list[date]]:
        """Sum up and drop days older than ``keep_flows`` days; drop sums older than ``keep_sums``.

        Returns the days of flows and of sums that have gone. Flows without a start, which are in no day, stay.
        """
        old = self._days(self.flows, today - timedelta(days=keep_flows))
        files = self._files(self.sums)
        open_days = [d for d in old if not files.exists(self._mark(d))]
        if open_days:
            stored = self.spark.read.parquet(self.flows).where(F.col("day").isin(*open_days))
            sums = hourly_sums(stored, self.by).hint("rebalance", "day")
            sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.sums)
        for day in open_days:
            files.mkdirs(self._mark(day))
        for day in old:
            self._drop(self.flows, day)
        gone = self._days(self.sums, today - timedelta(days=keep_sums))
        for day in gone:
            self._drop(self.sums, day)
            files.delete(self._mark(day), True)
        return old, gone
