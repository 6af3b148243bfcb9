"""Rules over a stream of flow events, one micro-batch per flush.

Everything a flush writes goes to folders named after the batch, overwritten when Spark replays
it, so a lost driver or executor never doubles an alert. The adaptive baseline of a rule travels as
a snapshot of its latest scores: bounded by ``window_size`` rows per (session, rule).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wiretide.operators import alerts
from wiretide.plans.detect import overall_risk, run_rules
from wiretide.plans.features import EventFeatures
from wiretide.rules import RuleRegistry, default_registry
from wiretide.session import drop_written
from wiretide.sinks.tables import live_alert_rows
from wiretide.streaming.adaptive import AdaptiveConfig, adapt_column, baseline_stats, rescore

# Fixed value: flush interval of the live engine.
FLUSH_INTERVAL = "5 seconds"
#: Session settings for flushes of up to some 100,000 events: no exchange is worth more than one task.
SMALL_FLUSHES = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false"}
#: Flushes after its last score that a session's history is kept: an hour at the usual interval.
KEEP_FLUSHES = 720


def _adapted(findings: DataFrame, history: DataFrame | None, config: AdaptiveConfig, by: str):
    """Findings with scores adapted to the history of earlier batches."""
    if history is None:
        return findings
    base = baseline_stats(history, config, by, "raw_score").select(
        by, "rule_id", "mean", "std_dev", "samples"
    )
    score = adapt_column(
        F.col("raw_score"),
        F.coalesce("samples", F.lit(0)),
        F.col("mean"),
        F.col("std_dev"),
        config,
    )
    if not config.enabled:
        score = F.col("raw_score")
    elif config.disabled_rules:
        score = F.when(F.col("rule_id").isin(*config.disabled_rules), F.col("raw_score")).otherwise(
            score
        )
    joined = findings.join(base, [by, "rule_id"], "left").withColumn("adapted_score", score)
    return rescore(joined.drop("mean", "std_dev", "samples"))


class RuleStream:
    """Flush handler; pass ``flush`` to ``foreachBatch``.

    Tables under ``folder``, one sub-folder per batch: ``alerts``, ``risk``, ``evaluations``
    and, when adapting, ``scores``.
    """

    def __init__(
        self,
        folder: str,
        registry: RuleRegistry | None = None,
        adaptive: AdaptiveConfig | None = None,
        by: str = "session_id",
        keep_flushes: int = KEEP_FLUSHES,
    ) -> None:
        self.keep_flushes = keep_flushes
        self.folder = folder.rstrip("/")
        self.registry = registry or default_registry()
        self.adaptive = adaptive
        self.by = by
        self._planned: set[str] = set()

    def _at(self, table: str, batch_id: int) -> str:
        return f"{self.folder}/{table}/batch_id={batch_id}"

    def _write(self, table: DataFrame, name: str, batch_id: int) -> None:
        # rebalance: files of a sensible size however many tasks the plan ended in
        table.hint("rebalance").write.mode("overwrite").parquet(self._at(name, batch_id))

    def _history(self, batch: DataFrame, batch_id: int) -> DataFrame | None:
        if self.adaptive is None or batch_id == 0:
            return None
        return batch.sparkSession.read.parquet(self._at("scores", batch_id - 1))

    def _snapshot(self, findings: DataFrame, history: DataFrame | None, batch_id: int) -> DataFrame:
        """The latest ``window_size`` recorded scores per rule after this batch.

        A session without a score for ``keep_flushes`` flushes has ended and leaves the snapshot.
        """
        now = findings.select(
            self.by,
            "rule_id",
            F.lit(batch_id).cast("bigint").alias("flush_id"),
            F.struct("rule_place", "order_time", "subject").cast("string").alias("seq"),
            "raw_score",
        )
        scores = now if history is None else history.unionByName(now)
        latest = Window.partitionBy(self.by, "rule_id").orderBy(F.desc("flush_id"), F.desc("seq"))
        newest = F.max("flush_id").over(Window.partitionBy(self.by, "rule_id"))
        return (
            scores.withColumn("place", F.row_number().over(latest))
            .where(F.col("place") <= self.adaptive.window_size)
            .withColumn("newest", newest)
            .where(F.col("newest") > batch_id - self.keep_flushes)
            .drop("place", "newest")
        )

    def flush(self, batch: DataFrame, batch_id: int) -> None:
        """Features, rules, scores and statistics of one micro-batch."""
        features = EventFeatures(batch, self.by)
        with ThreadPoolExecutor(4) as pool:
            # what the plans start from is written at the same time, and so are the results
            together(pool, batch.sparkSession, [lambda: features.flow_state, lambda: features.dns_cells])
            found = run_rules(features, self.registry, known=self._planned)
            history = self._history(batch, batch_id)
            findings = found.findings
            if self.adaptive is not None:
                findings = _adapted(findings, history, self.adaptive, self.by)
            findings = features.hold(findings)
            risk = overall_risk(findings, features.totals, self.by, found.failed_rules)
            flushes = features.totals.select(
                self.by,
                F.lit(batch_id).cast("bigint").alias("flush_id"),
                F.col("window_end").alias("evaluated_at"),
            )
            rule_ids = [r.rule_id for r in self.registry.get_all()]
            hits = findings.withColumn("flush_id", F.lit(batch_id).cast("bigint"))
            evaluations = alerts.evaluation_rows(flushes, hits, rule_ids, self.by)
            results = {"alerts": live_alert_rows(findings, self.by), "risk": risk, "evaluations": evaluations}
            if self.adaptive is not None:
                results["scores"] = self._snapshot(findings, history, batch_id)
            together(pool, batch.sparkSession, [partial(self._write, table, name, batch_id) for name, table in results.items()])
        if self.adaptive is not None and batch_id > 1:
            # a replay reads the snapshot before it, never an older one
            drop_written(batch.sparkSession, self._at("scores", batch_id - 2))
        features.release()


def together(pool: ThreadPoolExecutor, spark: SparkSession, tasks: list[Callable[[], object]]) -> None:
    """Run tasks in threads that belong to the caller's Spark job; the first error is raised."""
    for done in [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]:
        done.result()


def start_rule_stream(
    events: DataFrame,
    folder: str,
    checkpoint: str,
    registry: RuleRegistry | None = None,
    adaptive: AdaptiveConfig | None = None,
    interval: str | None = FLUSH_INTERVAL,
    by: str = "session_id",
    settings: dict[str, str] | None = None,
) -> StreamingQuery:
    """Run rules on every micro-batch of valid events. ``interval=None`` drains what is there.

    ``settings`` hold in the stream's own copy of the session only; ``SMALL_FLUSHES`` suits flushes that
    one task can work on.
    """
    handler = RuleStream(folder, registry, adaptive, by)

    def flush(batch: DataFrame, batch_id: int) -> None:
        for name, value in (settings or {}).items():
            batch.sparkSession.conf.set(name, value)
        handler.flush(batch, batch_id)

    writer = events.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    writer = (
        writer.trigger(availableNow=True) if interval is None
        else writer.trigger(processingTime=interval)
    )
    return writer.start()


def stream_to(
    table: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update"
) -> StreamingQuery:
    """Drain a streaming aggregate, such as ``alerts.rule_stats``, into ``write``."""
    return (
        table.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
