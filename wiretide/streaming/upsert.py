"""A table of running totals that a stream updates, exactly once per micro-batch.

Keys are dealt into parts by hash. A micro-batch reads the parts its keys are in, merges, and writes
only those parts, under its own version; then it writes a manifest that says which version holds each
part. A manifest counts once Spark has committed it, so a reader sees all of a batch or nothing. A
batch that is replayed without a manifest starts from the one before it, whatever its first run left
behind, and overwrites its own version; one that has a manifest is in the table: totals never double.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of the table; a batch rewrites those that its keys fall into.
PARTS = 64

_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


class RunningTotals:
    """``keys`` with ``totals``: columns of a batch by how two values of a key become one.

    ``upsert`` suits ``foreachBatch``; a folder belongs to one stream, whose batches count up. ``table``
    gives the latest version.
    """

    def __init__(
        self, spark: SparkSession, folder: str, keys: Sequence[str], totals: dict[str, str], parts: int = PARTS
    ) -> None:
        unknown = set(totals.values()) - set(_MERGE)
        if unknown:
            raise ValueError(f"no such merge: {sorted(unknown)}")
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts
        self.keys, self.totals = list(keys), dict(totals)

    # -- files -------------------------------------------------------------------------------
    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _files(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, kind: str) -> list[int]:
        """Versions under a folder, ascending; of manifests only committed ones."""
        files, home = self._files(), self._path(f"{self.folder}/{kind}")
        if not files.exists(home):
            return []
        names = [s.getPath().getName() for s in files.listStatus(home)]
        found = sorted(int(n.removeprefix("v=")) for n in names if n.startswith("v="))
        if kind != "manifest":
            return found
        return [v for v in found if files.exists(self._path(f"{self.folder}/{kind}/v={v}/_SUCCESS"))]

    def _manifest(self) -> dict[int, int]:
        """Part to version, by the latest manifest."""
        known = self._versions("manifest")
        if not known:
            return {}
        rows = self.spark.read.schema("part int, version long").parquet(f"{self.folder}/manifest/v={known[-1]}")
        return {r.part: r.version for r in rows.collect()}  # at most one row per part

    def _read(self, schema: T.StructType, held: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/data/v={version}/part={part}" for part, version in sorted(held.items())]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    # -- table -------------------------------------------------------------------------------
    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*(_MERGE[how](name).alias(name) for name, how in self.totals.items()))

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Merge a micro-batch's rows (keys and totals) into the table."""
        if any(v >= batch_id for v in self._versions("manifest")):
            return
        own = self._merged(batch.select(*self.keys, *self.totals)).withColumn("part", self._part())
        touched = [r.part for r in own.select("part").distinct().collect()]  # at most one row per part
        held = self._manifest()
        columns = own.drop("part")
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in columns.schema.fields])
        earlier = self._read(schema, {p: v for p, v in held.items() if p in touched})
        whole = self._merged(earlier.unionByName(columns)).withColumn("part", self._part())
        files = whole.repartition("part").write.mode("overwrite").partitionBy("part")
        files.parquet(f"{self.folder}/data/v={batch_id}")
        now = held | dict.fromkeys(touched, batch_id)
        rows = self.spark.createDataFrame(sorted(now.items()), "part int, version long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/v={batch_id}")
        self._drop_unused(batch_id, set(held.values()) | set(now.values()))

    def _drop_unused(self, batch_id: int, used: set[int]) -> None:
        """Drop versions that neither this batch's manifest nor the one before it names."""
        files, manifests = self._files(), self._versions("manifest")
        for version in [v for v in self._versions("data") if v not in used and v < batch_id]:
            files.delete(self._path(f"{self.folder}/data/v={version}"), True)
        for version in [v for v in manifests if v < batch_id][:-1]:
            files.delete(self._path(f"{self.folder}/manifest/v={version}"), True)

    def table(self, kinds: str) -> DataFrame:
        """The latest version; ``kinds`` is the schema of keys and totals."""
        return self._read(T.StructType.fromDDL(kinds), self._manifest())


#: What ``alerts.rule_stats`` adds up, as totals.
RULE_TOTALS = {"evaluations": "sum", "hits": "sum", "risk_sum": "sum", "max_risk": "max", "last_evaluation_at": "max"}


def rule_totals(evaluations: DataFrame, by: str = "session_id") -> DataFrame:
    """Evaluations of a micro-batch as rows for ``RunningTotals`` with ``RULE_TOTALS``."""
    return evaluations.select(
        "rule_id",
        by,
        F.lit(1).cast("long").alias("evaluations"),
        F.col("triggered").cast("long").alias("hits"),
        F.col("risk_score").cast("long").alias("risk_sum"),
        F.col("risk_score").cast("long").alias("max_risk"),
        F.col("evaluated_at").alias("last_evaluation_at"),
    )


def rule_stats_of(totals: DataFrame, by: str = "session_id") -> DataFrame:
    """Running totals in the form of ``alerts.rule_stats``."""
    return totals.select(
        "rule_id",
        by,
        "evaluations",
        "hits",
        (F.col("evaluations") - F.col("hits")).alias("miss"),
        (F.col("risk_sum") / F.col("evaluations")).alias("avg_risk_score"),
        F.col("max_risk").cast("double").alias("max_risk_score"),
        "last_evaluation_at",
    )
