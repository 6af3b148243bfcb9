"""Session settings for standalone use; library code never changes a caller's session."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # call-site capture on every Column call slows planning and helps only in debugging
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", app: str = "wiretide", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    partitions = str(cores) if str(cores).isdigit() else "8"
    settings = {**DEFAULTS, "spark.sql.shuffle.partitions": partitions, **extra}
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="wiretide-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only on a local master, where driver and executors are one process, may the setting be missing;
    then it is a temporary folder of this process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.conf.get("spark.master", "").startswith("local") and not spark.conf.get(
        "spark.master", ""
    ).startswith("local-cluster"):
        return f"file://{_local_folder()}"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def written(table: DataFrame, folder: str) -> tuple[DataFrame, str]:
    """The table written to a fresh sub-folder and read back, and that sub-folder.

    Cuts the plan, survives lost executors, and lets later steps read only the columns they need.
    """
    path = f"{folder}/wiretide-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_drop_rest)
    _written[path] = table.sparkSession
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path), path


def drop_written(spark: SparkSession, path: str) -> None:
    """Remove a folder made by ``written``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _written.pop(path, None)


#: Written tables that nobody has dropped yet; the end of the process drops them.
_written: dict[str, SparkSession] = {}


def _drop_rest() -> None:
    for path, spark in list(_written.items()):
        with contextlib.suppress(Exception):  # the session or its process may be gone
            drop_written(spark, path)
