"""Ground-truth labels: one small YAML file per capture."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.schemas import GROUND_TRUTH

# Keys of a label file.
LABEL_KEYS = ("pcap_file", "attack_present", "attack_types", "source_ips", "notes")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading YAML labels needs PyYAML on the executors") from error

    def texts(value: object) -> list[str]:
        return [str(v) for v in value] if isinstance(value, list) else []

    for batch in batches:
        rows = []
        for capture, text in zip(batch["capture_id"], batch["value"]):
            try:
                label = yaml.safe_load(text)
            except yaml.YAMLError:
                label = None
            if not isinstance(label, dict):
                continue
            rows.append(
                (
                    capture,
                    str(label.get("pcap_file", capture)),
                    bool(label.get("attack_present", False)),
                    texts(label.get("attack_types")),
                    texts(label.get("source_ips")),
                    str(label.get("notes", "")),
                    sorted(str(k) for k in label if k not in LABEL_KEYS),
                )
            )
        yield pd.DataFrame(rows, columns=GROUND_TRUTH.fieldNames())


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels keyed by file name without suffix.

    A file that is no YAML mapping gives no row, so its capture is left out of the metrics.
    ``unknown_keys`` lists keys that are not part of the format.
    """
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"(\.[A-Za-z0-9]+)+$", "")
    return files.select(name.alias("capture_id"), "value").mapInPandas(_read, GROUND_TRUTH)
