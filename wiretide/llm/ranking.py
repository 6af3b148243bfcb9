"""Places of rows in their groups and lookups by key, also where one key holds most rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretide.llm.common import settled

#: Bits of ``monotonically_increasing_id`` that number the rows of one partition.
_ROW_BITS = 33


def ranked(
    table: DataFrame,
    by: list[str],
    order: list[str],
    more: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The table with ``rank`` (from 0, by ``order`` within ``by``) and ``total`` (rows of the group).

    ``by`` columns hold no null; in ``order`` nulls come first. Rows are dealt by ranges of
    (``by``, ``order``), so a large group is many partitions; a row's rank is its place in its
    partition plus the group's rows in earlier ones. ``more`` may add columns to the groups (``by``,
    ``total``); every row then gets its group's. The sorted rows are kept in the shared folder, so a
    lost executor cannot change a place. Rows that tie in ``order`` stay apart.
    """
    keys = [*by, *order]
    dealt = table.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = settled(dealt.withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", _ROW_BITS))
    runs = placed.groupBy(*by, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*by)
    runs = runs.withColumns(
        {
            "total": F.sum("n").over(whole),
            "before": F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"),
        }
    )
    extra = []
    if more is not None:
        groups = more(runs.groupBy(*by).agg(F.sum("n").alias("total")))
        extra = [c for c in groups.columns if c not in (*by, "total")]
        runs = runs.join(groups.select(*by, *extra), by)
    return placed.join(runs, [*by, "part"]).select(
        *table.columns, (F.col("at") - F.col("first") + F.col("before")).alias("rank"), "total", *extra
    )


def spread_lookup(
    rows: DataFrame, key: str, table: DataFrame, salt: str, how: str = "inner", salts: int = 64
) -> DataFrame:
    """The rows joined with ``table``, which has each ``key`` once, where a key may hold most rows.

    Rows of a key are dealt by their column ``salt``; the table is joined with the distinct (key, salt)
    first, at most ``salts`` rows a key, so no task of the large join gets more than a share.
    """
    dealt = rows.withColumn("salt_", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    found = dealt.select(key, "salt_").distinct().join(table, key)
    return dealt.join(found, [key, "salt_"], how).drop("salt_")
