import random
import time

import pytest
from pyspark.sql import functions as F

from wiretide.streaming import adaptive, upsert

KINDS = "k string, n long, top long"


def totals(spark, folder, parts=4):
    return upsert.RunningTotals(spark, str(folder), ["k"], {"n": "sum", "top": "max"}, parts)


def rows_of(table):
    return {r.k: (r.n, r.top) for r in table.table(KINDS).collect()}


def batch(spark, rows):
    return spark.createDataFrame(rows, KINDS)


def test_batches_add_up_and_replays_do_not(spark, tmp_path):
    dice = random.Random(4)
    table, want = totals(spark, tmp_path), {}
    assert rows_of(table) == {}
    for number in range(5):
        rows = [(dice.choice(["a", "b", None, "d", "é"]), dice.randint(0, 9), dice.randint(-5, 5)) for _ in range(12)]
        for k, n, top in rows:
            old = want.get(k, (0, -99))
            want[k] = (old[0] + n, max(old[1], top))
        table.upsert(batch(spark, rows), number)
        table.upsert(batch(spark, rows), number)
        assert rows_of(table) == want
    table.upsert(batch(spark, [("a", 1, 1)]), 2)  # in the table long since
    assert rows_of(table) == want


def test_a_batch_that_died_before_its_manifest_is_done_again(spark, tmp_path):
    table = totals(spark, tmp_path)
    table.upsert(batch(spark, [("a", 1, 1), ("b", 2, 2)]), 0)
    # files of a run that ended before its manifest was committed
    broken = batch(spark, [("a", 50, 50)]).withColumn("part", F.lit(0))
    broken.write.partitionBy("part").parquet(str(tmp_path / "data" / "v=1"))
    (tmp_path / "manifest" / "v=1").mkdir()
    assert rows_of(table) == {"a": (1, 1), "b": (2, 2)}
    table.upsert(batch(spark, [("a", 10, 0)]), 1)
    assert rows_of(table) == {"a": (11, 1), "b": (2, 2)}


def test_only_touched_parts_are_written_and_old_versions_go(spark, tmp_path):
    table = totals(spark, tmp_path, parts=64)
    table.upsert(batch(spark, [(f"k{n}", 1, 1) for n in range(300)]), 0)
    for number in range(1, 5):
        table.upsert(batch(spark, [("k7", 1, number)]), number)
        written = [p.name for p in (tmp_path / "data" / f"v={number}").iterdir() if p.name.startswith("part=")]
        assert len(written) == 1
    assert rows_of(table)["k7"] == (5, 4) and len(rows_of(table)) == 300
    kept = sorted(p.name for p in (tmp_path / "data").iterdir() if p.name.startswith("v="))
    assert kept == ["v=0", "v=3", "v=4"]
    assert sorted(p.name for p in (tmp_path / "manifest").iterdir() if p.name.startswith("v=")) == ["v=3", "v=4"]


def test_unknown_merge(spark, tmp_path):
    with pytest.raises(ValueError):
        upsert.RunningTotals(spark, str(tmp_path), ["k"], {"n": "mean"})


def test_state_of_idle_rules_ends(spark, tmp_path):
    schema = "session_id string, rule_id string, flush_id long, seq long, raw_score double"

    def run(rule, seconds):
        rows = [("s", rule, 0, n, 0.5) for n in range(3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        scores = adaptive.stream_adaptive_scores(stream, keep_seconds=seconds).writeStream.format("parquet")
        query = scores.option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
        ends = time.monotonic() + 60
        while sum(p.numInputRows for p in query.recentProgress) < 3 and time.monotonic() < ends:
            time.sleep(0.2)
        query.stop()
        state = spark.read.format("statestore").load(str(tmp_path / "cp"))
        return {r.rule_id for r in state.select("key.rule_id").collect()}

    assert run("r1", 3600) == {"r1"}
    assert "r1" in run("r2", 0.001)
    assert run("r3", 3600) == {"r1", "r3"}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9
