from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from wiretide.sinks import retention

SCHEMA = (
    "capture_id string, src_ip string, dst_ip string, dst_port int, protocol string, start_time timestamp, "
    "packets_count long, bytes_sent long, bytes_recv long, duration_ms double, day date"
)
TODAY = date(2024, 5, 1)


def store(spark, tmp_path, days):
    rows = []
    for ago in days:
        day = TODAY - timedelta(days=ago)
        for n in range(6):
            start = datetime(day.year, day.month, day.day, n // 2, 10 * n)
            rows.append(("c", "10.0.0.1", "10.0.0.2", 80, "TCP", start, n, 10, 1, 2.0, day))
    table = spark.createDataFrame(rows, SCHEMA)
    table.write.mode("append").partitionBy("day").parquet(str(tmp_path / "flows"))
    return retention.FlowStore(spark, str(tmp_path / "flows"), str(tmp_path / "sums"))


def days_of(folder):
    return sorted(p.name for p in folder.iterdir() if p.name.startswith("day="))


def test_days_become_sums_and_go(spark, tmp_path):
    flows = store(spark, tmp_path, [1, 7, 8, 30, 100])
    old, gone = flows.maintain(TODAY)
    assert old == [TODAY - timedelta(days=d) for d in (100, 30, 8)] and gone == [TODAY - timedelta(days=100)]
    assert days_of(tmp_path / "flows") == ["day=2024-04-24", "day=2024-04-30"]
    assert days_of(tmp_path / "sums") == ["day=2024-04-01", "day=2024-04-23"]
    rows = spark.read.parquet(str(tmp_path / "sums")).where("day = '2024-04-23'").orderBy("hour").collect()
    assert [(r.hour.hour, r.flows, r.packets, r.bytes_sent, r.duration_ms) for r in rows] == [
        (0, 2, 1, 20, 4.0), (1, 2, 5, 20, 4.0), (2, 2, 9, 20, 4.0)
    ]
    assert flows.maintain(TODAY) == ([], [])
    # later more days are old; earlier sums stay as they are
    flows.maintain(TODAY + timedelta(days=3))
    assert days_of(tmp_path / "sums") == ["day=2024-04-01", "day=2024-04-23", "day=2024-04-24"]


def test_a_run_that_died_is_run_again(spark, tmp_path):
    flows = store(spark, tmp_path, [8, 9])
    part = spark.read.parquet(str(tmp_path / "flows")).where("day = '2024-04-22' AND packets_count < 2")
    half = retention.hourly_sums(part).write.partitionBy("day")
    half.parquet(str(tmp_path / "sums"))  # sums of part of a day, without a marker
    flows.maintain(TODAY)
    assert spark.read.parquet(str(tmp_path / "sums")).agg(F.sum("flows")).first()[0] == 12
    # marked, but not dropped in full: what is left of the day must not replace its sums
    store(spark, tmp_path, [8])
    flows.maintain(TODAY)
    assert spark.read.parquet(str(tmp_path / "sums")).agg(F.sum("flows")).first()[0] == 12
    assert days_of(tmp_path / "flows") == []


def test_only_old_partitions_are_read(spark, tmp_path):
    store(spark, tmp_path, [1, 2, 8])
    old = spark.read.parquet(str(tmp_path / "flows")).where(F.col("day").isin(TODAY - timedelta(days=8)))
    plan = retention.hourly_sums(old)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "day#" in plan.split("PartitionFilters")[1]
    assert len(old.inputFiles()) >= 1 and all("day=2024-04-23" in f for f in {r.f for r in old.select(F.input_file_name().alias("f")).collect()})


def test_nothing_stored(spark, tmp_path):
    flows = retention.FlowStore(spark, str(tmp_path / "flows"), str(tmp_path / "sums"))
    assert flows.maintain(TODAY) == ([], [])
