"""URL filters by a sort-merge range join.

A rule names a host and a path: it fits urls of that host and of all its subdomains whose path
starts with the rule's. A host is turned round, label by label, into a key (``www.example.com`` to
``com.example.www.``), so that a host and its subdomains are the keys of one interval, from
``com.example.`` up to ``com.example/``. Intervals of different hosts nest or are apart. Rules and
urls are sorted together by key; a sweep over them keeps the stack of the rules' hosts whose
intervals are open, and each url takes the longest fitting rule on the stack.

Scale: the key range is cut at points drawn from a sample of the urls, and each rule is sent to the
ranges that its interval meets: a rule of a huge host goes to its many ranges, all others to one or
two. Cut points are (key, path hash) pairs, so a host that holds a third of all urls is cut too.
Nothing is broadcast but the cut points, a fixed number per partition. A task streams through its
rows; it holds the open hosts' rules (their paths by length), not the urls.

Longest means the longest rule text, host and path together; among equals the longer host, then
``block`` before ``allow``. Defined results: a url that is null or without ``://`` has empty host
and path; no rule with a host fits it. Repeated urls are judged alike; repeated rules count once.
Rules with null parts are left out. Only the named columns are read, with those to keep.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretide.llm.common import lower_ascii

#: Cut points per shuffle partition.
CUTS = 4
#: Sampled urls per cut point.
SAMPLED = 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased host and the path of an absolute url; empty texts for any other."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, url.substr(start + 3, F.length(url)))
    host = lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """The host's labels from last to first, each with a dot behind it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def judge(
    pages: DataFrame,
    rules: DataFrame,
    *,
    keep: tuple[str, ...] = ("page_id",),
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``row`` (struct of the kept columns), ``host``, ``path``, ``rule`` (or null) and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block).
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col).cast("string"))
    urls = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), host.alias("host"), path.alias("path")
    ).withColumn("key", host_key(F.col("host")))
    urls = urls.withColumn("salt", F.xxhash64("path", "row"))
    cuts = _cut_points(urls)
    shared = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def range_of(key, salt):
        import pandas as pd

        return pd.Series([bisect.bisect_right(shared.value, pair) for pair in zip(key, salt)], dtype="int32")

    clean = (
        rules.select(
            lower_ascii(F.col("host").cast("string")).alias("host"),
            F.col("path").cast("string").alias("path"),
            F.col("verdict").cast("string").alias("verdict"),
        )
        .dropna()
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # block before allow
        .withColumn("key", host_key(F.col("host")))
    )
    least, most = F.lit(-(2**63)).cast("long"), F.lit(2**63 - 1).cast("long")
    end = F.concat(F.expr("substr(key, 1, length(key) - 1)"), F.lit("/"))
    placed = (
        clean.withColumn("from", range_of("key", least))
        .withColumn("to", range_of(end, least))
        .withColumn("range", F.explode(F.sequence("from", "to")))
    )
    none = F.lit(None)
    both = urls.select(
        range_of("key", "salt").alias("range"), "key", F.lit(1).alias("is_url"), "salt", "row", "host", "path",
        none.cast("string").alias("verdict"),
    ).unionByName(
        placed.select(
            "range", "key", F.lit(0).alias("is_url"), least.alias("salt"),
            none.cast(urls.schema["row"].dataType).alias("row"), "host", "path", "verdict",
        )
    )
    dealt = both.repartition("range").sortWithinPartitions("range", "key", "is_url", "salt")
    kind = urls.schema["row"].dataType.simpleString()
    schema = f"row {kind}, host string, path string, rule string, verdict string"
    return dealt.mapInArrow(_sweep(default), schema)


def _cut_points(urls: DataFrame) -> list[tuple[str, int]]:
    """Sorted (key, salt) pairs that cut the urls into ranges of about equal size."""
    spark = urls.sparkSession
    wanted = CUTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = urls.count()
    if not total:
        return []
    share = min(1.0, SAMPLED * wanted / total)
    drawn = urls.select("key", "salt").where(F.pmod(F.xxhash64("salt"), F.lit(1 << 30)) < int(share * (1 << 30)))
    pairs = sorted((r["key"], r["salt"]) for r in drawn.collect())
    step = max(1, len(pairs) // wanted)
    return sorted(set(pairs[step::step]))


def _sweep(default: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = None
        stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []
        for batch in batches:
            rules, verdicts, keep = [], [], []
            columns = [batch[c].to_pylist() for c in ("range", "key", "is_url", "host", "path", "verdict")]
            for part, key, is_url, host, path, verdict in zip(*columns):
                if part != place:
                    place, stack = part, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                keep.append(is_url == 1)
                if not is_url:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    _, paths, sizes = stack[-1]
                    paths[path] = host + path, verdict
                    if len(path) not in sizes:
                        bisect.insort(sizes, len(path))
                    continue
                best = None
                for _, paths, sizes in stack:
                    for size in reversed(sizes):
                        if size <= len(path) and (found := paths.get(path[:size])):
                            # hosts come from shortest to longest
                            if best is None or len(found[0]) >= len(best[0]):
                                best = found
                            break
                rules.append(best and best[0])
                verdicts.append(best[1] if best else default)
            out = batch.filter(pa.array(keep, pa.bool_()))
            arrays = [out["row"], out["host"], out["path"], pa.array(rules, pa.string()), pa.array(verdicts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "host", "path", "rule", "verdict"])

    return work
