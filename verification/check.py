"""Compare registered queries with their SQL: ``python -m verification.check [folder] [names...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from verification.oracles import ORACLES
from verification.queries import QUERIES
from wiretide.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _plain(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].astype(object)
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)]
    return sorted(rows, key=repr)


def compare(spark, con, name: str, folder: str) -> str:
    started = time.time()
    ours = QUERIES[name](spark, folder).toPandas()
    took = time.time() - started
    spark.catalog.clearCache()
    if name not in ORACLES:
        return f"rows {len(ours)} ({took:.1f}s, no SQL)"
    theirs = con.sql(ORACLES[name]).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"COLUMNS {sorted(ours.columns)} != {sorted(theirs.columns)}"
    kinds = {
        c: (str(ours[c].dtype), str(theirs[c].dtype))
        for c in ours.columns
        if str(ours[c].dtype) != str(theirs[c].dtype)
    }
    a, b = _plain(ours), _plain(theirs)
    if a != b:
        lost = [x for x in a if x not in set(b)][:3]
        more = [x for x in b if x not in set(a)][:3]
        return f"DIFFERENT {len(a)} {len(b)}\n  ours {lost}\n  sql  {more}"
    return f"ok {len(a)} ({took:.1f}s)" + (f" dtypes {kinds}" if kinds else "")


def main(argv: list[str]) -> int:
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        try:
            result = compare(spark, con, name, folder)
        except Exception as error:  # report and go on to the next query
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        bad += not result.startswith(("ok", "rows"))
        print(f"{name}: {result}", flush=True)
    print(f"{len(names)} queries, {bad} not equal")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
