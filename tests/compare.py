"""Run registered queries and their SQL twins side by side.

    python tests/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def make_spark(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("panelloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.driver.memory", "12g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return int(v)
    return v if isinstance(v, str) else str(v)


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, fn, sql, sf_dir, tolerance: float = 0.0) -> str:
    """Empty string when equal, else what differs."""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    ours = _sorted([tuple(_plain(r[c]) for c in names) for r in df.collect()])
    cur = con.execute(sql)
    theirs_names = [d[0] for d in cur.description]
    if sorted(theirs_names) != names:
        return f"columns {names} != {sorted(theirs_names)}"
    at = [theirs_names.index(c) for c in names]
    theirs = _sorted([tuple(_plain(r[i]) for i in at) for r in cur.fetchall()])
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            if tolerance and all(
                x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= tolerance) for x, y in zip(a, b)
            ):
                continue
            n = sum(x != y for x, y in zip(ours, theirs))
            return f"{n} of {len(ours)} rows differ, e.g. {dict(zip(names, a))} != {dict(zip(names, b))}"
    return "" if ours else "no rows on either side"


def main() -> None:
    from panelloom.catalog import ORACLES, QUERIES

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con = make_spark(), connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.perf_counter()
        try:
            if name in ORACLES:
                verdict = compare(spark, con, fn, ORACLES[name], sf_dir)
            else:
                verdict = f"rows only: {fn(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001 - report every failure and go on
            verdict = "ERROR " + str(e)[:700]
        bad += bool(verdict) and not verdict.startswith("rows only")
        print(f"{'ok ' if not verdict else '   '} {name:26s} {time.perf_counter() - start:6.2f}s {verdict}", flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main()
