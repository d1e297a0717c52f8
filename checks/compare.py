"""Run the registered queries beside their SQL and compare every value.

    python -m checks.compare SF_DIR [name ...]
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

FAMILIES = {
    "tinyint": "int", "smallint": "int", "integer": "int", "int": "int", "bigint": "bigint",
    "double": "double", "string": "string", "varchar": "string", "boolean": "boolean",
    "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp",
}


def session(cpus: str | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("staylight")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, folder, query, sql) -> str:
    frame = query(spark, folder)
    got = [tuple(r) for r in frame.collect()]
    got_types = {n: FAMILIES.get(t, t) for n, t in frame.dtypes}
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    result = db.sql(sql)
    want_types = {
        n: FAMILIES.get(str(t).lower(), str(t).lower()) for n, t in zip(result.columns, result.types)
    }
    want = result.fetchall()
    if got_types != want_types:
        odd = {
            n: (got_types.get(n), want_types.get(n))
            for n in {*got_types, *want_types}
            if got_types.get(n) != want_types.get(n)
        }
        return f"TYPES {odd}"
    a, b = _rows(frame.columns, got), _rows(result.columns, want)
    if a == b:
        return f"ok {len(a)} rows"
    only = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"VALUES {len(a)} vs {len(b)} rows, {sorted(got_types)}\n  spark {only[0]}\n  sql   {only[1]}"


def main(argv: list[str]) -> int:
    from checks.oracles import oracle_sql
    from checks.queries import queries

    folder, names = argv[0], argv[1:]
    spark, sqls, bad = session(), oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        started = time.perf_counter()
        try:
            if name in sqls:
                outcome = compare(spark, folder, query, sqls[name])
            else:
                outcome = f"ok {query(spark, folder).count()} rows (no SQL)"
        except Exception as error:  # report and go on with the next query
            outcome = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        bad += not outcome.startswith("ok")
        print(f"{time.perf_counter() - started:7.2f}s {name:28s} {outcome}", flush=True)
    print(f"{bad} differences")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
