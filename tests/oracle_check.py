"""Compares registered queries with their SQL statements: ``python tests/oracle_check.py SF_DIR [query …]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def expected_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return _by_name(names, result.fetchall())


def actual_rows(df) -> tuple[list[str], list[tuple]]:
    return _by_name(df.columns, [tuple(r) for r in df.collect()])


def _by_name(names: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    place = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in place], sorted((tuple(r[i] for i in place) for r in rows), key=repr)


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            got = actual_rows(query(spark, sf_dir))
            took = time.time() - started
            if name not in sql:
                print(f"{name}: no SQL, {len(got[1])} rows, {took:.1f}s", flush=True)
                continue
            want = expected_rows(con, sql[name])
            verdict = "ok" if got == want else "DIFFERENT"
            print(f"{name}: {verdict}, {len(got[1])} rows, {took:.1f}s (SQL {time.time() - started - took:.1f}s)", flush=True)
            if got != want:
                print("  columns", got[0], want[0] if want[0] != got[0] else "equal", "rows", len(got[1]), len(want[1]))
                extra = sorted(set(got[1]) - set(want[1]), key=repr)[:2]
                missing = sorted(set(want[1]) - set(got[1]), key=repr)[:2]
                print("  only Spark:", *extra, "\n  only SQL:  ", *missing, sep="\n    ", flush=True)
        except Exception as error:  # report every query
            print(f"{name}: FAILED {str(error)[:600]}", flush=True)


if __name__ == "__main__":
    main()
