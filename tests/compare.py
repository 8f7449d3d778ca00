"""Runs queries in Spark and their SQL in DuckDB and compares the rows.

From a shell: ``python -m tests.compare FOLDER [NAME ...]``.
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("leafmill")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(value: object) -> object:
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def rows(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    columns = [[_plain(v) for v in frame[n]] for n in names]
    return sorted(zip(*columns), key=repr)


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {n: str(frame[n].dtype) for n in sorted(frame.columns)}


def difference(mine: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} vs {sorted(theirs.columns)}"
    a, b = rows(mine), rows(theirs)
    if len(a) != len(b):
        return f"row counts {len(a)} vs {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"first difference {x!r:.600} vs {y!r:.600}"
    return None


def main() -> None:
    import __spark_entry__ as entry

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(folder)
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            mine = queries[name](spark, folder).toPandas()
            took = time.time() - start
            if name not in checks:
                print(f"rows  {name:28s} {len(mine):8d} rows  spark {took:6.2f}s", flush=True)
                continue
            start = time.time()
            theirs = con.execute(checks[name]).df()
            note = difference(mine, theirs)
            a, b = kinds(mine), kinds(theirs)
            types = {n: (a[n], b[n]) for n in a if n in b and a[n] != b[n]} if note is None else {}
        except Exception as failure:
            note, took, mine, types = f"{type(failure).__name__}: {str(failure)[:900]}", 0, [], {}
        bad += note is not None
        word = "ok   " if note is None else "WRONG"
        print(
            f"{word} {name:28s} {len(mine):8d} rows  spark {took:6.2f}s  sql {time.time() - start:6.2f}s"
            f" {types or ''} {note or ''}",
            flush=True,
        )
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
