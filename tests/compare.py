"""Comparison of a query with its SQL, the way the driver does it, and as a command:

    python -m tests.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def kind(spark_type: str) -> str:
    return {
        "bigint": "BIGINT",
        "int": "INTEGER",
        "double": "DOUBLE",
        "float": "FLOAT",
        "string": "VARCHAR",
        "boolean": "BOOLEAN",
        "timestamp_ntz": "TIMESTAMP",
    }.get(spark_type, spark_type)


def normal(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    result = con.execute(sql)
    theirs = {d[0]: str(d[1]) for d in result.description}
    rows = result.fetchall()
    ours = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    out = []
    if sorted(ours) != sorted(theirs):
        return [f"columns {sorted(ours)} != {sorted(theirs)}"]
    out += [f"type of {n}: {t} != {theirs[n]}" for n, t in ours.items() if t != theirs[n]]
    names, order = sorted(ours), list(theirs)
    expected = Counter(
        tuple(normal(row[order.index(n)]) for n in names) for row in rows
    )
    actual = Counter(tuple(normal(row[n]) for n in names) for row in df.collect())
    if actual != expected:
        extra, missing = actual - expected, expected - actual
        out.append(
            f"{sum(actual.values())} rows against {sum(expected.values())}; "
            f"{sum(extra.values())} differ, such as {next(iter(sorted(extra, key=str)), None)} "
            f"for {next(iter(sorted(missing, key=str)), None)}"
        )
    if not expected:
        out.append("no rows")
    return out


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session()
    con, sql, failed = connect(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            found = differences(query(spark, sf_dir), con, sql[name])
        except Exception as error:  # report and go on
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {time.time() - start:6.2f}s {name}", *found[:6])
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(), 1))
