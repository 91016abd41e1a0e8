"""Compare named queries with their SQL counterparts: ``python tests/oracle_check.py [folder] [name…]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def canonical(value):
    if value is None:
        return ""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(row[i]) for i in order) for row in rows)


DUCK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "smallint": "SMALLINT",
}


def compare(spark, con, folder: str, name: str, build, sql: str) -> list[str]:
    """Differences between a query and its SQL; empty when they agree."""
    df = build(spark, folder)
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for column, kind in df.dtypes:
        if DUCK_TYPES.get(kind, kind) != types[column]:
            problems.append(f"type of {column}: {kind} vs {types[column]}")
    got = rows_of(df.columns, df.collect())
    want = rows_of(names, result.fetchall())
    if len(got) != len(want):
        problems.append(f"{len(got)} rows, expected {len(want)}")
    if got != want:
        extra, lacking = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        problems.append(f"columns {sorted(names)}\n    only here: {extra}\n    only SQL:  {lacking}")
    if not want:
        problems.append("empty result")
    return problems


def main() -> None:
    import __spark_entry__ as entry
    from wayside.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            problems = compare(spark, con, folder, name, queries[name], oracles[name])
        except Exception as error:  # noqa: BLE001 - report and go on
            problems = [f"{type(error).__name__}: {" | ".join(str(error).splitlines()[:6])[:600]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s", *problems, sep="\n  ", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree; without SQL: {sorted(set(queries) - set(oracles))}; without query: {sorted(set(oracles) - set(queries))}")


if __name__ == "__main__":
    main()
