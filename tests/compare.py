"""Run registered queries against their SQL twins: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _order(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def differences(spark, con, name: str, query, sql: str, sf_dir: str) -> list[str]:
    """What differs between a query and its twin: columns, types, rows."""
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    kinds = dict(df.dtypes)
    cur = con.execute(sql)
    their_kinds = {d[0]: str(d[1]) for d in cur.description}
    theirs = cur.fetchall()
    position = {d[0]: i for i, d in enumerate(cur.description)}
    if sorted(position) != columns:
        return [f"columns {columns} against {sorted(position)}"]
    found = [
        f"type of {c}: {kinds[c]} against {their_kinds[c]}" for c in columns if TYPES.get(kinds[c], kinds[c]) != their_kinds[c]
    ]
    ours = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=_order)
    theirs = sorted((tuple(_plain(r[position[c]]) for c in columns) for r in theirs), key=_order)
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} against {len(theirs)}")
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first: {wrong[0][0]} against {wrong[0][1]}")
    if not ours:
        found.append("no rows")
    return found


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from gatewaylens.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle, bad = oracle_sql(), 0
    for name, query in queries().items():
        if wanted and name not in wanted or name not in oracle:
            continue
        begun = time.time()
        try:
            found = differences(spark, con, name, query, oracle[name], sf_dir)
        except Exception as error:
            found = [f"{type(error).__name__}: {str(error)[:900]}"]
        print(f"{'ok  ' if not found else 'DIFF'} {name} {time.time() - begun:.2f}s", *found, sep="\n     " if found else "")
        bad += bool(found)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
