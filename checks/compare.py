"""Compare each Spark query with its DuckDB counterpart.

Usage: python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    return repr(x)


def rows_of(table):
    """(sorted column names, column types, sorted rows) of an Arrow table."""
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    types = [str(table.schema.field(n).type).replace("large_", "") for n in names]
    return names, types, sorted(tuple(map(_cell, row)) for row in zip(*columns))


def difference(spark_table, duck_table) -> str | None:
    """None when equal, else the first thing that differs."""
    sn, st, sr = rows_of(spark_table)
    dn, dt, dr = rows_of(duck_table)
    if sn != dn:
        return f"columns {sn} != {dn}"
    if st != dt:
        return f"types {st} != {dt}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} != {len(dr)}; extra {list(set(sr) - set(dr))[:2]} missing {list(set(dr) - set(sr))[:2]}"
    for a, b in zip(sr, dr):
        if a != b:
            bad = sum(x != y for x, y in zip(sr, dr))
            return f"{bad} of {len(sr)} rows differ, first {a} != {b}"
    return None


def main(argv: list[str]) -> int:
    from checks.oracles import ORACLES
    from checks.queries import QUERIES
    from wayfare.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con, failed = local_session(8), connect(sf), 0
    for name in names:
        start = time.time()
        try:
            got = QUERIES[name](spark, sf).toArrow()
            middle = time.time()
            sql = ORACLES.get(name)
            told = None if sql is None else difference(got, con.sql(sql).to_arrow_table())
            note = f"rows only ({got.num_rows})" if sql is None else told or f"ok ({got.num_rows})"
        except Exception as error:  # report and go on with the next query
            middle, told = time.time(), "error"
            note = f"ERROR {type(error).__name__}: {str(error)[:900]}"
        failed += told is not None
        print(f"{name:26s} {middle - start:6.1f}s {time.time() - middle:6.1f}s  {note[:1200]}", flush=True)
    print(f"{failed} failed of {len(names)}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
