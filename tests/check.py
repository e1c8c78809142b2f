"""Compare registered queries with their SQL: python -m tests.check [sf] [name ...]"""

from __future__ import annotations

import sys
import time
import traceback

import duckdb

import __spark_entry__ as spark_entry
from tests.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def normal(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        if v != v:
            return "nan"
        return repr(v + 0.0) if v != int(v) or abs(v) > 1e15 else str(int(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(normal(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def compare(spark, con, folder, name) -> tuple[bool, str]:
    df = spark_entry.queries()[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = spark_entry.oracle_sql().get(name)
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, no SQL"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if got == want:
        return len(got) > 0, f"{len(got)} rows"
    differ = [(a, b) for a, b in zip(got, want) if a != b][:2]
    return False, f"{len(got)} rows vs {len(want)}; first differences {differ}"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session(name="check"), connect(folder)
    names = sys.argv[2:] or list(spark_entry.queries())
    bad = []
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, con, folder, name)
        except Exception as e:  # noqa: BLE001
            ok, note = False, "".join(traceback.format_exception_only(e))[:1500]
        print(f"{'ok ' if ok else 'BAD'} {name:28s} {time.time() - start:6.2f}s {note}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)} of {len(names)} right; wrong: {bad}")
    spark.stop()
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
