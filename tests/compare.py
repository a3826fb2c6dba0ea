"""Run queries beside their SQL twins.

    python -m tests.compare [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from bindings import ORACLES, QUERIES
from bindings.tables import DRIVER_TABLES


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x) if x is not None and isinstance(x, str) else ""), repr(x)) for x in r))


def problems(spark, con, folder: str, name: str) -> list[str]:
    df = QUERIES[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return [] if rows else ["no rows"]
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    out = []
    wide = {c: k for c, k in kinds.items() if k.startswith(("HUGEINT", "DECIMAL", "DATE", "TIMESTAMP", "UHUGE"))
            or "[]" in k or "STRUCT" in k}
    if wide:
        out.append(f"oracle types {wide}")
    bad = {f.name: f.dataType.simpleString() for f in df.schema.fields
           if f.dataType.simpleString().startswith(("decimal", "array", "struct", "date", "timestamp", "map"))}
    if bad:
        out.append(f"spark types {bad}")
    for f in df.schema.fields:
        theirs = kinds.get(f.name, "")
        ours = f.dataType.simpleString()
        if (ours in ("double", "float")) != (theirs in ("DOUBLE", "FLOAT")) or (ours == "string") != (theirs == "VARCHAR"):
            out.append(f"type of {f.name}: {ours} against {theirs}")
    if sorted(df.columns) != sorted(columns):
        return out + [f"columns {sorted(set(df.columns) ^ set(columns))}"]
    if len(rows) != len(expected):
        out.append(f"{len(rows)} rows against {len(expected)}")
    ours, theirs = _rows(df.columns, rows), _rows(columns, expected)
    if ours != theirs:
        differing = [(a, b) for a, b in zip(ours, theirs) if a != b]
        if differing:
            out.append(f"{len(differing)} rows differ, first {differing[0][0]} against {differing[0][1]}")
    if not rows:
        out.append("no rows")
    return out


def main():
    from airgrid.session import build_session

    arguments = sys.argv[1:]
    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    names = arguments[1:] or list(QUERIES)
    names = [q for q in QUERIES if any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in names)]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in names:
        begun = time.monotonic()
        try:
            found = problems(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {time.monotonic() - begun:6.2f}s {name}"
              + ("" if name in ORACLES else " (rows only)"), *found, sep="\n       " if found else "", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
