"""Run registered queries next to their SQL and compare all rows.

``python -m pairscape.checks.compare /path/to/tables [name-prefix …]``
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from .views import BASE


def connect(folder: str):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(repr(tuple(row[i] for i in order)) for row in rows)


def compare(spark, con, q, folder: str) -> dict:
    started = time.time()
    df = q.spark(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    out = {"name": q.name, "rows": len(rows), "seconds": round(time.time() - started, 2)}
    text = q.oracle()
    if text is None:
        return {**out, "ok": True, "note": "no SQL"}
    started = time.time()
    cur = con.execute(text)
    other = cur.fetchall()
    out["sql_seconds"] = round(time.time() - started, 2)
    names = [d[0] for d in cur.description]
    left, right = bag(df.columns, rows), bag(names, other)
    out["ok"] = left == right and sorted(names) == sorted(df.columns)
    if not out["ok"]:
        out["note"] = (
            f"spark {len(rows)} sql {len(other)}; only spark {list((left - right))[:3]}; "
            f"only sql {list((right - left))[:3]}; cols {sorted(names)}"
        )
    return out


def main(argv: list[str]) -> int:
    from ..session import build_session
    from . import QUERIES

    folder, wanted = argv[0], argv[1:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, q in QUERIES.items():
        if wanted and not any(name == w or name.startswith(w + "_") for w in wanted):
            continue
        try:
            r = compare(spark, con, q, folder)
        except Exception as exc:  # noqa: BLE001 - report and go on with the next query
            r = {"name": name, "ok": False, "note": f"{type(exc).__name__}: {str(exc)[:900]}"}
        bad += not r["ok"]
        print("ok  " if r["ok"] else "FAIL", r["name"], r.get("rows"), r.get("seconds"), r.get("sql_seconds"), r.get("note", ""), flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
