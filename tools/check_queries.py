"""Run queries next to their SQL and compare rows.

    python tools/check_queries.py [--sf 0.01] [--only PART] [--data /root/testdata]
"""

from __future__ import annotations

import argparse
import contextlib
import datetime as dt
import io
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from fieldweave.catalog import ORACLES, QUERIES  # noqa: E402
from fieldweave.fixtures import _TABLES  # noqa: E402
from fieldweave.session import build_session  # noqa: E402


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    keyed = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(keyed, key=repr)


def compare(spark, con, key, folder):
    frame = QUERIES[key](spark, folder)
    got = table(frame.columns, [tuple(r) for r in frame.collect()])
    if key not in ORACLES:
        return f"rows only ({len(got[1])})", len(got[1])
    cur = con.execute(ORACLES[key])
    want = table([d[0] for d in cur.description], cur.fetchall())
    kinds = dict(zip([d[0] for d in cur.description], [str(d[1]) for d in cur.description]))
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} vs {want[0]}", len(got[1])
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:3]
        lack = [r for r in want[1] if r not in set(got[1])][:3]
        return f"ROWS {len(got[1])} vs {len(want[1])}\n   columns {got[0]}\n   spark {extra}\n   sql   {lack}", len(got[1])
    odd = [f"{c}: {t} / {kinds[c]}" for c, t in frame.dtypes if (t in ("int", "bigint")) != (kinds[c] in ("INTEGER", "BIGINT", "NUMBER"))]
    return "ok" + (f"  types? {odd}" if odd else ""), len(got[1])


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("--only", default="")
    args.add_argument("--data", default="/root/testdata")
    args.add_argument("--no-broadcast", action="store_true", help="shuffle all joins and name nested-loop plans")
    opts = args.parse_args()
    folder = f"{opts.data}/sf{opts.sf}"
    spark = build_session("check", cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    if opts.no_broadcast:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    con = duckdb.connect()
    for t in _TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    nested = ("CartesianProduct", "BroadcastNestedLoopJoin")
    wanted = [w for w in opts.only.split(",") if w]
    for key in QUERIES:
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            note, n = compare(spark, con, key, folder)
            if opts.no_broadcast:
                shown = io.StringIO()
                with contextlib.redirect_stdout(shown):
                    QUERIES[key](spark, folder).explain()
                plan = shown.getvalue()
                note += "".join(f"  {name}!" for name in nested if name in plan)
        except Exception as error:  # noqa: BLE001 - reported per query
            note, n = "ERROR " + str(error)[:700] + "".join(traceback.format_tb(error.__traceback__)[-1:]), 0
        bad += not note.startswith(("ok", "rows only"))
        print(f"{key:40s} {time.time() - start:6.1f}s {n:8d}  {note}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
