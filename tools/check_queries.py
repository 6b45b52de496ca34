"""Compare registered queries with their SQL on one scale, with timings.

python tools/check_queries.py [sf] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rankforge.session import get_spark  # noqa: E402
from rankforge.workload import load  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(row, names):
    out = []
    for n in sorted(names):
        v = row[n]
        if isinstance(v, float):
            v = "nan" if math.isnan(v) else repr(v)
        elif isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
            v = repr([float(x) if isinstance(x, float) else x for x in v])
        out.append(repr(v) if not isinstance(v, str) else v)
    return tuple(out)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = get_spark(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "10g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    con.execute("set timezone='UTC'")
    queries, sql = load()
    bad = []
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            names = df.columns
            types = dict(df.dtypes)
            rows = df.collect()
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: {str(e)[:600]}", flush=True)
            if "-v" in parts:
                traceback.print_exc()
            continue
        t1 = time.time() - t0
        note = "rows-only"
        if name in sql:
            t0 = time.time()
            try:
                cur = con.execute(sql[name])
                onames = [d[0] for d in cur.description]
                otypes = {d[0]: str(d[1]) for d in cur.description}
                orows = cur.fetchall()
            except Exception as e:  # noqa: BLE001
                bad.append(name)
                print(f"SQL! {name}: {str(e)[:500]}", flush=True)
                continue
            t2 = time.time() - t0
            if sorted(onames) != sorted(names):
                note = f"COLUMNS {sorted(set(names) ^ set(onames))}"
            else:
                a = sorted(canonical(r.asDict(), names) for r in rows)
                b = sorted(canonical(dict(zip(onames, r)), names) for r in orows)
                if a == b:
                    note = f"ok (sql {t2:.1f}s)"
                else:
                    sa, sb = set(a), set(b)
                    only_a, only_b = sorted(sa - sb)[:2], sorted(sb - sa)[:2]
                    note = f"DIFF {len(a)} vs {len(b)} rows, {len(sa - sb)} differ; {sorted(names)} {only_a} | {only_b}"
            kinds = {
                n: (types[n], otypes.get(n)) for n in names
                if (types[n], otypes.get(n)) not in {
                    ("bigint", "BIGINT"), ("int", "INTEGER"), ("double", "DOUBLE"), ("string", "VARCHAR"), ("boolean", "BOOLEAN"),
                    ("array<double>", "DOUBLE[]"), ("array<bigint>", "BIGINT[]"), ("date", "DATE"),
                }
            }
            if kinds:
                note += f" TYPES {kinds}"
            if not note.startswith("ok") or kinds:
                bad.append(name)
        print(f"{t1:6.1f}s {len(rows):8d} {name}: {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
