"""Run registered queries in Spark and their SQL in DuckDB and compare whole results.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(df, con, sql):
    """None when equal, else a short account of the difference."""
    got_cols = df.columns
    got = rows(got_cols, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want = rows(want_cols, rel.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; e.g. {got[:1]} / {want[:1]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)}/{len(got)} rows differ ({sorted(got_cols)}): {str(bad[0][0])[:600]} != {str(bad[0][1])[:600]}"
    if not got:
        return "both results are empty"
    return None


def main(argv):
    from curaspark.plans.catalog import all_oracles, all_queries
    from curaspark.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    queries, oracles = all_queries(), all_oracles()
    chosen = [q for q in queries if not names or any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in names)]
    spark, con = local_session(), duck(sf_dir)
    failed = []
    for name in chosen:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                fault = compare(df, con, oracles[name])
                note = "ok" if fault is None else fault
            else:
                n = df.count()
                fault = None if n else "no rows"
                note = f"rows only: {n}"
        except Exception as e:  # report and go on with the next query
            fault = note = f"{type(e).__name__}: {str(e)[:1500]}"
        if fault:
            failed.append(name)
        print(f"{'FAIL' if fault else 'ok  '} {name:32s} {time.time() - start:6.2f}s {'' if note == 'ok' else note}", flush=True)
    print(f"{len(chosen) - len(failed)}/{len(chosen)} fine; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
