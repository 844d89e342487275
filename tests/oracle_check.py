"""Compare every registered query with its SQL on the same tables: `python -m tests.oracle_check [sf] [name ...]`."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _cell(x)) for k, x in v.items()))
    if isinstance(v, int):
        return float(v)
    if type(v).__name__ == "Decimal":
        return float(v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _cell(x)) for k, x in v.asDict().items()))
    return str(v)


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql):
    cols = spark_df.columns
    mine = canonical([tuple(r) for r in spark_df.collect()], cols)
    cur = con.execute(sql)
    other_cols = [d[0] for d in cur.description]
    theirs = canonical(cur.fetchall(), other_cols)
    if sorted(cols) != sorted(other_cols):
        return f"columns {sorted(cols)} != {sorted(other_cols)}", len(mine)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}; first mine {mine[:1]}; first sql {theirs[:1]}", len(mine)
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ: {sorted(cols)} mine {bad[0][0]} sql {bad[0][1]}", len(mine)
    return None, len(mine)


def main(argv):
    sf = argv[0] if argv else "0.01"
    names = argv[1:]
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tidemark.session import local_session

    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sql:
                problem, n = compare(df, con, sql[name])
            else:
                n, problem = df.count(), None
        except Exception as exc:  # noqa: BLE001
            problem, n = f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:38s} rows={n:<7d} {time.time() - t0:6.2f}s "
              f"{'' if name in sql else '(no sql) '}{problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
