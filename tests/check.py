"""Compare registered queries with their SQL in DuckDB.

Usage: python tests/check.py <sf dir> [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return float(f"{value:.12g}") if math.isfinite(value) else value
    if hasattr(value, "item"):
        return _plain(value.item())
    return value


def duck_rows(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def compare(df, sf_dir: str, sql: str) -> list[str]:
    """Differences between a Spark frame and a SQL result; empty when equal."""
    names, rows = duck_rows(sf_dir, sql)
    order = sorted(df.columns)
    if order != sorted(names):
        return [f"columns {order} against {sorted(names)}"]
    mine = sorted(
        (tuple(_plain(r[c]) for c in order) for r in df.collect()), key=repr
    )
    at = [names.index(c) for c in order]
    theirs = sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=repr)
    problems = []
    if len(mine) != len(theirs):
        problems.append(f"{len(mine)} rows against {len(theirs)}")
    for a, b in zip(mine, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            problems.append(f"{str(a)[-400:]} against {str(b)[-400:]}")
            break
    if not mine:
        problems.append("no rows at all")
    return problems


def main() -> int:
    from corpusmill.plans.oracles import ORACLES
    from corpusmill.plans.registered import QUERIES
    from corpusmill.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:] or list(QUERIES)
    # With the default that the sessions of others have.
    spark = local_session(**{"spark.sql.unionOutputPartitioning": "true"})
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problems = compare(df, sf_dir, ORACLES[name])
            else:
                problems = [] if df.count() else ["no rows at all"]
        except Exception as problem:
            problems = [f"{type(problem).__name__}: {str(problem)[:1500]}"]
        failed += bool(problems)
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'FAIL' if problems else 'ok'} {name} {kind} {time.time() - start:.2f}s", *problems[:2], flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} agree; without SQL: {sorted(set(QUERIES) - set(ORACLES))}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
