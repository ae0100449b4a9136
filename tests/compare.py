"""Runs registered queries beside their SQL: python tests/compare.py SF_DIR [NAME ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else round(float(v), 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    return v


def both(spark, sf_dir: str, query, sql: str) -> tuple[list, list]:
    """Sorted rows of either engine, columns by name."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in names) for r in df.collect()), key=repr)
    rel = con.execute(sql)
    at = {d[0]: i for i, d in enumerate(rel.description)}
    assert sorted(at) == names, (sorted(at), names)
    want = sorted((tuple(normal(r[at[c]]) for c in names) for r in rel.fetchall()), key=repr)
    return got, want


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tests.conftest import session

    spark = session()
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or [q for q in queries if not q.startswith(("op", "pipeline"))]:
        began = time.time()
        try:
            if name in oracle:
                got, want = both(spark, sys.argv[1], queries[name], oracle[name])
                says = "same" if got == want else f"DIFFERENT {len(got)} {len(want)} {[x for x in got if x not in want][:2]} {[x for x in want if x not in got][:2]}"
                says += f" {len(got)} rows"
            else:
                says = f"{queries[name](spark, sys.argv[1]).count()} rows"
        except Exception as e:  # noqa: BLE001
            says = f"ERROR {str(e)[:700]}"
        print(f"{name}: {says} ({time.time() - began:.1f} s)", flush=True)
