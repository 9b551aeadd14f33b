"""Compare a Spark result with DuckDB on the same tables: columns, types, row multiset."""

from __future__ import annotations

import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "float": "FLOAT",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, sf_dir: str, build, sql: str, con=None) -> dict:
    con = con or connect(sf_dir)
    t0 = time.time()
    df = build(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    plan = df._jdf.queryExecution().executedPlan().toString()
    joins = [j for j in ("CartesianProduct", "BroadcastNestedLoopJoin") if j in plan]
    rel = con.sql(sql)
    expected = rel.fetchall()
    t2 = time.time()
    ours = dict(df.dtypes)
    theirs = dict(zip(rel.columns, [str(t) for t in rel.types]))
    names = sorted(ours)
    problems = [f"plan has a {j}" for j in joins]
    if names != sorted(theirs):
        problems.append(f"columns {names} vs {sorted(theirs)}")
    else:
        for n in names:
            if KINDS.get(ours[n], ours[n]) != theirs[n]:
                problems.append(f"type of {n}: {ours[n]} vs {theirs[n]}")
        a_at = [df.columns.index(n) for n in names]
        b_at = [rel.columns.index(n) for n in names]
        a = sorted((tuple(r[i] for i in a_at) for r in rows), key=repr)
        b = sorted((tuple(r[i] for i in b_at) for r in expected), key=repr)
        if len(a) != len(b):
            problems.append(f"rows {len(a)} vs {len(b)}")
        if a != b:
            only_a = sorted(set(a) - set(b), key=repr)
            only_b = sorted(set(b) - set(a), key=repr)
            problems.append(f"values differ: {len(only_a)} / {len(only_b)}, e.g. {str(only_a[:2])[:500]} vs {str(only_b[:2])[:500]}")
    return {"rows": len(rows), "problems": problems, "spark": round(t1 - t0, 2), "sql": round(t2 - t1, 2)}
