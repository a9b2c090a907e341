"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        if glob.glob(path):
            con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "as_tuple"):
        return int(value) if value == int(value) else float(value)
    return value


def same(a, b) -> bool:
    """Equal; floats within the noise of summation order, NaN only to NaN."""
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def rows(columns, data):
    """Rows with columns by name, in an order that float noise does not change: other
    columns first, then floats to few digits."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]

    def key(row):
        exact = tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in row if not isinstance(v, float) and not isinstance(v, tuple))
        return exact, tuple(str(v) if isinstance(v, tuple) else round(v, 5) if math.isfinite(v) else str(v) for v in row if isinstance(v, (float, tuple))).__repr__()

    return sorted(out, key=key)


def differences(spark, con, query, sql, sf) -> list[str]:
    left = query(spark, sf)
    right = con.execute(sql)
    names = [d[0] for d in right.description]
    problems = []
    if sorted(left.columns) != sorted(names):
        return [f"columns {sorted(left.columns)} != {sorted(names)}"]
    a, b = rows(left.columns, [tuple(r) for r in left.collect()]), rows(names, right.fetchall())
    if len(a) != len(b):
        problems.append(f"rows {len(a)} != {len(b)}")
    if not a:
        problems.append("no rows")
    for x, y in zip(a, b):
        if not all(map(same, x, y)):
            problems.append(f"{sorted(names)}: {x} != {y}")
            if len(problems) > 3:
                break
    spark_types = dict(left.dtypes)
    duck_types = dict((d[0], str(d[1])) for d in right.description)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "decimal(20,0)": "DECIMAL(20,0)"}
    for name in names:
        if kinds.get(spark_types[name], spark_types[name]) != duck_types[name]:
            problems.append(f"type of {name}: {spark_types[name]} vs {duck_types[name]}")
    return problems


if __name__ == "__main__":
    import sys
    import time

    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con = duck(sf)
    wanted = sys.argv[1:]
    bad = 0
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            problems = differences(spark, con, query, sql, sf) if sql else [] if query(spark, sf).count() else ["no rows"]
        except Exception as error:  # report and go on
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        took = time.time() - start
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {took:.2f}s{'' if sql else ' (no sql)'}", flush=True)
        for p in problems:
            print("     ", p)
    print("failures:", bad)
