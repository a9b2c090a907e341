"""Numeric expressions against the SQL engine and Python's own formatting."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tracewell.functions import numeric as N


def test_rounding_equals_sql_at_binary_halves(spark):
    """0.285 and the like are below the half that scaling them gives; decimal rounding differs there."""
    values = [0.285, 1.005, 2.675, -1.005, 0.0405346503425, 5e300, float("inf"), float("-inf"), 17.1002243785, None]
    values += (np.log(2) / np.random.default_rng(3).integers(1, 10**7, 20000) * 1e5).tolist()
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    for digits in (2, 9, 12):
        found = [r.r for r in df.select("i", N.round_half(F.col("x"), digits).alias("r")).orderBy("i").collect()]
        expected = [r[0] for r in duckdb.connect().execute(f"select round(x, {digits}) from (select unnest(?::double[]) as x)", [values]).fetchall()]
        assert found == expected


def test_human_bytes_rounds_halves_to_even(spark):
    def plain(n):
        size = float(n)
        for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
            if size < 1024 or unit == "TiB":
                return f"{size:.2f} {unit}"
            size /= 1024

    sizes = [0, 1, 1023, 1024, 592000, 1030784, 1024 * 5 + 5 * 128, 2**20 - 1, 2**20, 2**30 - 1, 2**30, 2**40 - 1, 2**40, 2**53, -7, 1048575, 1029 * 1024]
    sizes += [k * 128 for k in range(1, 4000)]
    df = spark.createDataFrame([(n,) for n in [*sizes, None]], "n long")
    found = {r.n: r.t for r in df.select("n", N.human_bytes(F.col("n")).alias("t")).collect()}
    assert found.pop(None) is None
    assert found == {n: plain(n) for n in sizes}
