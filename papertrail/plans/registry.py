"""Registry of named queries: a Spark builder and, where SQL can express it,
an equivalent DuckDB query over the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


ROUND_BIAS = 1e-9


def stable_round_sql(sql: str) -> str:
    """Rewrite every ``round(x, 6)`` into ``round(CAST(x AS DOUBLE) + 1e-9, 6)``,
    the same boundary-safe rounding the Spark side applies (plans.common.r6):
    values sitting exactly on a half-way point then round the same way in both
    engines whatever their last-bit summation differences."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while True:
            ch = sql[k]
            depth += ch == "("
            depth -= ch == ")"
            if depth == 0:
                break
            k += 1
        inner = sql[j + 6:k]
        d, cut = 0, -1
        for m, ch in enumerate(inner):
            d += ch == "("
            d -= ch == ")"
            if ch == "," and d == 0:
                cut = m
        if cut >= 0 and inner[cut + 1:].strip() == "6":
            arg = stable_round_sql(inner[:cut])
            out.append(sql[i:j] + f"round(CAST(({arg}) AS DOUBLE) + {ROUND_BIAS}, 6)")
        else:
            out.append(sql[i:j] + "round(" + stable_round_sql(inner) + ")")
        i = k + 1


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``papertrail`` importable by Python workers (Arrow UDFs, mapInPandas)
    wherever they run: zip the package once per application and add it with
    ``addPyFile`` (executors fetch it from the driver)."""
    import os
    import tempfile
    import zipfile

    import papertrail
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(papertrail.__file__))
    fd, zpath = tempfile.mkstemp(prefix="papertrail-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)


def _shipped(fn: QueryFn) -> QueryFn:
    import functools

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)
    return run


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = _shipped(fn)
        if sql is not None:
            ORACLES[name] = stable_round_sql(sql)
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from papertrail.plans import (q_graph, q_text, q_profile, q_stats, q_propagate,  # noqa: F401
                                  q_models, q_io, q_misc)
