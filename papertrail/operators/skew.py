"""Hot-key splitting for equi-joins whose keys can be heavily skewed.

A key with n rows on the probe side gets s = ceil(n / hot_rows) salt values, however
many rows it has; keys of up to hot_rows rows stay whole.  Probe rows pick one salt from a hash of their own id; build rows
are replicated s times.  Only hot keys are listed in the salt table, which is
therefore bounded by rows / hot_rows, and is broadcast: joined by key, all rows of a
hot key would travel to one task before they are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 20_000


def salt_table(probe: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    freq = probe.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (freq.select(*keys, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_s"))
            .filter(F.col("_s") > 1))


def salted_join(probe: DataFrame, build: DataFrame, keys: list[str], probe_id: list[str],
                hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Inner equi-join on ``keys`` with hot keys split across tasks.

    Hot keys are found by counting the probe side's rows.  ``hot_rows=None`` leaves skew to AQE's skew-join splitting alone."""
    if hot_rows is None:
        return probe.join(build, keys)
    salts = F.broadcast(salt_table(probe, keys, hot_rows))
    p = (probe.join(salts, keys, "left")
         .withColumn("_salt", F.pmod(F.xxhash64(*probe_id), F.coalesce(F.col("_s"), F.lit(1))))
         .drop("_s"))
    b = (build.join(salts, keys, "left")
         .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_s"), F.lit(1)) - 1)))
         .drop("_s"))
    return p.join(b, keys + ["_salt"]).drop("_salt")
