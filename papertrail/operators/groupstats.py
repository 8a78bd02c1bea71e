"""Per-group statistics broadcast back to rows (AGG-03/04, WIN-01).

pandas' ``groupby(k)[c].transform(stat)`` becomes one ``groupBy(k).agg`` (partial
aggregation on the map side, so a huge group never sits in one task) joined
back on the key.  An unordered window over the author would instead place a
whole author in one task.  Variance and deviation are sample statistics
(ddof 1; NULL for one row).

The median is exact without a buffer that grows with a group.  Groups of up to ``SMALL`` rows take the built-in median; in
larger ones the middle is selected: a quantile sketch gives pivots for each (group, column), rows are counted between and at
the pivots, and only the interval that holds the middle goes on, until it has one distinct value or ``SMALL`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papertrail.session import materialize

STATS = ("mean", "max", "min", "var", "std", "median")

_AGG = {"mean": F.avg, "max": F.max, "min": F.min, "var": F.var_samp, "std": F.stddev_samp}

#: Rows of a group, or of an interval, whose values one buffer may hold; pivots of an interval.
SMALL = 4096
PIVOTS = 64


def group_medians(df: DataFrame, cols: list[str], group: str = "author_id", small: int = SMALL) -> DataFrame:
    """(group, {col}_median ...): exact medians of the non-null values."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    large = materialize(sizes.filter(F.col("_n") > small).select(group), "large_groups")
    medians = [F.median(F.col(c)).cast("double").alias(f"{c}_median") for c in cols]
    if large.isEmpty():
        return df.groupBy(group).agg(*medians)
    on = F.col(group).eqNullSafe(F.col("_g"))
    large = large.withColumnRenamed(group, "_g")
    few = df.join(large, on, "left_anti").groupBy(group).agg(*medians)
    return few.unionByName(_selected(df.join(large, on, "left_semi"), cols, group, small))


def _selected(df: DataFrame, cols: list[str], group: str, small: int) -> DataFrame:
    """Medians by repeated selection; every buffer is bounded by ``small`` and ``PIVOTS``."""
    value = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(c).cast("double").alias("v"))
                                for k, c in enumerate(cols)])).alias("s")
    long = materialize(df.select(F.col(group).alias("g"), value).select("g", "s.c", "s.v").filter("v is not null"),
                       "median_values")
    n = F.col("n")
    # both middle ranks; equal for an odd number of values
    middle = F.explode(F.array(F.struct(F.lit(0).alias("t"), F.floor((n - 1) / 2).alias("k")),
                               F.struct(F.lit(1).alias("t"), F.floor(n / 2).alias("k")))).alias("m")
    todo = (long.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .select("g", "c", "n", "lo", "hi", middle).select("g", "c", "n", "lo", "hi", "m.t", "m.k"))
    key = ["g", "c", "t"]
    found = None
    while True:
        todo = materialize(todo, "median_intervals")  # a row for each (large group, column, middle)
        done = todo.filter("lo = hi").select(*key, F.col("lo").alias("v"))
        inside = (long.join(todo.filter(f"lo < hi and n <= {small}").select(
            F.col("g").alias("g2"), F.col("c").alias("c2"), "t", "lo", "hi", "k"),
            F.col("g").eqNullSafe(F.col("g2")) & (F.col("c") == F.col("c2"))
            & F.col("v").between(F.col("lo"), F.col("hi")))
            .groupBy(*key, "k").agg(F.sort_array(F.collect_list("v")).alias("vs"))
            .select(*key, F.element_at("vs", (F.col("k") + 1).cast("int")).alias("v")))
        part = materialize(done.unionByName(inside), "medians_found")
        found = part if found is None else found.unionByName(part)
        todo = todo.filter(f"lo < hi and n > {small}")
        if todo.isEmpty():
            break
        todo = _narrowed(long, todo, key)
    middles = found.groupBy("g", "c").agg(F.avg("v").alias("v"))
    at = [F.max(F.when(F.col("c") == k, F.col("v"))).alias(f"{c}_median") for k, c in enumerate(cols)]
    return middles.groupBy(F.col("g").alias(group)).agg(*at)


def _narrowed(long: DataFrame, todo: DataFrame, key: list[str]) -> DataFrame:
    """One round: the part of each interval, between two pivots or at one, that holds the rank."""
    mine = todo.select(F.col("g").alias("g2"), F.col("c").alias("c2"), "t", "lo", "hi", "k")
    rows = long.join(mine, F.col("g").eqNullSafe(F.col("g2")) & (F.col("c") == F.col("c2"))
                     & F.col("v").between(F.col("lo"), F.col("hi"))).select(*key, "k", "v")
    shares = [i / PIVOTS for i in range(1, PIVOTS)]
    pivots = rows.groupBy(*key).agg(F.array_distinct(F.percentile_approx("v", shares, 100 * PIVOTS)).alias("p"))
    p = pivots.select(F.col("g").alias("g2"), F.col("c").alias("c2"), F.col("t").alias("t2"), "p")
    below = F.size(F.filter("p", lambda x: x < F.col("v")))
    part = 2 * below + F.array_contains("p", F.col("v")).cast("int")
    counted = (rows.join(p, F.col("g").eqNullSafe(F.col("g2")) & (F.col("c") == F.col("c2")) & (F.col("t") == F.col("t2")))
               .groupBy(*key, "k", part.alias("part"))
               .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    upto = F.sum("n").over(Window.partitionBy(*key).orderBy("part"))  # at most 2 * PIVOTS rows
    return (counted.withColumn("upto", upto).filter((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("n")))
            .select("g", "c", "n", "lo", "hi", "t", (F.col("k") - (F.col("upto") - F.col("n"))).alias("k")))


def group_stats(df: DataFrame, cols: list[str], group: str = "author_id",
                stats=STATS, small: int = SMALL) -> DataFrame:
    """One row per group with ``{col}_{stat}`` columns."""
    exprs = [_AGG[s](F.col(c)).alias(f"{c}_{s}") for s in stats if s != "median" for c in cols]
    out = df.groupBy(group).agg(*exprs) if exprs else df.select(group).distinct()
    if "median" not in stats:
        return out
    med = group_medians(df, cols, group, small).withColumnRenamed(group, "_m")
    return (out.join(med, F.col(group).eqNullSafe(F.col("_m")))
            .select(group, *[f"`{c}_{s}`" for s in stats for c in cols]))


def spreads(df: DataFrame, cols: list[str]) -> DataFrame:
    """AGG-04: max+min, max-min, max-median, median-min."""
    c = F.col
    out = {}
    for x in cols:
        mx, mn, md = c(f"`{x}_max`"), c(f"`{x}_min`"), c(f"`{x}_median`")
        out[f"{x}_max+min"] = mx + mn
        out[f"{x}_max-min"] = mx - mn
        out[f"{x}_max-median"] = mx - md
        out[f"{x}_median-min"] = md - mn
    return df.withColumns(out)


def broadcast_stats(df: DataFrame, cols: list[str], group: str = "author_id",
                    stats=STATS, with_spreads: bool = True) -> DataFrame:
    """WIN-01: attach the group's statistics to every row (join on the key; the
    planner broadcasts the per-group table only when its measured size allows)."""
    st = group_stats(df, cols, group, stats)
    if with_spreads and {"max", "min", "median"} <= set(stats):
        st = spreads(st, cols)
    return df.join(st, group, "left")
