"""Profile-level operators: top-k frequent values, distinct keywords, best-matching
co-author, and similarity of a paper to its author's top-k profile
(AGG-01/02, WIN-02/04, SIM-03..06, JON-02).

Skew: an author may hold a large share of all rows.  Counting is a partial
aggregation; the top-k cut runs in two phases (per (author, salt) then per
author over at most salts*k rows), so no task sorts an author's whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertrail import constants as K
from papertrail.functions.similarity import best_index_arrow, jaro_winkler, jaro_winkler_arrow
from papertrail.functions.text import py_str
from papertrail.operators.skew import HOT_ROWS, salted_join

TOPK_SALTS = 32


def top_k_values(df: DataFrame, value_col: str, k: int = K.TOP_K, group: str = "author_id",
                 order_col: str = "seq", keep_null: bool = True,
                 salts: int = TOPK_SALTS) -> DataFrame:
    """AGG-01 / WIN-02: the k most frequent values per group, ties broken by
    first appearance.  Returns (group, rank, value, cnt)."""
    src = df.select(group, order_col, F.col(value_col).alias("value"))
    if not keep_null:
        src = src.filter(F.col("value").isNotNull())
    counts = src.groupBy(group, "value").agg(F.count(F.lit(1)).alias("cnt"),
                                              F.min(order_col).alias("first_seen"))
    order = [F.col("cnt").desc(), F.col("first_seen").asc()]
    local = (counts.withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(salts)))
             .withColumn("_rn", F.row_number().over(
                 Window.partitionBy(group, "_salt").orderBy(*order)))
             .filter(F.col("_rn") <= k))
    return (local.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
            .filter(F.col("rank") <= k)
            .select(group, F.col("rank").cast("int").alias("rank"), "value", "cnt"))


def distinct_elements(df: DataFrame, array_col: str, group: str = "author_id") -> DataFrame:
    """AGG-02 / SET-04: distinct array elements per group, as rows (never one big array)."""
    return (df.select(group, F.explode(array_col).alias("value"))
            .filter(F.col("value").isNotNull()).distinct())


def best_match(authors: Column, target: Column, *, name_field: str = "name",
               out_field: str = "org", lower_names: bool = True, method: str = "arrow") -> Column:
    """SIM-03 / WIN-04: the ``out_field`` of the first author whose name has the
    strictly highest Jaro-Winkler score against ``target``; NULL without authors.
    Per row, no shuffle.  ``method='expr'`` keeps it all in JVM expressions."""
    if method == "arrow":
        idx = best_index_arrow(F.transform(authors, lambda a: a[name_field]), target,
                               lower_names=lower_names)
        hit = F.try_element_at(authors, idx + 1)[out_field]
        return F.when(idx.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(hit, F.lit("")))
    init = F.struct(F.lit(-1.0).alias("s"), F.lit(None).cast("string").alias("v"))

    def step(acc, a):
        nm = F.lower(a[name_field]) if lower_names else a[name_field]
        s = F.coalesce(jaro_winkler(nm, target), F.lit(-1.0))
        return F.when(s > acc["s"], F.struct(s.alias("s"),
                                             F.coalesce(a[out_field], F.lit("")).alias("v"))
                      ).otherwise(acc)

    return F.aggregate(authors, init, step)["v"]


def with_matched_org(pp: DataFrame, authors_col: str = "authors", name_col: str = "name",
                     out: str = "matched_org", method: str = "arrow") -> DataFrame:
    return pp.withColumn(out, best_match(F.col(authors_col), F.col(name_col), method=method))


def scored_pairs(pairs: DataFrame, a: str = "a", b: str = "b", method: str = "expr") -> DataFrame:
    """(a, b, jw): Jaro-Winkler of every distinct pair, once each, as a JVM expression or (``arrow``) in Arrow batches."""
    score = jaro_winkler_arrow if method == "arrow" else jaro_winkler
    return pairs.select(a, b).distinct().withColumn("jw", score(F.col(a), F.col(b)))


def profile_similarity(pp: DataFrame, topk: DataFrame, value: Column, prefix: str,
                       guard: Column | None = None, top_as_str: bool = False,
                       group: str = "author_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """SIM-04..06 with JON-02: Jaro-Winkler of each row's value against the
    group's top-k values; max, min, mean and max-min, 0 when guarded out or
    when the group has no top values.  Returns (group, seq, 4 columns).

    Rows are first reduced to the distinct values of a group, and those with their top values to the distinct pairs of all
    groups; a pair is scored once, however many profiles hold it, and the scores find back by value."""
    rows = pp.select(group, "seq", F.when(guard if guard is not None else F.lit(True), value).alias("_v"))
    top = topk.select(group, (py_str(F.col("value")) if top_as_str else F.col("value")).alias("_t"))
    held = rows.filter("_v is not null").select(group, "_v").distinct()
    asked = held.join(top.filter("_t is not null"), group)
    scores = scored_pairs(asked, "_v", "_t")
    agg = (salted_join(asked, scores, ["_v", "_t"], [group], hot_rows).groupBy(group, "_v")
           .agg(F.max("jw").alias("mx"), F.min("jw").alias("mn"), F.avg("jw").alias("av")))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return rows.join(agg, [group, "_v"], "left").select(
        group, "seq", z("mx").alias(f"max_jaro_{prefix}"), z("mn").alias(f"min_jaro_{prefix}"),
        z("av").alias(f"mean_jaro_{prefix}"), (z("mx") - z("mn")).alias(f"max_min_jaro_{prefix}"))


def matched_orgs(pp: DataFrame, authors_col: str = "authors", name_col: str = "name", group: str = "author_id",
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """SIM-03: (group, seq, matched_org): the org of the first co-author whose lower-cased name is most like the profile's.

    Each distinct (co-author name, profile name) is scored once; the best of a paper is a maximum of (score, -position),
    so the paper's co-authors need not meet in one row.  Papers without named co-authors have no row.  Worth its shuffles
    where the same names meet the same profiles often; :func:`with_matched_org` compares row by row."""
    each = pp.select(group, "seq", F.col(name_col).alias("_t"), F.posexplode(authors_col).alias("_pos", "_a")).select(
        group, "seq", "_t", "_pos", F.lower("_a.name").alias("_who"), F.coalesce("_a.org", F.lit("")).alias("_org"))
    each = each.filter("_who is not null and _t is not null")
    scores = scored_pairs(each, "_who", "_t", "arrow")
    return (salted_join(each, scores, ["_who", "_t"], [group, "seq"], hot_rows).groupBy(group, "seq")
            .agg(F.max_by("_org", F.struct("jw", -F.col("_pos"))).alias("matched_org")))
