"""Overlap self-joins inside groups by prefix filtering.

Rows of one group (papers of one profile) that share at least ``least`` elements are found without forming a pair for every
shared element.  The elements of a group are totally ordered from rare to frequent; a row is indexed under all but its
``least - 1`` most frequent elements.  Two rows that share ``least`` elements share one that both index, so the profile's own
name, which nearly every row holds, is never a join key when two names must be shared.  Elements that one row alone holds are
left out before.  A pair meets once: at the first element, in that order, that both rows hold; there the
sorted element lists, which travel with the keys, give the number of shared elements.  So no counts are shuffled.

Keys with many rows are split: a key of n rows gets ceil(n / hot_rows) parts, one side picks a part by its hash and the other
side goes to every part.  The counts come from the same frequencies that order the elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.operators.skew import HOT_ROWS, salted_join
from papertrail.session import materialize


def _parts(n: Column, hot_rows: int) -> Column:
    return F.ceil(n / F.lit(hot_rows)).cast("int")


def _meet(left: DataFrame, right: DataFrame, group: str, hot_rows: int) -> DataFrame:
    """Equi-join on (group, elem); both sides carry ``n``, the number of rows of the key."""
    split = left.withColumn("part", F.pmod(F.xxhash64("src_seq"), _parts(F.col("n"), hot_rows))).drop("n")
    spread = right.withColumn("part", F.explode(F.sequence(F.lit(0), _parts(F.col("n"), hot_rows) - 1))).drop("n")
    return split.join(spread, [group, "elem", "part"])


def ordered_elements(rows: DataFrame, elements: Column, least: int, group: str = "author_id",
                     carried: tuple[str, ...] = ()) -> DataFrame:
    """(group, seq, paper_id, elems): the distinct non-null elements of each row that another row of the group holds too,
    as (n, elem) from rare to frequent, n being the rows that hold it; rows with fewer than ``least`` drop out.  ``carried``
    columns of the rows come along."""
    row = [group, "seq", "paper_id", *carried]
    members = (rows.select(*row, F.explode(F.array_distinct(elements)).alias("elem"))
               .filter(F.col("elem").isNotNull()))
    freq = members.groupBy(group, "elem").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (members.join(freq, [group, "elem"])
            .groupBy(*row).agg(F.sort_array(F.collect_list(F.struct("n", "elem"))).alias("elems"))
            .filter(F.size("elems") >= least))


def overlap_pairs(rows: DataFrame, elements: Column, least: int, group: str = "author_id",
                  hot_rows: int = HOT_ROWS, fresh: str | None = None) -> DataFrame:
    """(group, src_seq, src, dst_seq, dst, shared) for every ordered pair of rows of a group that share ``least`` elements
    or more.  A row's elements are bounded (one paper's names); they travel once for each indexed element.

    ``fresh`` names a boolean column: then only pairs with a fresh row in them are formed, each fresh row being looked up
    among all rows, so rows that are not fresh never meet each other."""
    carried = (fresh,) if fresh else ()
    keyed = ordered_elements(rows, elements, least, group, carried).select(
        group, "seq", "paper_id", *carried, F.transform("elems", lambda x: x["elem"]).alias("held"),
        F.inline(F.slice("elems", F.lit(1), F.size("elems") - (least - 1))))
    once = F.col("src_seq") < F.col("dst_seq")  # a pair of rows that stand on both sides meets there twice
    asking = keyed.filter(fresh) if fresh else keyed
    src = asking.select(group, "elem", "n", F.col("seq").alias("src_seq"), F.col("paper_id").alias("src"),
                        F.col("held").alias("src_held"))
    dst = keyed.select(group, "elem", "n", *carried, F.col("seq").alias("dst_seq"), F.col("paper_id").alias("dst"),
                       F.col("held").alias("dst_held"))
    met = (_meet(src, dst, group, hot_rows).filter(once | ~F.col(fresh) if fresh else once)
           .withColumn("common", F.array_intersect("src_held", "dst_held"))
           .filter((F.size("common") >= least) & (F.col("common")[0] == F.col("elem"))))
    one = F.struct("src_seq", "src", "dst_seq", "dst")
    back = F.struct(F.col("dst_seq").alias("src_seq"), F.col("dst").alias("src"), F.col("src_seq").alias("dst_seq"),
                    F.col("src").alias("dst"))
    return met.select(group, F.size("common").cast("long").alias("shared"), F.inline(F.array(one, back)))


# --- containment of token sets -------------------------------------------------------------------------------------

def contained_names(names: DataFrame, group: str = "author_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(group, inner, outer) for all pairs of two different names of a group with tokens(inner) a subset of tokens(outer).
    ``names``: (group, name).  A name is looked up by its rarest token in the group, if other names hold that too."""
    toks = names.withColumn("toks", F.array_distinct(F.split("name", " ")))
    each = toks.select(group, "name", F.explode("toks").alias("tok"))
    freq = each.groupBy(group, "tok").agg(F.count(F.lit(1)).alias("n"))
    counted = each.join(freq.hint("merge"), [group, "tok"])
    rarest = counted.groupBy(group, "name").agg(F.min(F.struct("n", "tok")).alias("key")).filter("key.n > 1")
    inner = rarest.select(group, F.col("name").alias("inner"), F.split("name", " ").alias("inner_toks"),
                          F.col("key.tok").alias("elem"), F.col("key.n").alias("n"), F.xxhash64("name").alias("src_seq"))
    outer = counted.filter("n > 1").select(group, F.col("name").alias("outer"), F.split("name", " ").alias("outer_toks"),
                                           F.col("tok").alias("elem"), "n")
    return (_meet(inner, outer, group, hot_rows)
            .filter((F.col("inner") != F.col("outer")) & (F.size(F.array_except("inner_toks", "outer_toks")) == 0))
            .select(group, "inner", "outer"))


def contained_sets(inner: DataFrame, outer: DataFrame, inner_id: str, outer_id: str, inner_set: str = "ta",
                   outer_set: str = "tb", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(inner_id, outer_id) of all pairs where the non-empty set of tokens ``inner_set`` lies within ``outer_set``.

    An inner set is looked up by its token that the fewest outer sets hold.  One with a token that no outer set holds
    meets nothing; a token with n outer rows gets ceil(n / hot_rows) parts."""
    each = outer.select(outer_id, outer_set, F.explode(outer_set).alias("tok"))
    freq = each.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    key = (inner.select(inner_id, inner_set, F.explode(inner_set).alias("tok")).join(freq, "tok", "left")
           .groupBy(inner_id, inner_set).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "tok")).alias("k"))
           .filter("k.n > 0").select(inner_id, inner_set, F.col("k.tok").alias("tok")))
    return (salted_join(each, key, ["tok"], [outer_id], hot_rows)
            .filter(F.size(F.array_except(inner_set, outer_set)) == 0).select(inner_id, outer_id))


def subset_pairs(rows: DataFrame, names: Column, least: int, group: str = "author_id",
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """(group, src_seq, src, dst_seq, dst, shared): for ordered pairs of rows the number of (i, j) positions with the tokens
    of src's i-th name among those of dst's j-th, where it is ``least`` or more.

    Containment is settled once for distinct names.  A row then offers the names it holds, and covers these and the names
    contained in them, each with a multiplicity; names that one row alone covers meet nothing and are left out.  Prefix
    filter: of a row's names, from frequent to rare, those may go unindexed whose multiplicities times the most that any row
    covers them with add up to less than ``least``.

    The names held and covered are written once, so that no plan repeats the steps before, and their joins are merged:
    the files' sizes say little of what a broadcast table would take."""
    row = [group, "seq", "paper_id"]
    held = (rows.select(*row, F.filter(names, lambda x: x.isNotNull()).alias("all"))
            .select(*row, "all", F.explode(F.array_distinct("all")).alias("name")))
    held = materialize(held.select(*row, "name", F.size(F.filter("all", lambda x: x == F.col("name"))).alias("times")), "held")
    within = materialize(contained_names(held.select(group, "name").distinct(), group, hot_rows), "within")
    longer = salted_join(held.withColumnRenamed("name", "outer"), within, [group, "outer"], ["seq"], hot_rows)
    cover = (held.select(*row, F.col("name").alias("elem"), "times")
             .unionByName(longer.select(*row, F.col("inner").alias("elem"), "times"))
             .groupBy(*row, "elem").agg(F.sum("times").alias("m")))
    cover = materialize(cover, "cover")
    stats = cover.groupBy(group, "elem").agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("most")).filter("n > 1")
    stats = materialize(stats, "stats").hint("merge")
    offered = (held.withColumnRenamed("name", "elem").join(stats, [group, "elem"])
               .groupBy(*row).agg(F.sort_array(F.collect_list(F.struct("n", "elem", "times", "most"))).alias("elems")))
    rest = F.transform("elems", lambda x, i: F.struct(x["n"].alias("n"), x["elem"].alias("elem"), F.aggregate(
        F.slice(F.col("elems"), i + 1, F.size("elems")), F.lit(0).cast("long"),
        lambda s, y: s + y["times"] * y["most"]).alias("rest")))
    src = (offered.select(group, F.col("seq").alias("src_seq"), F.col("paper_id").alias("src"), "elems",
                          F.inline(F.filter(rest, lambda x: x["rest"] >= least))).drop("rest"))
    covers = cover.join(stats, [group, "elem"]).groupBy(*row).agg(F.collect_list(F.struct("elem", "m", "n")).alias("all"))
    dst = (covers.select(group, F.col("seq").alias("dst_seq"), F.col("paper_id").alias("dst"),
                         F.map_from_entries(F.transform("all", lambda x: F.struct(x["elem"], x["m"]))).alias("covers"),
                         F.inline("all")).drop("m"))
    common = F.filter("elems", lambda x: F.map_contains_key(F.col("covers"), x["elem"]))
    shared = F.aggregate("common", F.lit(0).cast("long"),
                         lambda s, x: s + x["times"] * F.element_at(F.col("covers"), x["elem"]))
    return (_meet(src, dst.hint("merge"), group, hot_rows).filter(F.col("src_seq") != F.col("dst_seq"))
            .withColumn("common", common).filter(F.col("common")[0]["elem"] == F.col("elem"))
            .withColumn("shared", shared).filter(F.col("shared") >= least)
            .select(group, "shared", "src_seq", "src", "dst_seq", "dst"))
