"""Per-group ROC-AUC and the error-weighted mean AUC (AGG-07/08/09).

AUC per group is the Mann-Whitney statistic:
    sum over distinct scores s of pos(s) * (neg_below(s) + neg(s) / 2) / (P * N).
Counting per (group, score) is a partial aggregation, so tied scores are one row.  The
running count of negatives is taken in two levels over ranges of (group, score) of about
equal depth (``ranks``), however narrow a band the scores lie in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.operators import ranks as R


def group_auc(df: DataFrame, group: str = "author_id", label: str = "label",
              score: str = "score", ranges: int | None = None) -> DataFrame:
    """(group, auc, n_pos, n_neg); auc is NULL when a group has one class only."""
    s = df.select(group, F.col(label).cast("long").alias("y"), F.col(score).cast("double").alias("s")) \
          .filter(F.col("s").isNotNull() & F.col("y").isNotNull())
    per = s.groupBy(group, "s").agg(F.sum("y").alias("pos"),
                                    F.sum(1 - F.col("y")).alias("neg"))
    per = R.running_sum(per, [group], ["s"], "neg", "before", ranges)
    contrib = F.col("pos") * (F.col("before") + F.col("neg") / 2.0)
    agg = per.groupBy(group).agg(F.sum(contrib).alias("u"), F.sum("pos").alias("n_pos"),
                                 F.sum("neg").alias("n_neg"))
    return agg.select(group, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                                    F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"),
                      "n_pos", "n_neg")


def weighted_auc(df: DataFrame, group: str = "author_id", label: str = "label",
                 score: str = "score", weight: str = "size") -> DataFrame:
    """AGG-09: sum(auc * w) with w = errors / sum(errors) over groups whose AUC
    is defined.  weight='size' counts rows whose score differs from the label
    (the observed rule, about the group size); weight='threshold' counts rows
    whose score is on the wrong side of 0.5."""
    auc = group_auc(df, group, label, score)
    y, p = F.col(label).cast("double"), F.col(score).cast("double")
    err = (p != y) if weight == "size" else (F.abs(p - y) >= 0.5)
    errs = df.groupBy(group).agg(F.sum(err.cast("long")).alias("errs"))
    j = auc.filter(F.col("auc").isNotNull()).join(errs, group)
    return j.agg((F.sum(F.col("auc") * F.col("errs")) / F.sum("errs")).alias("weighted_auc"),
                 F.count(F.lit(1)).alias("n_groups"))


def mean_over(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """AGG-07: mean of several predictions per row key."""
    return df.groupBy(*keys).agg(F.avg(value).alias(out))
