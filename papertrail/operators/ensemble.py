"""Score blending (JON-06, ENS-02, ENS-03)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail import constants as K

KEY = ["author_id", "paper_id"]


def average_scores(a: DataFrame, b: DataFrame, out: str = "score", key=KEY,
                   a_col: str = "score", b_col: str = "score") -> DataFrame:
    """ENS-02: (a + b) / 2 over rows present in both."""
    x = a.select(*key, F.col(a_col).alias("_a"))
    y = b.select(*key, F.col(b_col).alias("_b"))
    return x.join(y, key).select(*key, ((F.col("_a") + F.col("_b")) / 2).alias(out))


def join_scores(tables: dict[str, DataFrame], key=KEY) -> DataFrame:
    """JON-06: (key, one column for each scorer) of the rows that all tables hold; a table has its score under its name."""
    return reduce(lambda a, b: a.join(b, key), (d.select(*key, name) for name, d in tables.items()))


def blended(sci: str, w2v: str, trees: str) -> Column:
    """0.7 * (0.3 * w2v + 0.7 * sci) + 0.3 * trees."""
    return (F.lit(K.BLEND_GRAPH) * (F.lit(K.BLEND_W2V) * F.col(w2v) + F.lit(K.BLEND_SCI) * F.col(sci))
            + F.lit(K.BLEND_TREES) * F.col(trees))


def blend(graph_sci: DataFrame, graph_w2v: DataFrame, trees: DataFrame, key=KEY,
          col: str = "score") -> DataFrame:
    """ENS-03 with JON-06: 0.7 * (0.3 * w2v + 0.7 * sci) + 0.3 * trees, keyed by
    (author, paper); every key must be present in all three tables."""
    named = {"sci": graph_sci, "w2v": graph_w2v, "trees": trees}
    j = join_scores({n: d.select(*key, F.col(col).alias(n)) for n, d in named.items()}, key)
    return j.select(*key, blended("sci", "w2v", "trees").alias("score"))
