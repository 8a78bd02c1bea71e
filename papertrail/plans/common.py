"""Shared inputs for the registered queries (driver-table binding)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertrail.operators import graph as G
from papertrail.sources import driver as D


def graph_pp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile rows joined with papers, plus normalised names and lowered orgs."""
    return G.graph_input(D.profile_papers(spark, sf_dir))


def r6(c):
    """Round a double to 6 places so plans with different summation order agree.
    The small bias keeps values that sit exactly on a half-way point (common with
    small-integer data) on the same side in every engine."""
    return F.round(c.cast("double") + F.lit(1e-9), 6)
