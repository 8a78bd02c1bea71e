"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertrail.plans.registry import ship_package
from papertrail.session import ensure_checkpoint_dir

#: Rows per Arrow batch: whole texts travel in these batches, so a worker holds few of them at a time.
BATCH_ROWS = 512

#: Where a text may be cut without changing any pattern match: after visible text, before plain white space.
_CUT = re.compile(r"(?<=\S)(?=[ \t\r\n])")
_RUN = re.compile(r"\s ")


def share(spark: SparkSession) -> None:
    """Ship the package to Python workers and register the shared folder; no setting of the session changes."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)


def sliced(fn, rows: int = BATCH_ROWS):
    """``fn`` over the same batches in slices of at most ``rows`` rows, whatever the session's batch size is.

    Spark bounds a batch by bytes; the slices bound what ``fn`` turns into Python objects at a time."""
    def run(batches):
        return fn(b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))
    return run


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; a null text counts as empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def pieces(text: str) -> list[str]:
    """Cut a text at its safe boundaries: before white space that follows a visible character.

    No match of the public split patterns holds visible text followed by white space, and none looks
    behind, so the pieces give the matches of the whole text.  A run without white space stays whole."""
    if _RUN.search(text):
        return _CUT.split(text)
    head, *rest = text.split(" ")
    return [head, *[" " + x for x in rest]]


def parallelism(df: DataFrame) -> int:
    """Partitions for work that is heavier than its input bytes."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
               df.sparkSession.sparkContext.defaultParallelism)
