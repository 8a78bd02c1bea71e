"""papertrail: author-attribution analytics as Spark DataFrame jobs.

Every operator takes and returns DataFrames and is parameterised by column
names, so the same code runs on nested paper records and on flat tables.
"""

__all__ = ["session", "constants"]
