"""Operators the reference describes or comments out (OPT-02/04/05) and the
dictionary transliteration (TXT-16)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papertrail.operators import names as NM
from papertrail.plans.common import r6
from papertrail.plans.registry import register
from papertrail.sources import driver as D
from papertrail.sources.driver import SQL_LINES, SQL_PAPER, SQL_PLINES, SQL_PROFILE, sql_with

_NAME_SQL = "lower(regexp_replace(s_name, '[^\\w\\s]', '', 'g'))"


@register("opt_02", sql_with(SQL_PROFILE, SQL_LINES, SQL_PLINES) + f"""
, nm AS (SELECT DISTINCT {_NAME_SQL} AS n FROM plines)
SELECT a.n AS a, b.n AS b, CAST(levenshtein(a.n, b.n) AS INTEGER) AS dist FROM nm a, nm b
WHERE levenshtein(a.n, b.n) <= 1""")
def opt_02(spark, sf):
    """Co-author names within edit distance 1 of each other (exact, blocked)."""
    pr = D.profiles(spark, sf).select("paper_id")
    ln = D.lines(spark, sf).select(F.col("l_orderkey").alias("paper_id"), "s_name")
    from papertrail.functions.text import normalise_name
    names = pr.join(ln, "paper_id").select(normalise_name("s_name").alias("n")).distinct()
    out = NM.edit_distance_pairs(names.withColumnRenamed("n", "a"), names.withColumnRenamed("n", "b"), k=1)
    return out.select("a", "b", F.col("dist").cast("int").alias("dist"))


@register("opt_04", sql_with(SQL_PROFILE) + """
, py AS (SELECT pr.author_id, pr.paper_id, year(o.o_orderdate) AS year FROM profile pr
  JOIN orders o ON o.o_orderkey = pr.paper_id)
, c AS (SELECT author_id, year, count(*) AS publish_cnt FROM py GROUP BY author_id, year)
, s AS (SELECT author_id, max(year) AS ymax, min(year) AS ymin, avg(year) AS ymean FROM py GROUP BY author_id)
SELECT py.author_id, py.paper_id, c.publish_cnt, CAST(py.year - s.ymax AS BIGINT) AS year_max_diff,
  CAST(py.year - s.ymin AS BIGINT) AS year_min_diff, round(py.year - s.ymean, 6) AS year_mean_diff
FROM py JOIN c ON c.author_id = py.author_id AND c.year = py.year JOIN s ON s.author_id = py.author_id""")
def opt_04(spark, sf):
    """Papers per (author, year) and year minus the author's max/min/mean."""
    pr = D.profiles(spark, sf).select("author_id", "paper_id")
    o = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"),
                                            F.year("o_orderdate").alias("year"))
    py = pr.join(o, "paper_id")
    c = py.groupBy("author_id", "year").agg(F.count(F.lit(1)).alias("publish_cnt"))
    s = py.groupBy("author_id").agg(F.max("year").alias("ymax"), F.min("year").alias("ymin"),
                                    F.avg("year").alias("ymean"))
    j = py.join(c, ["author_id", "year"]).join(s, "author_id")
    return j.select("author_id", "paper_id", "publish_cnt",
                    (F.col("year") - F.col("ymax")).cast("long").alias("year_max_diff"),
                    (F.col("year") - F.col("ymin")).cast("long").alias("year_min_diff"),
                    r6(F.col("year") - F.col("ymean")).alias("year_mean_diff"))


@register("opt_05", sql_with(SQL_LINES, SQL_PAPER) + """
, c AS (SELECT paper_id, array_to_string(names, '') AS s FROM paper)
SELECT paper_id, round(CASE WHEN length(s) = 0 THEN 0.0
  ELSE len(list_distinct(string_split(s, ''))) / length(s) END, 6) AS char_ratio FROM c""")
def opt_05(spark, sf):
    """Distinct-character ratio of each paper's co-author names."""
    p = D.papers(spark, sf)
    return p.select("paper_id", r6(NM.char_ratio(F.transform("authors", lambda a: a["name"]))).alias("char_ratio"))


ACCENTED = "à-ÿ"


@F.pandas_udf(T.StringType())
def _strip_marks(s: pd.Series) -> pd.Series:
    return s.map(lambda c: "".join(ch for ch in unicodedata.normalize("NFD", c)
                                   if not unicodedata.combining(ch)))


@register("txt_16", f"""
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[{ACCENTED}]|[^{ACCENTED}]+'),
  lambda x: CASE WHEN regexp_full_match(x, '[{ACCENTED}]') THEN strip_accents(x) ELSE x END), ' ') AS translit
FROM documents""")
def txt_16(spark, sf):
    """Dictionary transliteration of whole document texts: the reading table
    (character -> reading) is built from the characters the corpus uses; each
    such character becomes its reading, other runs stay whole."""
    docs = D.table(spark, sf, "documents").select("doc_id", "text")
    chars = (docs.select(F.explode(F.regexp_extract_all("text", F.lit(f"[{ACCENTED}]"), 0)).alias("ch"))
             .distinct())
    reading = chars.select("ch", _strip_marks("ch").alias("reading"))
    return NM.transliterate(docs, "text", reading, char_class=ACCENTED).select("doc_id", "translit")
