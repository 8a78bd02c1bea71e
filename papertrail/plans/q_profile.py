"""Profile, fuzzy-matching and top-k queries (SIM-01..06, AGG-01/02, TXT-11,
WIN-02/04, JON-01/02, PRJ, SET-02..04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrail.functions.similarity import jaro_arrow, jaro_winkler, jaro_winkler_arrow
from papertrail.functions.text import py_str
from papertrail.operators import features as FE
from papertrail.operators import profiles as P
from papertrail.plans import sqlfrag as S
from papertrail.plans.common import r6
from papertrail.plans.registry import register
from papertrail.session import materialize
from papertrail.sources import driver as D
from papertrail.sources.driver import SQL_LINES, SQL_PAPER, SQL_PLINES, SQL_PROFILE, sql_with

BASE = sql_with(SQL_PROFILE, SQL_LINES, SQL_PAPER, SQL_PLINES)

# Name pairs compared when matching co-authors to the profile name.
SQL_NAME_PAIRS = """
, npairs AS (SELECT DISTINCT lower(s_name) AS a, name AS b FROM plines)"""

# First co-author (line order) with the strictly highest JW score.
SQL_MATCHED = f"""
, scored AS (
  SELECT author_id, paper_id, seq, n_name,
         row_number() OVER (PARTITION BY author_id, seq
           ORDER BY {S.jaro_winkler('lower(s_name)', 'name')} DESC, l_linenumber, l_suppkey, l_partkey) AS rn
  FROM plines)
, matched AS (
  SELECT pr.author_id, pr.paper_id, pr.seq, s.n_name AS matched_org
  FROM profile pr LEFT JOIN scored s ON s.author_id = pr.author_id AND s.seq = pr.seq AND s.rn = 1)"""


def _pp(spark, sf):
    return D.profile_papers(spark, sf)


def _name_pairs(spark, sf):
    pr = D.profiles(spark, sf).select("paper_id", "name")
    ln = D.lines(spark, sf).select(F.col("l_orderkey").alias("paper_id"), "s_name")
    return pr.join(ln, "paper_id").select(F.lower("s_name").alias("a"), F.col("name").alias("b")).distinct()


@register("sim_01", BASE + SQL_NAME_PAIRS + f"""
SELECT a, b, round({S.jaro('a', 'b')}, 6) AS jaro FROM npairs""")
def sim_01(spark, sf):
    """Jaro similarity over the distinct (co-author name, profile name) pairs."""
    return _name_pairs(spark, sf).select("a", "b", r6(jaro_arrow("a", "b")).alias("jaro"))


@register("sim_02", BASE + SQL_NAME_PAIRS + f"""
SELECT a, b, round({S.jaro_winkler('a', 'b')}, 6) AS jaro_winkler FROM npairs""")
def sim_02(spark, sf):
    return _name_pairs(spark, sf).select("a", "b", r6(jaro_winkler_arrow("a", "b")).alias("jaro_winkler"))


@register("sim_03", BASE + SQL_MATCHED + """
SELECT author_id, paper_id, matched_org FROM matched""")
def sim_03(spark, sf):
    """Org of the best-matching co-author per profile paper (first maximum)."""
    return P.with_matched_org(_pp(spark, sf)).select("author_id", "paper_id", "matched_org")


@register("win_04", BASE + SQL_MATCHED + """
SELECT author_id, paper_id, matched_org FROM matched""")
def win_04(spark, sf):
    """Same answer as SIM-03 through explode + max_by(org, (score, -position))."""
    pp = _pp(spark, sf)
    ex = pp.select("author_id", "seq", "paper_id", "name",
                   F.posexplode("authors").alias("pos", "a"))
    sc = ex.withColumn("s", jaro_winkler_arrow(F.lower("a.name"), F.col("name")))
    best = sc.groupBy("author_id", "seq").agg(
        F.max_by(F.coalesce(F.col("a.org"), F.lit("")), F.struct("s", (-F.col("pos")).alias("np")))
        .alias("matched_org"))
    return (pp.select("author_id", "seq", "paper_id").join(best, ["author_id", "seq"], "left")
            .select("author_id", "paper_id", "matched_org"))


def _topk_sql(value_expr: str, src: str, keep_null: bool = True) -> str:
    where = "" if keep_null else f"WHERE {value_expr} IS NOT NULL"
    return f"""
, cnts AS (SELECT author_id, {value_expr} AS value, count(*) AS cnt, min(seq) AS first_seen
  FROM {src} {where} GROUP BY author_id, {value_expr})
, topk AS (SELECT author_id, CAST(row_number() OVER (PARTITION BY author_id ORDER BY cnt DESC, first_seen) AS INTEGER) AS rank,
  value, cnt FROM cnts QUALIFY rank <= 5)"""


SQL_PP = """
, pp AS (SELECT pr.*, pa.venue, pa.year, pa.keywords FROM profile pr JOIN paper pa ON pa.paper_id = pr.paper_id)"""


@register("agg_01", BASE + SQL_PP + _topk_sql("venue", "pp") + " SELECT * FROM topk")
def agg_01(spark, sf):
    """Top-5 venues per author (NULL is a value; ties -> first seen)."""
    return P.top_k_values(_pp(spark, sf), "venue")


@register("win_02", BASE + SQL_PP + _topk_sql("year", "pp") + " SELECT * FROM topk")
def win_02(spark, sf):
    """Top-5 years per author, rank-and-cut."""
    return P.top_k_values(_pp(spark, sf), "year")


@register("agg_01_org", BASE + SQL_MATCHED + _topk_sql("matched_org", "matched", keep_null=False)
          + " SELECT * FROM topk")
def agg_01_org(spark, sf):
    """Top-5 matched organisations per author."""
    return P.top_k_values(P.with_matched_org(_pp(spark, sf)), "matched_org", keep_null=False)


@register("agg_02", BASE + SQL_PP + """
SELECT DISTINCT author_id, unnest(keywords) AS value FROM pp""")
def agg_02(spark, sf):
    """Distinct keywords per author, as rows."""
    return P.distinct_elements(_pp(spark, sf), "keywords")


@register("set_04", BASE + SQL_PP + """
SELECT DISTINCT author_id, unnest(keywords) AS value FROM pp""")
def set_04(spark, sf):
    return _pp(spark, sf).select("author_id", F.explode("keywords").alias("value")).distinct()


def _sim_sql(row_val: str, guard: str, top_val: str, prefix: str, src: str, topsrc: str) -> str:
    jw = S.jaro_winkler("r.v", "t.tv")
    return f"""
, simr AS (SELECT r.author_id, r.paper_id, r.seq,
   max(CASE WHEN r.ok THEN {jw} END) AS mx, min(CASE WHEN r.ok THEN {jw} END) AS mn,
   avg(CASE WHEN r.ok THEN {jw} END) AS av
  FROM (SELECT author_id, paper_id, seq, {row_val} AS v, {guard} AS ok FROM {src}) r
  LEFT JOIN (SELECT author_id, {top_val} AS tv FROM {topsrc}) t ON t.author_id = r.author_id
  GROUP BY r.author_id, r.paper_id, r.seq)
SELECT author_id, paper_id, round(coalesce(mx, 0), 6) AS max_jaro_{prefix},
 round(coalesce(mn, 0), 6) AS min_jaro_{prefix}, round(coalesce(av, 0), 6) AS mean_jaro_{prefix},
 round(coalesce(mx, 0) - coalesce(mn, 0), 6) AS max_min_jaro_{prefix} FROM simr"""


def _sim_out(pp, sim, prefix):
    cols = [f"{s}_jaro_{prefix}" for s in ("max", "min", "mean", "max_min")]
    return (pp.select("author_id", "seq", "paper_id").join(sim, ["author_id", "seq"])
            .select("author_id", "paper_id", *[r6(F.col(c)).alias(c) for c in cols]))


@register("sim_04", BASE + SQL_PP + _topk_sql("venue", "pp")
          + _sim_sql("venue", "coalesce(length(venue), 0) > 0", "value", "venue", "pp", "topk"))
def sim_04(spark, sf):
    """JW of each paper's venue against its author's top-5 venues."""
    pp = _pp(spark, sf)
    top = P.top_k_values(pp, "venue")
    sim = P.profile_similarity(pp, top, F.col("venue"), "venue",
                               guard=F.coalesce(F.length("venue"), F.lit(0)) > 0)
    return _sim_out(pp, sim, "venue")


@register("sim_05", BASE + SQL_PP + _topk_sql("year", "pp")
          + _sim_sql("year", "coalesce(length(year), 0) > 0", "coalesce(value, 'None')", "year", "pp", "topk"))
def sim_05(spark, sf):
    """JW of each paper's year (as text) against its author's top-5 years."""
    pp = _pp(spark, sf)
    top = P.top_k_values(pp, "year")
    sim = P.profile_similarity(pp, top, F.col("year"), "year", top_as_str=True,
                               guard=F.coalesce(F.length("year"), F.lit(0)) > 0)
    return _sim_out(pp, sim, "year")


@register("sim_06", BASE + SQL_MATCHED + _topk_sql("matched_org", "matched", keep_null=False)
          + _sim_sql("matched_org", "true", "value", "org", "matched", "topk"))
def sim_06(spark, sf):
    """JW of each paper's matched org against its author's top-5 matched orgs."""
    pp = materialize(P.with_matched_org(_pp(spark, sf)).select("author_id", "seq", "paper_id", "matched_org"), "matched")
    top = P.top_k_values(pp, "matched_org", keep_null=False)
    sim = P.profile_similarity(pp, top, F.col("matched_org"), "org")
    return _sim_out(pp, sim, "org")


@register("jon_02", BASE + SQL_PP + _topk_sql("venue", "pp") + """
SELECT pp.author_id, pp.paper_id, t.rank, t.value AS top_venue
FROM pp JOIN topk t ON t.author_id = pp.author_id""")
def jon_02(spark, sf):
    """Each profile paper joined with its author's top-5 venue list (by author id)."""
    pp = _pp(spark, sf)
    top = P.top_k_values(pp, "venue")
    return (pp.select("author_id", "paper_id").join(top, "author_id")
            .select("author_id", "paper_id", "rank", F.col("value").alias("top_venue")))


@register("txt_11", BASE + SQL_MATCHED + f"""
, t AS (SELECT m.author_id, m.paper_id, m.matched_org AS mo, pa.orgs FROM matched m JOIN paper pa ON pa.paper_id = m.paper_id)
, c AS (SELECT author_id, paper_id, mo, CAST(len(orgs) AS BIGINT) AS n,
   CAST(len(list_filter(orgs, lambda o: o = mo)) AS BIGINT) AS co FROM t)
SELECT author_id, paper_id, co AS co_org_cnt, n - co AS not_co_org_cnt, n - co AS org_dif_cnt,
 round({S.ratio0('co', 'n')}, 6) AS co_org_ratio, round({S.ratio0('n - co', 'n')}, 6) AS not_co_org_ratio,
 {S.char_len('mo')} AS author_org_len, {S.space_tokens('mo')} AS author_org_cnt,
 CAST(CASE WHEN coalesce(length(mo), 0) > 0 THEN 0 ELSE 1 END AS BIGINT) AS org_is_null FROM c""")
def txt_11(spark, sf):
    """Same-org / other-org co-author counts against the matched org (Q1 fixed)."""
    d = FE.author_features(P.with_matched_org(_pp(spark, sf)))
    return d.select("author_id", "paper_id", "co_org_cnt", "not_co_org_cnt", "org_dif_cnt",
                    r6(F.col("co_org_ratio")).alias("co_org_ratio"),
                    r6(F.col("not_co_org_ratio")).alias("not_co_org_ratio"),
                    "author_org_len", "author_org_cnt", "org_is_null")


@register("jon_01", BASE + """
SELECT pr.author_id, pr.paper_id, pr.label, pa.venue, pa.year, len(pa.keywords) AS n_keywords
FROM profile pr JOIN paper pa ON pa.paper_id = pr.paper_id""")
def jon_01(spark, sf):
    """Profile x paper equi-join."""
    return _pp(spark, sf).select("author_id", "paper_id", "label", "venue", "year",
                                 F.size("keywords").alias("n_keywords"))


@register("jon_01_missing", BASE + """
SELECT pr.author_id, pr.paper_id FROM profile pr
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = pr.paper_id)""")
def jon_01_missing(spark, sf):
    """Data-quality check: profile rows whose paper has no content record (its lines), by left anti-join."""
    content = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"))
    return D.profiles(spark, sf).join(content, "paper_id", "left_anti").select("author_id", "paper_id")


@register("agg_05", sql_with(SQL_PROFILE) + """
SELECT author_id, count(*) AS n_papers FROM profile GROUP BY author_id""")
def agg_05(spark, sf):
    """Profile size."""
    return D.profiles(spark, sf).groupBy("author_id").agg(F.count(F.lit(1)).alias("n_papers"))


@register("win_03", sql_with(SQL_PROFILE) + """
SELECT author_id, paper_id, label, seq FROM profile""")
def win_03(spark, sf):
    """Stable row order inside a profile: the carried position (no global row numbers)."""
    return D.profiles(spark, sf).select("author_id", "paper_id", "label", "seq")


@register("prj_03", BASE + SQL_PP + """
SELECT author_id, paper_id, venue, year FROM pp""")
def prj_03(spark, sf):
    """Keep / drop columns (model columns of the unlabelled table minus the author id)."""
    return _pp(spark, sf).drop("name", "label", "seq", "title", "abstract", "keywords",
                               "authors").select("author_id", "paper_id", "venue", "year")


@register("set_02", sql_with(SQL_PROFILE) + """
SELECT author_id, paper_id, label FROM profile WHERE label = 1
UNION ALL SELECT author_id, paper_id, label FROM profile WHERE label = 0""")
def set_02(spark, sf):
    """Bag union of positives and outliers (duplicates kept)."""
    pr = D.profiles(spark, sf).select("author_id", "paper_id", "label")
    return pr.filter("label = 1").unionByName(pr.filter("label = 0"))


@register("sim_jw_year_pairs", BASE + SQL_PP + _topk_sql("year", "pp") + f"""
SELECT DISTINCT pp.year AS a, coalesce(t.value, 'None') AS b, round({S.jaro_winkler('pp.year', "coalesce(t.value, 'None')")}, 6) AS jw
FROM pp JOIN topk t ON t.author_id = pp.author_id""")
def sim_jw_year_pairs(spark, sf):
    """Distinct (year, top year) pairs with their JW score: the distinct-pair table
    the profile similarity reuses."""
    pp = _pp(spark, sf)
    top = P.top_k_values(pp, "year").select("author_id", py_str(F.col("value")).alias("b"))
    pairs = pp.select("author_id", F.col("year").alias("a")).join(top, "author_id").select("a", "b").distinct()
    return pairs.select("a", "b", r6(jaro_winkler("a", "b")).alias("jw"))


@register("set_03", sql_with(SQL_PROFILE) + """
SELECT author_id, paper_id, 'train' AS part FROM profile WHERE paper_id IN
  (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT author_id, paper_id, 'test' FROM profile WHERE paper_id IN
  (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def set_03(spark, sf):
    """Corpus union of the labelled part (finished/open orders) and the
    unlabelled part (pending orders): one document per (author, paper)."""
    pr = D.profiles(spark, sf).select("author_id", "paper_id")
    st = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), "o_orderstatus")
    j = pr.join(st, "paper_id")
    train = j.filter(F.col("o_orderstatus") != "P").select("author_id", "paper_id", F.lit("train").alias("part"))
    test = j.filter(F.col("o_orderstatus") == "P").select("author_id", "paper_id", F.lit("test").alias("part"))
    return train.unionByName(test)
