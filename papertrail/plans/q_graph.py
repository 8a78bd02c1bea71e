"""Graph-construction queries (GRF, JON-03..05, FLT-01/02, SET-05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrail.operators import graph as G
from papertrail.plans.common import graph_pp
from papertrail.plans.registry import register
from papertrail.sources.driver import (SQL_LINES, SQL_PAPER, SQL_PLINES, SQL_PROFILE,
                                       sql_with, profiles)

# Thresholds scaled to the driver data (profiles hold 1-40 papers).
SUBSET_ABOVE = 15
MAX_PAPERS = 20

_NAME_SQL = "lower(regexp_replace(s_name, '[^\\w\\s]', '', 'g'))"

SQL_NAMES = f"""names AS (
  SELECT DISTINCT author_id, paper_id, seq, {_NAME_SQL} AS elem FROM plines)"""
SQL_ORGS = """orgs AS (
  SELECT DISTINCT author_id, paper_id, seq, lower(n_name) AS elem FROM plines)"""
SQL_KWS = """kws AS (
  SELECT DISTINCT author_id, paper_id, seq, p_name AS elem FROM plines)"""
SQL_PP = """pp AS (
  SELECT pr.author_id, pr.paper_id, pr.seq, pa.venue
  FROM profile pr JOIN paper pa ON pa.paper_id = pr.paper_id)"""


def _pairs_sql(src: str, min_shared: int, offset: int) -> str:
    return f"""SELECT a.author_id, a.paper_id AS src, b.paper_id AS dst,
       CAST(count(*) - {offset} AS BIGINT) AS weight
FROM {src} a JOIN {src} b ON a.author_id = b.author_id AND a.elem = b.elem AND a.seq <> b.seq
GROUP BY a.author_id, a.seq, a.paper_id, b.seq, b.paper_id HAVING count(*) >= {min_shared}"""


def _edges(df):
    return df.select("author_id", "src", "dst", "weight")


@register("jon_03", sql_with(SQL_PROFILE, SQL_LINES, SQL_PLINES, SQL_ORGS) + """
SELECT a.author_id, a.paper_id AS src, b.paper_id AS dst, count(*) AS shared
FROM orgs a JOIN orgs b ON a.author_id = b.author_id AND a.elem = b.elem AND a.seq <> b.seq
GROUP BY a.author_id, a.seq, a.paper_id, b.seq, b.paper_id""")
def jon_03(spark, sf_dir):
    """Shared-element counts of every pair of papers in one profile (orgs)."""
    return G.shared_counts(graph_input_table(spark, sf_dir), F.col("orgs")).select("author_id", "src", "dst", "shared")


@register("grf_01", sql_with(SQL_PROFILE, SQL_LINES, SQL_PLINES, SQL_NAMES) + _pairs_sql("names", 2, 1))
def grf_01(spark, sf_dir):
    """Pairs of papers in one profile sharing >= 2 normalised co-author names."""
    return _edges(G.coauthor_edges(graph_input_table(spark, sf_dir)))


@register("grf_03", sql_with(SQL_PROFILE, SQL_LINES, SQL_PLINES, SQL_ORGS) + _pairs_sql("orgs", 2, 1))
def grf_03(spark, sf_dir):
    return _edges(G.org_edges(graph_input_table(spark, sf_dir)))


@register("grf_05", sql_with(SQL_PROFILE, SQL_LINES, SQL_PLINES, SQL_KWS) + _pairs_sql("kws", 1, 0))
def grf_05(spark, sf_dir):
    return _edges(G.keyword_edges(graph_input_table(spark, sf_dir)))


_VENUE_SQL = sql_with(SQL_PROFILE, SQL_LINES, SQL_PAPER, SQL_PP) + """
SELECT a.author_id, a.paper_id AS src, b.paper_id AS dst, CAST(1 AS BIGINT) AS weight
FROM pp a JOIN pp b ON a.author_id = b.author_id AND a.venue IS NOT DISTINCT FROM b.venue
 AND a.seq <> b.seq"""


@register("grf_04", _VENUE_SQL)
def grf_04(spark, sf_dir):
    return _edges(G.venue_edges(graph_input_table(spark, sf_dir)))


@register("jon_04", _VENUE_SQL)
def jon_04(spark, sf_dir):
    """Within-author self-join on null-safe venue equality."""
    pp = graph_pp(spark, sf_dir).select("author_id", "seq", "paper_id", "venue")
    l, r = pp.alias("l"), pp.alias("r")
    return (l.join(r, (F.col("l.author_id") == F.col("r.author_id"))
                   & F.col("l.venue").eqNullSafe(F.col("r.venue"))
                   & (F.col("l.seq") != F.col("r.seq")))
            .select(F.col("l.author_id").alias("author_id"), F.col("l.paper_id").alias("src"),
                    F.col("r.paper_id").alias("dst"), F.lit(1).cast("long").alias("weight")))


@register("grf_04_cliques", sql_with(SQL_PROFILE, SQL_LINES, SQL_PAPER, SQL_PP) + """
SELECT author_id, paper_id, venue IS NULL AS venue_is_null, coalesce(venue, '') AS venue_value,
       count(*) OVER (PARTITION BY author_id, venue IS NULL, coalesce(venue, '')) AS clique_size
FROM pp""")
def grf_04_cliques(spark, sf_dir):
    """Venue edges in factorised (clique-membership) form."""
    c = G.venue_cliques(graph_pp(spark, sf_dir))
    return c.select("author_id", "paper_id", F.col("clique.is_null").alias("venue_is_null"),
                    F.col("clique.v").alias("venue_value"), "clique_size")


_SUBSET_SQL = sql_with(SQL_PROFILE, SQL_LINES, SQL_PLINES) + f"""
, nm AS (SELECT author_id, paper_id, seq, list_distinct(string_split({_NAME_SQL}, ' ')) AS toks FROM plines)
SELECT a.author_id, a.paper_id AS src, b.paper_id AS dst, CAST(count(*) - 1 AS BIGINT) AS weight
FROM nm a JOIN nm b ON a.author_id = b.author_id AND a.seq <> b.seq
 AND len(list_filter(a.toks, lambda t: NOT list_contains(b.toks, t))) = 0
GROUP BY a.author_id, a.seq, a.paper_id, b.seq, b.paper_id HAVING count(*) >= 2"""


@register("grf_02", _SUBSET_SQL)
def grf_02(spark, sf_dir):
    """Token-subset co-author edges of all profiles."""
    return _edges(G.subset_coauthor_edges(graph_input_table(spark, sf_dir)))


_SUBSET_COUNT_SQL = sql_with(SQL_PROFILE, SQL_LINES, SQL_PLINES) + f"""
, nm AS (SELECT author_id, paper_id, seq, list_distinct(string_split({_NAME_SQL}, ' ')) AS toks FROM plines)
SELECT a.author_id, a.paper_id AS src, b.paper_id AS dst, count(*) AS shared
FROM nm a JOIN nm b ON a.author_id = b.author_id AND a.seq <> b.seq
 AND len(list_filter(a.toks, lambda t: NOT list_contains(b.toks, t))) = 0
GROUP BY a.author_id, a.seq, a.paper_id, b.seq, b.paper_id"""


@register("jon_05", _SUBSET_COUNT_SQL)
def jon_05(spark, sf_dir):
    """Token-subset join of all profiles: name pairs of two papers in which the first's tokens are among the second's."""
    return G.subset_pair_counts(graph_input_table(spark, sf_dir)).select("author_id", "src", "dst", "shared")


_MERGE_SQL = sql_with(SQL_PROFILE, SQL_LINES, SQL_PLINES, SQL_PAPER, SQL_PP, SQL_NAMES, SQL_ORGS,
                      SQL_KWS) + f"""
, typed AS (
  SELECT *, 1 AS p, 'coauthor' AS kind FROM ({_pairs_sql("names", 2, 1)})
  UNION ALL SELECT *, 2, 'org' FROM ({_pairs_sql("orgs", 2, 1)})
  UNION ALL SELECT a.author_id, a.paper_id, b.paper_id, CAST(1 AS BIGINT), 3, 'venue'
    FROM pp a JOIN pp b ON a.author_id = b.author_id AND a.venue IS NOT DISTINCT FROM b.venue AND a.seq <> b.seq
  UNION ALL SELECT *, 4, 'keyword' FROM ({_pairs_sql("kws", 1, 0)}))
SELECT author_id, src, dst, arg_max(weight, p) AS weight, arg_max(kind, p) AS kind
FROM typed GROUP BY author_id, src, dst"""


_SIZED_MERGE_SQL = sql_with(SQL_PROFILE, SQL_LINES, SQL_PLINES, SQL_PAPER, SQL_PP, SQL_NAMES, SQL_ORGS,
                      SQL_KWS) + f"""
, sized AS (SELECT author_id, count(*) AS n FROM profile GROUP BY author_id)
, nm AS (
  SELECT p.author_id, p.paper_id, p.seq, list_distinct(string_split({_NAME_SQL}, ' ')) AS toks
  FROM plines p JOIN sized s ON s.author_id = p.author_id WHERE s.n > {SUBSET_ABOVE})

, names_small AS (
  SELECT n.* FROM names n JOIN sized s ON s.author_id = n.author_id WHERE s.n <= {SUBSET_ABOVE})
, co_small AS ({_pairs_sql("names_small", 2, 1)})
, co_large AS (
  SELECT a.author_id, a.paper_id AS src, b.paper_id AS dst, CAST(count(*) - 1 AS BIGINT) AS weight
  FROM nm a JOIN nm b ON a.author_id = b.author_id AND a.seq <> b.seq
   AND len(list_filter(a.toks, lambda t: NOT list_contains(b.toks, t))) = 0
  GROUP BY a.author_id, a.seq, a.paper_id, b.seq, b.paper_id HAVING count(*) >= 2)
, typed AS (
  SELECT *, 1 AS p, 'coauthor' AS kind FROM co_small
  UNION ALL SELECT *, 1, 'coauthor' FROM co_large
  UNION ALL SELECT *, 2, 'org' FROM ({_pairs_sql("orgs", 2, 1)})
  UNION ALL SELECT a.author_id, a.paper_id, b.paper_id, CAST(1 AS BIGINT), 3, 'venue'
    FROM pp a JOIN pp b ON a.author_id = b.author_id AND a.venue IS NOT DISTINCT FROM b.venue AND a.seq <> b.seq
  UNION ALL SELECT *, 4, 'keyword' FROM ({_pairs_sql("kws", 1, 0)}))
SELECT author_id, src, dst, arg_max(weight, p) AS weight, arg_max(kind, p) AS kind
FROM typed GROUP BY author_id, src, dst"""


def graph_input_table(spark, sf_dir):
    """The graph input (one row per profile paper with its element arrays),
    written once to the shared folder: every edge kind reads it."""
    from papertrail.session import materialize
    return materialize(graph_pp(spark, sf_dir).select(
        "author_id", "seq", "paper_id", "label", "names", "orgs", "keywords", "venue"), "graph_input")


@register("grf_06", _SIZED_MERGE_SQL)
def grf_06(spark, sf_dir):
    """All edge kinds merged; the highest-priority kind sets the weight.  Profiles above the size switch match names by
    token subset."""
    return G.merge_edges(G.typed_edges(graph_input_table(spark, sf_dir), subset_above=SUBSET_ABOVE))


@register("set_05", _SIZED_MERGE_SQL)
def set_05(spark, sf_dir):
    """Union of the four edge sets, a later one overwriting the weight of an edge that an earlier one holds."""
    pp = graph_input_table(spark, sf_dir)
    sets = (G.split_coauthor_edges(pp, subset_above=SUBSET_ABOVE), G.org_edges(pp), G.venue_edges(pp), G.keyword_edges(pp))
    union = sets[0]
    for edges in sets[1:]:
        union = union.unionByName(edges)
    return G.merge_edges(union)


@register("grf_08", sql_with(SQL_PROFILE, SQL_LINES, SQL_PLINES, SQL_NAMES) + f"""
SELECT author_id, src, dst, weight FROM ({_pairs_sql("names", 2, 1)})
UNION ALL SELECT DISTINCT author_id, paper_id, paper_id, CAST(1 AS BIGINT) FROM profile""")
def grf_08(spark, sf_dir):
    pp = graph_input_table(spark, sf_dir)
    nd = G.nodes(pp, [])
    return G.add_self_loops(G.coauthor_edges(pp), nd).select("author_id", "src", "dst", "weight")


@register("flt_01", sql_with(SQL_PROFILE) + f"""
SELECT author_id, paper_id, label FROM profile
WHERE author_id IN (SELECT author_id FROM profile GROUP BY author_id HAVING count(*) <= {MAX_PAPERS})""")
def flt_01(spark, sf_dir):
    return G.drop_large_profiles(profiles(spark, sf_dir), MAX_PAPERS).select(
        "author_id", "paper_id", "label")


@register("flt_02", sql_with(SQL_PROFILE, SQL_LINES, SQL_PLINES, SQL_NAMES) + f"""
SELECT author_id, paper_id, arg_max(label, seq) AS y FROM profile
WHERE author_id IN (SELECT author_id FROM ({_pairs_sql("names", 2, 1)}))
GROUP BY author_id, paper_id""")
def flt_02(spark, sf_dir):
    pp = graph_input_table(spark, sf_dir)
    return G.drop_edgeless(G.nodes(pp, []), G.coauthor_edges(pp)).select("author_id", "paper_id", "y")
