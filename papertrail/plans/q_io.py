"""Source/sink round trips on data written from the driver tables
(SRC-01..08, SNK-01..05, PRJ-01/02/05, FLT-04, JON-07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrail.operators import graph as G
from papertrail.plans.common import graph_pp, r6
from papertrail.plans.registry import register
from papertrail.session import materialize, scratch_path
from papertrail.sources import driver as D
from papertrail.sources import io as IO
from papertrail.sources.driver import SQL_LINES, SQL_PAPER, SQL_PLINES, SQL_PROFILE, sql_with

PROFILE_SQL = sql_with(SQL_PROFILE)


def _profiles_back(spark, sf, labelled=True):
    path = scratch_path(spark, "profiles")
    IO.write_profiles(D.profiles(spark, sf), path, labelled=labelled)
    return IO.read_profiles_lines(spark, path, labelled=labelled)


#: Profile rows with their part and order: papers are parted by rank.
PARTS_SQL = PROFILE_SQL + f""", ranked AS (SELECT *, (row_number() OVER (PARTITION BY author_id ORDER BY seq) - 1)
  // {IO.CHUNK} AS part FROM profile)"""


@register("src_01", PARTS_SQL + """
SELECT CAST(author_id AS VARCHAR) AS author_id, name, CAST(part AS BIGINT) AS part,
  CAST(sum(label) AS BIGINT) AS n_normal, CAST(sum(1 - label) AS BIGINT) AS n_outliers
FROM ranked GROUP BY author_id, name, part""")
def src_01(spark, sf):
    """Labelled profiles written as JSON lines and read back with a declared schema."""
    p = _profiles_back(spark, sf)
    return p.select("author_id", "name", "part", F.size("normal_data").cast("long").alias("n_normal"),
                    F.size("outliers").cast("long").alias("n_outliers"))


@register("prj_01", PARTS_SQL + f"""
SELECT CAST(author_id AS VARCHAR) AS author_id, CAST(paper_id AS VARCHAR) AS paper_id, label,
  CAST((1 - label)::BIGINT * {1 << 62} + part * {1 << 20}
       + row_number() OVER (PARTITION BY author_id, part, label ORDER BY seq) - 1 AS BIGINT) AS seq
FROM ranked""")
def prj_01(spark, sf):
    """Labelled flatten (positives, then outliers) of the re-read profiles; the
    carried ``seq`` orders rows as the lists do (no window needed)."""
    f = IO.flatten_labelled(_profiles_back(spark, sf))
    return f.select("author_id", "paper_id", "label", "seq")


@register("src_02", PROFILE_SQL + """
SELECT CAST(author_id AS VARCHAR) AS author_id, CAST(paper_id AS VARCHAR) AS paper_id FROM profile""")
def src_02(spark, sf):
    """Unlabelled profiles (a papers list) round trip, flattened (PRJ-02)."""
    return IO.flatten_unlabelled(_profiles_back(spark, sf, labelled=False)).select("author_id", "paper_id")


@register("prj_02", PARTS_SQL + f"""
SELECT CAST(author_id AS VARCHAR) AS author_id, name, CAST(paper_id AS VARCHAR) AS paper_id, CAST(part * {1 << 20}
  + row_number() OVER (PARTITION BY author_id, part ORDER BY seq) - 1 AS BIGINT) AS seq FROM ranked""")
def prj_02(spark, sf):
    """Unlabelled flatten of the re-read profiles with the order that the lists have."""
    return IO.flatten_unlabelled(_profiles_back(spark, sf, labelled=False)).select("author_id", "name", "paper_id", "seq")


@register("src_03", sql_with(SQL_LINES, SQL_PAPER) + """
SELECT CAST(paper_id AS VARCHAR) AS id, venue, year, CAST(len(names) AS INTEGER) AS n_authors,
  CAST(len(keywords) AS INTEGER) AS n_keywords, title FROM paper""")
def src_03(spark, sf):
    """Nested paper table written as JSON lines and read back (year as text)."""
    path = scratch_path(spark, "papers")
    IO.write_papers(D.papers(spark, sf), path)
    p = IO.read_papers_lines(spark, path)
    return p.select("id", "venue", "year", F.size("authors").alias("n_authors"),
                    F.size("keywords").alias("n_keywords"), "title")


_VEC_SQL = sql_with(SQL_PROFILE) + """
, v AS (SELECT DISTINCT pr.paper_id, o.o_totalprice / 100000.0 AS a, (year(o.o_orderdate) - 1995) / 5.0 AS b
  FROM profile pr JOIN orders o ON o.o_orderkey = pr.paper_id)
SELECT paper_id, 0 AS dim, round(a, 6) AS value FROM v UNION ALL SELECT paper_id, 1, round(b, 6) FROM v"""


def _paper_vec(spark, sf):
    o = D.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("paper_id"),
                    F.array(F.col("o_totalprice") / 100000.0, (F.year("o_orderdate") - 1995) / 5.0).alias("vec"))


def _long(df, key="paper_id", vec="vec"):
    return df.select(key, F.posexplode(vec).alias("dim", "value")).select(
        key, F.col("dim").cast("int").alias("dim"), r6(F.col("value")).alias("value"))


@register("src_04", _VEC_SQL)
def src_04(spark, sf):
    """Paper vectors written as parquet (SNK-02) and read back."""
    path = scratch_path(spark, "paper_vec")
    IO.write_paper_vectors(_paper_vec(spark, sf), path)
    return _long(IO.read_paper_vectors(spark, path))


@register("snk_02", _VEC_SQL)
def snk_02(spark, sf):
    """The paper table as written: the components that the files hold for every paper of a profile."""
    path = scratch_path(spark, "paper_vec")
    papers = _paper_vec(spark, sf).join(D.profiles(spark, sf).select("paper_id"), "paper_id", "left_semi").distinct()
    IO.write_paper_vectors(papers, path)
    return _long(spark.read.parquet(path))


_SCORE_SQL = sql_with(SQL_PROFILE) + """
SELECT CAST(pr.author_id AS VARCHAR) AS author_id, CAST(pr.paper_id AS VARCHAR) AS paper_id,
  round(o.o_totalprice / 600000.0, 6) AS score FROM profile pr JOIN orders o ON o.o_orderkey = pr.paper_id"""


def _write_scores(spark, sf):
    s = D.profiles(spark, sf).join(D.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("paper_id"), (F.col("o_totalprice") / 600000.0).alias("score")), "paper_id")
    path = scratch_path(spark, "scores")
    IO.write_scores(s.select("author_id", "paper_id", "score", "seq"), path, order_col="seq")
    return path


@register("src_05", _SCORE_SQL)
def src_05(spark, sf):
    """Score maps {author: {paper: p}} written (SNK-01) and read back."""
    r = IO.read_scores(spark, _write_scores(spark, sf))
    return r.select("author_id", "paper_id", r6(F.col("score")).alias("score"))


@register("snk_01", _SCORE_SQL.replace("SELECT CAST(pr.author_id", "SELECT author_id, CAST((rk - 1) // 4096 AS INTEGER) AS part, "
          "count(*) AS papers, round(sum(score), 6) AS total FROM (SELECT row_number() OVER (PARTITION BY pr.author_id "
          "ORDER BY pr.paper_id) AS rk, CAST(pr.author_id").replace("round(o.o_totalprice / 600000.0, 6)", "o.o_totalprice / 600000.0")
          + ") GROUP BY author_id, part")
def snk_01(spark, sf):
    """The records as written: one for each author and part, with the papers of its map and the sum of their scores."""
    records = spark.read.schema("author_id string, part int, scores map<string,double>").json(_write_scores(spark, sf))
    total = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda s, v: s + v)
    return records.select("author_id", "part", F.size("scores").cast("long").alias("papers"), r6(total).alias("total"))


_CSV_SQL = sql_with(SQL_PROFILE) + """
SELECT pr.author_id, pr.paper_id, pr.seq, round(o.o_totalprice / 100000.0, 6) AS w2v_0,
  round((year(o.o_orderdate) - 1995) / 5.0, 6) AS w2v_1 FROM profile pr JOIN orders o ON o.o_orderkey = pr.paper_id"""


def _csv_written(spark, sf):
    v = D.profiles(spark, sf).join(_paper_vec(spark, sf), "paper_id")
    path = scratch_path(spark, "vec_csv")
    IO.write_vectors_csv(v, path, ["author_id", "paper_id", "seq"], "vec", 2)
    return path


def _csv_read(spark, path):
    r = IO.read_vectors_csv(spark, path, "author_id long, paper_id long, seq long", 2)
    return r.select("author_id", "paper_id", "seq", r6(F.col("w2v_0")).alias("w2v_0"),
                    r6(F.col("w2v_1")).alias("w2v_1"))


@register("src_06", _CSV_SQL)
def src_06(spark, sf):
    """Dense vectors as keyed CSV (SNK-03) read back with a declared schema."""
    return _csv_read(spark, _csv_written(spark, sf))


@register("snk_03", _CSV_SQL)
def snk_03(spark, sf):
    """The lines as written: key and components of each, named by the header of its file."""
    lines = spark.read.text(_csv_written(spark, sf)).select("value", F.input_file_name().alias("file"))
    head = lines.filter(F.col("value").startswith("author_id")).select("file", F.split("value", ",").alias("header"))
    named = F.map_from_arrays("header", F.split("value", ","))
    rows = (lines.filter(~F.col("value").startswith("author_id")).join(F.broadcast(head), "file")  # a row for each file
            .select(named.alias("f")))
    return rows.select(*[F.expr(f"try_cast(f['{c}'] AS LONG)").alias(c) for c in ("author_id", "paper_id", "seq")],
                       *[r6(F.expr(f"try_cast(f['{c}'] AS DOUBLE)")).alias(c) for c in ("w2v_0", "w2v_1")])


_NAME_SQL = "lower(regexp_replace(s_name, '[^\\w\\s]', '', 'g'))"
_EDGE_SQL = sql_with(SQL_PROFILE, SQL_LINES, SQL_PLINES) + f"""
, names AS (SELECT DISTINCT author_id, paper_id, seq, {_NAME_SQL} AS elem FROM plines)
SELECT a.author_id, a.paper_id AS src, b.paper_id AS dst, CAST(count(*) - 1 AS BIGINT) AS weight
FROM names a JOIN names b ON a.author_id = b.author_id AND a.elem = b.elem AND a.seq <> b.seq
GROUP BY a.author_id, a.seq, a.paper_id, b.seq, b.paper_id HAVING count(*) >= 2"""


def _graph_tables(spark, sf):
    """Nodes and edges of a graph input that is worked out once for both."""
    pp = materialize(graph_pp(spark, sf), "graph_input")
    return G.nodes(pp, []), G.coauthor_edges(pp).select("author_id", "src", "dst", "weight")


@register("snk_04", _EDGE_SQL)
def snk_04(spark, sf):
    """Node/edge tables written partitioned by author bucket, then read (SRC-08)."""
    nodes, edges = _graph_tables(spark, sf)
    path = scratch_path(spark, "graph")
    IO.write_graph(nodes, edges, path)
    _, e = IO.read_graph(spark, path)
    return e.select("author_id", "src", "dst", "weight")


_READ_GRAPH_SQL = PROFILE_SQL + f"""
, e AS ({_EDGE_SQL}),
n AS (SELECT author_id, count(DISTINCT paper_id) AS n_nodes FROM profile GROUP BY author_id),
d AS (SELECT author_id, count(*) AS n_edges, sum(weight) AS total_weight FROM e GROUP BY author_id)
SELECT n.author_id, CAST(n_nodes AS BIGINT) AS n_nodes, CAST(coalesce(n_edges, 0) AS BIGINT) AS n_edges,
       CAST(coalesce(total_weight, 0) AS BIGINT) AS total_weight FROM n LEFT JOIN d ON d.author_id = n.author_id"""


@register("src_08", _READ_GRAPH_SQL)
def src_08(spark, sf):
    """Saved graphs read back: nodes, edges and total edge weight of every author."""
    nodes, edges = _graph_tables(spark, sf)
    path = scratch_path(spark, "graph")
    IO.write_graph(nodes, edges, path)
    n, e = IO.read_graph(spark, path)
    n = n.groupBy("author_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = e.groupBy("author_id").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("total_weight"))
    return n.join(e, "author_id", "left").na.fill(0, ["n_edges", "total_weight"])


@register("snk_05", _EDGE_SQL)
def snk_05(spark, sf):
    """Interrupted build resumed by key: a first run writes the authors of one
    market segment, the resume run builds only authors absent from the written
    node table."""
    pp = materialize(graph_pp(spark, sf), "graph_input")
    path = scratch_path(spark, "graph_resume")
    seg = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("author_id"), "c_mktsegment")
    first = pp.join(seg.filter(F.col("c_mktsegment") == "BUILDING"), "author_id", "left_semi")
    IO.write_graph(G.nodes(first, []), G.coauthor_edges(first).select("author_id", "src", "dst", "weight"), path)
    todo = IO.pending(pp, path, spark)
    IO.write_graph(G.nodes(todo, []), G.coauthor_edges(todo).select("author_id", "src", "dst", "weight"), path)
    _, e = IO.read_graph(spark, path)
    return e


@register("prj_05", _VEC_SQL.replace("SELECT paper_id, 0 AS dim", "SELECT paper_id, 0 AS dim", 1))
def prj_05(spark, sf):
    """Node vector assembled from columns in a fixed order (as an array)."""
    o = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), "o_totalprice", "o_orderdate")
    pr = D.profiles(spark, sf).select("paper_id").distinct()
    v = pr.join(o, "paper_id").select("paper_id", F.array(
        F.col("o_totalprice") / 100000.0, (F.year("o_orderdate") - 1995) / 5.0).alias("vec"))
    return _long(v)


_PAIR_SQL = sql_with(SQL_PROFILE) + """
, a AS (SELECT pr.author_id, pr.paper_id, o.o_totalprice / 100000.0 AS x1 FROM profile pr JOIN orders o ON o.o_orderkey = pr.paper_id)
, b AS (SELECT pr.author_id, pr.paper_id, (year(o.o_orderdate) - 1995) / 5.0 AS x2 FROM profile pr
  JOIN orders o ON o.o_orderkey = pr.paper_id WHERE o.o_orderstatus <> 'P')
, ok AS (SELECT a.author_id FROM a GROUP BY a.author_id
  HAVING count(*) = (SELECT count(*) FROM b WHERE b.author_id = a.author_id))
SELECT a.author_id, a.paper_id, round(a.x1, 6) AS x1, round(b.x2, 6) AS x2 FROM a
JOIN b ON b.author_id = a.author_id AND b.paper_id = a.paper_id WHERE a.author_id IN (SELECT author_id FROM ok)"""


def _feature_sets(spark, sf):
    pr = D.profiles(spark, sf).select("author_id", "paper_id")
    o = D.table(spark, sf, "orders")
    a = pr.join(o.select(F.col("o_orderkey").alias("paper_id"), (F.col("o_totalprice") / 100000.0).alias("x1")), "paper_id")
    b = pr.join(o.filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("paper_id"), ((F.year("o_orderdate") - 1995) / 5.0).alias("x2")), "paper_id")
    return a, b


def _guarded_pair(spark, sf):
    a, b = _feature_sets(spark, sf)
    na = a.groupBy("author_id").agg(F.count(F.lit(1)).alias("na"))
    nb = b.groupBy("author_id").agg(F.count(F.lit(1)).alias("nb"))
    ok = na.join(nb, "author_id").filter(F.col("na") == F.col("nb")).select("author_id")
    j = a.join(b, ["author_id", "paper_id"]).join(ok, "author_id", "left_semi")
    return j.select("author_id", "paper_id", r6(F.col("x1")).alias("x1"), r6(F.col("x2")).alias("x2"))


@register("flt_04", _PAIR_SQL)
def flt_04(spark, sf):
    """Pair two feature sets per author only when both cover the same number of nodes."""
    return _guarded_pair(spark, sf)


_CONCAT_SQL = sql_with(SQL_PROFILE) + """
SELECT pr.author_id, pr.paper_id, round(o.o_totalprice / 100000.0, 6) AS x_0,
       round((year(o.o_orderdate) - 1995) / 5.0, 6) AS x_1, round(l.q / 50.0, 6) AS x_2
FROM profile pr JOIN orders o ON o.o_orderkey = pr.paper_id
JOIN (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = pr.paper_id"""


@register("jon_07", _CONCAT_SQL)
def jon_07(spark, sf):
    """Feature vectors of two builders joined by (author, paper) and concatenated, first set first."""
    pr = D.profiles(spark, sf).select("author_id", "paper_id")
    o = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), F.array(
        F.col("o_totalprice") / 100000.0, (F.year("o_orderdate") - 1995) / 5.0).alias("x1"))
    li = D.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id")) \
        .agg(F.array(F.max("l_quantity") / 50.0).alias("x2"))
    j = pr.join(o, "paper_id").join(pr.join(li, "paper_id"), ["author_id", "paper_id"])
    x = F.concat("x1", "x2")
    return j.select("author_id", "paper_id", *[r6(x[i]).alias(f"x_{i}") for i in range(3)])


@register("snk_05_stream", _EDGE_SQL)
def snk_05_stream(spark, sf):
    """Incremental graph build: profile parts are dealt over files by (author, part), a Structured Streaming
    job (foreachBatch) reads them in about four batches and extends the graphs of the authors it meets."""
    from papertrail.streaming import incremental as INC
    root = scratch_path(spark, "stream")
    IO.write_profiles(D.profiles(spark, sf), f"{root}/all", chunk=4)  # most authors have several parts
    parts = IO.read_profiles_lines(spark, f"{root}/all")
    for k in range(4):
        parts.where(F.pmod(F.xxhash64("author_id", "part"), F.lit(4)) == k).write.json(f"{root}/in/batch={k}")
    files = len(spark.read.schema(INC.PART_SCHEMA).json(f"{root}/in").inputFiles())
    papers = INC.papers_by_string_id(D.papers(spark, sf))
    INC.build_stream(spark, f"{root}/in/*", papers, f"{root}/out", f"{root}/ckpt", max(1, files // 4))
    _, e = IO.read_graph(spark, f"{root}/out")
    return e.select(F.col("author_id").cast("long").alias("author_id"), F.col("src").cast("long").alias("src"),
                    F.col("dst").cast("long").alias("dst"), "weight")
