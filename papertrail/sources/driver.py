"""Binding of the driver's TPC-H-like tables onto the attribution data model.

author profile  = customer (author_id = c_custkey, name = lower(c_name))
paper           = orders   (label = status 'F', venue = priority with
                            '4-NOT SPECIFIED' as a missing venue, year = order year)
co-author       = lineitem -> supplier (name = s_name) -> nation (org = n_name)
keyword         = lineitem -> part (p_name); title = part types, abstract = part brands
Line order inside a paper is (l_linenumber, l_suppkey, l_partkey), unique per order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (author, paper): author_id, name, paper_id, label, seq."""
    cust = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("author_id"), F.lower("c_name").alias("name"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("author_id"),
        F.col("o_orderkey").alias("paper_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    return (orders.join(cust, "author_id")
            .select("author_id", "name", "paper_id", "label",
                    F.col("paper_id").alias("seq")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with its co-author name/org and keyword."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return (li.join(sup, li.l_suppkey == sup.s_suppkey)
            .join(nat, sup.s_nationkey == nat.n_nationkey)
            .join(part, li.l_partkey == part.p_partkey)
            .select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
                    "s_name", "n_name", "p_name", "p_type", "p_brand"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested paper table: paper_id, title, abstract, keywords, venue, year, authors.

    A paper's line items are bounded in number, so gathering them into arrays
    is a per-paper (not per-author) collection.
    """
    per_order = (lines(spark, sf_dir)
                 .groupBy("l_orderkey")
                 .agg(F.sort_array(F.collect_list(F.struct(
                     "l_linenumber", "l_suppkey", "l_partkey", "s_name", "n_name",
                     "p_name", "p_type", "p_brand"))).alias("ls")))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", "o_orderdate")
    ls = F.col("ls")
    return (orders.join(per_order, orders.o_orderkey == per_order.l_orderkey, "left")
            .select(
                F.col("o_orderkey").alias("paper_id"),
                F.coalesce(F.array_join(F.transform(ls, lambda x: x["p_type"]), " "),
                           F.lit("")).alias("title"),
                F.array_join(F.transform(ls, lambda x: x["p_brand"]), " ").alias("abstract"),
                F.coalesce(F.transform(ls, lambda x: x["p_name"]),
                           F.array().cast("array<string>")).alias("keywords"),
                F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED",
                       F.col("o_orderpriority")).alias("venue"),
                F.year("o_orderdate").cast("string").alias("year"),
                F.coalesce(F.transform(ls, lambda x: F.struct(
                    x["s_name"].alias("name"), x["n_name"].alias("org"))),
                    F.array().cast("array<struct<name:string,org:string>>")).alias("authors")))


def profile_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-01: profile rows joined with their paper record."""
    return profiles(spark, sf_dir).join(papers(spark, sf_dir), "paper_id")


# ---------------------------------------------------------------------------
# The same binding as SQL text, shared by the DuckDB oracle queries.
# ---------------------------------------------------------------------------

SQL_PROFILE = """profile AS (
  SELECT o.o_custkey AS author_id, lower(c.c_name) AS name, o.o_orderkey AS paper_id,
         CAST(o.o_orderstatus = 'F' AS INTEGER) AS label, o.o_orderkey AS seq
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""

SQL_LINES = """lines AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_partkey, s.s_name, n.n_name,
         p.p_name, p.p_type, p.p_brand
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey)"""

SQL_PAPER = """paper AS (
  SELECT o.o_orderkey AS paper_id,
         coalesce(t.title, '') AS title, t.abstract,
         coalesce(t.keywords, []::VARCHAR[]) AS keywords,
         CASE WHEN o.o_orderpriority <> '4-NOT SPECIFIED' THEN o.o_orderpriority END AS venue,
         CAST(year(o.o_orderdate) AS VARCHAR) AS year,
         coalesce(t.names, []::VARCHAR[]) AS names,
         coalesce(t.orgs, []::VARCHAR[]) AS orgs
  FROM orders o LEFT JOIN (
    SELECT l_orderkey,
           string_agg(p_type, ' ' ORDER BY l_linenumber, l_suppkey, l_partkey) AS title,
           string_agg(p_brand, ' ' ORDER BY l_linenumber, l_suppkey, l_partkey) AS abstract,
           list(p_name ORDER BY l_linenumber, l_suppkey, l_partkey) AS keywords,
           list(s_name ORDER BY l_linenumber, l_suppkey, l_partkey) AS names,
           list(n_name ORDER BY l_linenumber, l_suppkey, l_partkey) AS orgs
    FROM lines GROUP BY l_orderkey) t ON o.o_orderkey = t.l_orderkey)"""

# Profile rows with their lines (co-authors); papers without lines drop out.
SQL_PLINES = """plines AS (
  SELECT pr.author_id, pr.name, pr.paper_id, pr.label, pr.seq, l.*
  FROM profile pr JOIN lines l ON l.l_orderkey = pr.paper_id)"""


def sql_with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
