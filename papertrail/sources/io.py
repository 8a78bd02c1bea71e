"""Readers and writers (SRC-01..08, SNK-01..05, PRJ-01/02).

Formats
-------
* Reference layout: one JSON object keyed by id (``{id: {...}, ...}``).  It is
  a single record by construction, so reading it is one task
  (``wholetext``); it is accepted for compatibility, then written out in the
  splittable layout below.
* Splittable layout (used at scale): JSON lines, one record per
  (author, part) for profiles and score maps, one record per paper for papers.
  A profile or score map is cut into parts of at most ``CHUNK`` papers, so no
  record (and no task building it) holds an unbounded group.

Schemas are always declared, never inferred; ``year`` is read as a string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papertrail.operators import ranks as R

CHUNK = 4096
# seq of a flattened profile row: positives first, then part, then position.
_LABEL_SHIFT = 1 << 62
_PART_SHIFT = 1 << 20

AUTHOR_FIELD = T.StructType([T.StructField("name", T.StringType()),
                             T.StructField("org", T.StringType())])
PAPER_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("venue", T.StringType()), T.StructField("year", T.StringType()),
    T.StructField("authors", T.ArrayType(AUTHOR_FIELD))])
LABELLED = T.StructType([T.StructField("name", T.StringType()),
                         T.StructField("normal_data", T.ArrayType(T.StringType())),
                         T.StructField("outliers", T.ArrayType(T.StringType()))])
UNLABELLED = T.StructType([T.StructField("name", T.StringType()),
                           T.StructField("papers", T.ArrayType(T.StringType()))])


# --- SRC-01 / SRC-02: profiles -----------------------------------------------
def read_profiles_object(spark: SparkSession, path: str, labelled: bool = True) -> DataFrame:
    """Reference layout {author_id: {name, normal_data, outliers} | {name, papers}}."""
    st = LABELLED if labelled else UNLABELLED
    m = T.MapType(T.StringType(), st)
    raw = spark.read.text(path, wholetext=True)
    ex = raw.select(F.explode(F.from_json("value", m)).alias("author_id", "p"))
    cols = ["normal_data", "outliers"] if labelled else ["papers"]
    return ex.select("author_id", F.col("p.name").alias("name"), F.lit(0).cast("long").alias("part"),
                     *[F.col(f"p.{c}").alias(c) for c in cols])


def read_profiles_lines(spark: SparkSession, path: str, labelled: bool = True,
                        key_type: str = "string") -> DataFrame:
    """Splittable layout: one JSON line per (author_id, part)."""
    arr = "normal_data array<string>, outliers array<string>" if labelled else "papers array<string>"
    return spark.read.schema(f"author_id {key_type}, name string, part long, {arr}").json(path)


def flatten_labelled(nested: DataFrame) -> DataFrame:
    """PRJ-01: one row per (author, paper) with label 1 for positives then 0 for
    outliers; duplicates kept; ``seq`` orders the rows as the lists do."""
    def side(col, label):
        return nested.select("author_id", "name", F.posexplode(col).alias("pos", "paper_id"),
                             F.lit(label).alias("label"), "part")
    rows = side("normal_data", 1).unionByName(side("outliers", 0))
    return rows.select("author_id", "name", "paper_id", "label",
                       ((1 - F.col("label")).cast("long") * F.lit(_LABEL_SHIFT) + F.col("part").cast("long") * F.lit(_PART_SHIFT)
                        + F.col("pos")).cast("long").alias("seq"))


def part_of(seq):
    """The part of the nested record that a flattened row comes from."""
    c = F.col(seq) if isinstance(seq, str) else seq
    return F.shiftright(c.bitwiseAND(F.lit(_LABEL_SHIFT - 1)), 20)


def flatten_unlabelled(nested: DataFrame) -> DataFrame:
    """PRJ-02: one row per listed paper."""
    return nested.select("author_id", "name", F.posexplode("papers").alias("pos", "paper_id"), "part") \
        .select("author_id", "name", "paper_id",
                (F.col("part").cast("long") * F.lit(_PART_SHIFT) + F.col("pos")).cast("long").alias("seq"))


def write_profiles(flat: DataFrame, path: str, labelled: bool = True, chunk: int = CHUNK) -> None:
    """Write (author_id, name, paper_id, [label], seq) as JSON lines, lists ordered by seq; a record holds ``chunk``
    papers, the last of a profile what is left.  Papers are parted by their rank in the profile, counted in two levels,
    so neither gaps in ``seq`` nor a large profile change that."""
    ranked = R.rank(flat, ["author_id", "name"], ["seq"], "_rank")
    g = ranked.withColumn("part", F.expr(f"_rank div {chunk}")).groupBy("author_id", "name", "part")
    if labelled:
        agg = g.agg(F.sort_array(F.collect_list(F.struct("seq", "paper_id", "label"))).alias("l"))
        out = agg.select("author_id", "name", "part",
                         F.transform(F.filter("l", lambda x: x["label"] == 1), lambda x: x["paper_id"].cast("string")).alias("normal_data"),
                         F.transform(F.filter("l", lambda x: x["label"] == 0), lambda x: x["paper_id"].cast("string")).alias("outliers"))
    else:
        agg = g.agg(F.sort_array(F.collect_list(F.struct("seq", "paper_id"))).alias("l"))
        out = agg.select("author_id", "name", "part",
                         F.transform("l", lambda x: x["paper_id"].cast("string")).alias("papers"))
    out.write.mode("error").json(path)


# --- SRC-03 / SRC-04 / SNK-02: papers ---------------------------------------------
def read_papers_object(spark: SparkSession, path: str) -> DataFrame:
    """Reference layout {paper_id: {id, title, ...}}."""
    m = T.MapType(T.StringType(), PAPER_SCHEMA)
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", m)).alias("paper_id", "p")).select("paper_id", "p.*")


def read_papers_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAPER_SCHEMA).json(path)


def write_papers(papers: DataFrame, path: str, id_col: str = "paper_id") -> None:
    papers.select(F.col(id_col).cast("string").alias("id"), "title", "abstract", "keywords", "venue",
                  F.col("year").cast("string").alias("year"), "authors").write.mode("error").json(path)


def write_paper_vectors(df: DataFrame, path: str) -> None:
    """SNK-02: paper table plus its vector column, as parquet."""
    df.write.mode("error").parquet(path)


def read_paper_vectors(spark: SparkSession, path: str) -> DataFrame:
    """SRC-04."""
    return spark.read.parquet(path)


# --- SRC-05 / SNK-01: score maps ---------------------------------------------------
def write_scores(scores: DataFrame, path: str, chunk: int = CHUNK, order_col: str | None = None) -> None:
    """SNK-01: {author: {paper: score}} as JSON lines per (author, part).
    A paper scored twice for one author keeps its last score (by ``order_col``)."""
    s = scores
    if order_col:
        s = s.groupBy("author_id", "paper_id").agg(F.max_by("score", order_col).alias("score"))
    else:
        s = s.groupBy("author_id", "paper_id").agg(F.max("score").alias("score"))
    s = R.rank(s, ["author_id"], ["paper_id"], "_rank").withColumn("part", F.expr(f"_rank div {chunk}").cast("int"))
    out = s.groupBy("author_id", "part").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("paper_id").cast("string"), "score"))).alias("scores"))
    out.select(F.col("author_id").cast("string").alias("author_id"), "part", "scores") \
       .write.mode("error").json(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05 (splittable layout) -> (author_id, paper_id, score)."""
    d = spark.read.schema("author_id string, part int, scores map<string,double>").json(path)
    return d.select("author_id", F.explode("scores").alias("paper_id", "score"))


def read_scores_object(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05, reference layout {author: {paper: score}}."""
    m = "map<string,map<string,double>>"
    raw = spark.read.text(path, wholetext=True)
    a = raw.select(F.explode(F.from_json("value", m)).alias("author_id", "m"))
    return a.select("author_id", F.explode("m").alias("paper_id", "score"))


# --- SRC-06 / SNK-03: dense vectors as CSV ----------------------------------------
def write_vectors_csv(df: DataFrame, path: str, key: list[str], vec: str, dim: int,
                      prefix: str = "w2v_") -> None:
    """SNK-03: key columns plus one column per dimension (the key replaces row position)."""
    cols = [F.col(vec)[i].alias(f"{prefix}{i}") for i in range(dim)]
    df.select(*key, *cols).write.mode("error").option("header", True).csv(path)


def read_vectors_csv(spark: SparkSession, path: str, key_schema: str, dim: int,
                     prefix: str = "w2v_") -> DataFrame:
    """SRC-06 with a declared schema."""
    schema = key_schema + ", " + ", ".join(f"{prefix}{i} double" for i in range(dim))
    return spark.read.schema(schema).option("header", True).csv(path)


# --- SRC-07: stop words ------------------------------------------------------------
def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """One word per line; CR and surrounding whitespace removed, empty lines dropped."""
    t = spark.read.text(path)
    w = F.regexp_replace(F.regexp_replace("value", "\r", ""), "(?U)^\\s+|\\s+$", "")
    return t.select(w.alias("word")).filter(F.col("word") != "").distinct()


def stopword_set(spark: SparkSession, *lists, files: list[str] = ()) -> DataFrame:
    """TXT-18: union of word lists and stop-word files as one distinct table."""
    words = sorted({w for lst in lists for w in lst})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for f in files:
        df = df.unionByName(read_stopwords(spark, f))
    return df.distinct()


# --- SNK-04 / SRC-08: graphs ------------------------------------------------------
GRAPH_BUCKETS = 64


def _written(read: DataFrameReader, path: str) -> DataFrame | None:
    """The parquet table at ``path``, or None when nothing was written there yet."""
    from pyspark.errors import AnalysisException
    try:
        return read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def next_epoch(spark: SparkSession, path: str) -> int:
    """One past the last committed epoch; an epoch that failed before its commit is used again."""
    done = _written(spark.read, f"{path}/done")
    last = None if done is None else done.agg(F.max("epoch")).first()[0]
    return 0 if last is None else last + 1


def author_bucket(buckets: int = GRAPH_BUCKETS):
    """The partition that an author's rows lie in."""
    return F.pmod(F.xxhash64(F.col("author_id").cast("string")), F.lit(buckets)).cast("int")


def write_epoch(df: DataFrame, path: str, name: str, epoch: int, buckets: int = GRAPH_BUCKETS) -> None:
    """One table of one epoch by author bucket, replacing what an interrupted run of that epoch left."""
    (df.withColumn("bucket", author_bucket(buckets)).write.mode("overwrite").partitionBy("bucket")
     .parquet(f"{path}/{name}/epoch={epoch}"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, buckets: int = GRAPH_BUCKETS,
                epoch: int | None = None, authors: DataFrame | None = None) -> None:
    """Node and edge tables of one epoch, partitioned by an author bucket, each replacing what an interrupted
    run of that epoch left.  ``done/epoch=N`` is written last and lists the authors of the epoch: only
    then do readers see them.

    An author's graph is what the epochs from its ``base`` to its last one hold together.  ``authors`` (author_id, base)
    says which epochs this one adds to; without it, every author of ``nodes`` starts anew here and earlier
    epochs of it are superseded."""
    spark = nodes.sparkSession
    epoch = next_epoch(spark, path) if epoch is None else epoch
    for name, df in (("edges", edges), ("nodes", nodes)):
        write_epoch(df, path, name, epoch, buckets)
        # an epoch without rows has no file under its buckets: its columns are kept beside them
        spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{path}/schema/{name}/epoch={epoch}")
    if authors is None:
        written = spark.read.schema(nodes.schema).parquet(f"{path}/nodes/epoch={epoch}")
        authors = written.select("author_id").distinct().withColumn("base", F.lit(epoch))
    authors.select("author_id", F.col("base").cast("int").alias("base")).write.mode("overwrite").parquet(f"{path}/done/epoch={epoch}")


def committed(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """author_id, base, last: the epochs that hold each author's graph, as committed before epoch ``before``; None
    when nothing is."""
    done = _written(spark.read, f"{path}/done")
    if done is None:
        return None
    if before is not None:
        done = done.filter(F.col("epoch") < before)
    return done.groupBy("author_id").agg(F.max("base").alias("base"), F.max("epoch").alias("last"))


def read_epochs(spark: SparkSession, path: str, name: str, current: DataFrame, buckets: list[int] | None = None,
                schema: T.StructType | None = None) -> DataFrame:
    """Rows of table ``name`` in the epochs that ``current`` (author_id, base, last) gives for their authors.  Epochs that no
    author needs, and buckets besides ``buckets``, are pruned by partition."""
    held = F.col("epoch").between(F.col("base"), F.col("last"))
    done = spark.read.parquet(f"{path}/done").select("author_id", "epoch").join(current, "author_id")
    live = [r["epoch"] for r in done.filter(held).select("epoch").distinct().collect()]
    read = spark.read.option("mergeSchema", True)
    if schema is None:
        kept = _written(read, f"{path}/schema/{name}")
        schema = None if kept is None else kept.drop("epoch").schema
    if schema is not None:
        read = read.schema(T.StructType([*schema.fields, T.StructField("epoch", T.IntegerType()),
                                         T.StructField("bucket", T.IntegerType())]))
    rows = read.parquet(f"{path}/{name}").filter(F.col("epoch").isin(live))
    if buckets is not None:
        rows = rows.filter(F.col("bucket").isin(buckets))
    return rows.join(current, "author_id").filter(held).drop("bucket", "epoch", "base", "last")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of every author, from the author's committed epochs."""
    current = committed(spark, path)
    return read_epochs(spark, path, "nodes", current), read_epochs(spark, path, "edges", current)


# --- SNK-05: key-based resume ------------------------------------------------------
def pending(todo: DataFrame, done_path: str, spark: SparkSession) -> DataFrame:
    """Rows of authors that no committed epoch holds."""
    done = _written(spark.read, f"{done_path}/done")
    return todo if done is None else todo.join(done.select("author_id").distinct(), "author_id", "left_anti")
