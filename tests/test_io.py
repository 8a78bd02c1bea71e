import json
import os
import tempfile

from pyspark.sql import functions as F

from papertrail.sources import io as IO


def _tmp():
    return tempfile.mkdtemp(prefix="pt-test-", dir="/tmp")


def test_reference_layouts(spark):
    d = _tmp()
    with open(os.path.join(d, "train.json"), "w") as f:
        json.dump({"A1": {"name": "li wei", "normal_data": ["p1", "p2"], "outliers": ["p3"]}}, f)
    with open(os.path.join(d, "papers.json"), "w") as f:
        json.dump({"p1": {"id": "p1", "title": "t", "abstract": "", "keywords": ["k"], "venue": None,
                          "year": 2001, "authors": [{"name": "Li Wei", "org": "X"}]}}, f)
    prof = IO.flatten_labelled(IO.read_profiles_object(spark, os.path.join(d, "train.json")))
    rows = [(r.paper_id, r.label) for r in prof.orderBy("seq").collect()]
    assert rows == [("p1", 1), ("p2", 1), ("p3", 0)]
    pap = IO.read_papers_object(spark, os.path.join(d, "papers.json")).first()
    assert pap["year"] == "2001" and pap["venue"] is None and pap["authors"][0]["org"] == "X"


def test_stopwords_crlf(spark):
    d = _tmp()
    with open(os.path.join(d, "stop.txt"), "wb") as f:
        f.write(b"' '\r\na\r\nabout\r\n\r\n")
    words = sorted(r.word for r in IO.read_stopwords(spark, os.path.join(d, "stop.txt")).collect())
    assert words == ["' '", "a", "about"]
    s = IO.stopword_set(spark, ["x", "a"], files=[os.path.join(d, "stop.txt")])
    assert s.count() == 4


def test_score_roundtrip_last_wins(spark):
    d = _tmp()
    df = spark.createDataFrame([(1, 10, 0.1, 0), (1, 10, 0.7, 1), (1, 11, 0.3, 2)],
                               "author_id long, paper_id long, score double, seq long")
    IO.write_scores(df, os.path.join(d, "s"), order_col="seq")
    got = {(r.paper_id, r.score) for r in IO.read_scores(spark, os.path.join(d, "s")).collect()}
    assert got == {("10", 0.7), ("11", 0.3)}


def test_profile_chunks(spark):
    d = _tmp()
    flat = spark.createDataFrame([(1, "n", i, i % 2, i) for i in range(10)],
                                 "author_id long, name string, paper_id long, label int, seq long")
    IO.write_profiles(flat, os.path.join(d, "p"), chunk=4)
    back = IO.read_profiles_lines(spark, os.path.join(d, "p"))
    assert back.count() == 3
    f = IO.flatten_labelled(back)
    assert sorted(int(r.paper_id) for r in f.collect()) == list(range(10))
    assert [r.label for r in f.orderBy("seq").collect()] == [1] * 5 + [0] * 5


def test_parts_are_full_whatever_the_gaps(spark, tmp_path):
    """A profile with gaps in seq and one far larger than a record: every record full but each profile's last."""
    rows = [(1, "n", i, i % 2, 977 * i * i) for i in range(9001)] + [(2, "m", 10**6 + i, 1, i << 40) for i in range(5)]
    flat = spark.createDataFrame(rows, "author_id long, name string, paper_id long, label int, seq long").repartition(3)
    IO.write_profiles(flat, str(tmp_path / "p"))
    back = IO.read_profiles_lines(spark, str(tmp_path / "p"))
    n = {(int(r.author_id), r.part): r.n for r in
         back.select("author_id", "part", (F.size("normal_data") + F.size("outliers")).alias("n")).collect()}
    assert n == {(1, 0): 4096, (1, 1): 4096, (1, 2): 809, (2, 0): 5}
    got = [(int(r.paper_id), r.label) for r in IO.flatten_labelled(back).filter("author_id = '1'").orderBy("seq").collect()]
    assert got == [(i, 1) for i in range(1, 9001, 2)] + [(i, 0) for i in range(0, 9001, 2)]


def test_flatten_keeps_order_at_large_seq(spark, tmp_path):
    """Round trip of profile rows whose seq is past 2^23, 2^32 and 2^43: order and labels stay apart."""
    from papertrail.sources import io as IO
    seqs = [0, 1 << 23, (1 << 23) + 1, 1 << 32, 1 << 43]
    rows = [("a", "n", str(i), i % 2, s) for i, s in enumerate(seqs)]
    flat = spark.createDataFrame(rows, "author_id string, name string, paper_id string, label int, seq long")
    IO.write_profiles(flat, str(tmp_path / "p"))
    back = IO.flatten_labelled(IO.read_profiles_lines(spark, str(tmp_path / "p"))).collect()
    got = sorted(back, key=lambda r: r["seq"])
    assert [r["paper_id"] for r in got] == ["1", "3", "0", "2", "4"]
    assert len({r["seq"] for r in got}) == len(seqs)


def test_edit_distance_matches_brute_force_on_a_common_prefix(spark):
    from pyspark.sql import functions as F

    from papertrail.operators import names as N
    words = [f"supplier#{i:04d}" for i in range(60)] + ["", "a", "ab", "ba"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for k in (1, 2):
        got = {(r["a"], r["b"]) for r in N.edit_distance_pairs(
            df.withColumnRenamed("w", "a"), df.withColumnRenamed("w", "b"), k=k).collect()}
        cross = df.crossJoin(df.withColumnRenamed("w", "v")).where(F.levenshtein("w", "v") <= k).collect()
        assert got == {(r["w"], r["v"]) for r in cross}


def _stream_fixture(spark, tmp_path):
    """Two authors cut into parts of two papers, each part in a file of its own; every paper shares two names."""
    rows = [(a, "n", f"{a}{i}", i % 2, i) for a in ("a", "b") for i in range(6)]
    flat = spark.createDataFrame(rows, "author_id string, name string, paper_id string, label int, seq long")
    IO.write_profiles(flat, str(tmp_path / "all"), chunk=2)
    for k in range(3):
        (IO.read_profiles_lines(spark, str(tmp_path / "all")).where(F.col("part") == k)
         .write.json(str(tmp_path / "in" / f"batch={k}")))
    papers = flat.select("paper_id").distinct().withColumn("authors", F.expr(
        "array(named_struct('name', 'x one', 'org', 'o'), named_struct('name', 'y two', 'org', 'o'))"))
    want = {(a, f"{a}{i}", f"{a}{j}", 1) for a in ("a", "b") for i in range(6) for j in range(6) if i != j}
    return papers, want


def _edges_of(spark, path):
    rows = [tuple(r) for r in IO.read_graph(spark, path)[1].select("author_id", "src", "dst", "weight").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_stream_joins_parts_of_an_author_over_batches(spark, tmp_path):
    from papertrail.streaming import incremental as INC
    papers, want = _stream_fixture(spark, tmp_path)
    out = str(tmp_path / "out")
    INC.build_stream(spark, str(tmp_path / "in" / "*"), papers, out, str(tmp_path / "ckpt"))
    assert spark.read.parquet(f"{out}/done").select("epoch").distinct().count() >= 3
    assert _edges_of(spark, out) == want


def test_batch_survives_a_failure_between_writes_and_a_replay(spark, tmp_path):
    import pytest

    from papertrail.operators import graph as G
    from papertrail.streaming import incremental as INC
    papers, want = _stream_fixture(spark, tmp_path)
    out = str(tmp_path / "out")
    batches = [spark.read.schema(INC.PART_SCHEMA).json(str(tmp_path / "in" / f"batch={k}")) for k in range(3)]
    step = INC.graph_builder(papers, out, buckets=2)
    step(batches[0], 0)
    before = _edges_of(spark, out)
    nodes, G.nodes = G.nodes, lambda pp, cols: nodes(pp, cols).withColumn("x", F.raise_error(F.lit("lost")))
    try:
        with pytest.raises(Exception, match="lost"):
            step(batches[1], 1)  # edges of epoch 1 are written, its nodes are not
    finally:
        G.nodes = nodes
    assert _edges_of(spark, out) == before
    for k in (1, 2, 2, 2):
        step(batches[k], k)
    assert _edges_of(spark, out) == want


def test_stream_never_meets_known_papers_again(spark, tmp_path):
    """One author in six batches of two papers: every edge is written once, in the epoch of its later end."""
    from papertrail.streaming import incremental as INC
    out = str(tmp_path / "out")
    flat = spark.createDataFrame([("a", "n", f"p{i:02d}", i % 2, i) for i in range(12)],
                                 "author_id string, name string, paper_id string, label int, seq long")
    IO.write_profiles(flat, str(tmp_path / "all"), chunk=2)
    parts = IO.read_profiles_lines(spark, str(tmp_path / "all")).cache()
    papers = flat.select("paper_id").withColumn("authors", F.expr(
        "array(named_struct('name', 'x one', 'org', 'o'), named_struct('name', 'y two', 'org', 'o'))"))
    step = INC.graph_builder(papers, out, buckets=2)
    for k in range(6):
        step(parts.where(F.col("part") == k), k)
    edges = spark.read.parquet(f"{out}/edges")
    assert {r["epoch"]: r["count"] for r in edges.groupBy("epoch").count().collect()} == {
        k: 2 + 8 * k for k in range(6)}  # one new pair, and two new papers with 2 k known ones, in both directions
    assert _edges_of(spark, out) == {("a", f"p{i:02d}", f"p{j:02d}", 1) for i in range(12) for j in range(12) if i != j}


def test_a_part_that_comes_again_replaces_its_papers(spark, tmp_path):
    from papertrail.streaming import incremental as INC
    papers, want = _stream_fixture(spark, tmp_path)
    out = str(tmp_path / "out")
    batches = [spark.read.schema(INC.PART_SCHEMA).json(str(tmp_path / "in" / f"batch={k}")).cache() for k in range(3)]
    step = INC.graph_builder(papers, out, buckets=2)
    for k in range(3):
        step(batches[k], k)
    less = batches[1].where("author_id = 'a'").withColumn("normal_data", F.array().cast("array<string>"))
    gone = {x for r in batches[1].where("author_id = 'a'").collect() for x in r["normal_data"]}
    assert gone
    step(less, 3)
    assert _edges_of(spark, out) == {e for e in want if not gone & {e[1], e[2]}}
    assert {r["paper_id"] for r in IO.read_graph(spark, out)[0].where("author_id = 'a'").collect()} == (
        {e[1] for e in want if e[0] == "a"} - gone)
    step(batches[1], 4)
    assert _edges_of(spark, out) == want


def test_contained_sets_split_a_token_that_every_row_holds(spark):
    from papertrail.operators import overlap as O
    outer = [(i, ["all", f"t{i % 7}", f"u{i % 3}"]) for i in range(300)] + [(300, []), (301, None)]
    inner = [("a", ["all"]), ("b", ["all", "t3"]), ("c", ["u1", "all", "t2"]), ("d", ["all", "absent"]), ("e", ["t9"])]
    got = O.contained_sets(spark.createDataFrame(inner, "p string, ta array<string>"),
                           spark.createDataFrame(outer, "q int, tb array<string>"), "p", "q", hot_rows=20)
    assert sorted(tuple(r) for r in got.collect()) == sorted(
        (p, q) for p, ta in inner for q, tb in outer if tb and set(ta) <= set(tb))


def test_graph_without_edges_is_read(spark):
    """an epoch without a row leaves no file to take the columns from."""
    nodes, edges = "author_id long, paper_id long, y int", "author_id long, src long, dst long, weight long"
    path = _tmp() + "/g"
    IO.write_graph(spark.createDataFrame([(1, 10, 0)], nodes), spark.createDataFrame([], edges), path)
    n, e = IO.read_graph(spark, path)
    assert e.columns == ["author_id", "src", "dst", "weight"] and e.collect() == []
    assert [tuple(r) for r in n.collect()] == [(1, 10, 0)]
    IO.write_graph(spark.createDataFrame([(2, 20, 1)], nodes), spark.createDataFrame([(2, 20, 21, 3)], edges), path)
    n, e = IO.read_graph(spark, path)
    assert sorted(map(tuple, n.collect())) == [(1, 10, 0), (2, 20, 1)]
    assert [tuple(r) for r in e.collect()] == [(2, 20, 21, 3)]


def test_written_values_are_returned(spark, tmp_path):
    """jon_06 blends, snk_02 and snk_03 give the values that their files hold."""
    import datetime

    import __spark_entry__ as E
    day = datetime.date(2000, 1, 1)
    for name, schema, rows in (
            ("customer", "c_custkey long, c_name string", [(1, "A")]),
            ("orders", "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date",
             [(7, 1, "F", 150000.0, day), (8, 9, "O", 1.0, day)]),
            ("lineitem", "l_orderkey long, l_discount double, l_tax double", [(7, 0.1, 0.04)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    run = lambda q: sorted(map(tuple, E.queries()[q](spark, str(tmp_path)).collect()))
    assert run("snk_02") == [(7, 0, 1.5), (7, 1, 1.0)]
    assert run("snk_03") == [(1, 7, 7, 1.5, 1.0)]
    assert E.queries()["jon_06"](spark, str(tmp_path)).columns == ["author_id", "paper_id", "score"]
    assert run("jon_06") == run("ens_03") != []
