import itertools
import random

import pytest
from pyspark.sql import functions as F

from papertrail.operators import graph as G
from papertrail.operators import names as NM
from papertrail.operators.skew import salted_join

SCHEMA = "author_id long, seq long, paper_id long, names array<string>, orgs array<string>, " \
         "keywords array<string>, venue string"


def _pp(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_shared_names_threshold(spark):
    pp = _pp(spark, [(1, 0, 10, ["x", "y", "z"], [], [], "v"), (1, 1, 11, ["x", "y"], [], [], "w"),
                     (1, 2, 12, ["x"], [], [], "u")])
    e = {(r.src, r.dst): r.weight for r in G.coauthor_edges(pp).collect()}
    assert e == {(10, 11): 1, (11, 10): 1}


def test_salted_join_equals_plain(spark):
    rows = [(1, i, 100 + i, ["hub", f"n{i % 3}"], [], [], None) for i in range(12)]
    pp = _pp(spark, rows)
    plain = sorted(map(tuple, G.shared_counts(pp, F.col("names"), hot_rows=10**9).collect()))
    salted = sorted(map(tuple, G.shared_counts(pp, F.col("names"), hot_rows=2).collect()))
    assert plain == salted and len(plain) == 12 * 11


def test_subset_names_directed(spark):
    pp = _pp(spark, [(1, 0, 10, ["li wei"], [], [], None), (1, 1, 11, ["li wei ming", "wei li"], [], [], None)])
    e = {(r.src, r.dst): r.weight for r in G.subset_coauthor_edges(pp).collect()}
    assert e == {(10, 11): 1}


def _profiles(spark, rng, tokens):
    """Random profiles with an own name in most papers, nulls, empty lists and repeated names."""
    rows = []
    for author in range(4):
        own = " ".join(rng.sample(tokens, 2))
        for seq in range(rng.randint(1, 14)):
            names = [" ".join(rng.sample(tokens, rng.randint(1, 3))) for _ in range(rng.randint(0, 5))]
            names += [own] * (rng.random() < .9) + [None] * (rng.random() < .2) + names[:1] * (rng.random() < .3)
            rng.shuffle(names)
            rows.append((author, seq, 100 * author + seq // 2, names, [], [], None))
    return rows, _pp(spark, rows)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_overlaps_against_all_pairs(spark, least):
    rows, pp = _profiles(spark, random.Random(least), list("abcdef"))
    want, subset = {}, {}
    for a, b in itertools.product(rows, rows):
        if a[0] == b[0] and a[1] != b[1]:
            one, two = ([n for n in r[3] if n is not None] for r in (a, b))
            shared = len(set(one) & set(two))
            within = sum(set(x.split(" ")) <= set(y.split(" ")) for x in one for y in two)
            key = (a[0], a[1], a[2], b[1], b[2])
            want |= {key: shared} if shared >= least else {}
            subset |= {key: within} if within >= least else {}
    for hot in (1, 3, 10**6):
        got = {(r.author_id, r.src_seq, r.src, r.dst_seq, r.dst): r.shared
               for r in G.shared_counts(pp, F.col("names"), least, hot_rows=hot).collect()}
        assert got == want
        got = {(r.author_id, r.src_seq, r.src, r.dst_seq, r.dst): r.shared
               for r in G.subset_pair_counts(pp, "names", least, hot_rows=hot).collect()}
        assert got == subset


def _made(df, name):
    """Rows that the joins named so put out, from the metrics of the plan that ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if name in node.nodeName():
            total += node.metrics().apply("numOutputRows").value()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
    return total


@pytest.mark.parametrize("edges", [G.coauthor_edges, G.subset_coauthor_edges])
def test_own_name_of_a_large_profile_forms_no_pair(spark, edges):
    n = 50_000
    pp = (spark.range(n).select(
        F.lit(1).cast("long").alias("author_id"), F.col("id").alias("seq"), F.col("id").alias("paper_id"),
        F.array(F.lit("own name"), F.concat(F.lit("co"), F.floor(F.col("id") / 2).cast("string"))).alias("names")))
    df = edges(pp)
    assert _made(df, "Join") < 20 * n  # all pairs of the own name would be 2.5e9
    assert df.count() == n


def test_token_in_every_name(spark):
    n = 3000
    pp = (spark.range(n).select(
        F.lit(1).cast("long").alias("author_id"), F.col("id").alias("seq"), F.col("id").alias("paper_id"),
        F.array(F.concat(F.lit("li a"), (F.col("id") % 1500).cast("string")), F.lit("li own")).alias("names")))
    df = G.subset_coauthor_edges(pp)
    assert df.count() == n and _made(df, "Join") < 20 * n


def test_venue_null_and_empty(spark):
    pp = _pp(spark, [(1, i, 10 + i, [], [], [], v) for i, v in enumerate([None, None, "", ""])])
    e = sorted((r.src, r.dst) for r in G.venue_edges(pp).collect())
    assert e == [(10, 11), (11, 10), (12, 13), (13, 12)]
    c = {r.paper_id: r.clique_size for r in G.venue_cliques(pp).collect()}
    assert c == {10: 2, 11: 2, 12: 2, 13: 2}


def test_merge_priority(spark):
    pp = _pp(spark, [(1, 0, 10, ["a", "b", "c"], [], ["k"], "v1"), (1, 1, 11, ["a", "b", "c"], [], ["k"], "v2")])
    m = {(r.src, r.dst): (r.weight, r.kind) for r in G.merge_edges(G.typed_edges(pp)).collect()}
    assert m[(10, 11)] == (1, "keyword")   # keyword (1 shared) replaces co-author weight 2


def test_duplicate_paper_self_loop(spark):
    pp = _pp(spark, [(1, 0, 10, ["a", "b"], [], [], None), (1, 1, 10, ["a", "b"], [], [], None)])
    e = {(r.src, r.dst) for r in G.coauthor_edges(pp).collect()}
    assert e == {(10, 10)}
    nodes = G.nodes(pp.withColumn("label", F.col("seq").cast("int")), [])
    assert nodes.count() == 1 and nodes.first()["y"] == 1   # last row wins


def test_drop_edgeless(spark):
    pp = _pp(spark, [(1, 0, 10, ["a", "b"], [], [], None), (1, 1, 11, ["a", "b"], [], [], None),
                     (2, 0, 20, ["a"], [], [], None)]).withColumn("label", F.lit(1))
    kept = G.drop_edgeless(G.nodes(pp, []), G.coauthor_edges(pp))
    assert sorted(r.author_id for r in kept.collect()) == [1, 1]


def test_generic_salted_join(spark):
    l = spark.createDataFrame([(1, i) for i in range(50)], "k long, i long")
    r = spark.createDataFrame([(1, j) for j in range(3)], "k long, j long")
    assert salted_join(l, r, ["k"], ["i"], hot_rows=7).count() == 150


def test_edit_distance_blocking_exact(spark):
    words = ["smith", "smyth", "smit", "smiths", "jones", "jonas", "", "a", "ab", "ba", "abc", "bca"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {(r.a, r.b) for r in NM.edit_distance_pairs(df.withColumnRenamed("w", "a"),
                                                       df.withColumnRenamed("w", "b"), k=1).collect()}

    def lev(a, b):
        d = list(range(len(b) + 1))
        for i, ca in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, cb in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (ca != cb))
        return d[len(b)]
    want = {(a, b) for a, b in itertools.product(words, words) if lev(a, b) <= 1}
    assert got == want


def test_subset_plan_reads_its_steps_once(spark):
    """names held and covered are written once; before, the plan repeated the steps over 20 times."""
    pp = spark.createDataFrame([(1, 1, 10, ["a b", "c"]), (1, 2, 11, ["a b d", "c"])],
                               "author_id long, seq long, paper_id long, names array<string>")
    pairs = G.subset_pair_counts(pp)
    leaves = pairs._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert leaves <= 4
    assert sorted((r.src, r.dst, r.shared) for r in pairs.collect()) == [(10, 11, 2), (11, 10, 1)]


def _sized_profile(spark, papers):
    """One author with ``papers`` papers; only token subsets join the names of the first two."""
    rows = [(1, k, 100 + k, 0, ["li", "wei"] if k == 0 else ["li x", "wei y"] if k == 1 else [f"n{k}"], [f"o{k}"], [f"k{k}"],
             f"v{k}") for k in range(papers)]
    return spark.createDataFrame(rows, "author_id long, seq long, paper_id long, label int, names array<string>, "
                                       "orgs array<string>, keywords array<string>, venue string")


def test_large_profiles_match_names_by_token_subset(spark, monkeypatch):
    """the merged graph holds the subset edges of profiles above the size switch, and only theirs."""
    from papertrail.plans import q_graph as QG
    from papertrail.plans import registry
    registry.load_all()
    for papers, found in ((QG.SUBSET_ABOVE, []), (QG.SUBSET_ABOVE + 1, [(100, 101, 1, "coauthor")])):
        pp = _sized_profile(spark, papers)
        typed = G.typed_edges(pp, subset_above=QG.SUBSET_ABOVE)
        assert [tuple(r) for r in typed.select("src", "dst", "weight", "kind").collect()] == found
    monkeypatch.setattr(QG, "graph_input_table", lambda spark, sf: pp)
    assert [tuple(r) for r in QG.set_05(spark, "").collect()] == [(1, 100, 101, 1, "coauthor")]
    for name in ("grf_06", "set_05", "prp_01", "opt_03"):
        assert "co_large" in registry.ORACLES[name]


def test_set_05_unites_all_four_edge_sets(spark, monkeypatch):
    """org and venue edges are among the sets."""
    from papertrail.plans import q_graph as QG
    schema = ("author_id long, seq long, paper_id long, label int, names array<string>, orgs array<string>, "
              "keywords array<string>, venue string")
    pp = spark.createDataFrame([
        (1, 1, 1, 0, ["a"], ["o", "p"], ["x"], "v1"), (1, 2, 2, 0, ["b"], ["o", "p"], ["y"], "v2"),
        (1, 3, 3, 0, ["c"], ["q"], ["z"], "v3"), (1, 4, 4, 0, ["d"], ["r"], ["w"], "v3")], schema)
    monkeypatch.setattr(QG, "graph_input_table", lambda spark, sf: pp)
    assert {(r.src, r.dst, r.kind) for r in QG.set_05(spark, "").collect()} == {
        (1, 2, "org"), (2, 1, "org"), (3, 4, "venue"), (4, 3, "venue")}


def test_salted_join_splits_hot_keys_before_they_travel(spark):
    probe = spark.createDataFrame([(i, "hot" if i % 10 else f"k{i}") for i in range(500)] + [(900, None)], "id long, k string")
    build = spark.createDataFrame([("hot", 1), ("hot", 2), ("k10", 3), ("none", 4), (None, 5)], "k string, v int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = salted_join(probe, build, ["k"], ["id"], hot_rows=20)
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = sorted((r.id, r.k, r.v) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 1
    assert rows == sorted([(i, "hot", v) for i in range(500) if i % 10 for v in (1, 2)] + [(10, "k10", 3)])
