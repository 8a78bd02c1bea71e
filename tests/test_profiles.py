from pyspark.sql import functions as F

from papertrail.operators import profiles as P


def test_top_k_first_seen_tie(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("b a a b c".split())],
                               "author_id long, seq long, v string")
    r = P.top_k_values(df, "v", k=2, salts=4).orderBy("rank").collect()
    assert [x["value"] for x in r] == ["b", "a"]


def test_top_k_counts_null(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, None), (1, 2, "x")], "author_id long, seq long, v string")
    r = P.top_k_values(df, "v").orderBy("rank").collect()
    assert r[0]["value"] is None and r[0]["cnt"] == 2
    r2 = P.top_k_values(df, "v", keep_null=False).collect()
    assert [x["value"] for x in r2] == ["x"]


def test_best_match_first_on_tie(spark):
    df = spark.createDataFrame([([("li wei", "orgA"), ("li wei", "orgB"), ("zhang", "orgC")], "li wei"),
                                ([], "x")],
                               "authors array<struct<name:string,org:string>>, name string")
    for method in ("arrow", "expr"):
        r = df.select(P.best_match(F.col("authors"), F.col("name"), method=method)).collect()
        assert r[0][0] == "orgA" and r[1][0] is None


def test_profile_similarity_zero_without_value(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, "abc")], "author_id long, seq long, venue string")
    top = P.top_k_values(rows, "venue")
    sim = P.profile_similarity(rows, top, F.col("venue"), "venue",
                               guard=F.coalesce(F.length("venue"), F.lit(0)) > 0)
    r = {x["seq"]: x for x in sim.collect()}
    assert r[0]["max_jaro_venue"] == 0.0
    assert r[1]["max_jaro_venue"] > 0.9


def test_similarity_scores_each_pair_once(spark):
    """2 000 profiles that hold seven years in all: 49 pairs are scored, not one for each paper and top year."""
    pp = spark.range(20_000).select((F.col("id") % 2000).alias("author_id"), F.col("id").alias("seq"),
                                    (1990 + F.pmod(F.xxhash64("id"), F.lit(7))).cast("string").alias("year"))
    top = P.top_k_values(pp, "year")
    asked = pp.select("author_id", F.col("year").alias("a")).join(top.select("author_id", F.col("value").alias("b")), "author_id")
    assert P.scored_pairs(asked).count() <= 49
    got = {(r.author_id, r.seq): r.max_jaro_year for r in P.profile_similarity(pp, top, F.col("year"), "year").collect()}
    assert len(got) == 20_000 and set(got.values()) <= {1.0, *(v for v in got.values() if v < 1)}
    plan = P.profile_similarity(pp, top, F.col("year"), "year")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_matched_orgs_equals_row_form(spark):
    import random
    rnd = random.Random(3)
    names = ["li wei", "Li Wei", "wei li", "zhang", "", None, "l. wei"]
    rows = [(a, s, rnd.choice(["li wei", "zhang san"]), [(rnd.choice(names), rnd.choice(["A", "B", None]))
             for _ in range(rnd.randint(0, 4))]) for a in range(5) for s in range(12)]
    df = spark.createDataFrame(rows, "author_id long, seq long, name string, authors array<struct<name:string,org:string>>")
    want = {(r.author_id, r.seq): r.matched_org for r in P.with_matched_org(df, method="expr").collect()}
    for hot in (1, 10**6):
        got = {(r.author_id, r.seq): r.matched_org for r in P.matched_orgs(df, hot_rows=hot).collect()}
        assert {k: got.get(k) for k in want} == want
