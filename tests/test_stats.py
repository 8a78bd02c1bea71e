from pyspark.sql import functions as F

from papertrail.operators import ensemble as EN
from papertrail.operators import expand as EX
from papertrail.operators import groupstats as GS
from papertrail.operators import metrics as M


def test_single_row_group(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 3.0)], "author_id long, x double")
    r = {x["author_id"]: x for x in GS.group_stats(df, ["x"]).collect()}
    assert r[1]["x_var"] is None and r[1]["x_std"] is None and r[1]["x_median"] == 5.0
    assert r[2]["x_median"] == 2.0 and r[2]["x_var"] == 2.0


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.9), (1, 0, 0.9), (2, 1, 0.5)],
                               "author_id long, label int, score double")
    r = {x["author_id"]: x["auc"] for x in M.group_auc(df, ranges=4).collect()}
    assert r[1] == 0.75 and r[2] is None


def test_auc_matches_rank_formula(spark):
    import random
    rnd = random.Random(3)
    rows = [(a, rnd.randint(0, 1), round(rnd.random(), 1)) for a in range(5) for _ in range(40)]
    df = spark.createDataFrame(rows, "author_id long, label int, score double")
    got = {x["author_id"]: x["auc"] for x in M.group_auc(df, ranges=3).collect()}
    for a in range(5):
        pos = [s for g, y, s in rows if g == a and y == 1]
        neg = [s for g, y, s in rows if g == a and y == 0]
        u = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert abs(got[a] - u / (len(pos) * len(neg))) < 1e-12


def test_auc_of_a_million_rows_in_a_narrow_band(spark):
    """One author, nearly all scores within 1e-6 of each other: ranges stay of equal depth."""
    import numpy as np

    from papertrail.operators import ranks as R
    n = 1_000_000
    score = F.when(F.col("id") == 0, F.lit(1e9)).otherwise(0.5 + F.pmod(F.hash("id"), F.lit(800_000)) * 1e-12)
    df = spark.range(n).select(F.lit(1).alias("author_id"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("label"),
                               score.alias("score"))
    got = M.group_auc(df, ranges=40).first()
    y, s = (np.array(c) for c in zip(*df.select("label", "score").toPandas().itertuples(index=False)))
    rank = np.empty(n)
    rank[np.argsort(s, kind="stable")] = np.arange(n)
    _, inverse, times = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - (times - 1) / 2)[inverse]  # mean ranks from 1
    pos = int(y.sum())
    assert (got.n_pos, got.n_neg) == (pos, n - pos)
    assert abs(got.auc - (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (n - pos))) < 1e-9
    per = R.ranged(df.select("author_id", "score").distinct(), ["author_id"], ["score"], 40)
    sizes = [r["count"] for r in per.groupBy(R.RANGE).count().collect()]
    assert len(sizes) == 40 and max(sizes) < 3 * sum(sizes) / 40


def test_ranks_against_sorting(spark):
    import random

    from papertrail.operators import ranks as R
    rnd = random.Random(2)
    rows = [(g, k, rnd.randint(0, 5)) for g in range(3) for k in rnd.sample(range(10_000), [1, 40, 3000][g])]
    df = spark.createDataFrame(rows, "g long, k long, v long")
    got = {(r.g, r.k): (r.before, r.rank) for r in
           R.rank(R.running_sum(df, ["g"], ["k"], "v", "before", 7), ["g"], ["k"], "rank", 5).collect()}
    for g in range(3):
        total = 0
        for i, (_, k, v) in enumerate(sorted(r for r in rows if r[0] == g)):
            assert got[g, k] == (total, i)
            total += v


def test_medians_by_selection(spark):
    import random
    import statistics
    rnd = random.Random(1)
    rows = [(g, rnd.choice([rnd.random(), 0.5, 0.25]), float(rnd.randint(0, 3)), None if rnd.random() < .3 else 1.0 * k)
            for g, n in ((1, 20_000), (None, 6001), (3, 9000), (4, 7), (5, 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "author_id long, a double, b double, c double").repartition(5)
    got = {r.author_id: (r.a_median, r.b_median, r.c_median) for r in GS.group_medians(df, ["a", "b", "c"], small=100).collect()}
    for g in (1, None, 3, 4, 5):
        for k in range(3):
            xs = [r[k + 1] for r in rows if r[0] == g and r[k + 1] is not None]
            assert got[g][k] == (statistics.median(xs) if xs else None)


def test_blend(spark):
    k = "author_id long, paper_id long, score double"
    sci = spark.createDataFrame([(1, 1, 1.0)], k)
    zero = spark.createDataFrame([(1, 1, 0.0)], k)
    assert round(EN.blend(sci, zero, zero).first()["score"], 6) == 0.49


def test_poly_names(spark):
    names = EX.poly2_names(["a", "b", "c"])
    assert [n for n, _, _ in names] == ["a^2", "a b", "a c", "b^2", "b c", "c^2"]
    assert len(EX.poly2_names([f"x{i}" for i in range(33)])) == 561
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    r = EX.poly2(df, ["a", "b"], keep=[]).first()
    assert (r["a^2"], r["a b"], r["b^2"]) == (4.0, 6.0, 9.0)


def test_products_of_whole_numbers_are_not_rounded(spark):
    from papertrail.operators import expand as EX
    from papertrail.plans import q_stats
    rows = [(1, 0, -1, 1 / 3), (2, 5, 2**40, 0.0000015), (3, None, -7, None), (4, 2**52 + 1, 3, -0.5), (5, 0, 0, float("nan"))]
    df = spark.createDataFrame(rows, "id long, a long, b long, c double").coalesce(1)
    cols = ["a", "b", "c"]
    got = q_stats._rounded_products(df, cols, ["id"])
    want = q_stats._round_all(EX.poly2(df, cols, keep=["id"]), {"id"})
    assert got.columns == want.columns
    assert [repr(r) for r in got.orderBy("id").collect()] == [repr(r) for r in want.orderBy("id").collect()]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("round(") == 3  # of c alone
