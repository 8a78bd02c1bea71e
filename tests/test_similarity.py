import random

import pytest

from papertrail.functions.similarity import (jaro, jaro_arrow, jaro_py, jaro_winkler,
                                             best_index_arrow, jaro_winkler_arrow, jaro_winkler_py,
                                             score_pairs)


@pytest.mark.parametrize("a,b,expected", [("", "", 1.0), ("a", "a", 0.0), ("ab", "ba", 0.0),
                                          ("MARTHA", "MARHTA", 0.944444)])
def test_jaro_fixtures(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    r = df.select(jaro("a", "b"), jaro_arrow("a", "b")).first()
    assert round(r[0], 6) == expected and round(r[1], 6) == expected


def test_jaro_winkler_uncapped_prefix(spark):
    df = spark.createDataFrame([("abcdefghijklmnop", "abcdefghijklmnoq"), ("a", "a")], "a string, b string")
    r = [round(x[0], 6) for x in df.select(jaro_winkler("a", "b")).collect()]
    assert r == [1.020833, 0.1]


def test_expression_matches_python(spark):
    rnd = random.Random(7)
    pairs = []
    for _ in range(300):
        a = "".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 9)))
        b = "".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 9)))
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", jaro_winkler("a", "b").alias("e"), jaro_winkler_arrow("a", "b").alias("w")).collect()
    for r in got:
        exp = jaro_winkler_py(r["a"], r["b"])
        assert abs(r["e"] - exp) < 1e-12 and abs(r["w"] - exp) < 1e-12
    assert jaro_py("", "x") == 0.0


def test_scored_pairs_equal_the_rule():
    """Side by side, to the last bit, whatever the lengths and characters."""
    rnd = random.Random(11)
    for alphabet, longest in (("ab", 9), ("supplier#0123", 30), ("a\0é\U0001F600", 6), ("xyz", 300)):
        a, b = ([("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, longest)))) for _ in range(200)] for _ in "ab")
        assert list(score_pairs(a, b)) == [jaro_py(x, y) for x, y in zip(a, b)]
        assert list(score_pairs(a, b, 0.1)) == [jaro_winkler_py(x, y, 0.1) for x, y in zip(a, b)]
    assert len(score_pairs([], [])) == 0


def test_best_index_is_the_first_of_the_best(spark):
    rows = [(["x", "Ann Li", "ann li", None], "ann li"), ([None, ""], "a"), ([], "a"), (None, "a"), (["a"], None),
            ([None, None], "b"), (["b", "ab", "abc", "abc"], "abc")]
    df = spark.createDataFrame(rows, "n array<string>, t string").coalesce(1)
    assert [r[0] for r in df.select(best_index_arrow("n", "t")).collect()] == [1, 1, None, None, None, None, 2]


def test_queries_score_pairs_in_arrow_batches(spark):
    """SIM-01, SIM-02 and WIN-04 score in batches, not by nested lambdas run row by row."""
    from papertrail.plans import registry
    registry.load_all()
    for q in ("sim_01", "sim_02", "win_04"):
        plan = registry.QUERIES[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "aggregate(sequence" not in plan, q
