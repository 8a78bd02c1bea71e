from papertrail.plans.registry import stable_round_sql


def test_round_rewrite_nested_and_untouched():
    sql = "SELECT round(coalesce(mx, 0) - coalesce(mn, 0), 6) AS a, round(x) b, around(y, 6), round(round(z, 2) / 3, 6)"
    out = stable_round_sql(sql)
    assert "round(CAST((coalesce(mx, 0) - coalesce(mn, 0)) AS DOUBLE) + 1e-09, 6)" in out
    assert "round(x) b" in out and "around(y, 6)" in out
    assert "round(CAST((round(z, 2) / 3) AS DOUBLE) + 1e-09, 6)" in out


def test_rounding_agrees_between_engines(spark):
    import duckdb
    from pyspark.sql import functions as F
    from papertrail.plans.common import r6
    vals = [0.0559375, 0.1234565, -0.0559375, 2.5e-7, 1.0]
    spark_out = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v double")
                 .select(r6(F.col("v"))).collect()]
    con = duckdb.connect()
    duck_out = [con.execute(stable_round_sql(f"SELECT round({v}::DOUBLE, 6)")).fetchone()[0] for v in vals]
    assert spark_out == duck_out
