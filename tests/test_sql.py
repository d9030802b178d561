"""Formula functions in SQL."""

from __future__ import annotations

from tabflow.functions import sql


def test_functions_in_sql(spark):
    made = sql.register_functions(spark, "own_")
    assert len(made) > 60
    assert set(made).isdisjoint(sql.LEFT_OUT)
    row = spark.sql("SELECT own_upper('ab') a, own_left('abcdef', 3) b, own_left('ab', 3) c, own_sqrt(16) d, own_sqrt(-1) e, own_round(2.5) f, own_log(8, 2) g, own_proper('two words') h, own_similarity('kitten', 'sitting') i, own_hex_encode(x'0aff') j, own_sum(2, 3) k").first()
    assert tuple(row) == ("AB", "abc", None, 4.0, None, 3, 3.0, "Two Words", 3, "0aff", 5.0)
    plan = spark.range(5).selectExpr("own_upper(cast(id as string)) AS u")._jdf.queryExecution().optimizedPlan().toString()
    assert "upper(cast(id" in plan
    assert "Python" not in plan
