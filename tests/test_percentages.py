"""Percentages on a tie of the last decimal against SQL."""

from pyspark.sql import functions as F

from panelloom.functions.nullsafe import percent_of
from panelloom.operators import scenario


def test_ties_are_those_of_sql(spark, duck):
    cases = [(125775, 150000), (125773, 150000), (1, 2000), (3, 2000), (7, 2000), (677, 800), (1677, 2000), (1, 3), (5, 5), (0, 7)]
    cases += [(k, 2000) for k in range(0, 2000, 3)]
    got = spark.createDataFrame(cases, "a long, b long").select("a", "b", percent_of(F.col("a"), F.col("b")).alias("p")).collect()
    for a, b, p in map(tuple, got):
        assert duck.execute("select round_even(100.0 * (?::double / ?::double), 1)", [a, b]).fetchone()[0] == p, (a, b)


def test_positions_at_a_tie(spark, duck):
    n = 2000
    table = spark.createDataFrame([(i, 1, "t", float(i)) for i in range(n)], "scenario_id long, year int, target string, value double")
    got = {r["scenario_id"]: r["percentile"] for r in scenario.percentile_positions(table.select("scenario_id", "target", "value"), table).collect()}
    want = dict(duck.execute(f"select i, round_even(100.0 * cume_dist() over (order by i), 1) from range({n}) t(i)").fetchall())
    assert got == want
