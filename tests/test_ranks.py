import random

from corpuskiln.operators.ranks import ranked


def test_ranks_equal_sorting(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1, 1, 1, 2, 3]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "lane string, v int, _at long").repartition(5)
    for by in ([], ["lane"]):
        for size in (10, 1000):
            got = ranked(df, ["v"], by, range_rows=size).collect()
            assert sorted((r.lane, r.v, r._at) for r in got if r.lane and r.v) == sorted(r for r in rows if r[0] and r[1]) and got[0].__fields__ == ["lane", "v", "_at", "rank"]
            for lane in {r.lane for r in got} if by else {...}:
                mine = sorted((r for r in got if lane is ... or r.lane == lane), key=lambda r: r.rank)
                assert [r.rank for r in mine] == list(range(1, len(mine) + 1))
                assert [r.v or 0 for r in mine] == sorted(r.v or 0 for r in mine)


def test_descending_and_empty(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(50)], "v int, k int")
    got = sorted(ranked(df, ["v", "k"], descending=["v"], range_rows=8).collect(), key=lambda r: r.rank)
    assert [(r.v, r.k) for r in got] == sorted(((i % 7, i) for i in range(50)), key=lambda x: (-x[0], x[1]))
    assert ranked(df.limit(0), ["v"]).count() == 0


def test_a_value_of_many_rows_is_cut(spark):
    """One value in all rows still fills ranges evenly."""
    df = spark.range(0, 1000, 1, 4).selectExpr("1 AS v")
    got = [r.rank for r in ranked(df, ["v"], range_rows=100).collect()]
    assert sorted(got) == list(range(1, 1001))
    plan = ranked(df, ["v"], range_rows=100)
    sizes = [r.n for r in plan.selectExpr("(rank - 1) div 100 AS part").groupBy("part").count().withColumnRenamed("count", "n").collect()]
    assert sizes == [100] * 10
