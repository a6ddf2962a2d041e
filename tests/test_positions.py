"""Places of rows by a distributed prefix sum against a sort in Python."""

import random

from pyspark.sql import functions as F

from tallyhouse.functions.positions import numbered


def _rows(n, rng):
    return [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, *range(50)]), i) for i in range(n)]


def _key(*values):
    return tuple((v is not None, v) if v is not None else (False,) for v in values)


def test_places_within_groups_and_totals(spark):
    rows = _rows(900, random.Random(3))
    frame = spark.createDataFrame(rows, "g string, x int, i int").repartition(7)
    found = numbered(frame, ["x", "i"], ["g"], total="n").collect()
    assert len(found) == len(rows)
    for group in ("a", "b", "c", None):
        expected = sorted((r for r in rows if r[0] == group), key=lambda r: _key(r[1], r[2]))
        mine = sorted((r for r in found if r.g == group), key=lambda r: r.place)
        assert [(r.g, r.x, r.i) for r in mine] == expected
        assert [r.place for r in mine] == list(range(len(expected)))
        assert {r.n for r in mine} == {len(expected)}


def test_places_over_the_whole_table_ties_and_repeats(spark):
    rows = [(i % 3,) for i in range(500)] + [(None,)] * 20
    found = numbered(spark.createDataFrame(rows, "x int").repartition(5), ["x"], place="p").collect()
    assert sorted(r.p for r in found) == list(range(520))
    assert [r.x for r in sorted(found, key=lambda r: r.p)] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))


def test_an_empty_table_and_an_order_over_many_partitions(spark):
    empty = spark.createDataFrame([], "x int")
    assert numbered(empty, ["x"]).columns == ["x", "place"] and numbered(empty, ["x"]).count() == 0
    spread = spark.range(20_000).select((F.col("id") * 7 % 20_000).alias("x"))
    assert numbered(spread, ["x"]).filter("x <> place").count() == 0
