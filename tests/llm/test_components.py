"""Components by contraction, with rounds in one task and with shuffled ones, against union-find."""

import random

import pytest

from tallyhouse.llm import common


def _roots(links):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            low, high = sorted((top(a), top(b)))
            parent[high] = low
    ends = {x for a, b in links if a is not None and b is not None and a != b for x in (a, b)}
    return {x: top(x) for x in ends}


@pytest.mark.parametrize("limit", [0, 40, 100_000])
def test_components_at_every_limit(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "ONE_TASK", limit)
    draw = random.Random(5)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    star = [(7, i) for i in range(2000, 2040)]
    loose = [(draw.randrange(200), draw.randrange(200)) for _ in range(90)]
    links = chain + star + loose + star[:3] + [(5, 5), (None, 3), (3, None), (-4, 1003)]
    draw.shuffle(links)
    rows = common.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(4)).collect()
    assert len(rows) == len({r["id"] for r in rows})
    assert {r["id"]: r["root"] for r in rows} == _roots(links)


def test_components_of_nothing(spark):
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
