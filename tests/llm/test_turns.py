"""Links found in a large group grow with its members, not with their pairs."""

from pyspark.sql import functions as F

from tallyhouse.llm import common


def test_links_of_a_large_group_are_found_in_turns(spark, monkeypatch):
    members = spark.range(400).select(F.lit(1).cast("long").alias("key"), "id").cache()
    # Those drawn first have no link, so all of the group is left to the exact step.
    alone = [r.id for r in members.orderBy(F.xxhash64("id"), "id").limit(common.DRAWS).collect()]
    alone += [next(i for i in range(400) if i not in alone)]

    def close(a, b):
        return ~F.col(a).isin(alone) & ~F.col(b).isin(alone)

    counts, whole = [], common.components

    def counted(links):
        counts.append(links.count())
        return whole(links)

    monkeypatch.setattr(common, "components", counted)
    known = members.select("id", F.lit(1).alias("n"))
    found = common.linked_components(
        members, lambda ids: known.join(ids, "id", "left_semi"),
        lambda a, b: F.col(f"{a}_n") == F.col(f"{b}_n"),
        lambda pairs: pairs.filter(~F.col("a").isin(alone) & ~F.col("b").isin(alone)),
        lambda ids: ids.withColumn("finer", F.array(F.lit(7).cast("long"))), close=close,
    )
    roots = {r.id: r.root for r in found.collect()}
    linked = [i for i in range(400) if i not in alone]
    assert {roots[i] for i in linked} == {linked[0]}
    assert all(roots.get(i, i) == i for i in alone)
    assert sum(counts) <= 10 * 400  # all pairs are 78,210
