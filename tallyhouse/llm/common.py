"""What several operators share: text columns, lineage cuts, connected components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tallyhouse.functions.lineage import checkpoint_folder, cut, stored  # noqa: F401

# Fixed value: the white space between words, as a character class body.
SPACE = r"\x20\x09-\x0D"
TASKS_PER_CORE = 4
DRAWS = 3
SPLIT = 8
WIDER = 8  # by which the turns of a comparison grow
ONE_TASK = 100_000  # links of two ids


def text_of(column: str = "text") -> Column:
    """A text column with NULL as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def map_texts(rows: DataFrame, make: Callable[[], Callable], columns: str) -> DataFrame:
    """Columns worked out in Python from the texts of ``(id, text)``, next to the ids.

    ``make`` is called once a task; what it returns gets a list of texts and gives one list
    per column. Ids pass through untouched, NULLs and all.
    """
    kinds = StructType.fromDDL(columns)
    arrow = [(field.name, to_arrow_type(field.dataType)) for field in kinds]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make()
        for batch in batches:
            found = find(batch.column("text").to_pylist())
            arrays = [pa.array(values, type=kind) for values, (_, kind) in zip(found, arrow)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], ["id", *[n for n, _ in arrow]])

    rows = rows.select("id", "text")
    return rows.mapInArrow(work, StructType([rows.schema["id"], *kinds.fields]))


def _few_tasks(df: DataFrame) -> DataFrame:
    return df.coalesce(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)


def held(df: DataFrame) -> DataFrame:
    """``cut`` in a few tasks per core, for tables much smaller than the input: its readers have no more."""
    return cut(_few_tasks(df))


def components(links: DataFrame) -> DataFrame:
    """Connected components of the links ``(a, b)``: rows ``(id, root)``, root the smallest id.

    Distributed union-find by contraction: every node moves to the first of itself and its
    neighbours, links follow their ends, and those that have become loops go, so finished
    components take no further part. The first round orders nodes by id, which closes stars
    around small ids at once; later rounds order them by a hash that differs from round to
    round, so even a long chain shrinks by a constant factor each time and there are
    logarithmically many rounds. A round is a grouping and two joins, whose hot nodes are
    plain skewed keys; the driver learns only how many links are left. Rounds with at most
    ``ONE_TASK`` links run in one task each, which spares them all shuffles. Every round's
    tables are stored, so that no round's plan or size rests on those before. A NULL end is no
    node, and a node without a link to another has no row.
    """
    known = links.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    left, moves = _contracted(known, [F.col("a"), F.col("b")]), []
    count = left.count()
    while not moves or count:
        turn, few = len(moves), count <= ONE_TASK

        def place(node: str) -> Column:
            return F.xxhash64(F.lit(turn), node) if turn else F.col(node)

        left = left.coalesce(1) if few else left
        both = left.union(left.select("b", "a"))
        both = both.coalesce(1) if few else both
        first = both.groupBy(F.col("a").alias("id")).agg(F.min_by("b", place("b")).alias("near"))
        ahead = place("near") < place("id")
        moved = stored(_few_tasks(first.select("id", F.when(ahead, F.col("near")).otherwise(F.col("id")).alias("root"))))
        moves.append((moved, few))
        a, b = (_sent(moved.select(F.col("id").alias(s), F.col("root").alias(f"{s}_root")), few) for s in "ab")
        left = _contracted(left.join(a, "a").join(b, "b"), [F.col("a_root"), F.col("b_root")])
        count = (left.coalesce(1) if few else left).count()
    found, few = moves.pop()
    while moves:
        # The smallest id of a component stays in place in the first round: later nodes hold it.
        if len(moves) == 1:
            smallest = found.groupBy("root").agg(F.min("id").alias("low"))
            found = found.join(_sent(smallest, few), "root").select("id", F.col("low").alias("root"))
        later = _sent(found.select(F.col("id").alias("root"), F.col("root").alias("final")), few)
        moved, few = moves.pop()
        found = moved.join(later, "root", "left").select("id", F.coalesce("final", "root").alias("root"))
    return found


def _sent(nodes: DataFrame, few: bool) -> DataFrame:
    """Nodes for a join; those of ``ONE_TASK`` links, two a link at most, go to every task."""
    return F.broadcast(nodes.coalesce(1)) if few else nodes


def _contracted(links: DataFrame, ends: list[Column]) -> DataFrame:
    ordered = links.select(F.greatest(*ends).alias("a"), F.least(*ends).alias("b"))
    return stored(_few_tasks(ordered.filter("a <> b").distinct()))


def linked_components(
    members: DataFrame,
    features: Callable[[DataFrame], DataFrame],
    plausible: Callable[[str, str], Column],
    verify: Callable[[DataFrame], DataFrame],
    finer: Callable[[DataFrame], DataFrame],
    draws: int = DRAWS,
    close: Callable[[str, str], Column] | None = None,
) -> DataFrame:
    """Components ``(id, root)`` of all links among ids that share a key.

    ``members`` has rows ``(key, id)``; ``features(ids)`` gives one row ``(id, ...)`` for each
    of the ids asked for, from a table that is cut. ``plausible(a, b)`` is a cheap condition on the features of two ids,
    named ``a_...`` and ``b_...``, that refuses no link; ``verify`` takes pairs ``(a, b)`` and
    keeps the links. An id without a link may have no row.

    Groups of at most ``SPLIT`` members are compared whole. In larger ones every member is
    compared with ``draws`` others, those first by a hash of the id: members of a group of
    copies share many keys, whose draws are then mostly the same few, so that pairs do not
    grow with the number of shared keys, and nearly all are connected through these. Components of the links so far are worked out once. What is left
    is exact: ids of large groups whose members then still lie in different components are
    divided by a second, independent set of keys (``finer(ids)`` gives ``(id, finer)``, an
    array of them), and pairs across components are compared. ``plausible`` is part of that
    join's condition, so pairs it refuses never become rows. So is ``close(a, b)``, the whole
    condition of a link where the features are enough for it; pairs are then compared in turns
    (``_across``). Without it each turn would fetch anew what ``verify`` reads.
    """
    dealt = members.repartition("key")  # read by both the groups and the join with them
    groups = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    groups = groups.filter("low <> high").select("key", "n")
    shared = dealt.join(groups.hint("shuffle_hash"), "key").distinct()
    turns = Window.partitionBy("key").orderBy(F.xxhash64("id"), "id")
    shared = held(shared.withColumn("turn", F.row_number().over(turns)))
    known = features(shared.select("id").distinct())
    drawn = F.col("turn") <= F.when(F.col("n") <= SPLIT, SPLIT).otherwise(draws)
    pairs = shared.join(shared.filter(drawn).select("key", F.col("id").alias("lead")), "key").filter("id <> lead")
    pairs = pairs.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
    pairs = pairs.join(_named(known, "a"), "a").join(_named(known, "b"), "b").filter(plausible("a", "b"))
    roots = held(components(verify(pairs.select("a", "b"))))
    release(members.sparkSession)

    mixed = held(_mixed(_rooted(shared.filter(F.col("n") > SPLIT), roots)).select("id", "root").distinct())
    if mixed.isEmpty():
        return roots
    divided = mixed.join(finer(mixed.select("id")), "id").select(F.explode("finer").alias("key"), "id", "root")
    divided = _mixed(divided.distinct())
    if close:
        merged = _across(divided, known, lambda a, b: plausible(a, b) & close(a, b))
    else:
        full = divided.join(known, "id")
        apart = (F.col("a") < F.col("b")) & (F.col("a_root") != F.col("b_root")) & plausible("a", "b")
        pairs = _named(full, "a").join(_named(full, "b"), "key").filter(apart)
        pairs = held(pairs.select("a", "b", "a_root", "b_root").distinct())
        if pairs.isEmpty():
            return roots
        merged = held(_joined(pairs.join(verify(pairs.select("a", "b")), ["a", "b"], "left_semi")))
    release(members.sparkSession)
    return roots if merged is None else _moved(roots, merged)


def _across(rows: DataFrame, known: DataFrame, close: Callable[[str, str], Column]) -> DataFrame | None:
    """Roots ``(id, root)`` of the roots that links in the groups of ``rows`` (``key``, ``id``, ``root``) connect, if any.

    Every pair of a group that lies in different components is compared, in turns: the ``SPLIT``
    members first by a hash of the ids with each other and with all that lie outside the group's
    largest component, then eight times as many, until all of the group are among them. What has
    become one component goes between turns. An id with many links in its group so meets one of
    them early, and one that is compared with many has few: the links found in a turn grow with
    the members, not with their pairs. No pair is compared twice, and ``close``, the condition
    of a link, is part of the join's.
    """
    whole = Window.partitionBy("key")
    turn = F.row_number().over(whole.orderBy(F.xxhash64("id"), "id"))
    rows = rows.withColumn("turn", turn).withColumn("n", F.count("*").over(whole))
    rows = held(rows.withColumn("met", F.lit(0)))  # the members up to this turn have been compared with it
    merged, upto = None, SPLIT
    while not rows.isEmpty():
        sized = rows.withColumn("size", F.count("*").over(Window.partitionBy("key", "root")))
        main = sized.withColumn("main", F.max(F.struct("size", "root")).over(whole)["root"])
        taken = (F.col("turn") <= upto) | (F.col("root") != F.col("main"))
        full = main.filter(taken).select("key", "id", "root", "turn", "met").join(known, "id")
        new = (F.col("a_turn") < F.col("b_turn")) & (F.col("a_turn") > F.col("b_met"))
        apart = new & (F.col("a_root") != F.col("b_root")) & close("a", "b")
        pairs = _named(full.filter(F.col("turn") <= upto), "a").join(_named(full, "b"), "key").filter(apart)
        pairs = held(pairs.select("a", "b", "a_root", "b_root").distinct())
        rows = main.filter(F.col("n") > upto).withColumn("met", F.when(taken, upto).otherwise(F.col("met")))
        rows = held(rows.drop("size", "main"))
        if not pairs.isEmpty():
            joined = held(_joined(pairs))
            merged = joined if merged is None else held(_moved(merged, joined))
            now = joined.select(F.col("id").alias("root"), F.col("root").alias("final"))
            rows = rows.join(now, "root", "left").withColumn("root", F.coalesce("final", "root")).drop("final")
            rows = held(_mixed(rows))
        upto *= WIDER
    return merged


def _joined(links: DataFrame) -> DataFrame:
    """Components of the roots of both ends of links."""
    return components(links.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))


def _named(rows: DataFrame, side: str) -> DataFrame:
    """The rows with ``id`` named as the side and other columns but ``key`` marked by it."""
    return rows.select([F.col(c).alias({"id": side, "key": "key"}.get(c, f"{side}_{c}")) for c in rows.columns])


def _moved(roots: DataFrame, merged: DataFrame) -> DataFrame:
    """The roots after ``merged`` joined some of them; ids that were in no component until then were their own."""
    final = merged.select(F.col("id").alias("root"), F.col("root").alias("final"))
    moved = roots.join(final, "root", "left").select("id", F.coalesce("final", "root").alias("root"))
    return moved.union(merged.join(roots.select("id"), "id", "left_anti").select("id", "root"))


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files, cut tables and generated classes that nothing refers to any more.

    It does so when the driver collects garbage, which one with room to spare seldom does in the
    middle of a job of many steps.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows ``(key, id, root)``; an id that has no root is its own."""
    return members.select("key", "id").join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows ``(key, id, root)`` of keys with more than one root."""
    keys = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    return rows.join(keys.filter("lo <> hi").select("key"), "key", "left_semi")
