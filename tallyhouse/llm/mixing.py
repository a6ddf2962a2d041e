"""Mixing sources to target weights by Pfair scheduling.

A source's rows, in a seeded random order, are cut into blocks. With ``share`` of every
``period`` slots, its block i (from 0) is released at floor(i * period / share) and due at
ceil((i + 1) * period / share); earliest-deadline-first then gives every slot a block, and
after any number of slots each source is less than one block away from its target. The
pattern repeats every ``period`` slots, so one period is worked out (its length is the sum
of the shares, a parameter) and applied to all blocks by arithmetic. When a source has no
block left, the others go on with their weights renormalised, so every row is kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

REST = "rest"
MAX_PERIOD = 100_000
BLOCK_ROWS = 64
BUCKET_ROWS = 20_000


def pfair_period(shares: Mapping[str, int]) -> dict[str, list[int]]:
    """For each source the slots of one period that earliest-deadline-first gives it."""
    period = sum(shares.values())
    slots: dict[str, list[int]] = {name: [] for name in shares}
    waiting = [(0, name, 0) for name in sorted(shares)]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []  # deadline, source, block
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, name, block = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(block + 1) * period // shares[name]), name, block))
        _, name, block = heapq.heappop(ready)
        slots[name].append(slot)
        if block + 1 < shares[name]:
            release = (block + 1) * period // shares[name]
            heapq.heappush(waiting, (max(release, slot + 1), name, block + 1))
    return slots


def phases(shares: Mapping[str, int], blocks: Mapping[str, int]) -> list[tuple]:
    """Rows ``(source, first, last, base, period, slots)``: where a source's blocks go.

    Each phase ends when one of its sources has no block left, so there are at most as many
    phases as sources.
    """
    active = {name: share for name, share in shares.items() if blocks.get(name, 0) > 0}
    done = dict.fromkeys(active, 0)
    base, rows = 0, []
    while active:
        period, slots = sum(active.values()), pfair_period(active)
        ends = {}
        for name, share in active.items():
            turns, rest = divmod(blocks[name] - done[name] - 1, share)
            ends[name] = turns * period + slots[name][rest] + 1
        length = min(ends.values())
        for name, share in active.items():
            turns, rest = divmod(length, period)
            gone = turns * share + sum(slot < rest for slot in slots[name])
            rows.append((name, done[name], done[name] + gone - 1, base, period, slots[name]))
            done[name] += gone
        base += length
        active = {name: share for name, share in active.items() if done[name] < blocks[name]}
    return rows


def mix(
    rows: DataFrame,
    weights: Mapping[str, int],
    rest: int = 1,
    id_column: str = "doc_id",
    source_column: str = "source",
    block_rows: int = BLOCK_ROWS,
    seed: int = 0,
) -> DataFrame:
    """One row per row: ``id``, ``source``, ``block``, ``slot`` and ``position`` in the mixture.

    ``weights`` gives each named source its integer share; every other source, and NULL, is
    part of one more source with share ``rest``. Sorting by ``position`` gives the mixture;
    positions of a source's short last block are not filled up. Rows are ordered within a
    source by a hash of the id, then by id; repeated ids get places next to one another in
    any order, a NULL id counts as an id of its own. No row is dropped and an empty table
    gives no row. Only the two columns are read.

    The driver receives one count per named source. Ranks within a source, which may hold
    most of the table, are counted in buckets of about ``BUCKET_ROWS`` rows.
    """
    shares = {**weights, REST: rest} if REST not in weights else dict(weights)
    if min(shares.values()) < 1 or sum(shares.values()) > MAX_PERIOD:
        raise ValueError(f"shares are positive whole numbers that add up to {MAX_PERIOD} at most")
    source = F.col(source_column)
    named = F.when(source.isin(*[w for w in weights]), source).otherwise(F.lit(REST))
    hashed = F.xxhash64(F.lit(seed), F.col(id_column))
    keyed = rows.select(
        F.col(id_column).alias("id"), named.alias("source"), hashed.alias("order")
    )
    counts = {r["source"]: r["n"] for r in keyed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    top = F.shiftrightunsigned("order", 32)
    ordered = keyed.withColumn("bucket", F.shiftright(top * buckets, 32))
    sizes = ordered.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("source", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "bucket").orderBy(
        F.shiftrightunsigned("order", 1), "order", "id"
    )
    ranked = ordered.withColumn("rank", F.row_number().over(within) - 1).join(
        sizes, ["source", "bucket"]
    )
    ranked = ranked.withColumn("rank", F.col("before") + F.col("rank"))
    blocks = {name: -(-n // block_rows) for name, n in counts.items()}
    plan = rows.sparkSession.createDataFrame(
        phases(shares, blocks),
        "source string, first long, last long, base long, period long, slots array<int>",
    )
    block = F.floor(F.col("rank") / block_rows)
    placed = ranked.withColumn("block", block).join(
        F.broadcast(plan),  # at most the square of the named sources, each with its share of slots
        (ranked["source"] == plan["source"]) & F.col("block").between(F.col("first"), F.col("last")),
    )
    turn = F.col("block") - F.col("first")
    share = F.size("slots")
    slot = (
        F.col("base")
        + F.floor(turn / share) * F.col("period")
        + F.element_at("slots", (turn % share + 1).cast("int"))
    )
    return placed.select(
        "id", ranked["source"].alias("source"), "block", slot.alias("slot"),
        (slot * block_rows + F.col("rank") % block_rows).alias("position"),
    )


def in_mixture_order(
    docs: DataFrame, weights: Mapping[str, int], id_column: str = "doc_id", position: str | None = None, **settings
) -> DataFrame:
    """All rows with their own columns, range-partitioned and sorted by place in the mixture.

    Written files, read in their order, are the mixture; ``position`` names a column to be
    added with the place, for readers that keep no order. Rows that share an id stand together.
    """
    places = mix(docs, weights, id_column=id_column, **settings).groupBy("id").agg(
        F.min("position").alias("_mix_position")
    )
    joined = docs.join(places, docs[id_column].eqNullSafe(places["id"])).drop(places["id"])
    added = [F.col("_mix_position").alias(position)] if position else []
    return joined.orderBy("_mix_position").select(*docs.columns, *added)
