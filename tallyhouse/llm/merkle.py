"""Merkle manifest of a dataset: a postorder append log per tree, and proofs read from it.

The leaves of a tree, in order, are dealt among aligned builders of ``FAN ** HEIGHT`` leaves.
A builder takes its leaves one after the other and writes a node as soon as its last child
is complete, so that its segment of the log is in postorder. The subtree of an aligned
builder is one consecutive part of the tree's whole log, and the position of any node
follows from its level, its number and the number of leaves alone (sums of subtree sizes),
so siblings are read from a segment by address and no pointers are kept. The roots of the
segments are the leaves of the next tier of builders, until one node per tree is left; those
form one more tree. A path is handed down from tier to tier once per segment, not per leaf.

A tree of ``n`` leaves: while several nodes remain, every ``FAN`` consecutive ones (the last
run may be shorter, even one) become the SHA-256 of their hexadecimal digests in a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.positions import numbered
from tallyhouse.llm.common import cut

FAN = 16
HEIGHT = 3
_SIZE = 32  # bytes of a digest
_STEP = "array<struct<left:binary,right:binary>>"
_STEP_ARROW = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


# --- one tree in postorder ---------------------------------------------------------


def _joined(digests: Sequence[bytes]) -> bytes:
    return sha256(b"".join(digests).hex().encode()).digest()


def tree_height(leaves: int) -> int:
    """Levels above the leaves of a tree that ends in one node."""
    height = 0
    while leaves > 1:
        leaves, height = -(-leaves // FAN), height + 1
    return height


def in_completion_order(leaves: Sequence[bytes], height: int) -> list[bytes]:
    """The nodes of a tree of ``height`` levels above its leaves, each behind its last child."""
    log: list[bytes] = []
    open_nodes: list[list[bytes]] = [[] for _ in range(height + 1)]
    for leaf in leaves:
        log.append(leaf)
        open_nodes[0].append(leaf)
        level = 0
        while level < height and len(open_nodes[level]) == FAN:
            log.append(_joined(open_nodes[level]))
            open_nodes[level] = []
            level += 1
            open_nodes[level].append(log[-1])
    for level in range(height):  # the ragged right edge
        if open_nodes[level]:
            log.append(_joined(open_nodes[level]))
            open_nodes[level + 1].append(log[-1])
    return log


def position(level: int, number: int, leaves: int, height: int) -> int:
    """Place (from 0) in the log of a node: the nodes that are complete before it.

    A full node ends with leaf ``end``; what is written by then are all full nodes of its own
    and lower levels up to that leaf, and those of higher levels up to the leaf before. The
    nodes of the ragged edge come last, lower levels first.
    """
    end = (number + 1) * FAN**level
    if end <= leaves:
        below = sum(end // FAN**k for k in range(level + 1))
        return below + sum((end - 1) // FAN**k for k in range(level + 1, height + 1)) - 1
    full = sum(leaves // FAN**k for k in range(height + 1))
    return full + sum(leaves % FAN**k != 0 for k in range(1, level))


@lru_cache(maxsize=64)
def _addresses(leaves: int, height: int) -> list[list[int]]:
    """Byte address in a segment of every node, by level and number."""
    counts = [-(-leaves // FAN**level) for level in range(height + 1)]
    return [
        [_SIZE * position(level, number, leaves, height) for number in range(count)]
        for level, count in enumerate(counts)
    ]


class Segment:
    """A builder's part of the log, read by closed-form addresses."""

    def __init__(self, nodes: bytes, leaves: int, height: int):
        self.nodes, self.height = nodes, height
        self.at = _addresses(leaves, height)

    def digests(self, level: int, first: int, stop: int) -> bytes:
        found = self.at[level][first:stop]
        return b"".join(self.nodes[a : a + _SIZE] for a in found)

    def family(self, level: int, number: int) -> tuple[bytes, bytes]:
        """The siblings to the left and to the right of a node."""
        first = number // FAN * FAN
        stop = min(first + FAN, len(self.at[level]))
        return self.digests(level, first, number), self.digests(level, number + 1, stop)

    def steps(self, number: int, start: int = 0) -> list[tuple[bytes, bytes]]:
        """The families met on the way from leaf ``number`` to the segment's root, from a level on."""
        return [self.family(level, number // FAN**level) for level in range(start, self.height)]


# --- tiers of builders -------------------------------------------------------------


def _height_of(total: int, height: int) -> int:
    """Height of a builder's subtree: that of the whole tree if it holds all of it."""
    return tree_height(total) if total <= FAN**height else height


def _segments(nodes: DataFrame, height: int) -> DataFrame:
    """One row per builder: ``tree``, ``block``, ``total``, ``count``, ``nodes``, ``root``."""
    block = F.floor(F.col("index") / FAN**height).alias("block")

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        total = table.column("total")[0].as_py()
        log = in_completion_order(table.column("digest").to_pylist(), _height_of(total, height))
        return table.slice(0, 1).select(["tree", "block", "total"]).append_column(
            "count", pa.array([table.num_rows], pa.int64())
        ).append_column("nodes", pa.array([b"".join(log)], pa.binary())).append_column(
            "root", pa.array([log[-1]], pa.binary())
        )

    dealt = nodes.select("tree", block, "index", "total", "digest").groupBy("tree", "block")
    return cut(dealt.applyInArrow(
        build, "tree string, block bigint, total bigint, count bigint, nodes binary, root binary"
    ))


def grow(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The tiers of builders over ``(tree, index, total, digest)``; the last has one per tree.

    ``tree`` is a name without NULL, ``index`` the leaf's number from 0, ``total`` the leaves
    of its tree. The driver learns the largest tree's size. A tier has ``FAN ** height``
    times fewer nodes than the one below, so there are logarithmically many.
    """
    most = nodes.agg(F.max("total")).first()[0] or 0
    tiers = [_segments(nodes, height)]
    while most > FAN**height:
        most = -(-most // FAN**height)
        total = F.ceil(F.col("total") / FAN**height)
        above = tiers[-1].select("tree", F.col("block").alias("index"), total.alias("total"), F.col("root").alias("digest"))
        tiers.append(_segments(above, height))
    return tiers


def append_log(tiers: Sequence[DataFrame], height: int = HEIGHT) -> DataFrame:
    """The whole log as rows ``(tree, position, level, number, digest)``.

    Sorted by ``position`` within a tree it is its postorder, whichever builders wrote it.
    """
    parts = []
    for tier, segments in enumerate(tiers):

        def rows(batches: Iterator[pa.RecordBatch], tier: int = tier) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    own = _height_of(r["total"], height)
                    segment = Segment(r["nodes"], r["count"], own)
                    out = []
                    for level in range(0 if tier == 0 else 1, own + 1):
                        first = r["block"] * FAN ** (height - level)
                        for k in range(len(segment.at[level])):
                            out.append((r["tree"], tier * height + level, int(first) + k, r["leaves"], segment.digests(level, k, k + 1)))
                    columns = list(zip(*out)) or [()] * 5
                    tree, levels, numbers, leaves, digests = columns
                    places = [position(a, b, c, tree_height(c)) for a, b, c in zip(levels, numbers, leaves)]
                    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, k) for v, k in zip((tree, places, levels, numbers, digests), kinds)],
                        ["tree", "position", "level", "number", "digest"],
                    )

        sizes = tiers[0].groupBy("tree").agg(F.max("total").alias("leaves"))
        parts.append(segments.join(sizes, "tree").mapInArrow(
            rows, "tree string, position bigint, level int, number bigint, digest binary"
        ))
    log = parts[0]
    for part in parts[1:]:
        log = log.union(part)
    return log


def _handed_down(segments: DataFrame, paths: DataFrame, height: int) -> DataFrame:
    """Paths ``(tree, block, path)`` of a tier's builders, as paths of the leaves they hold."""

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                segment = Segment(r["nodes"], r["count"], _height_of(r["total"], height))
                above = [(p["left"], p["right"]) for p in r["path"]]
                found = [
                    [{"left": a, "right": b} for a, b in segment.steps(k) + above] for k in range(r["count"])
                ]
                first = r["block"] * FAN**height
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["tree"]] * len(found), pa.string()),
                        pa.array(range(first, first + len(found)), pa.int64()),
                        pa.array(found, _STEP_ARROW),
                    ],
                    ["tree", "block", "path"],
                )

    joined = segments.join(paths, ["tree", "block"])
    return joined.mapInArrow(children, f"tree string, block bigint, path {_STEP}")


def _paths(tiers: Sequence[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """``(tree, block, path)`` of the lowest builders, given ``(tree, path)`` of whole trees."""
    paths = tops.select("tree", F.lit(0).cast("bigint").alias("block"), "path")
    for segments in reversed(tiers[1:]):
        paths = _handed_down(segments, paths, height)
    return paths


def manifest(
    rows: DataFrame, leaf: Column, id_column: str, tree_column: str, checked: Column | None = None,
    height: int = HEIGHT, with_siblings: bool = False,
) -> DataFrame:
    """One row per row: ``id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``leaf`` and ``checked`` are binary digests; rows of one ``tree_column`` value, ascending
    by id and then by leaf (NULL first), are a tree, and the roots of the trees, ordered by
    that value (NULL first, then bytewise), form the tree of ``root``, which the driver learns. A proof is the
    siblings of a leaf level by level, left to right, up to ``root``; ``proof_sha256`` is
    their digest and ``with_siblings`` adds them as one hexadecimal text. ``folded_root`` is
    worked out from ``checked`` (a leaf made anew; ``leaf`` itself if not given) and the
    siblings, and ``verified`` tells whether it equals ``root``.

    Rows are leaves one by one, repeated ones too; a NULL id is an id like any other. An
    empty table gives no row. Other columns are ignored. No task holds more than
    ``FAN ** height`` leaves of a tree.
    """
    given = rows.select(
        F.col(id_column).alias("id"), F.concat(F.lit("="), F.col(tree_column).cast("string")).alias("tree"),
        leaf.alias("digest"), (leaf if checked is None else checked).alias("checked"),
    ).withColumn("tree", F.coalesce("tree", F.lit("")))
    given = cut(given)  # numbering reads its rows twice, and texts shall be read once
    leaves = cut(numbered(given, ["id", "digest"], ["tree"], place="index", total="total"))
    tiers = grow(leaves.select("tree", "index", "total", "digest"), height)
    subroots = tiers[-1].select("tree", F.col("root").alias("digest"))
    tops = cut(numbered(subroots, ["tree"], place="index", total="total"))
    forest = grow(tops.select(F.lit("").alias("tree"), "index", "total", "digest"), height)
    start = forest[-1].select("tree", F.array().cast(_STEP).alias("path"))
    lowest = _paths(forest, start, height)
    climbed = _handed_down(forest[0], lowest, height).select(F.col("block").alias("index"), "path")
    top = forest[-1].first()  # one digest, or none for an empty table
    subtree = cut(tops.join(climbed, "index").select("tree", "path"))
    paths = _paths(tiers, subtree, height)
    known = subroots.select("tree", F.col("digest").alias("subroot"))
    blocks = tiers[0].drop("root").join(paths, ["tree", "block"]).join(known, "tree")
    dealt = leaves.withColumn("block", F.floor(F.col("index") / FAN**height))
    root = top["root"].hex() if top else ""
    out = f"id {leaves.schema['id'].dataType.simpleString()}, leaf string, subroot string, root string, " \
        "proof_sha256 string, folded_root string, verified boolean" + ", siblings string" * with_siblings

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        left, here = left.sort_by("index"), right.to_pylist()[0]
        own = _height_of(here["total"], height)
        segment = Segment(here["nodes"], here["count"], own)
        above = [(p["left"], p["right"]) for p in here["path"]]
        proofs, folded, texts = [], [], []
        run, tail, steps = "", "", []
        for k, leaf in enumerate(left.column("checked").to_pylist()):
            if k % FAN == 0:  # the leaves of a run share all but their own siblings
                run = segment.digests(0, k, min(k + FAN, left.num_rows)).hex() if own else ""
                steps = [(a.hex(), b.hex()) for a, b in segment.steps(k, 1) + above]
                tail = "".join(a + b for a, b in steps)
            place = 64 * (k % FAN)
            before, after = run[:place], run[place + 64 :]
            siblings = before + after + tail
            digest = leaf.hex()
            if own:
                digest = sha256((before + digest + after).encode()).hexdigest()
            for a, b in steps:
                digest = sha256((a + digest + b).encode()).hexdigest()
            proofs.append(sha256(siblings.encode()).hexdigest())
            folded.append(digest)
            if with_siblings:
                texts.append(siblings)
        columns = {
            "id": left.column("id"), "leaf": [d.hex() for d in left.column("digest").to_pylist()],
            "subroot": [here["subroot"].hex()] * len(folded), "root": [root] * len(folded),
            "proof_sha256": proofs, "folded_root": folded, "verified": [d == root for d in folded],
        }
        return pa.table(columns | ({"siblings": texts} if with_siblings else {}))

    blocks = blocks.select("tree", "block", "total", "count", "nodes", "path", "subroot")
    return dealt.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(prove, out)


def row_digest(columns: Sequence[str], **changed: Column) -> Column:
    """SHA-256 of a row: each column as ``-`` if NULL, else its UTF-8 byte count, ``:`` and value."""
    parts = []
    for name in columns:
        value = changed.get(name, F.col(name)).cast("string")
        sized = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(sized, F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))
