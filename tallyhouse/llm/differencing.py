"""Packing into near-equal windows by Karmarkar-Karp multiway differencing.

Every document is the ids of its text and an end id. Whole windows' worth of a long document
are windows of their own, and what is left of it takes part in the packing, in independent
groups dealt by hash. Differencing keeps partial partitions, at first one per piece; the two
with the largest imbalances are merged with the largest sums of one put upon the smallest of
the other, until one partition is left, whose windows are nearly equal. The number of windows
starts at the least that could hold the pieces and rises whenever one exceeds the capacity.

Near-equal windows have small gaps. One document in ``FILLERS`` brings its ids along; these
are set aside and cut to fill the gaps, and what is left of them makes windows of its own.
The last few ids of a group go to sequences whose lengths are powers of two, which need no
padding. If a group's fillers cannot fill its gaps, its pieces are cut at multiples of half
the length, and so on down to ``BLOCK`` ids, since smaller pieces differ less. No other ids
leave the task that made them: checksums of longer pieces are put together from blocks.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import cut, map_texts, text_of

CAPACITY = 2048
END_ID = 1
BLOCK = 256
FILLERS = 8
GROUP_DOCS = 1024
# Fixed value: where the byte-level vocabulary cuts a text before merging.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ID = "<u4"


# --- ids ---------------------------------------------------------------------------


def byte_level_ids(path: str) -> Callable[[str], np.ndarray]:
    """What gives a text's ids under a byte-level BPE vocabulary in a tokenizer file.

    Ids are ranks: a merge's place in the file is that of its result in the vocabulary, as is
    checked here, so merging by the lowest id gives what the file's own library does. Special
    strings inside a text are their special ids.
    """
    from tiktoken import Encoding

    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    vocabulary, merges = whole["model"]["vocab"], whole["model"]["merges"]
    special = {t["content"]: t["id"] for t in whole["added_tokens"]}
    joined = [m if isinstance(m, list) else m.split(" ") for m in merges]
    if any(vocabulary[a + b] != 256 + rank for rank, (a, b) in enumerate(joined)):
        raise ValueError(f"the ids of {path} are not in the order of its merges")
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(map(letters.__getitem__, w)): i for w, i in vocabulary.items() if w not in special}
    model = Encoding("byte level", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: model.encode_to_numpy(text, allowed_special="all")


@lru_cache(maxsize=None)
def _zeros(length: int) -> bytes:
    return bytes(length)


def joined_crc32(left: int, right: int, right_bytes: int) -> int:
    """CRC-32 of two byte strings in a row from those of each."""
    empty = _zeros(right_bytes)
    return zlib.crc32(empty, left) ^ zlib.crc32(empty) ^ right


def _measurer(path: str, block: int, end_id: int, capacity: int, fillers: int) -> Callable:
    def make() -> Callable:
        ids_of, seen = byte_level_ids(path), 0

        def measure(texts: list[str]) -> tuple:
            nonlocal seen
            lengths, checks, kept = [], [], []
            for text in texts:
                ids = np.append(ids_of(text), end_id).astype(_ID)
                raw = ids.tobytes()
                lengths.append(len(ids))
                checks.append([zlib.crc32(raw[a : a + 4 * block]) for a in range(0, len(raw), 4 * block)])
                rest = len(ids) % capacity
                kept.append(raw[len(raw) - 4 * rest :] if seen % fillers == 0 else None)
                seen += 1
            return lengths, checks, kept

        return measure

    return make


# --- differencing ------------------------------------------------------------------


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """The pieces (by number) of each of ``windows`` windows, near-equal in their sums.

    A partial partition is its sums in falling order, without those that are 0, and for each
    the root of a binary tree of pieces. Ties are broken by the pieces' order.
    """
    parts = {i: (np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)}
    waiting = [(-s if windows > 1 else 0, i) for i, s in enumerate(sizes)]
    heapq.heapify(waiting)
    trees: list[tuple[int, int]] = []  # of number len(sizes) + place
    while len(waiting) > 1:
        (_, a), (_, b) = heapq.heappop(waiting), heapq.heappop(waiting)
        (high, high_roots), (low, low_roots) = parts.pop(a), parts.pop(b)
        both = len(high) + len(low) - windows  # so many windows hold pieces of both
        if both <= 0:
            sums, roots = np.concatenate([high, low]), np.concatenate([high_roots, low_roots])
        else:
            rising, rising_roots = low[::-1], low_roots[::-1]
            alone = len(high) - both
            met = range(len(sizes) + len(trees), len(sizes) + len(trees) + both)
            trees += zip(high_roots[alone:].tolist(), rising_roots[:both].tolist())
            sums = np.concatenate([high[:alone], high[alone:] + rising[:both], rising[both:]])
            roots = np.concatenate([high_roots[:alone], np.arange(met.start, met.stop), rising_roots[both:]])
        order = np.argsort(-sums, kind="stable")
        sums, roots = sums[order], roots[order]
        imbalance = int(sums[0] - (sums[-1] if len(sums) == windows else 0))
        parts[a] = sums, roots
        heapq.heappush(waiting, (-imbalance, a))
    found: list[list[int]] = []
    for root in next(iter(parts.values()))[1].tolist() if parts else []:
        pieces, open_roots = [], [root]
        while open_roots:
            node = open_roots.pop()
            if node < len(sizes):
                pieces.append(node)
            else:
                open_roots += trees[node - len(sizes)]
        found.append(sorted(pieces))
    return found


def near_equal(sizes: list[int], capacity: int) -> list[list[int]]:
    """``difference`` into the fewest windows tried that none of them exceeds the capacity.

    The number starts at the lower bound and rises by one at least, by a quarter of the share
    by which the fullest window is too full if that is more.
    """
    windows = -(-sum(sizes) // capacity)
    while True:
        found = difference(sizes, windows)
        most = max((sum(sizes[i] for i in pieces) for pieces in found), default=0)
        if most <= capacity:
            return found
        windows += max(1, windows * (most - capacity) // (4 * capacity))


# --- groups ------------------------------------------------------------------------


def _pieces_of(row: int, length: int, checks: list[int], capacity: int, block: int, first: int, grain: int):
    """Pieces ``(row, start, length, crc)`` of ``grain`` ids from ``first`` on, the last shorter."""
    for start in range(first, length, grain):
        stop = min(start + grain, length)
        crc = 0
        for at in range(start, stop, block):
            crc = joined_crc32(crc, checks[at // block], 4 * (min(at + block, stop) - at))
        yield row, start, stop - start, crc


def pack_group(
    lengths: list[int], checks: list[list[int]], kept: list[bytes | None],
    capacity: int = CAPACITY, block: int = BLOCK,
) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(document, start, length, crc, sequence, offset)`` of one group's packing."""
    sequences: list[list[tuple[int, int, int, int]]] = []
    loose, pool = [], []
    for row, (length, sums) in enumerate(zip(lengths, checks)):
        rest = length % capacity
        whole = _pieces_of(row, length - rest, sums, capacity, block, 0, capacity)
        sequences += [[piece] for piece in whole]
        if rest and kept[row] is None:
            loose.append((row, length - rest, length, sums))
        elif rest:
            pool.append((row, length - rest, kept[row]))
    spare = sum(len(raw) // 4 for _, _, raw in pool)
    grain = capacity
    while True:
        pieces = [p for row, first, length, sums in loose for p in _pieces_of(row, length, sums, capacity, block, first, grain)]
        windows = near_equal([p[2] for p in pieces], capacity)
        gaps = capacity * len(windows) - sum(p[2] for p in pieces)
        if gaps <= spare or grain <= block:
            break
        grain //= 2
    for chosen in windows:
        window: list[tuple[int, int, int, int]] = []
        for row, start, size, crc in (pieces[i] for i in chosen):
            if window and window[-1][0] == row and sum(window[-1][1:3]) == start:  # not cut after all
                _, before, length, other = window.pop()
                start, size, crc = before, length + size, joined_crc32(other, crc, 4 * size)
            window.append((row, start, size, crc))
        sequences.append(window)
    filled = len(sequences) - len(windows)

    def take(wanted: int) -> list[tuple[int, int, int, int]]:
        """So many ids from the fillers, or what is left of them."""
        taken = []
        while wanted and pool:
            row, start, raw = pool.pop()
            part, raw = raw[: 4 * wanted], raw[4 * wanted :]
            taken.append((row, start, len(part) // 4, zlib.crc32(part)))
            wanted -= len(part) // 4
            if raw:
                pool.append((row, start + len(part) // 4, raw))
        return taken

    for window in sequences[filled:]:
        window += take(capacity - sum(p[2] for p in window))
    left = sum(len(raw) // 4 for _, _, raw in pool)
    sequences += [take(capacity) for _ in range(left // capacity)]
    size = capacity
    while pool:  # the set bits of what is left
        size //= 2
        if left % capacity & size:
            sequences.append(take(size))
    out = []
    for number, sequence in enumerate(sequences):
        offset = 0
        for row, start, length, crc in sequence:
            out.append((row, start, length, crc, number, offset))
            offset += length
    return out


def pack_near_equal(
    docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID, group_docs: int = GROUP_DOCS, block: int = BLOCK,
    fillers: int = FILLERS,
) -> DataFrame:
    """One row per piece: ``id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    ``capacity`` is a power of two times ``block``, and a power of two for the last sequences
    to need no padding. A document is its text's ids and ``end_id``; NULL and empty texts are
    the end id alone. Each id is in exactly one piece. Rows are packed each, also repeated
    ones and those that share an id or have none; other columns are ignored, and an empty
    table gives no row. Groups are of about ``group_docs`` rows, dealt by row, so that
    neither one id nor copies of one text meet in a task. A group ends with at most one
    sequence for each power of two below the capacity.
    """
    rows = docs.select(F.col(id_column).alias("id"), text_of(text).alias("text"))
    make = _measurer(tokenizer_path, block, end_id, capacity, fillers)
    measured = cut(map_texts(rows, make, "tokens bigint, checks array<bigint>, kept binary"))
    groups = max(1, -(-measured.count() // group_docs))
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))

    def place(table: pa.Table) -> pa.Table:
        base = table.column("_group")[0].as_py() << 32
        table = table.sort_by("_row")
        lengths = table.column("tokens").to_pylist()
        packed = pack_group(lengths, table.column("checks").to_pylist(), table.column("kept").to_pylist(), capacity, block)
        columns = list(zip(*packed))
        which = pa.array(columns[0], pa.int64())
        ids, tokens = (table.column(c).combine_chunks().take(which) for c in ("id", "tokens"))
        start, length, crc, sequence, offset = (pa.array(c, pa.int64()) for c in columns[1:])
        sequence = pa.array([base + s for s in sequence.to_pylist()], pa.int64())
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table([ids, start, length, crc, tokens, sequence, offset], names=names)

    kind = rows.schema["id"].dataType.simpleString()
    dealt = measured.withColumn("_row", F.monotonically_increasing_id()).withColumn("_group", number)
    return dealt.groupBy("_group").applyInArrow(
        place,
        f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    )
