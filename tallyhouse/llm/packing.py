"""Packing documents into sequences: tokens, pieces, and sum-of-squares bin packing.

Sum-of-squares packing puts each piece where the squared counts of open sequences per
residual gap become smallest: an exact fit closes a sequence, a gap that many sequences
already have is avoided, and a new sequence is opened only where that costs less. Pieces
come longest first. Packing is done in independent groups of about ``GROUP_PIECES`` pieces
dealt by hash, so no task holds more, or in consecutive ranges of a given order, so that the
sequences follow a mixture; a group ends with a few part-filled sequences, which
is the price of not packing the whole table in one place.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import cut, map_texts, text_of

CAPACITY = 4096
END_ID = 1
GROUP_PIECES = 65_536
RANGE_PIECES = 4_096  # of a group that is a range of the mixture
RANGE_STEP = 256  # positions that are counted together and stay in one range
MAX_CACHED = 300_000
# Letters with closing marks: the tokenizer makes one pre-token of each of the two.
_PLAIN = re.compile(r"([^\W\d_A-Z]*)([.,;:!?|#$%&*]*)")
# How byte-level vocabularies write bytes: printable ones as themselves, the rest from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class WordIds(dict):
    """Token ids of white-space separated words as little-endian bytes, filled on demand.

    The tokenizer drops white space and never merges across it, so the ids of a text are
    those of its words in a row. Only ASCII white space is cut at; anything rarer stays
    inside a word and is left to the tokenizer. Plain lower-case words go straight to its
    vocabulary model, past the clean-up that would not change them.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = array("I", self._ids(word.decode("utf-8", "surrogatepass"))).tobytes()
        if len(self) >= MAX_CACHED:  # words not met again since the last time are forgotten
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found

    def _ids(self, word: str) -> list[int]:
        letters, marks = _PLAIN.match(word).groups()
        if len(letters) + len(marks) == len(word) and (not letters or letters.isalpha()):
            if not letters.isascii():
                letters = letters.lower()  # as the tokenizer does for the scripts below
                if max(letters) >= "\u0250" or "\u0307" in letters or not is_normalized("NFC", letters):
                    return self.tokenizer.encode(word, add_special_tokens=False).ids
                letters = letters.encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = [t.id for t in self.tokenize(letters)] if letters else []
            return ids + [t.id for t in self.tokenize(marks)] if marks else ids
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def ids_of(self, text: str) -> bytes:
        raw = text.encode("utf-8", "surrogatepass")
        # The vocabulary is lower case; special strings are matched before that, as they are.
        words = (raw if b"<|" in raw else raw.lower()).split()
        return b"".join(map(self.__getitem__, words))


def cut_pieces(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text: str = "text",
               capacity: int = CAPACITY, order: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, and ``order``.

    A document is its token ids and the end id; NULL and empty texts are the end id alone.
    Only documents longer than ``capacity`` are cut.
    """

    def make():
        cache, end = WordIds(tokenizer_path), array("I", [END_ID]).tobytes()

        def pieces(text: str) -> list[dict]:
            ids, out = cache.ids_of(text) + end, []
            for start in range(0, len(ids), 4 * capacity):
                part = ids[start : start + 4 * capacity]
                place = {"piece": len(out), "start": start // 4, "length": len(part) // 4}
                out.append(place | {"ids_crc32": zlib.crc32(part)})
            return out

        return lambda texts: [[pieces(text) for text in texts]]

    kept = [F.col(id_column).alias("doc_id"), *([F.col(order)] if order else [])]
    rows = docs.select(F.struct(*kept).alias("id"), text_of(text).alias("text"))
    found = map_texts(
        rows, make, "pieces array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
    )
    out = found.select("id", F.inline("pieces"))
    return out.select("id.doc_id", "piece", "start", "length", "ids_crc32", *([f"id.{order}"] if order else []))


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, the pieces being placed in the given order."""
    open_at = np.zeros(capacity + 1, np.int64)  # open sequences by how full they are
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    for i, size in enumerate(lengths.tolist()):
        room = capacity - size
        # Change of the sum of squares / 2 for a sequence filled up to each level.
        change = 2 * (open_at[size:] - open_at[: room + 1] + 1)
        change[room] -= 1  # a full sequence is no longer open
        change[open_at[: room + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * open_at[size] + 1 if size < capacity else 0
        level = room - int(np.argmin(change[::-1]))  # ties: the fullest
        if level == 0:
            number, used = used, used + 1
        else:
            number = waiting[level].pop()
            open_at[level] -= 1
        sequence[i], offset[i] = number, level
        if level + size < capacity:
            waiting[level + size].append(number)
            open_at[level + size] += 1
    return sequence, offset


def ranges(pieces: DataFrame, order: str, group_pieces: int, step: int) -> DataFrame:
    """Adds ``_group``, numbers from 0 that rise with ``order``, of about ``group_pieces`` rows each.

    Every ``step`` values of ``order`` are counted together, and these counts are added up in
    one task. Only where one such step alone holds more than a group are its rows dealt by
    ``_order`` among as many groups as they fill.
    """
    stepped = pieces.withColumn("_step", F.floor(F.col(order) / step))
    sizes = stepped.groupBy("_step").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    sizes = sizes.select(F.col("_step").alias("_at"), "_n", F.floor(before / group_pieces).alias("_first"))
    joined = stepped.join(sizes, stepped["_step"].eqNullSafe(sizes["_at"]))
    part = F.pmod("_order", F.ceil(F.col("_n") / group_pieces))
    return joined.withColumn("_group", F.col("_first") + part).drop("_step", "_at", "_n", "_first")


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int | None = None,
    order: str | None = None, step: int | None = None,
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces ``(doc_id, piece, length, ...)``.

    With ``order``, a whole-number column that is left out of the result, groups are its
    consecutive ranges: sequence numbers rise from range to range, and no sequence holds
    pieces of two. The pieces are read twice, so pass a table or a ``cut`` one. An empty
    table gives no row.
    """
    hashed = F.xxhash64("doc_id", "piece", "length")
    if order:
        dealt = ranges(pieces.withColumn("_order", hashed), order, group_pieces or RANGE_PIECES, step or RANGE_STEP)
        pieces = pieces.drop(order)
        dealt = dealt.select(*pieces.columns, "_order", "_group")
    else:
        groups = max(1, -(-pieces.count() // (group_pieces or GROUP_PIECES)))
        dealt = pieces.withColumns({"_order": hashed, "_group": F.pmod(hashed, F.lit(groups))})

    def place(table: pa.Table) -> pa.Table:
        base = table.column("_group")[0].as_py() * 2**32
        table = table.drop_columns(["_group"]).sort_by("_order").drop_columns(["_order"])
        lengths = table.column("length").to_numpy()
        hashed = sum_of_squares(lengths, capacity)
        falling = np.argsort(-lengths, kind="stable")
        number, offset = (np.empty_like(lengths) for _ in range(2))
        number[falling], offset[falling] = sum_of_squares(lengths[falling], capacity)
        if hashed[0].max() < number.max():
            number, offset = hashed
        return table.append_column("sequence_id", pa.array(base + number)).append_column("offset", pa.array(offset))

    kinds = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return dealt.groupBy("_group").applyInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, order: str | None = None
) -> DataFrame:
    """Every document in pieces, each with its sequence and place; repeated rows are packed each."""
    return pack(cut(cut_pieces(docs, tokenizer_path, capacity=capacity, order=order)), capacity, order=order)
