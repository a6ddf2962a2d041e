"""Near-duplicate documents by MinHash, banding and odd sketches.

A document's set is its distinct five-word shingles (A-Z lower-cased, words cut at ASCII
white space). MinHash values make ``BANDS`` band keys; documents that share a key are
candidates. ``HASHES`` MinHash values set bits of a parity bitmap, the odd sketch: the
population count of two sketches' XOR estimates how many values differ, most precisely at
high similarity, and refuses candidates far below the threshold. What is left is confirmed
on the full shingle sets. Equal sets are one candidate.

Two documents of similarity 0.75 share none of 40 bands of five values with a chance of
2 in 100,000. The sketch refuses 1 in 100,000 of such pairs (worked out exactly from the
distribution of its odd bits, with a limit of 336 flips), and far fewer of more similar ones.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import components, cut, held, linked_components, map_texts, text_of

WORDS = 5
PERCENT = 75
BANDS, ROWS = 40, 5
FINER, FINER_ROWS = 54, 6  # bands of other values, by which large groups are divided
HASHES = 600  # samples of the odd sketch; the bands are made of the first of them
SKETCH_BITS = 2048
REFUSED_BELOW = 0.66
DRAWS = 2  # of each key of a large group; a document has 40 keys
CHUNK = 1 << 16
MAX_CACHED = 500_000

_rng = np.random.default_rng(20240607)
_PLACE = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_FLIP = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_FACTOR = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """64-bit hash of each word; forgets everything when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_CACHED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(text: str, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; none for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    if len(words) < WORDS:
        total = (hashes * _PLACE[: len(words)]).sum(keepdims=True, dtype=np.uint64)
        return _mixed(total + np.full(1, len(words), np.uint64) * _SHORT)
    n = len(words) - WORDS + 1
    total = hashes[:n] * _PLACE[0]
    for k in range(1, WORDS):
        total += hashes[k : k + n] * _PLACE[k]
    return np.unique(_mixed(total))


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values: one row per (non-empty) set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), HASHES), np.uint64)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat((flat ^ _FLIP[j]) * _FACTOR[j], starts)
    return out


def band_keys(minima: np.ndarray, bands: int = BANDS, values: int = ROWS) -> np.ndarray:
    """Band keys of each row of MinHash values, as signed integers."""
    rows = minima[:, : bands * values].reshape(len(minima), bands, values)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _SHORT, rows.shape[:2]).copy()
    for k in range(values):
        keys = _mixed(keys + rows[:, :, k])
    return keys.view(np.int64)


def odd_sketch(minima: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the MinHash samples: ``SKETCH_BITS`` bits per row as signed integers."""
    bits = _mixed(minima + np.arange(1, HASHES + 1, dtype=np.uint64) * _SHORT) % np.uint64(SKETCH_BITS)
    counts = np.zeros((len(minima), SKETCH_BITS), np.uint8)
    np.add.at(counts, (np.arange(len(minima))[:, None], bits.astype(np.int64)), 1)
    return np.packbits(counts & 1, axis=1).view(">i8").astype(np.int64)


def _signer() -> Callable:
    """Gives for texts their set sizes, two hashes of the whole sets, band keys and sketches."""
    cache = _WordHashes()

    def sign(texts: list[str]) -> tuple:
        sets = [shingle_hashes(text, cache) for text in texts]
        empty = np.zeros(0, np.int64)
        bands, finer, sketches = ([empty] * len(sets) for _ in range(3))
        filled = [i for i, s in enumerate(sets) if len(s)]
        start = 0
        while start < len(filled):
            size, end = 0, start
            while end < len(filled) and (end == start or size + len(sets[filled[end]]) <= CHUNK):
                size += len(sets[filled[end]])
                end += 1
            minima = _minima([sets[i] for i in filled[start:end]])
            others = band_keys(minima[:, BANDS * ROWS :], FINER, FINER_ROWS)
            for i, b, f, s in zip(filled[start:end], band_keys(minima), others, odd_sketch(minima)):
                bands[i], finer[i], sketches[i] = b, f, s
            start = end
        one = [s.sum(dtype=np.uint64).astype(np.int64) for s in sets]
        two = [_mixed(s + _SHORT).sum(dtype=np.uint64).astype(np.int64) for s in sets]
        return [len(s) for s in sets], one, two, bands, finer, sketches

    return sign


def _collector() -> Callable:
    """Gives for texts their full shingle sets."""
    cache = _WordHashes()
    return lambda texts: [[shingle_hashes(text, cache).view(np.int64) for text in texts]]


def most_flips(similarity: float) -> int:
    """Population count that two odd sketches' XOR is expected to have at a similarity."""
    differing = 2 * HASHES * (1 - similarity)
    return int(SKETCH_BITS / 2 * (1 - exp(-2 * differing / SKETCH_BITS)))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """One row per row: ``id``, ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked where 100 * intersection >= percent * union of their sets
    (``percent`` 75 or more); ``component_id`` is the smallest id a document reaches, and
    that document is kept. A text with fewer than five words is one shingle; NULL, empty and
    blank texts have none and are linked with nothing. Rows that share an id are one
    document with all their links. A NULL id can represent no group: such a row has no
    component and is kept. An empty table gives no row; other columns are ignored.
    """
    if percent < PERCENT:
        raise ValueError(f"bands and sketches are laid out for {PERCENT} percent and more")
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), text_of(text).alias("text"))
    signed = cut(
        map_texts(
            rows, _signer,
            "n bigint, k1 bigint, k2 bigint, bands array<bigint>, finer array<bigint>, odd array<bigint>",
        )
    )
    known = signed.filter("n > 0 AND id IS NOT NULL")
    classes = known.groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    chosen = known.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    members = chosen.select(F.explode("bands").alias("key"), "id")
    limit = most_flips(REFUSED_BELOW)

    def features(ids: DataFrame) -> DataFrame:
        words = [F.col("odd")[i].alias(f"o{i}") for i in range(SKETCH_BITS // 64)]
        return held(chosen.join(ids, "id", "left_semi").select("id", "n", *words))

    def finer(ids: DataFrame) -> DataFrame:
        return chosen.join(ids, "id", "left_semi").select("id", "finer")

    def plausible(a: str, b: str) -> Column:
        na, nb = F.col(f"{a}_n"), F.col(f"{b}_n")
        flips = sum(
            F.bit_count(F.col(f"{a}_o{i}").bitwiseXOR(F.col(f"{b}_o{i}"))) for i in range(SKETCH_BITS // 64)
        )
        return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (flips <= limit)

    def verify(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = map_texts(rows.join(ids, "id", "left_semi"), _collector, "shingles array<bigint>")
        sets = held(sets)
        left, right = (sets.select(F.col("id").alias(s), F.col("shingles").alias(f"{s}_set")) for s in "ab")
        both = F.size(F.array_intersect("a_set", "b_set"))
        union = F.size("a_set") + F.size("b_set") - both
        return held(pairs.join(left, "a").join(right, "b").filter(100 * both >= percent * union).select("a", "b"))

    roots = held(linked_components(members, features, plausible, verify, finer, draws=DRAWS))
    # Rows of one id may belong to several classes, which the id then links.
    copies = known.join(classes, ["k1", "k2"]).select("id", "rep").distinct()
    several = copies.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi")
    if several.isEmpty():
        # Every other class is a star around its representative.
        member = (F.col("n") > 0) & F.col("id").isNotNull()
        joined = signed.join(classes, ["k1", "k2"], "left").withColumn("rep", F.when(member, F.col("rep")).otherwise(F.col("id")))
        joined = joined.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left")
        joined = joined.withColumn("root", F.coalesce("root", "rep"))
    else:
        links = copies.select(F.col("id").alias("a"), F.col("rep").alias("b"))
        links = links.union(roots.select(F.col("id").alias("a"), F.col("root").alias("b")))
        joined = signed.join(components(links), "id", "left")
    component = F.coalesce("root", "id")
    return joined.select(
        "id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay when one of each group of near copies is kept."""
    kept = near_duplicates(docs).filter("kept").select("id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["id"]), "left_semi")
