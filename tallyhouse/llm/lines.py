"""Fuzzy line removal: near-equal lines are found by MinHash and one of each group stays.

A line's shingles are runs of ``SHINGLE_CHARS`` characters: one from the start of every word,
over the words behind it, and in words longer than that one from every character at which a
whole run still lies within the word. So every character is in a shingle, and an edit changes
those around it only, with or without spaces. Their 64-bit hashes in ascending order are a
bottom-k MinHash sample; every two consecutive values among the lowest are a band, and lines
that share a band are candidates. Parity bitmaps of the whole sets bound from below how many
shingles two lines differ in, and refuse no link; the rest is confirmed by the exact Jaccard
similarity of the sets. Links are closed to components by distributed union-find, and the
first line of each in the order of documents stays.

With ten bands, two lines of similarity 0.8 fail to share one with a chance of 0.1 % (no two
neighbours among the lowest 11 of their union are common), and more similar ones with much
less; the bands by which large groups are divided miss 0.06 %. Lines are told apart by a 64-bit
hash of their text. All of it is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import SPACE, cut, held, linked_components, text_of

SHINGLE_CHARS = 12
BANDS, BAND_VALUES = 10, 2
FINER, FINER_VALUES = 20, 3  # bands of other hashes, by which large groups are divided
WORDS = 4  # of 64 bits in a parity bitmap
JACCARD_PERCENT = 80
HOT_SHARE = 10_000
SENT_IDS = 500_000  # ids of eight bytes that are broadcast at most


def _lines(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """Every line that has a word: ``id``, ``copy`` (hash of the text), ``pos``, ``line``, ``h``."""
    rows = docs.select(F.col(id_column).alias("id"), text_of(text).alias("text"))
    rows = rows.select(
        "id", F.xxhash64("text").alias("copy"), F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    return rows.filter(F.col("line").rlike(f"[^{SPACE}]")).withColumn("h", F.xxhash64("line"))


def line_shingles(line: Column, chars: int = SHINGLE_CHARS) -> Column:
    """Sorted hashes of the distinct shingles of a line that has a word.

    A shingle starts at a word's first character, or within a word where ``chars`` characters
    of it are left. At the line's end it is as long as what is left there.
    """
    # Looks ahead, then passes what is left of a word, and white space, or one character of a long one.
    # Java's \s is SPACE, and matches faster than the class.
    found = F.regexp_extract_all(
        line, F.lit(f"(?s)(?=(\\S.{{0,{chars - 1}}}+))(?:\\S{{1,{chars}}}+(?!\\S)\\s*+|\\S)"), F.lit(1)
    )
    return F.sort_array(F.array_distinct(F.transform(found, lambda s: F.xxhash64(s))))


def line_bands(shingles: Column, bands: int = BANDS, values: int = BAND_VALUES) -> Column:
    """Keys of a line: hashes of neighbours among its lowest shingle hashes; of a short line, all its hashes."""
    last = F.least(F.size(shingles) - values, F.lit(bands - 1))
    neighbours = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(shingles, i + k) for k in range(values)])
    )
    return F.when(F.size(shingles) < values, shingles).otherwise(neighbours)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def parity_words(shingles: Column, words: int = WORDS) -> list[Column]:
    """A bitmap of ``64 * words`` bits, each the parity of the shingles that fall on it."""

    def word(k: int) -> Column:
        def flip(bits: Column, s: Column) -> Column:
            here = F.shiftright(s, 6).bitwiseAND(words - 1) == k
            return F.when(here, bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), s.bitwiseAND(63).cast("int")))).otherwise(bits)

        return F.aggregate(shingles, F.lit(0).cast("bigint"), flip)

    return [word(k).alias(f"o{k}") for k in range(words)]


def repeated_lines(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text",
    chars: int = SHINGLE_CHARS, bands: int = BANDS, percent: int = JACCARD_PERCENT,
) -> DataFrame:
    """``id``, ``copy`` and ``dropped``: the sorted numbers (from 0) of the lines to remove.

    Only documents that lose lines have a row; ``copy`` is the hash of the text. The first
    line of a group is the one of the smallest id (NULL before others), then ``copy``, then
    number; rows repeated whole are one document and keep the same lines. Lines without a
    word and NULL texts take no part; an empty table gives no row. The whole of every line is
    read, however long.

    Copies of one line beyond a ten-thousandth of all lines are set aside before the bands
    (they are linked by being equal), so no line's copies pile up in one task. There can be
    ten thousand such lines at most, which bounds what is broadcast.
    """
    place = F.struct("id", "copy", "pos")
    occurrences = cut(_lines(docs, id_column, text).select("id", "copy", "pos", "h"))
    counted = occurrences.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    total = occurrences.count()
    hot = counted.filter(F.col("n") * HOT_SHARE > total).select("h", "first")
    lines = _lines(docs, id_column, text).join(F.broadcast(hot), "h", "left")
    lines = lines.filter(F.col("first").isNull() | F.col("first").eqNullSafe(place))
    keys = _once(line_shingles(F.col("line"), chars), lambda s: line_bands(s, bands))
    members = lines.select(F.explode(keys).alias("key"), F.col("h").alias("id"))
    known: list[DataFrame] = []  # the sets of lines that share a key

    def features(ids: DataFrame) -> DataFrame:
        ids = held(ids)
        if ids.count() <= SENT_IDS:  # else texts go where their ids are
            ids = F.broadcast(ids)
        wanted = _lines(docs, id_column, text).select(F.col("h").alias("id"), "line").join(ids, "id", "left_semi")
        sets = wanted.dropDuplicates(["id"]).select("id", line_shingles(F.col("line"), chars).alias("set"))
        known.append(held(sets.select("id", "set", F.size("set").alias("n"), *parity_words(F.col("set")))))
        return known[0]

    def finer(ids: DataFrame) -> DataFrame:
        again = F.sort_array(F.transform("set", lambda s: F.xxhash64(F.lit(1), s)))
        return known[0].join(ids, "id", "left_semi").select("id", _once(again, lambda s: line_bands(s, FINER, FINER_VALUES)).alias("finer"))

    def plausible(a: str, b: str) -> Column:
        left, right = F.col(f"{a}_n"), F.col(f"{b}_n")
        differ = sum(F.bit_count(F.col(f"{a}_o{k}").bitwiseXOR(F.col(f"{b}_o{k}"))) for k in range(WORDS))
        close = 100 * F.least(left, right) >= percent * F.greatest(left, right)
        # Of similar sets at most this share of both is on one side only, and a bit flips for one of these.
        return close & ((100 + percent) * differ <= (100 - percent) * (left + right))

    def close(a: str, b: str) -> Column:
        both = F.size(F.array_intersect(f"{a}_set", f"{b}_set"))
        return 100 * both >= percent * (F.size(f"{a}_set") + F.size(f"{b}_set") - both)

    def verify(pairs: DataFrame) -> DataFrame:
        left, right = (known[0].select(F.col("id").alias(s), F.col("set").alias(f"{s}_set")) for s in "ab")
        return held(pairs.join(left, "a").join(right, "b").filter(close("a", "b")).select("a", "b"))

    roots = linked_components(members, features, plausible, verify, finer, close=close).withColumnRenamed("id", "h")
    grouped = cut(
        occurrences.join(roots, "h", "left").select(
            "id", "copy", "pos", F.coalesce("root", "h").alias("line_group")
        )
    )
    stays = grouped.groupBy("line_group").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    losing = grouped.join(stays.filter("n > 1"), "line_group").filter(~F.col("first").eqNullSafe(place))
    return losing.groupBy("id", "copy").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def deduplicate_lines(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", **settings: int
) -> DataFrame:
    """The documents with their repeated lines removed, all other columns as they are.

    A document that loses no line is unchanged; one that loses all its lines keeps the empty
    text, or its blank lines if it had any.
    """
    found = repeated_lines(docs, id_column, text, **settings).select(
        F.col("id").alias("_lines_id"), F.col("copy").alias("_lines_copy"), F.col("dropped").alias("_lines_dropped")
    )
    same = docs[id_column].eqNullSafe(found["_lines_id"]) & (F.xxhash64(text_of(text)) == found["_lines_copy"])
    joined = docs.join(found, same, "left").withColumn("_lines_all", F.split(text, "\n"))
    numbers = F.array_except(F.sequence(F.lit(0), F.size("_lines_all") - 1), F.col("_lines_dropped"))
    left = F.array_join(F.transform(numbers, lambda i: F.get("_lines_all", i)), "\n")
    cleaned = F.when(F.col("_lines_dropped").isNotNull(), left).otherwise(F.col(text))
    return joined.withColumn(text, cleaned).select(*docs.columns)
