"""Quality rules whose thresholds adapt to each language and source, in built-in expressions.

Four measures of every document (symbols per word, share of repeated lines, share of words
in repeated five-word windows, mean word length) go into quantile sketches per language and
source. A sketch counts values in buckets whose bounds grow by a fixed factor, so it has a
fixed relative error, is a plain grouped count, merges by adding and does not depend on the
order of the rows. The outer fences of each sketch are the thresholds, joined back to the
documents. Every group that has quartiles uses its own sketch, whatever its size; one with
fewer than four documents has none and takes the merged sketch of its language, and such a
language that of the whole corpus.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import SPACE, cut, text_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
# Fixed value: the characters counted as symbols.
SYMBOLS = "[#*$%&|<>]"
_ZERO = -(2**31)  # bucket of the value 0

MEASURES = ("symbols", "lines", "repeats", "length")


@dataclass(frozen=True)
class Fences:
    """How far outside the middle half of its group a document may lie.

    A measure is out of bounds above ``q75 + reach * spread`` (mean word length also below
    ``q25 - reach * spread``), with ``spread = max(q75 - q25, least[measure])``. ``few`` is
    the number of documents below which a group has no quartiles and uses the next larger
    one's sketch, and ``growth`` the factor between bucket bounds.
    """

    reach: float = 3.0
    least: dict = field(
        default_factory=lambda: {"symbols": 0.1, "lines": 0.1, "repeats": 0.05, "length": 1.0}
    )
    few: int = 4
    growth: float = 1.02


def document_measures(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text",
    lang: str = "lang", source: str = "source",
) -> DataFrame:
    """``id``, ``lang``, ``source``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines``,
    ``n_dup_lines``, ``n_repeat_words`` of every row, from its whole text, without a shuffle.

    NULL text is empty and gives zeros. Windows are told apart by a 64-bit hash.
    """
    rows = docs.select(
        F.col(id_column).alias("id"), F.col(lang).alias("lang"), F.col(source).alias("source"),
        text_of(text).alias("text"),
    )
    words = F.array_remove(F.split("text", f"[{SPACE}]+"), "")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    rows = rows.withColumns({"words": words, "lines": lines})
    starts = F.sequence(F.lit(0), F.size("words") - WINDOW)
    hashes = F.when(
        F.size("words") >= WINDOW,
        F.transform(starts, lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("windows", hashes)
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(repeated, placed))
    alike = F.filter(
        "placed",
        lambda x, j: (F.get("placed", j - 1)["h"] == x["h"]) | (F.get("placed", j + 1)["h"] == x["h"]),
    )
    rows = rows.withColumn("found", F.sort_array(F.transform(alike, lambda x: x["i"])))
    covered = F.aggregate(
        "found",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda state, i: F.struct(
            (state["n"] + F.least(F.lit(WINDOW), i - state["last"])).alias("n"), i.alias("last")
        ),
        lambda state: state["n"],
    )
    return rows.select(
        "id", "lang", "source",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("text", f"[{SPACE}]+", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def judge(
    docs: DataFrame, fences: Fences | None = None, id_column: str = "doc_id", text: str = "text",
    lang: str = "lang", source: str = "source",
) -> DataFrame:
    """The measures of every row with ``base_failed`` and ``kept``.

    ``base_failed``: fewer than ten words, or more than 20 % of the words in repeated
    windows. Of the others, those within all fences of their language and source are kept.
    Documents that fail the base rules are not in the sketches. NULL languages and sources
    are groups like any other; repeated rows count each; an empty table gives no row.
    """
    fences = fences or Fences()
    rows = cut(document_measures(docs, id_column, text, lang, source))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    rows = rows.withColumn("base_failed", failed)
    bounds = thresholds(rows.filter(~F.col("base_failed")), fences).alias("bounds")
    joined = rows.alias("rows").join(
        bounds,
        F.col("rows.lang").eqNullSafe(F.col("bounds.lang"))
        & F.col("rows.source").eqNullSafe(F.col("bounds.source")),
        "left",
    )
    inside = F.lit(True)
    for name, value in _measures().items():
        low, high = F.col(f"bounds.{name}_low"), F.col(f"bounds.{name}_high")
        inside = inside & (value <= high) & (value >= low)
    return joined.select(
        *[F.col(f"rows.{c}") for c in rows.columns],
        (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"),
    )


def _measures() -> dict[str, Column]:
    words, lines = F.col("n_words"), F.col("n_lines")
    parts = (("n_symbols", words), ("n_dup_lines", lines), ("n_repeat_words", words), ("word_chars", words))
    ratios = (F.try_divide(part, whole) for part, whole in parts)  # NULL without a word
    return dict(zip(MEASURES, ratios))


def thresholds(rows: DataFrame, fences: Fences) -> DataFrame:
    """One row per language and source with the bounds ``<measure>_low`` and ``<measure>_high``."""
    values = rows.select(
        "lang", "source",
        F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), v.alias("x")) for n, v in _measures().items()])),
    )
    bucket = F.when(F.col("x") <= 0, F.lit(_ZERO)).otherwise(
        F.ceil(F.log("x") / log(fences.growth)).cast("int")
    )
    counts = values.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    counts = cut(counts)
    found = None
    for keys in (["lang", "source"], ["lang"], []):
        merged = counts.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        bounds = _bounds(merged, keys, fences)
        if found is None:
            found = bounds
            continue
        same = F.lit(True)
        for key in keys:
            same = same & F.col(f"own.{key}").eqNullSafe(F.col(f"wider.{key}"))
        measure = F.col("own.measure") == F.col("wider.measure")
        few = F.col("own.total") < fences.few
        found = found.alias("own").join(bounds.alias("wider"), same & measure).select(
            "own.lang", "own.source", "own.measure",
            *[F.when(few, F.col(f"wider.{c}")).otherwise(F.col(f"own.{c}")).alias(c) for c in ("total", "low", "high")],
        )
    picks = [
        F.max(F.when(F.col("measure") == name, F.col(side))).alias(f"{name}_{side}")
        for name in MEASURES for side in ("low", "high")
    ]
    return found.groupBy("lang", "source").agg(*picks)


def _bounds(sketch: DataFrame, keys: list[str], fences: Fences) -> DataFrame:
    """Fences of each group of a sketch ``(keys, measure, bucket, n)``, with its ``total``."""
    group = Window.partitionBy(*keys, "measure")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sketch.withColumns({"total": F.sum("n").over(group), "upto": F.sum("n").over(upto)})
    g = fences.growth
    value = F.when(F.col("bucket") == _ZERO, 0.0).otherwise(
        F.pow(F.lit(g), F.col("bucket")) * (2 / (g + 1))
    )
    def quantile(p: float) -> Column:
        return F.min(F.when(F.col("upto") >= p * F.col("total"), value))

    found = rows.groupBy(*keys, "measure").agg(
        F.max("total").alias("total"), quantile(0.25).alias("q25"), quantile(0.75).alias("q75")
    )
    least = F.create_map(*[F.lit(x) for item in fences.least.items() for x in item])
    spread = F.greatest(F.col("q75") - F.col("q25"), least[F.col("measure")])
    low = F.when(F.col("measure") == "length", F.col("q25") - fences.reach * spread).otherwise(0.0)
    return found.select(
        *keys, "measure", "total", low.alias("low"), (F.col("q75") + fences.reach * spread).alias("high")
    )


def keep_good(docs: DataFrame, fences: Fences | None = None) -> DataFrame:
    """The documents that are kept, with their own columns; rows that share an id are judged alike."""
    good = judge(docs, fences).filter("kept").select("id").distinct()
    return docs.join(good, docs["doc_id"].eqNullSafe(good["id"]), "left_semi")
