"""Token counts by pre-token: no document is ever encoded, no ids are made.

A pre-token is a run of spaces with the characters up to the next space, or a line feed.
The vocabulary holds no piece that crosses such a border (checked when the model is
loaded), so a text's tokens are those of its pre-tokens, and each distinct pre-token needs
to be counted once. Pre-tokens with more than a ``COMMON``-th of all uses are at most
``COMMON`` many; they are counted first and sent to every task, so that no word's
occurrences meet in one place. All others are dealt by hash with the documents' frequencies
of them, counted once where they meet, and summed per document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyhouse.llm.common import cut, text_of

COMMON = 1_000_000
SENT_BYTES = 32  # a longer common pre-token is sent as its 128-bit hash
BUCKET_WORDS = 50_000
LOCAL_WORDS = 500_000
LIMIT = 4096
_GAP = b"\xff"  # in no UTF-8 text
_PRETOKEN = re.compile("[ ▁]+[^ ▁\n]*|[^ ▁\n]+|\n")


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, with the space that the library puts in front of it."""
    return _PRETOKEN.findall(" " + text) if text else []


def _sent(word: str) -> str:
    """A pre-token as it is sent to every task: itself, or a line feed and its hash if it is long."""
    raw = word.encode("utf-8", "surrogatepass")
    return word if len(raw) <= SENT_BYTES else "\n" + xxhash.xxh3_128_hexdigest(raw)


class PieceCounter:
    """Pieces per pre-token as the library's model gives them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        if crossing := [p for p in pieces if "\n" in p[1:] or "▁" in p.lstrip("▁")]:
            raise ValueError(f"pieces cross the borders of pre-tokens: {crossing[:3]}")
        self.lead = len(self.model.encode("\n"))

    def count(self, words: list[str]) -> list[int]:
        # Behind a line feed a pre-token stands as it does inside a text.
        found = self.model.encode(["\n" + word for word in words], num_threads=1)
        return [len(ids) - self.lead for ids in found]


def _uses(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter[str] = Counter()

    def flush() -> pd.DataFrame:
        return pd.DataFrame({"word": np.array(list(seen), object), "uses": list(seen.values())})

    for frame in frames:
        for text in frame["text"]:
            seen.update(pretokens(text))
            if len(seen) >= LOCAL_WORDS:
                yield flush()
                seen.clear()
    yield flush()


def count_tokens(
    docs: DataFrame, model_path: str, id_column: str = "doc_id", text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """One row per row: ``id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    NULL and empty texts have no token. Rows are counted one by one, also those that share
    an id; other columns are ignored, and an empty table gives no row.

    The driver receives the common pre-tokens (at most ``COMMON``, those of more than
    ``SENT_BYTES`` bytes as hashes; in practice some ten thousands) with their piece counts.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), text_of(text).alias("text")
    )
    vocabulary = cut(
        rows.select("text").mapInPandas(_uses, "word string, uses bigint")
        .groupBy("word").agg(F.sum("uses").alias("uses"))
    )
    sizes = vocabulary.agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("uses"), F.count("*").alias("words")).first()
    total, words = sizes["uses"], sizes["words"]
    buckets = max(1, -(-words // BUCKET_WORDS))

    def count_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = PieceCounter(model_path)
        for frame in frames:
            words = frame["word"].tolist()
            yield pd.DataFrame({"word": np.array([_sent(w) for w in words], object), "pieces": counter.count(words)})

    common = vocabulary.filter(F.col("uses") * COMMON > total)
    counted = common.select("word").mapInPandas(count_pieces, "word string, pieces int").toPandas()
    known = spark.sparkContext.broadcast(dict(zip(counted["word"], counted["pieces"].tolist())))

    id_kind = to_arrow_type(rows.schema["id"].dataType)
    longs = pa.list_(pa.int64())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A parcel with every row's id, size and common tokens, and one per bucket of rare words."""
        pieces = known.value
        for batch in batches:
            numbers, texts = batch.column("row").to_pylist(), batch.column("text").to_pylist()
            sums, rare = [], [[] for _ in range(buckets)]
            for number, text in zip(numbers, texts):
                found = 0
                for word, uses in Counter(pretokens(text)).items():
                    name = word if len(word) <= SENT_BYTES // 4 else _sent(word)
                    if name in pieces:
                        found += uses * pieces[name]
                    else:
                        raw = word.encode("utf-8", "surrogatepass")
                        rare[xxhash.xxh3_64_intdigest(raw) % buckets].append((raw, number, uses))
                sums.append(found)
            parcels = [(-1, b"", numbers, sums)]
            for bucket, entries in enumerate(rare):
                if entries:
                    words, places, uses = zip(*sorted(entries))
                    parcels.append((bucket, _GAP.join(words), places, uses))
            sizes = [len(text.encode("utf-8", "surrogatepass")) for text in texts]
            ends = pa.array([0] + [len(numbers)] * len(parcels), pa.int32())
            columns = [pa.array(c, k) for c, k in zip(zip(*parcels), (pa.int32(), pa.binary(), longs, longs))]
            columns += [pa.ListArray.from_arrays(ends, v) for v in (batch.column("id"), pa.array(sizes, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "words", "numbers", "uses", "ids", "sizes"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, pieces, current = PieceCounter(model_path), {}, None
        for batch in batches:
            for k, (bucket, raw) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist())):
                numbers, uses, ids, sizes = (batch.column(c)[k].values for c in ("numbers", "uses", "ids", "sizes"))
                if bucket >= 0:
                    if bucket != current:
                        pieces, current = {}, bucket
                    words = raw.split(_GAP)
                    new = list({w for w in words if w not in pieces})
                    pieces.update(zip(new, counter.count([w.decode("utf-8", "surrogatepass") for w in new])))
                    found = np.fromiter(map(pieces.__getitem__, words), np.int64, len(words)) * uses.to_numpy()
                    order, place = np.unique(numbers.to_numpy(), return_inverse=True)
                    numbers = pa.array(order)
                    uses = pa.array(np.bincount(place, weights=found).astype(np.int64))
                    ids, sizes = pa.nulls(len(order), id_kind), pa.array(np.zeros(len(order), np.int64))
                yield pa.RecordBatch.from_arrays([numbers, ids, sizes, uses], ["row", "id", "n_bytes", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    parcels = rows.mapInArrow(
        split,
        "bucket int, words binary, numbers array<bigint>, uses array<bigint>, "
        f"ids array<{kind}>, sizes array<bigint>",
    )
    spread = F.when(F.col("bucket") < 0, -F.element_at("numbers", 1) - 1).otherwise(F.col("bucket"))
    dealt = parcels.repartition(spread).sortWithinPartitions("bucket")
    sums = dealt.mapInArrow(add_up, f"row bigint, id {kind}, n_bytes bigint, n_tokens bigint").groupBy("row")
    sums = sums.agg(F.max("id").alias("id"), *[F.sum(c).alias(c) for c in ("n_bytes", "n_tokens")])
    return sums.select("id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
