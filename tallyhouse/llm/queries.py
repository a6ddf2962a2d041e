"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import (
    chat, differencing, lines, merkle, mixing, neardup, neighbours, packing, periodic, pii, quality, secrets, tokens,
)
from tallyhouse.llm.common import SPACE

QUERIES = {}
ORACLES = {}
PACK_TOKENIZER, COUNT_MODEL = "word_bpe_49k.json", "piece_bpe_32k.model"
EQUAL_TOKENIZER = "byte_bpe_50k.json"
# The mixture: the one large source gets a fifth of the slots, every other source an equal share.
TARGETS = {"src0": 19, **{f"src{i}": 4 for i in range(1, 20)}}


def _query(build):
    QUERIES[build.__name__] = build
    return build


def _op1_sql() -> str:
    """The conversations as text in plain SQL: marks around escaped texts, learnt texts as they are."""
    template = chat.LLAMA_LIKE

    def escaped(column: str) -> str:
        text = f"replace({column}, '\\', '\\\\')"
        for mark in template.marks():  # no two of them overlap
            text = f"replace({text}, '{mark}', '{mark[0]}\\{mark[1:]}')"
        return text

    before, says, after = template.other
    own = " ".join(
        f"WHEN '{name}' THEN '{marks.opening}' || {escaped('said')} || '{marks.closing}'"
        for name, marks in template.roles.items()
    )
    learnt = ", ".join(f"'{name}'" for name, marks in template.roles.items() if marks.loss)
    return f"""
WITH turns AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS said FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
written AS (
  SELECT *, CASE role {own} ELSE '{before}' || {escaped('role')} || '{says}' || {escaped('said')} || '{after}' END AS whole,
    CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS letter
  FROM turns),
told AS (
  SELECT conv_id, COUNT(*) AS n_turns,
    string_agg(role || chr(10) || said || chr(10), '' ORDER BY turn NULLS FIRST, role, said) AS read_back,
    COALESCE(string_agg(said, '' ORDER BY turn NULLS FIRST, role, said) FILTER (role IN ({learnt})), '') AS learnt,
    string_agg(whole, '' ORDER BY turn NULLS FIRST, role, said) AS whole,
    string_agg(letter, '' ORDER BY turn NULLS FIRST, role, said) AS machine
  FROM written GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(read_back) AS turns_sha256, length(learnt) AS loss_chars,
  sha256(learnt) AS loss_sha256, length(whole) AS formatted_chars,
  regexp_full_match(machine, 's?(ua)+') AS valid
FROM told"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_chat_format(spark, sf_dir):
    """Every conversation formatted, and read back from the formatted text."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = chat.format_chat(turns.unionByName(probe))
    out = out.select("conv_id", "valid", chat.formatted(F.col("segments")).alias("text"),
                     chat.loss_text(F.col("segments")).alias("learnt"))
    out = out.withColumn("turns", chat.read_turns(F.col("text")))
    digest = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return out.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("text").cast("bigint").alias("formatted_chars"), "valid",
    )


@_query
def op2_mix_sources(spark, sf_dir):
    """The place of every document in the mixture."""
    return mixing.mix(_table(spark, sf_dir, "documents"), TARGETS).withColumnRenamed("id", "doc_id")


def _joined_spans(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _span_digest(found: DataFrame, base: Column, kinds) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.withColumn("base", base).select(
        F.col("id").alias("doc_id"), *[count(kind) for kind in kinds],
        F.sha2(_joined_spans(F.col("base")), 256).alias("base_sha256"), _joined_spans(F.col("spans")).alias("spans"),
    )


@_query
def op3_secrets(spark, sf_dir):
    """The secrets of every document."""
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    return _span_digest(found, F.filter("spans", lambda s: s["kind"] != "novel"), secrets.KINDS[:3])


@_query
def op4_quality(spark, sf_dir):
    """Measures and verdict of every document."""
    return quality.judge(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@_query
def op5_neighbours(spark, sf_dir):
    """The ten nearest of every hundredth vector among all others."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@_query
def op6_near_duplicates(spark, sf_dir):
    """The group of near copies of every document."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@_query
def op7_pack(spark, sf_dir):
    """The sequence and place of every piece of every document."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(PACK_TOKENIZER))


@_query
def op8_personal_data(spark, sf_dir):
    """The personal data in every document."""
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    return _span_digest(found, F.filter("spans", lambda s: s["base"]), pii.KINDS)


@_query
def op9_line_dedup(spark, sf_dir):
    """Lines of every document, and the numbers of those removed as near-equal to earlier ones."""
    docs = _table(spark, sf_dir, "documents")
    dropped = lines.repeated_lines(docs).withColumnRenamed("id", "_id")
    rows = docs.select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_copy"),
        F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"),
    )
    joined = rows.join(dropped, rows["doc_id"].eqNullSafe(dropped["_id"]) & (rows["_copy"] == dropped["copy"]), "left")
    found = F.coalesce("dropped", F.array().cast("array<int>"))
    return joined.select(
        "doc_id", "n_lines", F.size(found).cast("bigint").alias("n_dropped"), F.array_join(found, ",").alias("dropped")
    )


@_query
def op10_token_counts(spark, sf_dir):
    """Bytes and tokens of every document."""
    counts = tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(COUNT_MODEL))
    return counts.withColumnRenamed("id", "doc_id")


@_query
def op11_pack_near_equal(spark, sf_dir):
    """The sequence and place of every piece of every document, in near-equal windows."""
    docs = _table(spark, sf_dir, "documents")
    packed = differencing.pack_near_equal(docs, public_tokenizers.path(EQUAL_TOKENIZER))
    return packed.withColumnRenamed("id", "doc_id")


def _made_periodic(docs: DataFrame) -> Column:
    """The text, in a tenth of the documents with its words repeated from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        first = (g % n).cast("int")
        period = (1 + F.floor((n - first) / (3 + g % 8))).cast("int")
        places = F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.when(i < first, i).otherwise(first + (i - first) % period)
        )
        chosen = F.transform(places, lambda i: F.get(words, i))
        return F.when(n > 0, F.array_join(chosen, " ")).otherwise("")

    words = F.regexp_extract_all(F.col("text"), F.lit(f"[^{SPACE}]+"), F.lit(0))
    # As the only element of an array, the words are made once and not for every place.
    changed = F.get(F.transform(F.array(words), repeated), 0)
    return F.when((h % 10 == 0) & F.col("text").isNotNull(), changed).otherwise(F.col("text"))


@_query
def op12_periodic_runs(spark, sf_dir):
    """Repetitions in every document, and what is left without them."""
    docs = _table(spark, sf_dir, "documents")
    found = periodic.find_runs(docs.select("doc_id", _made_periodic(docs).alias("text")))
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    )
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    found = found.withColumn("longest", longest)
    length, period = F.col("longest.length"), -F.col("longest.p")
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), (-F.col("longest.s")).alias("start"),
        length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query
def op13_merkle_manifest(spark, sf_dir):
    """Leaf, proof and roots of every document, checked against texts tampered with here and there."""
    docs = _table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaf = merkle.row_digest(columns)
    checked = F.when(tampered, merkle.row_digest(columns, text=lowered)).otherwise(leaf)
    return merkle.manifest(docs, leaf, "doc_id", "source", checked).withColumnRenamed("id", "doc_id")


ORACLES["op1_chat_format"] = _op1_sql()
