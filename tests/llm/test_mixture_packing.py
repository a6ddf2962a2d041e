"""Packed sequences follow the mixture that the stage before decided."""

from collections import Counter, defaultdict

import public_tokenizers

import corpus_pipeline
from tallyhouse.llm import mixing, packing
from tallyhouse.llm.queries import TARGETS
from pyspark.sql import functions as F

PACK = public_tokenizers.path("word_bpe_49k.json")


def test_source_shares_of_every_range_follow_the_targets(spark):
    sizes = {"hot": 2400, "x": 400, "y": 400}  # the hot one has three quarters of the rows
    source = {i: s for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))}
    frame = spark.createDataFrame([(i, "a few words", s) for i, s in source.items()], "doc_id long, text string, source string")
    mixed = mixing.in_mixture_order(frame, {"hot": 2, "x": 1, "y": 1}, position="place", block_rows=4)
    pieces = packing.cut_pieces(mixed.repartition(6, F.rand(2)), PACK, order="place")
    rows = packing.pack(pieces.localCheckpoint(), group_pieces=100, order="place", step=20).collect()
    assert sorted(r.doc_id for r in rows) == sorted(source) and "place" not in rows[0].asDict()
    groups = defaultdict(Counter)
    for r in rows:
        groups[r.sequence_id >> 32][source[r.doc_id]] += 1
    assert sorted(groups) == list(range(32))
    for g in range(15):  # x and y end after 1600 of the rows
        for name, share in (("hot", 2), ("x", 1), ("y", 1)):
            assert abs(groups[g][name] - sum(groups[g].values()) * share / 4) <= 8, (g, groups[g])


def test_one_position_that_holds_most_rows_is_dealt_out(spark):
    rows = [(i, 0, 10, 7) for i in range(1000)] + [(5000 + i, 0, 10, 1000 + i) for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, piece int, length long, place long")
    found = packing.pack(frame, group_pieces=50, order="place", step=4).collect()
    assert len(found) == 1100
    assert max(Counter(r.sequence_id >> 32 for r in found).values()) <= 150


def test_the_last_stages_depend_on_the_targets(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} here", f"src{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    monkeypatch.setattr(packing, "RANGE_PIECES", 100)
    monkeypatch.setattr(packing, "RANGE_STEP", 64)

    def packed(name, targets):
        monkeypatch.setattr(corpus_pipeline, "TARGETS", targets)
        corpus_pipeline.mix_sources(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        out = corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/{name}"), "")
        return {r.doc_id: r.sequence_id >> 32 for r in out.collect()}

    mostly = [packed(s, {s: 50, "src1": 1}) for s in ("src0", "src2")]
    first = [Counter(d % 3 for d, g in found.items() if g == 0) for found in mostly]
    assert first[0][0] > 2 * first[0][2] and first[1][2] > 2 * first[1][0]
