"""Token counts where a long pre-token stands in every document."""

import public_tokenizers
from sentencepiece import SentencePieceProcessor

from tallyhouse.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_a_long_separator_in_every_document_is_counted_up_front(spark, monkeypatch):
    separator = "=" * 60 + "-" * 20
    url = "https://example.org/" + "a1b2" * 20
    rows = [(i, f"{separator}\nsome words {i}\n{separator}\n{url} x{i * 7919}") for i in range(200)]
    rows += [(500, None), (501, ""), (502, separator), (503, "日本語" * 40), (504, "日本語" * 40)]
    sent = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(tokens, "COMMON", 300)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = SentencePieceProcessor(model_file=PATH)
    found = {r.id: r.n_tokens for r in tokens.count_tokens(frame, PATH).collect()}
    assert found == {i: len(model.encode(text or "")) for i, text in rows}
    assert sum(name.startswith("\n") and len(name) > 1 for name in sent[0]) >= 2
    assert all(len(name.encode()) <= tokens.SENT_BYTES + 1 for name in sent[0])
