"""The registered queries and the pipeline over a small folder, against brute force."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tallyhouse.llm import pii, quality, secrets
from tallyhouse.llm.queries import COUNT_MODEL, PACK_TOKENIZER, TARGETS
from tests.llm.test_sets import _brute_lines, _roots, _set
from tests.llm.test_texts import ODD, _base_personal, _base_secrets
from tests.oracle import compare, connect

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, key long, h int"
LONG = "long text without an end " * 4000


def _write(spark, folder, rows):
    made = [(i, t, lang, source, len(t or ""), "clash", 0, 0) for i, t, lang, source in rows]
    spark.createDataFrame(made, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def _corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 110").collect()
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs]
    rows += [(10_000 + i, t, [None, "en"][i % 2], ["src0", None, "src3"][i % 3]) for i, t in enumerate(ODD + [LONG, LONG])]
    return rows


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = _corpus(spark)
    return rows, _write(spark, tmp_path_factory.mktemp("corpus"), rows)


def _run(spark, name, folder):
    return entry.queries()[name](spark, folder).collect()


def _digest(spans):
    return sha256(",".join(f"{kind}:{start}:{end}" for start, kind, end in spans).encode()).hexdigest()


def test_op1_equals_its_sql(spark, tmp_path):
    turns = [(1, 0, "user", "a\\b [INST] </s>"), (1, 1, "assistant", "<<SYS>>é🙂\n"), (2, 0, None, None), (2, 1, "tool", "[SAYS]"),
             (3, 2, "assistant", None), (3, 1, "user", ""), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "x" * 50_000),
             (5, 0, "user", "same"), (5, 0, "user", "same"), (5, None, "assistant", "first"), (None, 0, "user", "no id")]
    frame = spark.createDataFrame([(*t, "clash", True) for t in turns], "conv_id long, turn long, role string, text string, segments string, valid boolean")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    duck = connect("/root/testdata/sf0.001")
    duck.execute(f"CREATE OR REPLACE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert compare(entry.queries()["op1_chat_format"](spark, str(tmp_path)), duck, entry.oracle_sql()["op1_chat_format"]) is None


def test_op3_and_op8_digests(spark, corpus):
    rows, folder = corpus
    texts = {i: t or "" for i, t, *_ in rows}
    found = {r.doc_id: r for r in _run(spark, "op3_secrets", folder)}
    assert set(found) == set(texts)
    for i, t in texts.items():
        base, counts = _base_secrets(t), Counter(k for _, k, _ in _base_secrets(t))
        r = found[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(counts[k] for k in secrets.KINDS[:3])
        assert r.base_sha256 == _digest(base)
        assert {f"{k}:{s}:{e}" for s, k, e in base} <= set(r.spans.split(","))
    found = {r.doc_id: r for r in _run(spark, "op8_personal_data", folder)}
    assert set(found) == set(texts)
    for i, t in texts.items():
        base = [(s, pii.KINDS[k], e) for s, k, e in _base_personal(t)]
        counts, r = Counter(k for _, k, _ in base), found[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in pii.KINDS)
        assert r.base_sha256 == _digest(base)
        assert {f"{k}:{s}:{e}" for s, k, e in base} <= set(r.spans.split(","))


def _words(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_op4_measures_and_base_rules(spark, corpus):
    rows, folder = corpus
    found = {r.doc_id: r for r in _run(spark, "op4_quality", folder)}
    assert set(found) == {i for i, *_ in rows}
    for i, t, *_ in rows:
        words, r = _words(t), found[i]
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        repeated = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if _words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(words) < 10 or 100 * len(repeated) > 20 * len(words))
        assert not (r.base_failed and r.kept)


def _near(rows):
    sets = {i: _set(t) for i, t, *_ in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, _roots(sets, links)


def test_op6_equals_brute_force(spark, corpus):
    rows, folder = corpus
    sets, roots = _near(rows)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in _run(spark, "op6_near_duplicates", folder)}
    assert found == {i: (len(sets[i]), roots[i], roots[i] == i) for i in sets}


def test_op9_joins_back_to_every_row(spark, tmp_path):
    rng = random.Random(8)
    pool = [" ".join(rng.choice("red green blue black white brown".split()) + str(rng.randrange(30)) for _ in range(rng.randrange(2, 14))) for _ in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", "", "x"]) for _ in range(rng.randrange(1, 7))), "en", "s") for i in range(60)]
    rows += [(90, None, None, None), (91, "", "en", "s"), (92, "\n \n", "en", "s"), (93, "y" * 30_000, "en", "s"), (94, "y" * 30_000, "en", "s")]
    folder = _write(spark, tmp_path, rows)
    gone = _brute_lines([(i, t) for i, t, *_ in rows])
    found = {r.doc_id: (r.n_dropped, r.dropped) for r in _run(spark, "op9_line_dedup", folder)}
    assert found == {i: (len(gone.get(i, ())), ",".join(map(str, gone.get(i, ())))) for i, *_ in rows}


def test_op2_places_every_document(spark, corpus):
    rows, folder = corpus
    found = _run(spark, "op2_mix_sources", folder)
    assert sorted(r.doc_id for r in found) == sorted(i for i, *_ in rows)
    slots = defaultdict(set)
    for r in found:
        slots[r.slot].add((r.source, r.block))
    assert sorted(slots) == list(range(len(slots))) and all(len(own) == 1 for own in slots.values())


def test_op5_ranks_exact_distances(spark):
    folder = "/root/testdata/sf0.001"
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    found, hits, wanted = defaultdict(list), 0, 0
    for r in _run(spark, "op5_neighbours", folder):
        assert r.score == pytest.approx(np.linalg.norm(vectors[r.query_id] - vectors[r.vec_id]), abs=1e-12)
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in vectors if i % 100 == 0}
    for q, own in found.items():
        true = sorted((np.linalg.norm(vectors[q] - v), i) for i, v in vectors.items() if i != q)[:10]
        assert [rank for rank, *_ in sorted(own)] == list(range(1, 11))
        hits, wanted = hits + len({i for _, i in true} & {i for _, i, _ in own}), wanted + len(true)
    assert hits >= 0.9 * wanted


def _pieces(tokenizer, text, size=4096):
    ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
    return [(k, s, len(ids[s : s + size]), zlib.crc32(ids[s : s + size].tobytes())) for k, s in enumerate(range(0, len(ids), size))]


def _check_packing(found, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(PACK_TOKENIZER))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {i: sorted(own) for i, own in pieces.items()} == {i: _pieces(tokenizer, t) for i, t in texts.items()}
    for places in sequences.values():
        ends = np.cumsum([0] + [length for _, length in sorted(places)])
        assert [offset for offset, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= 4096


def test_op7_and_op10_equal_the_libraries(spark, corpus):
    rows, folder = corpus
    texts = {i: t for i, t, *_ in rows}
    _check_packing(_run(spark, "op7_pack", folder), texts)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(COUNT_MODEL))
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in _run(spark, "op10_token_counts", folder)}
    counts = {i: len(model.encode(t or "")) for i, t in texts.items()}
    assert found == {i: (len((t or "").encode()), counts[i], counts[i] > 4096) for i, t in texts.items()}


def test_the_pipeline_equals_its_stages_by_brute_force(spark, corpus):
    rows, folder = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.id for r in quality.judge(docs).filter("kept").collect()}
    good = [(i, t) for i, t, *_ in rows if i in kept]
    gone = _brute_lines(good)
    cleaned = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone.get(i, ())))) for i, t in good]
    cleaned = [(i, t) for i, t in cleaned if _words(t)]
    _, roots = _near(cleaned)
    _check_packing(corpus_pipeline.run(spark, folder).collect(), {i: t for i, t in cleaned if roots[i] == i})
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules" and set(TARGETS) >= {"src0"}


def test_pipeline_of_no_documents_and_of_missing_values(spark, tmp_path):
    empty = _write(spark, tmp_path / "empty", [])
    assert corpus_pipeline.run(spark, empty).collect() == []
    text = " ".join(f"word{i} of{i % 7}" for i in range(60))
    rows = [(None, text, None, None), (7, text, None, "src1"), (7, text, None, "src1"), (8, None, "en", None), (9, "", None, "src1")]
    found = corpus_pipeline.run(spark, _write(spark, tmp_path / "odd", rows)).collect()
    assert {r.doc_id for r in found} <= {None, 7} and 1 <= len(found) <= 2
