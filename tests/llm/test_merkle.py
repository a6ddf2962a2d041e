"""Merkle manifest: log, proofs and roots against a tree built in plain Python."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import merkle, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, index int"


def _hash(parts):
    return sha256("".join(parts).encode()).hexdigest()


def _levels(leaves):
    """All levels of a tree, the single node last."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([_hash(low[i : i + 16]) for i in range(0, len(low), 16)])
    return levels


def _postorder(levels, level, number):
    if level:
        for k in range(16 * number, min(16 * number + 16, len(levels[level - 1]))):
            yield from _postorder(levels, level - 1, k)
    yield levels[level][number]


def _path(levels, number):
    for level in levels[:-1]:
        run = number // 16 * 16
        yield level[run:number], level[number + 1 : run + 16]
        number //= 16


def _leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return _hash("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def _expected(rows):
    """Result rows by brute force: rows are tuples of DOCS."""
    trees = {}
    for row in rows:
        trees.setdefault(row[3], []).append(row)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for name in names:
        ordered = sorted(trees[name], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[1])))
        built[name] = (ordered, _levels([_leaf(r, r[1]) for r in ordered]))
    forest = _levels([built[name][1][-1][0] for name in names])
    out = []
    for place, name in enumerate(names):
        ordered, levels = built[name]
        for number, row in enumerate(ordered):
            path = [*_path(levels, number), *_path(forest, place)]
            text = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = _leaf(row, text)
            for left, right in path:
                folded = _hash([*left, folded, *right])
            siblings = [d for left, right in path for d in [*left, *right]]
            leaf = levels[0][number]
            out.append((row[0], leaf, levels[-1][0], forest[-1][0], _hash(siblings), folded, folded == forest[-1][0]))
    return sorted(out, key=str)


def _rows(rng, sizes):
    rows, number = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "Some Text", "kein grosser", "ÄÖ Üß é", "line\nTwo" * rng.randrange(40)])
            rows.append((number, text, rng.choice(["en", None]), source, rng.choice([None, 7]), "x", "y", 3))
            number += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 31, 255, 256, 257, 272, 273, 4095, 4096])
def test_positions_are_those_of_the_postorder(n):
    leaves = [sha256(str(i).encode()).hexdigest() for i in range(n)]
    levels, height = _levels(leaves), merkle.tree_height(n)
    assert len(levels) == height + 1
    log = [d.hex() for d in merkle.in_completion_order([bytes.fromhex(d) for d in leaves], height)]
    assert log == list(_postorder(levels, height, 0))
    for level, nodes in enumerate(levels):
        for number, digest in enumerate(nodes):
            assert log[merkle.position(level, number, n, height)] == digest


def test_the_log_of_several_tiers_is_one_postorder(spark):
    sizes = {"a": 1, "b": 16, "c": 17, "d": 300, "e": 256}
    rows = [(t, i, n, sha256(f"{t}{i}".encode()).digest()) for t, n in sizes.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "tree string, index long, total long, digest binary").repartition(3)
    tiers = merkle.grow(frame, height=1)
    assert len(tiers) == 3
    found = merkle.append_log(tiers, height=1).collect()
    for tree, n in sizes.items():
        levels = _levels([sha256(f"{tree}{i}".encode()).hexdigest() for i in range(n)])
        log = sorted((r for r in found if r.tree == tree), key=lambda r: r.position)
        assert [r.position for r in log] == list(range(len(log)))
        assert [r.digest.hex() for r in log] == list(_postorder(levels, len(levels) - 1, 0))


def _result(frame):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


def test_the_registered_query_equals_brute_force(spark, tmp_path):
    """NULLs in every column, empty texts, a hot source, repeated rows and ids, clashing names."""
    rng = random.Random(8)
    rows = _rows(rng, {None: 3, "hot": 300, "": 1, "é": 16, "z": 17, "Z": 2, **{f"s{i}": 1 + i % 3 for i in range(30)}})
    rows += rows[:3] + [(5, "Other Text With That Id", "en", "hot", 1, "", "", 0), (None, "NO id", None, "hot", None, None, None, None)]
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    expected = _expected(rows)
    found = _result(queries.QUERIES["op13_merkle_manifest"](spark, str(tmp_path)))
    assert found == expected
    assert any(not r[-1] for r in expected) and any(r[-1] for r in expected)


def test_small_builders_in_several_tiers_give_the_same_rows(spark):
    rows = _rows(random.Random(9), {"hot": 700, "b": 20, None: 1, **{f"s{i}": 2 for i in range(40)}})
    frame = spark.createDataFrame(rows, DOCS)
    leaf = merkle.row_digest(["doc_id", "source", "lang", "n_chars", "text"])
    found = merkle.manifest(frame, leaf, "doc_id", "source", height=1, with_siblings=True).collect()
    expected = {r[0]: r for r in _expected(rows)}
    for r in found:
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == expected[r.id][1:5]
        assert r.verified and r.folded_root == r.root and _hash([r.siblings]) == r.proof_sha256
    assert len(found) == len(rows)


def test_one_row_and_an_empty_table(spark):
    row = (4, None, None, None, None, "x", "y", 1)
    leaf = merkle.row_digest(["doc_id", "text"])
    (found,) = merkle.manifest(spark.createDataFrame([row], DOCS), leaf, "doc_id", "source").collect()
    assert found.leaf == found.subroot == found.root == found.folded_root == _hash(["1:4", "-"])
    assert found.proof_sha256 == _hash([])
    assert merkle.manifest(spark.createDataFrame([], DOCS), leaf, "doc_id", "source").collect() == []


def test_a_changed_row_is_found_out(spark):
    frame = spark.createDataFrame([(i, "same text", "en", "s", 1, "", "", 0) for i in range(40)], DOCS)
    columns = ["doc_id", "text"]
    other = merkle.row_digest(columns, text=F.when(F.col("doc_id") == 7, "Same text").otherwise(F.col("text")))
    found = merkle.manifest(frame, merkle.row_digest(columns), "doc_id", "source", other).collect()
    assert [r.id for r in found if not r.verified] == [7]
