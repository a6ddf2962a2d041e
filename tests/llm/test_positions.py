"""Lines without white space: shingles from inside long words against brute force."""

import random

from tallyhouse.llm import lines
from tests.llm import test_sets as sets


def test_lines_without_spaces_equal_brute_force(spark):
    rng = random.Random(31)
    long = "".join(rng.choices("abcdefghijkmnopqrstuvwxyz0123456789", k=200))
    texts = [
        "https://www.a.org/x\nself.assertEqual(a,b)\nshort", "https://www.b.com/y\nself.assertEqual(c,d)\nshort",
        f"{long}\nx = self.assertEqual(first,second)", f"a!{long[2:]}\nx = self.assertEqual(third,fourth)",
        "日本語の文章は空白なしで書かれる一行目です\n🙂🙂a" + long, "日本語の文章は空白なしで書かれ別の二つ目だ\n🙂🙂b" + long,
    ]
    texts += ["\n".join(" ".join(sets._words(rng, 12)) for _ in range(3)) for _ in range(6)]
    texts.append(texts[-1].replace("alpha", "Alpha", 1))
    rows = list(enumerate(texts))
    expected = sets._brute_lines(rows)
    found = lines.repeated_lines(sets._docs(spark, rows)).collect()
    assert {r.id: list(r.dropped) for r in found} == expected
    assert 0 not in expected.get(1, ()) and 1 not in expected[1] and 0 in expected[3]


def test_large_groups_with_little_in_common_are_divided(spark, monkeypatch):
    """Hundreds of lines share a phrase: their bands' groups are split by other bands, and no link is lost."""
    from tallyhouse.llm import common

    monkeypatch.setattr(common, "SPLIT", 8)
    rng = random.Random(32)
    phrase = "all of these lines begin with one and the same phrase"
    texts = [f"{phrase} {' '.join(sets._words(rng, 7))}" for _ in range(150)]
    texts += [t.replace(t.split()[-1], "edited") for t in texts[:40]] + [texts[3]]
    rows = list(enumerate(texts))
    found = {r.id: list(r.dropped) for r in lines.repeated_lines(sets._docs(spark, rows)).collect()}
    expected = sets._brute_lines(rows)
    assert found == expected and len(expected) > 20


def test_the_parity_bound_refuses_no_link(spark):
    rng = random.Random(33)
    rows = []
    for i in range(300):
        base = [rng.randrange(-(2**63), 2**63) for _ in range(rng.randrange(1, 120))]
        other = sorted({*base[rng.randrange(0, 1 + len(base) // 6):], *(rng.randrange(-(2**63), 2**63) for _ in range(rng.randrange(0, 1 + len(base) // 8)))})
        rows.append((sorted(set(base)), other or [1]))
    frame = spark.createDataFrame(rows, "x array<long>, y array<long>")
    from pyspark.sql import functions as F

    words = frame.select("x", "y", F.array(*lines.parity_words(F.col("x"))).alias("a"), F.array(*lines.parity_words(F.col("y"))).alias("b"))
    for r in words.collect():
        differ = sum(((u ^ v) & (2**64 - 1)).bit_count() for u, v in zip(r.a, r.b))
        assert differ <= len({*r.x} ^ {*r.y})
        folded = [0] * lines.WORDS
        for s in r.x:
            folded[(s >> 6) & (lines.WORDS - 1)] ^= 1 << (s & 63)
        assert [v & (2**64 - 1) for v in r.a] == folded
