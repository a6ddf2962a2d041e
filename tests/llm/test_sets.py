"""Quality rules, line removal and near copies against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import common, lines, neardup, quality

DOCS = "doc_id long, text string, lang string, source string, kept string, n int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "clash", 0) for i, t in rows], DOCS)


def _find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def _roots(nodes, links):
    parent = {n: n for n in nodes}
    for a, b in links:
        a, b = _find(parent, a), _find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: _find(parent, n) for n in nodes}


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)]
    links += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(300)] + [(7, 7)]
    frame = spark.createDataFrame(links + links[:5] + [(None, 3), (3, None)], "a long, b long")
    found = {r.id: r.root for r in common.components(frame).collect()}
    expected = _roots({x for p in links for x in p}, links)
    assert found == {n: r for n, r in expected.items() if n in found}
    assert set(found) == {x for a, b in links if a != b for x in (a, b)}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def _words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n)]


def _set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def _near_copies(rng):
    rows, n = [], 0
    passage = _words(rng, 60)
    for _ in range(25):
        words = _words(rng, rng.randrange(30, 200))
        for _ in range(rng.randrange(1, 6)):
            copy = list(words)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = "edited" + str(rng.randrange(99))
            rows.append((n, " ".join(copy)))
            n += 1
    for _ in range(15):
        rows.append((n, " ".join(_words(rng, 40) + passage + _words(rng, 40))))
        n += 1
    base = _words(rng, 90)
    for _ in range(60):  # copies of one text that are often too far from each other
        copy = list(base)
        for k in rng.sample(range(90), 3):
            copy[k] = "other" + str(rng.randrange(999))
        rows.append((n, " ".join(copy)))
        n += 1
    odd = ["", None, " \n\t ", "one", "ONE", "two words", "Two  Words", "a b c d e", "A B\nC D E", "é É", "É É"]
    return rows + [(n + k, t) for k, t in enumerate(odd)] + [(n + 50, "x " * 30_000), (n + 51, "x " * 30_000)]


def test_near_copies_equal_brute_force(spark):
    rows = _near_copies(random.Random(9))
    random.Random(2).shuffle(rows)
    sets = {i: _set(t) for i, t in rows}
    links = [
        (i, j) for i in sets for j in sets
        if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    expected = _roots(sets, links)
    found = neardup.near_duplicates(_docs(spark, rows).repartition(5)).collect()
    assert {r.id: (r.n_shingles, r.component_id, r.kept) for r in found} == {
        i: (len(sets[i]), expected[i], expected[i] == i) for i in sets
    }


def test_near_copies_of_missing_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(50))
    other = " ".join(f"v{i}" for i in range(50))
    rows = [(None, long), (4, long), (4, other), (2, other), (9, long), (9, long)]
    found = sorted((str(r.id), r.component_id, r.kept) for r in neardup.near_duplicates(_docs(spark, rows)).collect())
    assert found == [
        ("2", 2, True), ("4", 2, False), ("4", 2, False), ("9", 2, False), ("9", 2, False), ("None", None, True),
    ]
    assert neardup.near_duplicates(_docs(spark, [])).collect() == []
    kept = neardup.keep_one_of_each(_docs(spark, rows))
    assert sorted((r.doc_id is None, r.text == other) for r in kept.collect()) == [(False, True), (True, False)]
    assert kept.columns == ["doc_id", "text", "lang", "source", "kept", "n"]
    with pytest.raises(ValueError):
        neardup.near_duplicates(_docs(spark, rows), percent=50)


SPACE = "[\x20\x09-\x0d]"


def _line_set(line):
    """Runs of 12 characters from every word's start, and from inside words as long as they lie within."""
    starts = set()
    for word in re.finditer("[^\x20\x09-\x0d]+", line):
        starts |= {word.start(), *range(word.start(), word.end() - 11)}
    return {line[i : i + 12] for i in starts}


def _brute_lines(rows):
    place = defaultdict(list)
    for i, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if _line_set(line):
                place[line].append((i, pos))
    sets = {line: _line_set(line) for line in place}
    first = {line: min(p) for line, p in place.items()}
    by_first = {p: line for line, p in first.items()}
    nodes = sorted(by_first)
    links = []
    for x, a in enumerate(nodes):
        for b in nodes[:x]:
            u, v = sets[by_first[a]], sets[by_first[b]]
            if 100 * len(u & v) >= 80 * len(u | v):
                links.append((a, b))
    roots = _roots(nodes, links)
    dropped = defaultdict(list)
    for line, places in place.items():
        for p in places:
            if p != roots[first[line]]:
                dropped[p[0]].append(p[1])
    return {i: sorted(p) for i, p in dropped.items()}


def _line_docs(rng):
    pool = [" ".join(_words(rng, rng.randrange(1, 60))) for _ in range(60)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rng.randrange(1, 8)):
            line = rng.choice(pool).split(" ")
            if rng.random() < 0.6:
                line[rng.randrange(len(line))] = "edited" + str(rng.randrange(99))
            own.append(" ".join(line))
        rows.append((i, "\n".join(own + rng.choice([[], [""], ["  ", "license of all"], ["license of all"]]))))
    return rows + [(90, ""), (91, None), (92, "\n\n"), (93, "y" * 50_000), (94, "y" * 50_000 + "\n" + "z y" * 9_000), (95, "é\r\né\r\nx")]


def test_repeated_lines_equal_brute_force(spark):
    rows = _line_docs(random.Random(3))
    expected = _brute_lines(rows)
    found = {r.id: list(r.dropped) for r in lines.repeated_lines(_docs(spark, rows).repartition(4)).collect()}
    assert found == expected
    cleaned = lines.deduplicate_lines(_docs(spark, rows))
    assert cleaned.columns == ["doc_id", "text", "lang", "source", "kept", "n"]
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    for i, text in rows:
        gone = set(expected.get(i, ()))
        assert texts[i] == (None if text is None else "\n".join(l for k, l in enumerate(text.split("\n")) if k not in gone))


def test_lines_of_missing_and_repeated_ids(spark):
    rows = [(None, "only line here"), (1, "only line here\nand more"), (1, "only line here\nand more"), (1, "and more")]
    out = lines.deduplicate_lines(_docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) in (
        [("1", ""), ("1", "and more"), ("1", "and more"), ("None", "only line here")],
        [("1", ""), ("1", ""), ("1", "and more"), ("None", "only line here")],
    )
    assert lines.repeated_lines(_docs(spark, [])).collect() == []
    plan = lines.deduplicate_lines(_docs(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def _measures(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    kept = [l for l in text.split("\n") if re.search("[^\x20\x09-\x0d]", l)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(kept), len(kept) - len(set(kept)), len(covered)


def test_measures_equal_brute_force(spark):
    rng = random.Random(6)
    texts = ["", None, "  \n\t", "a", "a b c d e a b c d e", "# * $ %", "x\u00a0y \u2003z", "\n".join(["same line"] * 4)]
    texts += [" ".join(rng.choice("ab") for _ in range(n)) for n in range(1, 40)] + ["é" * 70_000, "w " * 50_000]
    rows = list(enumerate(texts))
    found = quality.document_measures(_docs(spark, rows)).collect()
    assert {r.id: tuple(r)[3:] for r in found} == {i: _measures(t) for i, t in rows}


def test_each_group_has_its_own_fences(spark):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        source = "code" if i % 3 == 0 else "news"
        words = [rng.choice("lorem ipsum dolor sit amet tempor labore magna".split()) + str(rng.randrange(500)) for _ in range(60)]
        if source == "code":
            words = [w + "#" for w in words]
        rows.append((i, " ".join(words), "en", source))
    rows += [(1000, " ".join(f"magna{100 + i}#" for i in range(60)), "en", "news"), (1001, " ".join(f"magna{100 + i}#" for i in range(60)), "en", "code")]
    rows += [(1002, " ".join(f"magna{100 + i}" for i in range(60)), None, None), (1003, "too short", "en", "code"), (1003, "too short", "en", "code")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    verdict = {r.id: (r.base_failed, r.kept) for r in quality.judge(frame).collect()}
    assert verdict[1000] == (False, False) and verdict[1001] == (False, True)
    assert verdict[1002] == (False, True) and verdict[1003] == (True, False)
    assert all(verdict[i] == (False, True) for i in range(900))
    assert quality.judge(frame).count() == len(rows) and quality.keep_good(frame).count() == 902
    assert quality.judge(frame.limit(0)).collect() == []
    plan = quality.judge(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_sketch_quantiles_are_close_in_any_partitioning(spark):
    frame = spark.range(20_000).select(
        F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(100).alias("n_words"), F.lit(10).alias("n_lines"),
        (F.col("id") % 100).alias("n_symbols"), F.lit(0).alias("n_dup_lines"), F.lit(0).alias("n_repeat_words"),
        F.lit(500).alias("word_chars"),
    )
    fences = quality.Fences(reach=0.0)
    rows = [quality.thresholds(f, fences).head() for f in (frame, frame.repartition(13, F.rand(1)))]
    assert rows[0] == rows[1]
    assert abs(rows[0].symbols_high - 0.74) <= 0.74 * 0.011 and rows[0].lines_high == 0.0
