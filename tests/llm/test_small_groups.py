"""Quality thresholds of small sources next to a hot one."""

import random

from tallyhouse.llm import quality


def test_a_small_source_is_judged_by_its_own_documents(spark):
    rng = random.Random(21)

    def text(mark):
        return " ".join(rng.choice("lorem ipsum dolor sit amet".split()) + str(rng.randrange(500)) + mark for _ in range(60))

    rows = [(i, text(""), "en", "hot") for i in range(300)]
    rows += [(1000 + i, text("#"), "en", "code") for i in range(20)]
    rows += [(2000 + i, text("#"), "en", "table") for i in range(4)]
    rows += [(3000, text("####"), "en", "code"), (4000, text("#"), "en", "single")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.id: r.kept for r in quality.judge(frame).collect()}
    assert all(kept[i] for i in kept if i < 3000)
    assert not kept[3000]  # its own source's fences reject it
    assert not kept[4000]  # no quartiles of its own: judged by its language
