"""Tables written to cut lineage."""

import re

from tallyhouse.functions.lineage import stored


def test_stored_rows_and_their_size(spark, capsys):
    rows = spark.createDataFrame([(1, "a"), (2, None), (None, "")], "n bigint, s string")
    wide = rows
    for _ in range(3):
        wide = wide.join(rows.select("n"), "n", "left")
    kept = stored(wide)
    assert kept.schema == wide.schema
    assert sorted(kept.collect(), key=str) == sorted(wide.collect(), key=str)
    kept.explain(mode="cost")
    plan = capsys.readouterr().out
    assert "Join" not in plan and re.findall(r"sizeInBytes=[0-9.]+ (\w+)", plan)[0] in ("B", "KiB")


def test_stored_without_rows(spark):
    kept = stored(spark.createDataFrame([], "n bigint"))
    assert kept.columns == ["n"] and kept.count() == 0
