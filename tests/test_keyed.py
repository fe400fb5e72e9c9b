"""Tables whose rows are replaced by key."""

import pytest

from tracewright.sources.keyed import KeyedTable, names_in

SCHEMA = "submission_id long, place long, value string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_replacing_one_of_many_leaves_the_others(spark, tmp_path):
    make = lambda *x: spark.createDataFrame(list(x), SCHEMA)
    table = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["submission_id"], buckets=4)
    assert table.read().count() == 0
    first = [(i, k, "old") for i in range(200) for k in range(2)] + [(None, 0, "no key"), (None, 0, "no key")]
    table.replace(make(*first))
    assert rows_of(table.read()) == sorted(first, key=str)
    table.replace(make((7, 5, "new"), (300, 0, "new")), spark.createDataFrame([(9,), (999,)], "submission_id long"))
    want = [r for r in first if r[0] not in (7, 9)] + [(7, 5, "new"), (300, 0, "new")]
    assert rows_of(table.read()) == sorted(want, key=str)
    table.upsert(make((7, 5, None), (8, 0, "upserted"), (8, 9, "added")), ["submission_id", "place"])
    want = [(*r[:2], "upserted") if r[:2] == (8, 0) else r for r in want] + [(8, 9, "added")]
    assert rows_of(table.read()) == sorted(want, key=str)
    table.replace(make((8, 0, "again")), make().select("submission_id"))
    table.vacuum()
    assert len(names_in(spark, f"{tmp_path}/t/commits")) == 1
    assert rows_of(table.read()) == sorted([r for r in want if r[0] != 8] + [(8, 0, "again")], key=str)


def test_a_write_that_dies_changes_nothing(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["submission_id"], buckets=3)
    good = spark.createDataFrame([(i, 0, "old") for i in range(20)], SCHEMA)
    table.replace(good)
    before = rows_of(table.read())
    bad = spark.createDataFrame([(3, 0, "new"), (4, 0, "x")], SCHEMA).selectExpr("submission_id", "place", "if(submission_id = 4, raise_error('lost'), value) as value")
    with pytest.raises(Exception, match="lost"):
        table.replace(bad)
    assert table.version() == 1 and rows_of(table.read()) == before
    table.replace(spark.createDataFrame([(3, 0, "new")], SCHEMA))
    table.vacuum()
    assert rows_of(table.read()) == sorted([r for r in before if r[0] != 3] + [(3, 0, "new")], key=str)
    assert len(names_in(spark, f"{tmp_path}/t/data")) == 2


def test_compacted_flags(spark, tmp_path):
    from tracewright.streaming import detectors

    config = spark.createDataFrame([("h", True, 1.0)], "heuristic_id string, enabled boolean, weight double")
    path = f"{tmp_path}/live"
    rows = lambda *x: spark.createDataFrame(list(x), "submission_id long, session_id string, seq long, heuristic_id string, severity string, confidence double")
    got = lambda: {(r["submission_id"], r["seq"], r["severity"]) for r in detectors.live_flags(spark, path).collect()}
    for i, batch in enumerate([[(1, "a", 1, "h", "low", 1.0)], [(1, "a", 2, "h", "low", 1.0), (1, "a", 1, "h", "high", 1.0)], [(2, "b", 1, "h", "low", 1.0)]]):
        detectors.write_flags(rows(*batch), path, config, i)
    want = {(1, 1, "high"), (1, 2, "low"), (2, 1, "low")}
    detectors.compact_flags(spark, path, 2)
    assert got() == want and [n for n in names_in(spark, path) if "=" in n] == ["batch=2"]
    detectors.write_flags(rows((1, "a", 2, "h", "medium", 1.0)), path, config, 3)
    detectors.compact_flags(spark, path, 4)
    assert got() == {(1, 1, "high"), (1, 2, "medium"), (2, 1, "low")} and not [n for n in names_in(spark, path) if "=" in n]
