import pytest

from brickline.operators.slices import SlicedTable

FORM = "id long, maker string, change_note string"


def held(table, as_of=None):
    return sorted((tuple(r) for r in table.rows(as_of).collect()), key=str)


def key(rows):
    return sorted(rows, key=str)


@pytest.fixture
def table(spark, tmp_path):
    rows = [(1, "a", "x"), (2, "a", None), (3, None, "n"), (4, "", "e"), (4, "", "e"), (None, "b", "k")]
    return SlicedTable.create(spark.createDataFrame(rows, FORM), str(tmp_path / "t"), "maker")


def test_null_and_empty_slices_replaced_and_restored(spark, table):
    first = held(table)
    assert len(first) == 6
    assert table.replace(spark.createDataFrame([(9, None, "new"), (8, "zz", "other")], FORM), spark.createDataFrame([(None,), ("a",)], "maker string")) == 1
    # a has no rows left, zz wasn't named
    assert held(table) == key([(9, None, "new"), (4, "", "e"), (4, "", "e"), (None, "b", "k")])
    assert held(table, 0) == first
    assert {tuple(r) for r in table.report(1).collect()} == {(None, 1, 1), ("a", 2, 0)}
    assert table.restore(0, spark.createDataFrame([("a",)], "maker string")) == 2
    assert held(table) == key([(1, "a", "x"), (2, "a", None), (9, None, "new"), (4, "", "e"), (4, "", "e"), (None, "b", "k")])
    assert table.restore(0) == 3
    assert held(table) == first


def test_insert_takes_new_keys_only(spark, table):
    first = held(table)
    new = [(1, "a", "again"), (None, "b", "null key"), (7, "a", "z"), (7, "a", "y"), (10, "new", None)]
    table.insert(spark.createDataFrame(new, FORM), ["id"])
    assert held(table) == key([*first, (7, "a", "y"), (10, "new", None)])
    # a slice that wasn't there is empty after the restore
    table.restore(0)
    assert held(table) == first
    table.insert(spark.createDataFrame([(10, "new", "later")], FORM), ["id"])
    assert held(table) == key([*first, (10, "new", "later")])


def test_changes_without_rows_and_lost_jobs(spark, table):
    first = held(table)
    nothing = spark.createDataFrame([], FORM)
    assert (table.replace(nothing), table.insert(nothing, ["id"]), table.version()) == (1, 2, 2)
    assert held(table) == first
    # rows and entries of a job that was lost before its end are not read, and written over
    table._write_rows(spark.createDataFrame([(5, "a", "lost")], FORM), 3)
    spark.createDataFrame([("a", 3)], "of string, source long").write.parquet(f"{table.path}/entries/change=3")
    assert held(table) == first and table.version() == 2
    table.replace(spark.createDataFrame([(6, "b", "done")], FORM))
    assert held(table) == key([r for r in first if r[1] != "b"] + [(6, "b", "done")])
    with pytest.raises(Exception, match="(?i)exists"):
        table._commit(nothing.selectExpr("maker as of", "id as source"), 3)


def test_empty_table(spark, tmp_path):
    table = SlicedTable.create(spark.createDataFrame([], FORM), str(tmp_path / "e"), "maker")
    assert held(table) == [] and table.report(0).count() == 0
    table.replace(spark.createDataFrame([(1, "a", "x")], FORM))
    assert held(table) == [(1, "a", "x")]
