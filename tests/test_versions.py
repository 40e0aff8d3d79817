"""Versions of calibration tables: two writers, old versions, patches that name their fields."""

import pytest

from stereolake.sources import tables, versions

SCHEMA = "session long, f0 double, cx double"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_one_of_two_writers_is_told(spark):
    root = tables.fresh_path(spark, "calibrations")
    assert versions.current(spark, root) == 0
    first = [(1, 900.0, 640.0), (2, 800.0, 630.0)]
    assert versions.commit(spark.createDataFrame(first, SCHEMA), root, 0) == 1
    change = spark.createDataFrame([(2, 805.0)], "session long, f0 double")
    slow = versions.patch(versions.read(spark, root), spark.createDataFrame([(1, 1.0)], "session long, f0 double"))
    assert versions.merge(spark, root, change) == 2
    with pytest.raises(versions.VersionConflict):
        versions.commit(slow, root, 1)
    with pytest.raises(versions.VersionConflict):
        versions.merge(spark, root, change, based_on=1)
    assert versions.current(spark, root) == 2
    assert rows(versions.read(spark, root, 1)) == first
    assert rows(versions.read(spark, root)) == [(1, 900.0, 640.0), (2, 805.0, 630.0)]
    # what the loser wrote belongs to no version; started again from the last one it goes through
    assert versions.merge(spark, root, spark.createDataFrame([(1, 1.0)], "session long, f0 double")) == 3
    assert rows(versions.read(spark, root)) == [(1, 1.0, 640.0), (2, 805.0, 630.0)]
    with pytest.raises(KeyError):
        versions.read(spark, root, 9)


def test_null_is_told_from_not_named(spark):
    base = spark.createDataFrame([(1, 1.0, 10.0), (2, 2.0, 20.0), (3, 3.0, 30.0), (4, 4.0, 40.0)], SCHEMA)
    changes = spark.createDataFrame([(1, None, None, ["cx"]), (2, 5.0, 7.0, ["f0", "unknown"]), (3, 9.0, 9.0, None), (8, 1.0, 1.0, ["f0"])], "session long, f0 double, cx double, named array<string>")
    assert sorted(map(tuple, versions.patch(base, changes).collect())) == [(1, 1.0, None), (2, 5.0, 20.0), (3, 3.0, 30.0), (4, 4.0, 40.0)]
    assert versions.patch(base, changes.drop("named").where("session = 1")).where("session = 1").first().f0 is None
