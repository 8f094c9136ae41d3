"""Newest-N and trim with null dates and keys: nulls come last, none is lost early."""

import datetime as dt

import pytest

from storecast.operators import ordering


@pytest.fixture(scope="module")
def rows(spark):
    day = dt.date(2024, 1, 1)
    data = [(i, None if i % 4 == 0 else day + dt.timedelta(days=i % 5)) for i in range(40)]
    return data, spark.createDataFrame(data, "id long, d date").repartition(3)


@pytest.mark.parametrize("n", [0, 1, 7, 30, 31, 35, 40, 100])
def test_newest_rows_ranks_null_dates_last(rows, n):
    data, df = rows
    want = sorted(data, key=lambda r: (r[1] is not None, r[1] or dt.date.min, r[0]), reverse=True)[:n]
    got = ordering.newest_rows(df, n, "d", ["id"]).collect()
    assert sorted(r.id for r in got) == sorted(i for i, _ in want)


def test_newest_by_key_with_null_keys(spark):
    df = spark.createDataFrame([(i if i < 10 else None, i) for i in range(15)], "k long, v long")
    assert sorted(r.k for r in ordering.newest_by_key(df, 4, "k").collect()) == [6, 7, 8, 9]
    got = ordering.newest_by_key(df, 12, "k").collect()
    assert len(got) == 12 and sum(r.k is None for r in got) == 2
    assert ordering.newest_by_key(df, 99, "k").count() == 15
    assert ordering.newest_by_key(df.where("k is null"), 3, "k").count() == 3
