"""Arguments that would give wrong rows, and settings that are missing."""

import pytest

from millrace.operators.joins import salted_join
from millrace.scratch import scratch_path


def test_salted_join(spark):
    big = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 13)], "k long, v long")
    small = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "k long, name string")
    for how in ("inner", "left"):
        assert sorted(salted_join(big, small, "k", 4, how).collect(), key=repr) == sorted(big.join(small, "k", how).collect(), key=repr)
    for how in ("right", "full", "outer", "cross"):
        with pytest.raises(ValueError):
            salted_join(big, small, "k", 4, how)


def test_scratch_without_a_setting(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
