import math

import pytest
from pyspark.sql import functions as F

from sylvan.functions import scalars as s


def test_grids():
    assert [s.tree_count(k) for k in range(12)] == [1, 2, 3, 4, 6, 8, 11, 16, 23, 32, 45, 64]
    assert [s.alpha_value(k) for k in range(8)] == [0.5, 0.2, 0.1, 0.05, 0.02, 0.01, 0.005, 0.002]
    assert s.tree_count_steps(8) == 6 and s.snap_tree_count(10) == 8
    assert s.alpha_steps(0.01, 1000) == 6 and s.alpha_steps(0, 100) == 6


@pytest.mark.parametrize(("alpha", "want"), [(0.1, [0.001, 0.004, 0.016, 0.256]), (0.01, [0.001, 0.0014142, 0.002, 0.004]), (0.5, [0.001, 0.5, 250.0])])
def test_leaf_share(alpha, want):
    for h, w in zip((0, 1, 2, 4), want, strict=False):
        assert s.leaf_share(alpha, 1000, h) == pytest.approx(w, rel=1e-4)


def test_leaf_share_limits():
    assert s.leaf_share(0, 1000, 3) is None
    assert s.leaf_share(1, 1000, 3) == 1
    assert s.leaf_share(1 / 1000, 1000, 7) == pytest.approx(0.001)


def test_rounding_and_text():
    assert [s.round_two_digits(n) for n in (90, 135, 1234)] == [90, 140, 1200]
    assert s.snap_alpha(0.01, 100) == 0 and s.snap_alpha(0.02, 1000) == 0.02 and s.snap_alpha(0.013, 10000) == pytest.approx(0.01)
    assert [s.alpha_text(a) for a in (0, 1.0, 0.5, 0.02, 0.001)] == ["0.0", "1.0", "0.5", "0.02", "0.001"]


def test_tolerant_comparison():
    x = 0.1 + 0.2
    assert s.same(x, 0.3) and s.at_most(x, 0.3) and not s.below(0.3, x)
    assert not s.same(math.nan, math.nan) and s.below(1.0, 1.1) and s.same(0.0, -0.0)


def test_names():
    assert s.with_suffix("a.b.attr", "fs") == "a.b.fs.attr" and s.with_suffix("a", "fs") == "a.fs"
    assert s.first_digit_place(0.02) == 2 and s.first_digit_place(0.1) == 1


def test_missing_text(spark):
    rows = spark.createDataFrame([(1.5,), (None,)], "x double").select(s.missing_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == ["1.5", "?"]


def test_in_base():
    assert [s.in_base(*x) for x in ((0,), (-255, 16), (255, 2), (35, 36))] == ["0", "-ff", "11111111", "z"]
    with pytest.raises(ValueError, match="base"):
        s.in_base(1, 1)


def test_leaf_share_column(spark):
    df = spark.createDataFrame([(a, float(n), h) for a in (0.0, 0.01, 0.2, 0.5, 1.0) for n in (1000, 50) for h in range(5)], "a double, n double, h int")
    for r in df.select("*", s.leaf_share_column(F.col("a"), F.col("n"), F.col("h")).alias("got")).collect():
        assert r.got == (None if (want := s.leaf_share(r.a, r.n, r.h)) is None else pytest.approx(want))
