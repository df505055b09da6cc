import pytest

from sylvan.sources import tables
from sylvan.sources.schema import DataError, SchemaError, parse_schema

GOOD = """y: 0,1 (class).
lat: cont.
name: nom.
flag: 0,1 (split).
w: cont (weight).
contexts:
name never.
ghost never.
"""


def test_parse_and_write():
    s = parse_schema(GOOD)
    assert (s.target, s.weight, s.active, s.booleans) == ("y", "w", ("lat", "flag"), ("flag",))
    assert s.attribute("flag").split and s.column_number("flag") == 4 and not s.is_active("name")
    again = parse_schema(s.without("lat").to_text())
    assert again.active == ("flag",) and again.with_("lat").active == ("lat", "flag")


@pytest.mark.parametrize(("text", "code"), [
    ("a: cont (class).\nb: cont (class).", "several classes"), ("a: cont.", "no class"), ("y: cont (class).\na: cont.\na: cont.", "duplicate name"),
    ("y: cont (class).\na*b: cont.", "forbidden character"), ("y: cont (class).\na: text.", "unknown type"), ("y: cont (class).\na: nom.", "active nominal"),
    ("y: cont (class).\na: cont (weight).\nb: cont (weight).", "several weights"),
])
def test_schema_errors(text, code):
    with pytest.raises(SchemaError) as e:
        parse_schema(text)
    assert e.value.code == code


def test_read_table(spark, tmp_path):
    (tmp_path / "t").write_text("1 \t2.5\tjoe\t1\t3\n0\t?\tann\t0\t1\n\n")
    rows = tables.read_table(spark, str(tmp_path / "t"), parse_schema(GOOD)).collect()
    assert [tuple(r) for r in rows] == [(1.0, 2.5, "joe", 1.0, 3.0), (0.0, None, "ann", 0.0, 1.0)]


@pytest.mark.parametrize("line", ["1\t2\tjoe\t1", "1\t2\tjoe\t1\t3\t4", "1\tx\tjoe\t1\t3"])
def test_bad_cells(spark, tmp_path, line):
    (tmp_path / "t").write_text(line + "\n")
    with pytest.raises(Exception, match="too few|too many|not a number"):
        tables.read_table(spark, str(tmp_path / "t"), parse_schema(GOOD)).collect()


def test_checks(spark):
    s = parse_schema(GOOD)
    df = lambda *rows: spark.createDataFrame(list(rows), "y double, lat double, name string, flag double, w double")
    assert tables.checked(df((1.0, 2.0, "a", 1.0, 1.0)), s, "train").count() == 1
    for rows, role, code in (([], "train", "empty train"), ([(None, 1.0, "a", 0.0, 1.0)], "valid", "missing target in valid"), ([(1.0, 1.0, "a", 2.0, 1.0)], "train", "not a boolean")):
        with pytest.raises(DataError) as e:
            tables.checked(df(*rows), s, role)
        assert e.value.code == code
    lacking = df((None, 1.0, "a", 2.0, 1.0))
    assert not tables.has_targets(tables.checked(lacking, s, "test"), "y")


def test_checks_on_the_way(spark):
    """A file's checks are made as it is written, and its rows counted."""
    from sylvan.plans.storage import stored

    s = parse_schema(GOOD)
    df = lambda *rows: spark.createDataFrame(list(rows), "y double, lat double, name string, flag double, w double")
    rows, n = tables.checked_as_read(df((1.0, 2.0, "a", 1.0, 1.0), (0.0, 2.0, "a", 0.0, 1.0)), s, "train", stored)
    assert rows.count() == n == 2
    for bad, role, code in (([], "train", "empty train"), ([(None, 1.0, "a", 0.0, 1.0)], "valid", "missing target in valid"), ([(1.0, 1.0, "a", 2.0, 1.0)], "train", "not a boolean")):
        with pytest.raises(DataError) as e:
            tables.checked_as_read(df(*bad), s, role, stored)
        assert e.value.code == code


def test_missing_is_null(spark):
    df = tables.nan_to_null(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, k int"))
    assert {r.attr: r.n_missing for r in tables.missing_profile(df, ("x",)).collect()} == {"x": 1}
    assert [r.x for r in tables.sorted_values(df, "x").collect()] == [2.0, None]
    probe = tables.probe_points(spark, ("a", "b"), spark.createDataFrame([(1.0,)], "a double")).collect()
    assert tuple(probe[0]) == (1.0, None)
