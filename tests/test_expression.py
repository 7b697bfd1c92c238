import pytest
from pyspark.sql import types as T

from plumbline.functions.expression import ExpressionError, check_expression, compile_expression, filtered
from plumbline.operators import table as tab

SCHEMA = T.StructType([T.StructField("plot", T.StringType()), T.StructField("area", T.DoubleType()), T.StructField("owner", T.StringType()), T.StructField("level", T.DoubleType())])
ROWS = [("P1", 120.5, "Rao", 0.0), ("P2", None, None, 4.0), ("10", 30.0, "", None), ("9", -2.5, "Bai", 1e20)]


@pytest.fixture(scope="module")
def plots(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("area + 1", [121.5, None, 31.0, -1.5]),
        ("1 + 2 * 3 - 4 / 2", [5.0] * 4),
        ("10 - 3 - 2", [5.0] * 4),
        ("7 % -3", [1.0] * 4),
        ("-area", [-120.5, None, -30.0, 2.5]),
        ("area / 0", [None] * 4),
        ("round(area)", [121.0, None, 30.0, -2.0]),
        ("owner = null", [False, True, False, False]),
        ("owner <> 'Rao'", [False, True, True, True]),
        ("not owner", [False, True, True, False]),
        ("owner and area", [True, False, False, True]),
        ("level or false", [False, True, False, True]),
        ("plot < 20", [False, False, True, True]),
        ("plot + 1", ["P11", "P21", "11", "10"]),
        ("owner + '!'", ["Rao!", "!", "!", "Bai!"]),
        ("isnull(owner)", [False, True, True, False]),
        ("coalesce(owner, plot)", ["Rao", "P2", "10", "Bai"]),
        ("if(area > 0, 'up', plot)", ["up", "P2", "up", "9"]),
        ("concat(plot, '-', area)", ["P1-120.5", "P2-", "10-30", "9--2.5"]),
        ("min(area, level, plot)", [0.0, 4.0, 10.0, -2.5]),
        ("number(plot)", [None, None, 10.0, 9.0]),
        ("substr(plot, 0, 1)", ["P", "P", "1", "9"]),
        ("sqrt(area)", [120.5**0.5, None, 30**0.5, None]),
        ("[area] >= 30 AND Not(level = 4)", [True, False, True, False]),
        ("true = 1", [True] * 4),
        ("'it\\'s'", ["it's"] * 4),
    ],
)
def test_values(plots, source, want):
    got = [r[0] for r in plots.select(compile_expression(source, SCHEMA).column.alias("v")).collect()]
    assert got == [pytest.approx(w) if isinstance(w, float) else w for w in want]


@pytest.mark.parametrize("source", ["", "area +", "(area", "aera > 1", "rond(area)", "round()", "area area", "'open", "1 @ 2", "substr(plot)"])
def test_errors(plots, source):
    assert check_expression(source, SCHEMA)
    with pytest.raises(ExpressionError):
        compile_expression(source, SCHEMA)
    assert filtered(plots, source).count() == 0


def test_suggestions_and_fields():
    assert "'area'" in check_expression("aera", SCHEMA) and "'round'" in check_expression("rond(area)", SCHEMA)
    assert compile_expression("area + [level] + area", SCHEMA).fields == ["area", "level"]


def test_sort_puts_empty_values_last(plots):
    for down, want in ((False, ["9", "10", "P1", "P2"]), (True, ["10", "9", "P2", "P1"])):
        assert [r["plot"] for r in tab.build_table(plots, sort_by="plot", descending=down).collect()] == want
    assert [r["owner"] for r in tab.build_table(plots, sort_by="owner").collect()][:2] == ["Bai", "Rao"]


def test_columns(plots):
    with pytest.raises(tab.Refused):
        tab.retype_field(plots, "plot", "number")
    assert [r["plot"] for r in tab.retype_field(plots, "plot", "integer", force=True).collect()] == [None, None, 10, 9]
    with pytest.raises(tab.Refused):
        tab.add_field(plots, "area", "double")
    assert tab.rename_field(plots, "area", "size").schema["size"].metadata == {"source_name": "area"}
