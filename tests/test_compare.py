import math
from datetime import datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from model import matches as expected
from pyspark.sql import functions as F

from quire.functions.compare import COMPARISONS, OPERATORS, matches
from quire.functions.values import number_of, parse_number, parse_time, real_text, time_of

TEXTS = [
    None, "", "abc", "Abc", "9", "10", " 10 ", "1,000", "1000", "(5)", "-5", "5-", "1e3", "1d", "NaN", "nan",
    "Infinity", "-infinity", "2024-01-02", "2024-01-02 00:00:00", "01/02/2024", "2024-01-02T02:00:00+02:00",
    "2024-01-03", "true", "True", "zz", "٣", "0", "-0", ".5", "5.", "1e", "--1", "$5",
]
CELLS = {
    "string": TEXTS,
    "bigint": [None, 0, 1, -1, 9, 10, 1000, 2**53, 2**53 + 1, -(2**53) - 1, 2**62],
    "int": [None, 0, 5, -5, 10, 1000, 2**31 - 1],
    "double": [None, 0.0, 0.5, -5.0, 10.0, 1000.0, math.nan, math.inf, -math.inf, 9007199254740993.0],
    "boolean": [None, True, False],
    "timestamp_ntz": [None, datetime(2024, 1, 2), datetime(2024, 1, 2, 0, 0, 0, 5), datetime(2024, 1, 3), datetime(1999, 1, 1)],
}
LITERALS = [*TEXTS, "10.5", "-10.5", "9007199254740993", "0.1"]


@pytest.mark.parametrize("dtype", list(CELLS))
def test_every_cell_against_every_literal(spark, dtype):
    rows = spark.createDataFrame(list(enumerate(CELLS[dtype])), f"i int, c {dtype}")
    tests = {f"{k}|{op}": (op, v) for k, v in enumerate(LITERALS) for op in COMPARISONS}
    bits = [F.coalesce(matches(F.col("c"), dtype, op, v), F.lit(False)) for op, v in tests.values()]
    wrong = []
    step = 40  # keep the generated projections small
    for at in range(0, len(bits), step):
        for row in rows.select("i", F.array(*bits[at:at + step]).alias("b")).collect():
            for (op, v), got in zip(list(tests.values())[at:at + step], row.b):
                if got != expected(CELLS[dtype][row.i], op, v):
                    wrong.append((CELLS[dtype][row.i], op, v, got))
    assert wrong == []


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.one_of(st.none(), st.sampled_from(TEXTS), st.text(max_size=6).filter(lambda s: s.isprintable()),
                       st.integers(-99, 99).map(str), st.floats(width=32).map(str),
                       st.dates().map(str)), min_size=1, max_size=30),
    st.sampled_from(OPERATORS),
    st.lists(st.one_of(st.none(), st.sampled_from(TEXTS), st.integers(-99, 99).map(str)), min_size=1, max_size=4),
)
def test_text_cells_like_the_model(spark, cells, op, values):
    value = values if op in ("in", "not_in") else values[0]
    rows = spark.createDataFrame(list(enumerate(cells)), "i int, c string")
    got = {r.i for r in rows.filter(matches(F.col("c"), "string", op, value)).collect()}
    assert got == {i for i, c in enumerate(cells) if expected(c, op, value)}


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(
    st.from_regex(r"[ ]?[+(-]?[0-9,]{1,5}(\.[0-9]{0,3})?([eE][+-]?[0-9])?[)+-]?[ ]?", fullmatch=True),
    st.from_regex(r"[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}([T ][0-9]{1,2}:[0-5][0-9](:[0-5][0-9](\.[0-9]{1,7})?(Z|[+-]0[0-9]:00)?)?)?", fullmatch=True),
    st.from_regex(r"[01]?[0-9]/[0-3]?[0-9]/[12][0-9]{3}( [0-9]{1,2}:[0-5][0-9]:[0-5][0-9] [AaPp][Mm])?", fullmatch=True),
), min_size=1, max_size=60))
def test_cells_parse_as_literals_do(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", number_of(F.col("t")).alias("n"), time_of(F.col("t")).alias("at")).collect():
        assert (r.n, r.at) == (parse_number(r.t), parse_time(r.t)), r.t


def test_membership(spark):
    rows = spark.createDataFrame([(None,), ("a",), ("10.0",), ("b",)], "c string")
    def kept(op, values):
        return [r.c for r in rows.filter(matches(F.col("c"), "string", op, values)).collect()]

    assert kept("in", ["a", "10"]) == ["a", "10.0"]
    assert kept("not_in", ["a", "10"]) == [None, "b"]
    assert kept("in", [None]) == [None]
    assert kept("not_in", [None, "b"]) == ["a", "10.0"]


def test_decimal_cells(spark):
    rows = spark.createDataFrame([(Decimal("1.50"),), (None,)], "c decimal(9,2)")
    assert rows.filter(matches(F.col("c"), "decimal(9,2)", "==", "1.5")).count() == 1


def test_typed_comparisons_reach_the_scan(spark):
    path = "/root/testdata/sf0.001/orders.parquet"
    orders = spark.read.parquet(path)
    test = (
        matches(F.col("o_custkey"), "bigint", ">=", "10.5")
        & matches(F.col("o_orderstatus"), "string", "==", "F")
        & matches(F.col("o_orderdate"), "timestamp_ntz", "<", "1997-01-01")
        & matches(F.col("o_totalprice"), "double", ">", "5")
    )
    plan = orders.filter(test)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    for part in ("GreaterThan(o_custkey,10)", "EqualTo(o_orderstatus,F)", "LessThan(o_orderdate", "GreaterThan(o_totalprice,5.0)"):
        assert part in pushed


@pytest.mark.parametrize("value,text", [
    (1.0, "1"), (1e7, "10000000"), (1.25e15, "1.25E+15"), (1e-4, "0.0001"), (1e-5, "1E-05"), (1e300, "1E+300"),
    (-2.5, "-2.5"), (0.0, "0"), (123456789012345.0, "123456789012345"), (math.nan, "NaN"),
])
def test_real_text(spark, value, text):
    assert spark.createDataFrame([(value,)], "x double").select(real_text(F.col("x"))).first()[0] == text
