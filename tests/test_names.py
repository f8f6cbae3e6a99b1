"""Name rules: the six published cases, plus column form == string form."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions.names import (column_key, column_key_col, sanitize_col, sanitize_columns,
                                    sanitize_name)

CASES = [("My Pipeline", "my_pipeline"), ("sales-data", "sales_data"),
         ("2024 sales", "t_2024_sales"), ("users@v2!", "usersv2"), ("", ""),
         ("customers", "customers")]


@pytest.mark.parametrize("name,expected", CASES)
def test_sanitize_name(name, expected):
    assert sanitize_name(name) == expected


def test_sanitize_col_matches_cases(spark):
    df = spark.createDataFrame([(n,) for n, _ in CASES], "n string")
    got = [r[0] for r in df.select(sanitize_col("n")).collect()]
    assert got == [e for _, e in CASES]


def _plain_rule(s: str) -> str:
    # the rule in words: lower; blank and hyphen -> _; keep [a-z0-9_]; t_ before a digit
    out = "".join(ch for ch in s.lower().replace(" ", "_").replace("-", "_")
                  if re.fullmatch(r"[a-z0-9_]", ch))
    return ("t_" + out) if out[:1].isdigit() else out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcXYZ09 -_@!é.", max_size=12), min_size=1, max_size=20))
def test_sanitize_col_property(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(sanitize_col("n")).collect()]
    assert got == [_plain_rule(n) for n in names]
    assert got == [sanitize_name(n) for n in names]


def test_sanitize_columns(spark):
    df = spark.createDataFrame([(1, 2)], "`Order Id` int, `2nd-value` int")
    assert sanitize_columns(df).columns == ["order_id", "t_2nd_value"]


def test_column_key(spark):
    assert column_key(" Email ") == "email"
    assert column_key("First Name") == "first_name"
    df = spark.createDataFrame([(" Email ",), ("First Name",), ("\tx y\n",)], "n string")
    assert [r[0] for r in df.select(column_key_col(F.col("n"))).collect()] == \
        ["email", "first_name", "x_y"]
