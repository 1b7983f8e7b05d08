"""Scalar semantics: (expression, expected value)."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewater.functions import numeric, strings, temporal

L = F.lit
CASES = [
    (lambda: numeric.to_int(L(3.5)), 4),
    (lambda: numeric.to_int(L(4.5)), 5),
    (lambda: numeric.to_int(L(-4.5)), -5),
    (lambda: numeric.mod(L(4), L(0)), None),
    (lambda: numeric.mod(L(-7), L(3)), -1),
    (lambda: numeric.int_div(L(7), L(2)), 3),
    (lambda: numeric.int_div(L(-7), L(2)), -3),
    (lambda: numeric.int_div(L(7), L(0)), None),
    (lambda: numeric.format_plain(L(1220.532), 0), "1221"),
    (lambda: numeric.format_plain(L(1220.532), 1.4), "1220.5"),
    (lambda: numeric.format_plain(L(100), 2), "100.00"),
    (lambda: numeric.exact_power(L(3), 4).cast("long"), 81),
    (lambda: strings.left(L("ABC"), -1), ""),
    (lambda: strings.right(L("ABC"), 1.5), "BC"),
    (lambda: strings.mid(L("ABCDEFG"), -5, 3), "CDE"),
    (lambda: strings.mid(L("ABCDEFG"), 2, -1), ""),
    (lambda: strings.mid(L("ABC"), 2.5, 1.5), "C"),
    (lambda: strings.locate("", L("")), 1),
    (lambda: strings.locate("x", L("abc")), 0),
    (lambda: strings.instr(L("abcabc"), "c"), 3),
    (lambda: strings.trim(L("1234123"), "123"), "4"),
    (lambda: strings.trim(L("xxaxx"), "x", "leading"), "axx"),
    (lambda: strings.trim(L("xxaxx"), "x", "trailing"), "xxa"),
    (lambda: strings.repeat(L("ab"), 2.1), "abab"),
    (lambda: strings.concat(L("a"), L(None)), None),
    (lambda: strings.concat(L("a"), L(3.5)), "a3.5"),
    (lambda: strings.like(L("AbC"), "aBc"), True),
    (lambda: strings.like(L("AbC"), "a_c"), True),
    (lambda: strings.like(L("AbC"), "[a-b]%"), True),
    (lambda: strings.like(L("AbC"), "[^a-b]%"), False),
    (lambda: strings.like(L("a%c"), "a#%c", "#"), True),
    (lambda: strings.like(L("abc"), "a#%c", "#"), False),
    (lambda: strings.like(L("a.c"), "a.[b-d]"), True),
    (lambda: strings.like_binary(L("AbC"), "abc"), False),
    (lambda: strings.like_binary(L("AbC"), "Ab%"), True),
    (lambda: temporal.parse_date(L("2022/7/2")), datetime.date(2022, 7, 2)),
    (lambda: temporal.parse_date(L("20220413")), datetime.date(2022, 4, 13)),
    (lambda: temporal.parse_date(L("1970.1.2")), datetime.date(1970, 1, 2)),
    (lambda: temporal.parse_date(L("nothing")), None),
    (lambda: temporal.date_format(L("2022-07-02").cast("date"), "%Y/%m/%d"), "2022/07/02"),
    (lambda: temporal.date_format(L("2022-07-02").cast("date"), "%A"), "A"),
    (lambda: temporal.date_format(L("2022-07-02").cast("date"), ""), None),
    (lambda: temporal.time_format(L("110203"), "%H.%i.%s"), "11.02.03"),
    (lambda: temporal.time_format(L("11:2:3"), "%T"), "11:02:03"),
    (lambda: temporal.timestamp_format(L(86400), seconds=True), "1970-01-02 00:00:00"),
    (lambda: temporal.unix_timestamp(L(12), numeric=True), 12),
    (lambda: temporal.datediff(L("2022-07-02").cast("date"), L("2022-06-30").cast("date")), 2),
]


@pytest.fixture(scope="module")
def values(spark):
    return spark.range(1).select(*[f().alias(f"c{i}") for i, (f, _) in enumerate(CASES)]).first()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(values, i):
    assert values[f"c{i}"] == CASES[i][1]
