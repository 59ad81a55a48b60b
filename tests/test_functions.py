"""Scalar expressions against hand-made and computed values."""

from datetime import datetime, timedelta, timezone
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from countersign.functions import (
    batch_day,
    conflict_phase,
    grace_over,
    hours_since,
    instant,
    is_filled,
    iso_stamp,
    leading_number,
    money_text,
    or_default,
    transaction_id,
)
from tests.plans import plan_of

AMOUNTS = [
    ("75.00", 75.0),
    ("12.90abc", 12.9),
    ("abc", 0.0),
    ("$75", 0.0),
    ("1,468.00", 1.0),
    (" -5", -5.0),
    ("1e3", 1000.0),
    ("1e", 1.0),
    ("1e+", 1.0),
    (".5", 0.5),
    ("5.", 5.0),
    ("-.5e1x", -5.0),
    ("-", 0.0),
    (".", 0.0),
    ("", 0.0),
    ("Infinity", float("inf")),
    ("-Infinityx", float("-inf")),
    ("infinity", 0.0),
    ("1d", 1.0),
    ("1f", 1.0),
    ("0x10", 0.0),
    ("NaN", 0.0),
    (None, 0.0),
    ("-0", 0.0),
    ("+3", 3.0),
    ("\t\n 7", 7.0),
    ("\u00a0\ufeff8", 8.0),
    ("\u2028\u3000 9", 9.0),
    ("1_000", 1.0),
    ("1e999", float("inf")),
    ("1e-999", 0.0),
    ("٣", 0.0),
]


def values(spark, items, kind, *columns):
    rows = spark.createDataFrame(list(enumerate(items)), f"i int, x {kind}")
    return [tuple(r)[1:] for r in rows.select("i", *columns).orderBy("i").collect()]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_leading_number(spark, setting, ansi):
    setting("spark.sql.ansi.enabled", ansi)
    texts = [text for text, _ in AMOUNTS]
    got = [v for (v,) in values(spark, texts, "string", leading_number(F.col("x")))]
    assert got == [n for _, n in AMOUNTS]
    assert all(str(v) != "-0.0" for v in got)


@given(st.lists(st.floats(allow_nan=False), min_size=200, max_size=200))
@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
def test_leading_number_reads_back_any_double(spark, numbers):
    texts = [{"inf": "Infinity", "-inf": "-Infinity"}.get(repr(n), repr(n)) for n in numbers]
    got = [v for (v,) in values(spark, texts, "string", leading_number(F.col("x")))]
    assert got == numbers


def two_decimals(amount: float) -> str:
    """Round the exact binary value, ties away from zero."""
    exact = Decimal(abs(amount)).quantize(Decimal("0.01"), ROUND_HALF_UP)
    return f"${'-' if amount < 0 else ''}{exact}"


def test_money_text_known_values(spark):
    known = [
        (1.005, "$1.00"),
        (2.675, "$2.67"),
        (0.125, "$0.13"),
        (-0.125, "$-0.13"),
        (1.45, "$1.45"),
        (8.345, "$8.35"),
        (10.235, "$10.23"),
        (-0.001, "$-0.00"),
        (0.0, "$0.00"),
        (-0.0, "$0.00"),
        (0.995, "$0.99"),
        (1468.0, "$1468.00"),
        (12.9, "$12.90"),
        (99999.999, "$100000.00"),
        (float("inf"), "$Infinity"),
        (float("-inf"), "$-Infinity"),
        (1e21, "$1e+21"),
        (-1.5e22, "$-1.5e+22"),
        (123456789012345680000.0, "$123456789012345683968.00"),
        (2.0**60, "$1152921504606846976.00"),
        (70368744177664.125, "$70368744177664.13"),
        (100000000000000.125, "$100000000000000.13"),
        (2.0**53 + 2, "$9007199254740994.00"),
        (2.0**69, "$590295810358705651712.00"),
    ]
    got = [v for (v,) in values(spark, [a for a, _ in known], "double", money_text(F.col("x")))]
    assert got == [text for _, text in known]


@given(
    st.lists(st.floats(min_value=-1e20, max_value=1e20), min_size=300, max_size=300),
    st.lists(st.integers(-(10**10), 10**10), min_size=300, max_size=300),
)
@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
def test_money_text_is_exact(spark, free, thousandths):
    numbers = free + [n / 1000 for n in thousandths] + [n / 8 for n in thousandths]
    got = [v for (v,) in values(spark, numbers, "double", money_text(F.col("x")))]
    assert got == [two_decimals(n) for n in numbers]


def test_text_defaults(spark):
    x = F.col("x")
    got = values(spark, [None, "", " ", "0", "a"], "string", or_default(x, "Unknown"), is_filled(x))
    assert got == [("Unknown", False), ("Unknown", False), (" ", True), ("0", True), ("a", True)]


def test_transaction_id(spark):
    got = values(spark, ["2026-04-03"], "string", transaction_id(F.col("x"), F.lit(12)))
    assert got == [("2026-04-03-12",)]


def test_stamps(spark):
    moment = datetime(2024, 1, 30, 23, 59, 59, 999_999, tzinfo=timezone.utc)
    now = instant(moment)
    row = spark.range(1).select(iso_stamp(now), batch_day(now)).head()
    assert tuple(row) == ("2024-01-30T23:59:59.999Z", "2024-01-30")
    naive = spark.range(1).select(iso_stamp(instant(datetime(1969, 12, 31, 23)))).head()
    assert naive[0] == "1969-12-31T23:00:00.000Z"


DAY = datetime(2024, 1, 31, tzinfo=timezone.utc)
GATES = [
    # batch date, moment, hours, gate open, phase on
    (None, DAY, None, False, False),
    ("", DAY, None, False, False),
    ("not a date", DAY, None, True, False),
    ("2024-01-30", DAY - timedelta(seconds=1), 24 - 1 / 3600, False, False),
    ("2024-01-30", DAY - timedelta(milliseconds=1), 24 - 1 / 3_600_000, False, False),
    ("2024-01-30", DAY, 24.0, True, True),
    ("2024-01-30", DAY + timedelta(days=9), 240.0, True, True),
    ("2024-02-01", DAY, -24.0, False, False),
]


@pytest.mark.parametrize("date, moment, hours, gate, phase", GATES)
def test_gate(spark, date, moment, hours, gate, phase):
    day, now = F.lit(date).cast("string"), instant(moment)
    row = spark.range(1).select(
        hours_since(day, now), grace_over(day, now, 24.0), conflict_phase(day, now, 24.0)
    )
    got = tuple(row.head())
    assert got[0] == (None if hours is None else pytest.approx(hours))
    assert got[1:] == (gate, phase)
    ungated = spark.range(1).select(grace_over(day, now, None), conflict_phase(day, now, None))
    assert tuple(ungated.head()) == (True, True)


def test_gate_ignores_the_session_zone(spark, setting):
    setting("spark.sql.session.timeZone", "Australia/Melbourne")
    now = instant(DAY)
    row = spark.range(1).select(hours_since(F.lit("2024-01-30"), now))
    assert row.head()[0] == 24.0


def test_expressions_are_generated_code(spark):
    rows = spark.range(5).select(
        money_text(leading_number(F.col("id").cast("string"))).alias("m"),
        grace_over(F.lit("2024-01-30"), instant(DAY), 24.0).alias("g"),
    )
    plan = plan_of(rows)
    assert "*(1) Project" in plan and "Python" not in plan
    assert "true AS g" in plan  # the gate folds to a literal
