import datetime
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import numbers


@pytest.mark.parametrize(
    "text, number",
    [
        ("555-1234", 555.0), ("2020-01-15", 2020.0), ("192.168.1.1", 192.168), ("1e5", 100000.0), ("1e", 1.0),
        ("-.5x", -0.5), ("+3", 3.0), ("0x10", 0.0), ("5.", 5.0), (".", None), ("NaN", None), ("", None), (" 12 ", 12.0),
        (" 7　", 7.0), ("true", None), ("CUST-1", None), ("Infinity", float("inf")), ("-Infinity", float("-inf")),
        ("Inf", None), ("12abc", 12.0), (None, None),
    ],
)
def test_lenient_number(spark, text, number):
    df = spark.createDataFrame([(text,)], "v STRING")
    assert df.select(numbers.lenient_number(F.col("v"))).first()[0] == number


@pytest.mark.parametrize("text, number", [("12", 12.0), (" 1.5 ", 1.5), ("555-1234", None), ("NaN", None), ("", None)])
def test_strict_mode_wants_the_whole_cell(spark, text, number):
    df = spark.createDataFrame([(text,)], "v STRING")
    assert df.select(numbers.cell_number(F.col("v"), T.StringType(), "strict")).first()[0] == number


def test_dates_are_years_only_when_lenient(spark):
    df = spark.createDataFrame([(datetime.date(2020, 1, 15),)], "d DATE")
    lenient, strict = (numbers.cell_number(F.col("d"), T.DateType(), m) for m in ("lenient", "strict"))
    assert tuple(df.select(lenient, strict).first()) == (2020.0, None)


@pytest.mark.parametrize(
    "number, text",
    [(5.0, "5"), (-0.0, "0"), (1863.84, "1863.84"), (1e7, "10000000"), (12345678.9, "12345678.9"), (0.001, "0.001"), (-2.5, "-2.5"), (100.0, "100"),
     (0.0005, "0.0005"), (1e-6, "0.000001"), (-1.25e-5, "-0.0000125"), (1e-7, "1e-7"), (1.5e-7, "1.5e-7"), (1e20, "100000000000000000000"),
     (1.2345e20, "123450000000000000000"), (1e21, "1e+21"), (-1.5e300, "-1.5e+300"), (123456789.125, "123456789.125"), (5e-324, "4.9e-324")],
)
def test_number_text(spark, number, text):
    df = spark.createDataFrame([(number,)], "v DOUBLE")
    assert df.select(numbers.number_text(F.col("v"))).first()[0] == text


def leading_number(text):
    """The longest start of the text that is a plain decimal number."""
    text = text.strip()
    for end in range(len(text), 0, -1):
        if re.fullmatch(r"[+-]?Infinity", text[:end]):
            return float(text[:end])
        if re.fullmatch(r"[0-9eE+.-]+", text[:end]):
            try:
                return float(text[:end])
            except ValueError:
                continue
    return None


def test_lenient_number_on_random_texts(spark):
    draw = random.Random(11)
    texts = ["".join(draw.choice("0123456789..++--eE xI,") for _ in range(draw.randint(0, 7))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", numbers.lenient_number(F.col("t")).alias("n")).collect()
    assert [(r["t"], r["n"]) for r in rows] == [(t, leading_number(t)) for t in texts]
