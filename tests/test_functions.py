"""Column functions on literal rows."""

from __future__ import annotations

import datetime
import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, text


def values(spark, function, inputs, kind="string"):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k int, x {kind}")
    return [r["y"] for r in rows.select("k", function(F.col("x")).alias("y")).orderBy("k").collect()]


def test_match_key(spark):
    cases = {"Midwest Ltd. IPO": "midwest", "Jay Bee Laminations Ltd. O": "jay bee laminations", "X & Y Private Limited": "x and y", "Gulf Lloyds (India) Ltd": "gulf lloyds india", "Indo-MIM": "indo mim", "A B (A B IPO)": "a b", None: "", "": ""}
    assert values(spark, text.match_key, list(cases)) == list(cases.values())


def test_match_key_is_idempotent(spark):
    names = ["Alpha Beta Ltd", "Gamma-Delta (India) Pvt. Ltd.", "One & Two Inc.", "Plain"]
    once = values(spark, text.match_key, names)
    assert values(spark, text.match_key, once) == once


def test_slug(spark):
    cases = {"Company Ltd.": "company-ltd", "A & B Company": "a-and-b-company", "Acme Private Limited": "acme-private-ltd", "Company IPO": "company", "100% Pure+": "100-percent-pure-plus", None: "", "x" * 120: "x" * 100}
    assert values(spark, text.slug, list(cases)) == list(cases.values())
    assert values(spark, text.is_slug, ["a-b", "A-b", "-a", "a--b"]) == [True, False, False, False]


def test_legal_key(spark):
    assert values(spark, text.legal_key, ["Foo Pvt Ltd Limited", "Bar's (B) Corp.", "Baz IPO"]) == ["foo", "bars b", "baz"]


def test_display_name(spark):
    assert values(spark, text.display_name, ["<b>Foo</b> Ltd. O", "Twinkle Papers IPO", "Acme Limited LT"]) == ["Foo Ltd.", "Twinkle Papers", "Acme Limited"]


def test_amount(spark):
    cases = {"₹500 Cr": 5e9, "Rs 50 Lakhs": 5e6, "1,234.5 crore": 12345e6, "5 billion": 5e9, "2.5M": 2.5e6, "7K": 7e3, "1,250": 1250.0, "": None, "none": None}
    assert values(spark, money.amount, list(cases)) == [pytest.approx(v) if v is not None else None for v in cases.values()]
    assert values(spark, lambda c: money.amount(c, large=True), ["120", "20000"]) == [1.2e9, 20000.0]


def test_percentage(spark):
    assert values(spark, money.percentage, ["85%", "0.85", "12 percent", "x"]) == [85.0, 85.0, 12.0, 0.0]


def test_js_round(spark):
    numbers = [1.005, -2.5, 2.345, 0.285]
    assert values(spark, lambda c: money.js_round(c, 2), numbers, "double") == [math.floor(x * 100 + 0.5) / 100 for x in numbers]
    assert values(spark, money.js_round, [-2.5, 2.5, 0.49], "double") == [-2.0, 3.0, 0.0]


def test_price_band(spark):
    assert [tuple(v) for v in values(spark, money.price_band, ["Rs 95 - 100", "₹1,200", "-"])] == [(95.0, 100.0), (1200.0, 1200.0), (None, None)]


def test_day(spark):
    d = datetime.date
    cases = {"2025-01-15": d(2025, 1, 15), "15-Jan-2025": d(2025, 1, 15), "15 January 2025": d(2025, 1, 15), "15/01/2025": d(2025, 1, 15), "01/15/2025": d(2025, 1, 15), "03/04/2025": d(2025, 4, 3), "31/02/2025": None, "1736899200": d(2025, 1, 15), "1736899200000": d(2025, 1, 15), "": None, None: None}
    assert values(spark, dates.day, list(cases)) == list(cases.values())


def test_status(spark):
    rows = spark.createDataFrame([("2026-06-10", "2026-06-14", None), ("2026-06-10", "2026-06-13", None), ("2026-06-10", "2026-06-13", "2026-06-14"), ("2026-06-20", None, None), (None, None, None)], "o string, c string, l string")
    out = rows.select(dates.status(*[F.col(x).cast("date") for x in "ocl"], F.lit("2026-06-14").cast("date")).alias("s")).collect()
    assert [r["s"] for r in out] == ["OPEN", "CLOSED", "LISTED", "UPCOMING", None]


def test_similarities(spark):
    rows = spark.createDataFrame([("word", "two words"), ("Foo Ltd", "Foo Limited"), ("", ""), ("kitten", "sitting")], "a string, b string")
    out = rows.select(text.trigram_similarity(F.col("a"), F.col("b")).alias("t"), text.edit_similarity(F.col("a"), F.col("b")).alias("e")).collect()
    assert [round(r["t"], 6) for r in out][:2] == [0.363636, 0.333333]
    assert out[2]["e"] == 1.0 and round(out[3]["e"], 6) == round(4 / 7, 6)


def test_document_type(spark):
    cases = {"Draft Red Herring Prospectus": "DRHP", "RHP of X": "RHP", "Basis of Allotment": "BASIS_OF_ALLOTMENT", "Prospectus": "PROSPECTUS", "Corrigendum": "ADDENDUM", None: "ADDENDUM"}
    assert values(spark, text.document_type, list(cases)) == list(cases.values())


def test_bid_tiers(spark):
    row = spark.range(1).select(money.bid_tiers(F.lit(46), F.lit(321)).alias("t")).first()["t"]
    assert tuple(row)[1:] == (13, 14, 67, 68)


def test_string_hash(spark):
    def h(s):
        x = 0
        for c in s:
            x = (x * 31 + ord(c) + 2**31) % 2**32 - 2**31
        return x

    names = ["abc", "a much longer identifier 0123456789", ""]
    assert values(spark, text.string_hash, names) == [h(n) for n in names]


def test_grouped_inr(spark):
    assert values(spark, money.grouped_inr, [1, 1234, 123456, 12345678, -100000], "long") == ["1", "1,234", "1,23,456", "1,23,45,678", "-1,00,000"]
