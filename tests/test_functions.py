"""Scalar functions against golden cases."""

import datetime as dt

from pyspark.sql import functions as F

from tradesift.functions import dates, format, names, text


def rows(spark, f, values, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_money_figures(spark):
    cases = {
        "₹3,000 crore": 3000, "Rs 2,021 crore": 2021, "2480cr": 2480, "67.65 cr": 67.65, "₹800-Crore IPO": 800, "38 lakh crore": 3_800_000, "₹85 lakh": 0.85, "25 lakh shares": None,
        "1.5 crore Thyrocare shares": None, "Rs 500 crore worth of shares": 500, "Rs 3,25,00,00,000": 325, "$10 million": 88, "€10 mn": 96, "Rs 12,345 per share": None, "no figure": None, "": None, None: None,
        "sells 5% stake for ₹150 crore in a ₹2,000 crore transaction": 2000,
    }
    assert rows(spark, text.stated_max, list(cases)) == list(cases.values())


def test_proximity(spark):
    far = "x" * 70
    cases = {
        "block deal of Rs 300 crore": 300, "revenue of Rs 300 crore": None, "stake sold; revenue Rs 300 crore": None, f"stake sold {far} Rs 300 crore": None, f"Rs 900 crore revenue {far} {far} stake deal Rs 200 crore": 200,
        "selling for Rs 300 crore": None, "👩 é stake for Rs 250 crore": 250,
    }
    assert rows(spark, lambda c: text.gated_amount(c, F.lit(None).cast("string")), list(cases)) == list(cases.values())


def test_reconcile(spark):
    cases = [(300.0, "₹3,000 crore", 3000.0, True), (300.0, "$3,000 crore", 300.0, False), (300.0, "₹310 crore and ₹3,000 crore", 300.0, False), (None, "₹3,000 crore", None, False), (300.0, None, 300.0, False)]
    df = spark.createDataFrame([(i, a, r) for i, (a, r, _, _) in enumerate(cases)], "i int, a double, r string")
    got = df.select("i", text.reconcile(F.col("a"), F.col("r")).alias("x")).orderBy("i").collect()
    assert [(r.x.amount, r.x.fixed) for r in got] == [c[2:] for c in cases]


def test_stake(spark):
    cases = {"sells 4.58% stake": 4.58, "50% growth": None, "pares its 14% holding": 14, "100% stake": None, "stake of 7 per cent": 7, None: None}
    assert rows(spark, text.stake_percent, list(cases)) == list(cases.values())


def test_titles(spark):
    assert rows(spark, text.normalise_title, ["  Promoter sells 5% - Mint", "É a_b, c!", None]) == ["promoter sells 5", "é a_b c", ""]
    assert rows(spark, lambda c: text.title_tokens(text.normalise_title(c)), ["Promoter sells stake in Acme Acme"]) == [["acme"]]


def test_names(spark):
    got = rows(spark, names.company_tokens, ["Fine Edge Engineering", "L&T Finance", "M&M", "Acme (Old Co), a unit of X", "Beta formerly Gamma", None])
    assert got == [["edge", "fine"], ["finance"], [], ["acme"], ["beta"], []]
    assert rows(spark, names.person_key, ["AGARWAL SUNIL KUMAR", "Mr. Sunil K Agarwal"]) == ["agarwal kumar sunil", "agarwal sunil"]
    assert rows(spark, names.seller_class, ["Indian Continent Investment Ltd", "SBI Mutual Fund", "Sunil Mittal", None]) == ["ambiguous", "institution", "individual", "individual"]
    pairs = spark.createDataFrame([(1, ["a"], ["a", "b"], 2000.0, 1900.0), (2, [], ["a"], 2000.0, 1899.0), (3, ["a", "c"], ["a", "b"], None, 1.0)], "i int, a array<string>, b array<string>, x double, y double")
    got = pairs.select("i", names.subset_match(F.col("a"), F.col("b")), names.amount_match(F.col("x"), F.col("y"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(True, True), (False, False), (False, False)]


def test_dates(spark):
    assert rows(spark, dates.parse_trade_date, ["1-Jul-2026", "01-07-2026", "2026-07-01", "26-7-1", "bad", None]) == [dt.date(2026, 7, 1)] * 3 + [None] * 3
    d = dt.date
    assert rows(spark, dates.span_weeks, [[d(2026, 6, 1), d(2026, 7, 15)], [d(2026, 6, 1)], [d(2026, 6, 1), d(2026, 6, 2), None]], "array<date>") == ["6", "several", "1"]


def test_format(spark):
    assert rows(spark, format.amount, [2000.0, 1713.5, None], "double") == ["Rs 2,000cr", "Rs 1,713.5cr", "Size undisclosed"]
    assert rows(spark, format.general, [2000.0, 3.5, 245.5, 0.0], "double") == ["2000", "3.5", "245.5", "0"]
    assert rows(spark, format.escape, ["a_b*[c]`"]) == ["a\\_b\\*\\[c\\]\\`"]
    sales = [(f"d{i}", 10.0) for i in range(25)]
    df = spark.createDataFrame([(sales,)], "s array<struct<trade_date:string,value_cr:double>>")
    shown = df.select(format.pattern_alert(F.lit("A"), F.lit("B"), F.lit(250.0), F.col("s"), F.lit("6"))).first()[0]
    assert "5 earlier sales totalling Rs 50cr" in shown and shown.count("\nd") == 20
