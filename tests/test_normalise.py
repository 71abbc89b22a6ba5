"""Landed JSON to rows: the rules of every normaliser, and the family classifier."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from bourselight.operators import classify, normalise
from bourselight.sources.landing import route


def landed(spark, payload, endpoint="/api/v1/x/A", symbol="A", **params):
    text = payload if isinstance(payload, str) else json.dumps(payload)
    return spark.createDataFrame([(endpoint, symbol, params, text)],
                                 "endpoint string, symbol string, params map<string,string>, payload string")


def dicts(df):
    return [r.asDict() for r in df.collect()]


def test_symbols(spark):
    got = dicts(normalise.symbols(landed(spark, [
        {"symbol": " ABC ", "name": "Abc Ltd ", "nse_code": "ABC", "bse_code": "", "consolidated_ind": True},
        {"symbol": "XYZ", "name": None}, {"symbol": "  "}, {"name": "none"}])))
    assert got == [
        {"symbol": "ABC", "name": "Abc Ltd", "nse_code": "ABC", "bse_code": None, "consolidated_ind": True},
        {"symbol": "XYZ", "name": "XYZ", "nse_code": None, "bse_code": None, "consolidated_ind": False}]


def test_quotes(spark):
    quote = {"current_price": 0, "change": "-100.00%", "volume": 0, "market_cap": "12,461", "high52": -1}
    got = dicts(normalise.quotes(landed(spark, {"A": quote, "B": {}, "C": {"current_price": "5.5", "change": "-100%"}})))
    assert [r["symbol"] for r in got] == ["A", "C"]
    assert (got[0]["current_price"], got[0]["change_pct"], got[0]["volume"], got[0]["market_cap"], got[0]["high52"]) == (
        None, None, 0.0, 12461.0, None)
    assert (got[1]["current_price"], got[1]["change_pct"]) == (5.5, -100.0)


STATEMENT = {"financials": [
    {"header": "Mar 2026", "year": "2026", "period_end": "20260331", "revenueFromOperations": 100.5, "financeCosts": "-",
     "eps": "1,234.5"},
    {"year": 2025, "period_end": "31-Mar-2025", "result_date": "2025-05-01", "revenueFromOperations": 90}]}


def test_statements(spark):
    sent = landed(spark, STATEMENT, statement_type="c", statement_code="pl", period="annual")
    periods = sorted(dicts(normalise.statement_periods(sent)), key=lambda r: r["header"])
    assert [(p["header"], p["year"], p["period_end"], p["result_date"], p["schema_kind"]) for p in periods] == [
        ("Mar 2025", 2025, dt.date(2025, 3, 31), dt.date(2025, 5, 1), "general"),
        ("Mar 2026", 2026, dt.date(2026, 3, 31), None, "general")]
    lines = {(r["header"], r["field_name"]): r["value"] for r in dicts(normalise.statement_lines(sent))}
    assert lines == {("Mar 2026", "revenueFromOperations"): 100.5, ("Mar 2026", "financeCosts"): None,
                     ("Mar 2026", "eps"): 1234.5, ("Mar 2025", "revenueFromOperations"): 90.0}
    other = landed(spark, STATEMENT, statement_type="c", statement_code="bs", period="annual")
    assert {p["schema_kind"] for p in dicts(normalise.statement_periods(other))} == {"unknown"}
    assert dicts(normalise.statement_lines(landed(spark, {"financials": []}))) == []
    assert dicts(normalise.statement_lines(landed(spark, "not json"))) == []


def test_prices(spark):
    day = {"quote_date": "2018-06-18", "open_price": 10, "high_price": 12, "low_price": 9, "close_price": 11, "volume": 5}
    zero = {"open_price": 0, "high_price": 0, "low_price": 0, "close_price": 0, "volume": 0}
    got = dicts(normalise.prices(landed(spark, {"price": [
        day, {**day, **zero}, {**day, "close_price": 0}, {**day, "low_price": -1}, {**day, "quote_date": "?"},
        {**day, "close_price": None}, {"quote_date": "2018-06-19"}]})))
    assert [r["close"] for r in got] == [11.0, None]


def test_series_and_metrics(spark):
    payload = {"ratios": [{"header": "TTM", "year": None, "ebitda": "5"}, {"header": "", "ebitda": 1}, {"ebitda": 2}]}
    got = dicts(normalise.basic_financials(landed(spark, payload, statement_type="c", statement_code="pl")))
    assert [(r["header"], r["year"], r["field_name"], r["value"]) for r in got] == [("TTM", None, "ebitda", 5.0)]
    got = dicts(normalise.metrics(landed(spark, {"financial_metrics": {"x": 1, "y": "NA"}}, statement_type="s", ratio_type="gr")))
    assert {(r["family"], r["field_name"], r["value"]) for r in got} == {("gr", "x", 1.0), ("gr", "y", None)}


def test_index_rows(spark):
    master = [{"index_symbol": " NIF50 ", "index_name": "", "exchange": "", "market_cap": 0, "constituents": ["A", "", None, "B"]}]
    sent = landed(spark, master)
    row = dicts(normalise.indices(sent))[0]
    assert (row["index_symbol"], row["index_name"], row["exchange"], row["market_cap"]) == ("NIF50", "NIF50", None, None)
    assert sorted(r["symbol"] for r in dicts(normalise.constituents(sent))) == ["A", "B"]
    quotes = [{"index_symbol": "VIX", "quote_date": "2026-08-06", "pe": 0, "pb": 0, "div_yield": 0, "market_cap": 0},
              {"index_symbol": "N", "quote_date": "2026-08-06", "pe": 20, "pb": 0, "div_yield": 0}]
    got = {r["index_symbol"]: (r["pe"], r["pb"], r["div_yield"]) for r in dicts(normalise.index_quotes(landed(spark, quotes)))}
    assert got == {"VIX": (None, None, None), "N": (20.0, 0.0, 0.0)}
    returns = [{"index_symbol": "N", "1M": 0, "1Y": "5.5%", "3Y": None, "dates": {"last_date": "2026-08-06"}}]
    got = dicts(normalise.index_returns(landed(spark, returns)))
    assert got == [{"index_symbol": "N", "horizon": "1Y", "return_pct": 5.5, "as_of": dt.date(2026, 8, 6)}]


def test_actions_and_holdings(spark):
    paid = landed(spark, {"dividend": [{"date": "2025-08-14", "amount": "5.5", "dividend_type": "Final"}, {"date": "?"}]})
    split = landed(spark, {"split": [{"date": "14-Aug-2025", "action": "1:5"}]}, "/api/v1/corporate-actions/split/A")
    got = dicts(normalise.all_actions(paid, split))
    assert [(r["action"], r["ex_date"], r["subject"], r["amount"], r["dividend_type"]) for r in got] == [
        ("dividend", dt.date(2025, 8, 14), "Final", 5.5, "Final"), ("split", dt.date(2025, 8, 14), "1:5", None, None)]
    quarter = {"date_header": "Jun 2026", "distributions": [
        {"group": "publicShareholding", "data": {"shareholdingPct": 40, "totalShareholders": "4,651,816"}}, {"group": ""}]}
    got = dicts(normalise.shareholding(landed(spark, {"distributions": [quarter, {"distributions": []}]})))
    assert [(r["period_label"], r["shareholding_pct"], r["total_shareholders"]) for r in got] == [("Jun 2026", 40.0, 4651816.0)]


@pytest.mark.parametrize(
    ("endpoint", "table"),
    [("/api/v1/financials/A", "statement"), ("/api/v1/basic-financials/A", "basic_financial"), ("/api/v1/ratios/A", "ratio"),
     ("/api/v1/daily-price-ratios/A", "price_ratio_daily"), ("/api/v1/daily-quotes/A", "price_daily"),
     ("/api/v1/index/quote/all", "index_quote_daily"), ("/api/v1/quote", "quote"), ("/api/v1/holidays-calendar", "archive_only")],
)
def test_routes(spark, endpoint, table):
    assert spark.createDataFrame([(endpoint,)], "endpoint string").select(route()).collect()[0][0] == table


def kind_of(spark, fields):
    df = spark.createDataFrame([(list(fields),)], "f array<string>").select(classify.classify(F.col("f")).alias("c"))
    return df.collect()[0]["c"]


def test_classifier(spark):
    for family, markers in classify.MARKERS.items():
        full = kind_of(spark, markers)
        assert (full["kind"], full["confidence"], full["hits"]) == (family, 1.0, len(markers))
        assert kind_of(spark, [*markers[:2], "eps", "otherIncome"])["kind"] == family
    assert kind_of(spark, ["eps", "income", "year"])["kind"] == "unknown"
    assert kind_of(spark, ["somethingElse"])["confidence"] == 0.0
    tie = kind_of(spark, ["interestExpended", "financeCosts"])
    assert (tie["kind"], tie["confidence"], tie["margin"]) == ("bank", 0.125, 0.0)
