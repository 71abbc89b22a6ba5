"""Damaged copies of the tables, as checks and repairs meet them: whole tables with some figures spoilt."""

from __future__ import annotations

from pyspark.sql import functions as F

DAMAGED_PRICES = """
SELECT symbol, quote_date, CASE WHEN volume % 23 = 0 THEN -close WHEN volume % 19 = 0 THEN 0 ELSE close END AS close,
  CASE WHEN volume % 19 = 0 THEN 0 ELSE high END AS high, CASE WHEN volume % 19 = 0 THEN 0 ELSE low END AS low,
  CASE WHEN volume % 19 = 0 THEN 0 WHEN volume % 29 = 0 THEN -open ELSE open END AS open,
  CASE WHEN volume % 19 = 0 THEN 0 ELSE volume END AS volume FROM prices"""

DAMAGED_QUOTES = """
SELECT symbol, CASE WHEN shares % 9 = 0 THEN 0 WHEN shares % 10 = 0 THEN -current_price ELSE current_price END
    AS current_price,
  CASE WHEN shares % 9 = 0 THEN -100 WHEN shares % 8 = 0 THEN 60 ELSE change_pct END AS change_pct,
  CASE WHEN shares % 11 = 0 THEN 0 ELSE market_cap END AS market_cap,
  CASE WHEN shares % 12 = 0 THEN 0 ELSE high52 END AS high52, low52, volume, shares FROM quote"""

# The quote feed also carries exchange codes as keys, and lacks some companies.
FEED = """
SELECT CASE WHEN c.bse_code IS NOT NULL AND c.industry = 'PROMO' THEN c.bse_code
    WHEN c.industry = 'SMALL' THEN concat('ETF', c.symbol) ELSE c.symbol END AS symbol, q.change_pct
FROM company c JOIN quote q ON c.symbol = q.symbol"""


def damaged_prices(t):
    volume = F.col("volume")
    blank = volume % 19 == 0
    zero = F.lit(0.0)
    return t.prices.select(
        "symbol", "quote_date",
        F.when(volume % 23 == 0, -F.col("close")).when(blank, zero).otherwise(F.col("close")).alias("close"),
        F.when(blank, zero).otherwise(F.col("high")).alias("high"),
        F.when(blank, zero).otherwise(F.col("low")).alias("low"),
        F.when(blank, zero).when(volume % 29 == 0, -F.col("open")).otherwise(F.col("open")).alias("open"),
        F.when(blank, zero).otherwise(volume).alias("volume"),
    )


def damaged_quotes(t):
    shares = F.col("shares")
    price = F.col("current_price")
    return t.quote.select(
        "symbol",
        F.when(shares % 9 == 0, 0.0).when(shares % 10 == 0, -price).otherwise(price).alias("current_price"),
        F.when(shares % 9 == 0, -100.0).when(shares % 8 == 0, 60.0).otherwise(F.col("change_pct")).alias("change_pct"),
        F.when(shares % 11 == 0, 0.0).otherwise(F.col("market_cap")).alias("market_cap"),
        F.when(shares % 12 == 0, 0.0).otherwise(F.col("high52")).alias("high52"),
        "low52", "volume", "shares",
    )


def feed(t):
    code, kind = F.col("bse_code"), F.col("industry")
    key = (
        F.when(code.isNotNull() & (kind == "PROMO"), code)
        .when(kind == "SMALL", F.concat(F.lit("ETF"), F.col("symbol")))
        .otherwise(F.col("symbol"))
    )
    quoted = t.company.join(t.quote.select("symbol", "change_pct"), "symbol")
    return quoted.select(key.alias("symbol"), "change_pct")
