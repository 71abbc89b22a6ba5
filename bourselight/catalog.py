"""The column catalog of the company snapshot: names, units, where each figure comes from."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

CRORE_SCALE = 1e-7
PERCENT_SCALE = 100.0

# `index` is matched through the membership table and is no column of the snapshot.
PSEUDO_KEYS = ("index",)


class UnknownColumn(ValueError):
    """A name that no catalog entry carries."""


@dataclass(frozen=True)
class CatalogColumn:
    key: str
    label: str
    aliases: tuple[str, ...]
    unit: str
    source: str
    group: str
    fields: tuple[str, ...]

    @property
    def scale(self) -> float:
        """Landed rupees become crore and landed fractions become percentages."""
        if self.source in ("statement", "basic", "ratio", "metric"):
            return {"crore": CRORE_SCALE, "percent": PERCENT_SCALE}.get(self.unit, 1.0)
        return 1.0

    @property
    def spark_type(self) -> str:
        return "string" if self.unit == "text" else "double"

    def names(self) -> tuple[str, ...]:
        return (self.key, self.label, *self.aliases)

    def field(self) -> StructField:
        """The column's type, with label and unit as column metadata."""
        kind = StringType() if self.unit == "text" else DoubleType()
        return StructField(self.key, kind, True, {"label": self.label, "unit": self.unit})


# Key, label, aliases, unit, source, group in the source, and fields in order of preference.
# fmt: off
COLUMNS = (
    CatalogColumn("name", "Name", (), "text", "company", "", ("name",)),
    CatalogColumn("macro_sector", "Macro sector", (), "text", "company", "", ("macro_sector",)),
    CatalogColumn("industry", "Industry", (), "text", "company", "", ("industry",)),
    CatalogColumn("sector", "Sector", (), "text", "company", "", ("sector",)),
    CatalogColumn("sub_industry", "Sub industry", (), "text", "company", "", ("sub_industry",)),
    CatalogColumn("schema_kind", "Statement schema", (), "text", "company", "", ("schema_kind",)),
    CatalogColumn("current_price", "Current price", ("CMP", "Price"), "price", "quote", "", ("current_price",)),
    CatalogColumn("market_cap", "Market Capitalization", ("Market cap", "Mcap"), "crore", "quote", "", ("market_cap",)),
    CatalogColumn("volume", "Volume", (), "count", "quote", "", ("volume",)),
    CatalogColumn("change_pct", "Day change", (), "percent", "quote", "", ("change_pct",)),
    CatalogColumn("high52", "High price 52 weeks", ("52w high",), "price", "quote", "", ("high52",)),
    CatalogColumn("low52", "Low price 52 weeks", ("52w low",), "price", "quote", "", ("low52",)),
    CatalogColumn("shares_outstanding", "Shares outstanding", (), "count", "quote", "", ("shares",)),
    CatalogColumn("pe", "Price to Earning", ("PE", "P/E"), "ratio", "computed", "", ()),
    CatalogColumn("pb", "Price to book value", ("PB", "P/B"), "ratio", "computed", "", ()),
    CatalogColumn("ps", "Price to Sales", ("PS",), "ratio", "computed", "", ()),
    CatalogColumn("pfcf", "Price to free cash flow", ("PFCF",), "ratio", "computed", "", ()),
    CatalogColumn("ptb", "Price to tangible book", (), "ratio", "computed", "", ()),
    CatalogColumn("income", "Total income", (), "crore", "statement", "pl", ("income",)),
    CatalogColumn("sales", "Sales", ("Revenue", "Sales latest year"), "crore", "statement", "pl", ("revenueFromOperations", "income", "netPremiumIncome", "premiumEarned")),
    CatalogColumn("net_profit", "Net Profit", ("PAT", "Profit after tax"), "crore", "statement", "pl", ("profitLossForPeriod", "profitLossForThePeriod", "profitLossAfterTax", "profitLossAfterTaxAndExtraordinaryItems", "profitOrLossAttributableToOwners")),
    CatalogColumn("pbt", "Profit before tax", (), "crore", "statement", "pl", ("profitBeforeTax", "profitLossBeforeTax", "profitOrLossBeforeTax")),
    CatalogColumn("eps", "EPS", ("Earnings per share",), "price", "statement", "pl", ("eps",)),
    CatalogColumn("interest", "Interest", (), "crore", "statement", "pl", ("financeCosts", "interestExpended")),
    CatalogColumn("depreciation", "Depreciation", (), "crore", "statement", "pl", ("depreciationAndAmortisation",)),
    CatalogColumn("other_income", "Other income", (), "crore", "statement", "pl", ("otherIncome",)),
    CatalogColumn("tax_expense", "Tax", (), "crore", "statement", "pl", ("taxExpense", "provisionForTax", "provisionsForTaxes")),
    CatalogColumn("ebitda", "EBITDA", (), "crore", "basic", "pl", ("ebitda",)),
    CatalogColumn("ebit", "EBIT", (), "crore", "basic", "pl", ("ebit",)),
    CatalogColumn("operating_profit", "Operating profit", (), "crore", "basic", "pl", ("operatingProfit",)),
    CatalogColumn("operating_revenue", "Operating revenue", (), "crore", "basic", "pl", ("operatingRevenue",)),
    CatalogColumn("dividend_payout", "Dividend Payout", (), "percent", "basic", "pl", ("dividendPayout",)),
    CatalogColumn("sales_per_share", "Sales per share", (), "price", "basic", "pl", ("salesPerShare",)),
    CatalogColumn("book_value_total", "Book value total", (), "crore", "basic", "bs", ("bookValue",)),
    CatalogColumn("book_value", "Book value", ("Book value per share",), "price", "basic", "bs", ("bookValuepershare",)),
    CatalogColumn("tangible_book_value", "Tangible book value", (), "price", "basic", "bs", ("tangibleBookValueperShare",)),
    CatalogColumn("total_assets", "Total assets", (), "crore", "basic", "bs", ("totalAssets",)),
    CatalogColumn("total_equity", "Total equity", (), "crore", "basic", "bs", ("totalEquity",)),
    CatalogColumn("total_debt", "Total debt", ("Debt",), "crore", "basic", "bs", ("totalDebt",)),
    CatalogColumn("net_debt", "Net debt", (), "crore", "basic", "bs", ("netDebt",)),
    CatalogColumn("total_cash", "Cash", (), "crore", "basic", "bs", ("totalCash",)),
    CatalogColumn("reserves", "Reserves", (), "crore", "basic", "bs", ("totalReserves",)),
    CatalogColumn("working_capital", "Working capital", (), "crore", "basic", "bs", ("workingCapital",)),
    CatalogColumn("cfo", "Cash from operations", (), "crore", "basic", "cf", ("operatingCashFlow",)),
    CatalogColumn("cfi", "Cash from investing", (), "crore", "basic", "cf", ("investingCashFlow",)),
    CatalogColumn("cff", "Cash from financing", (), "crore", "basic", "cf", ("financingCashFlow",)),
    CatalogColumn("fcf", "Free cash flow", (), "crore", "basic", "cf", ("fcf",)),
    CatalogColumn("capex", "Capital expenditure", (), "crore", "basic", "cf", ("capex",)),
    CatalogColumn("fcf_per_share", "Free cash flow per share", (), "price", "basic", "cf", ("fcfPerShare",)),
    CatalogColumn("returnonequity", "Return on equity", ("ROE",), "percent", "ratio", "pr", ("returnOnEquity",)),
    CatalogColumn("returnoncapital", "Return on capital employed", ("ROCE",), "percent", "ratio", "pr", ("returnOnCapital",)),
    CatalogColumn("returnonasset", "Return on assets", ("ROA",), "percent", "ratio", "pr", ("returnOnAsset",)),
    CatalogColumn("returnontangibleassets", "Return on tangible assets", (), "percent", "ratio", "pr", ("returnOnTangibleAssets",)),
    CatalogColumn("grossmargin", "Gross margin", (), "percent", "ratio", "pr", ("grossMargin",)),
    CatalogColumn("operatingmargin", "OPM", ("Operating margin",), "percent", "ratio", "pr", ("operatingMargin",)),
    CatalogColumn("ebitdamargin", "EBITDA margin", (), "percent", "ratio", "pr", ("ebitdaMargin",)),
    CatalogColumn("ebitmargin", "EBIT margin", (), "percent", "ratio", "pr", ("ebitMargin",)),
    CatalogColumn("netmargin", "Net profit margin", ("NPM",), "percent", "ratio", "pr", ("netMargin",)),
    CatalogColumn("pretaxmargin", "Pre tax margin", (), "percent", "ratio", "pr", ("preTaxMargin",)),
    CatalogColumn("effectivetaxrate", "Tax rate", (), "percent", "ratio", "pr", ("effectiveTaxRate",)),
    CatalogColumn("totaldebttoequity", "Debt to equity", (), "ratio", "ratio", "le", ("totalDebtToEquity",)),
    CatalogColumn("longtermdebttoequity", "Long term debt to equity", (), "ratio", "ratio", "le", ("longTermDebtToEquity",)),
    CatalogColumn("totaldebttoassets", "Debt to assets", (), "ratio", "ratio", "le", ("totalDebttoAssets",)),
    CatalogColumn("financialleverage", "Financial leverage", (), "ratio", "ratio", "le", ("financialLeverage",)),
    CatalogColumn("totaldebttofcf", "Debt to free cash flow", (), "ratio", "ratio", "le", ("totalDebtTofcf",)),
    CatalogColumn("currentratio", "Current ratio", (), "ratio", "ratio", "li", ("currentRatio",)),
    CatalogColumn("quickratio", "Quick ratio", (), "ratio", "ratio", "li", ("quickRatio",)),
    CatalogColumn("interestcoverage", "Interest Coverage Ratio", (), "ratio", "ratio", "li", ("interestCoverage",)),
    CatalogColumn("assetturnover", "Asset turnover", (), "ratio", "ratio", "ef", ("assetTurnover",)),
    CatalogColumn("inventoryturnover", "Inventory turnover", (), "ratio", "ratio", "ef", ("inventoryTurnover",)),
    CatalogColumn("receivableturnover", "Receivable turnover", (), "ratio", "ratio", "ef", ("receivableTurnover",)),
    CatalogColumn("workingcapitalturnover", "Working capital turnover", (), "ratio", "ratio", "ef", ("workingCapitalTurnover",)),
    CatalogColumn("debtordays", "Debtor days", (), "days", "ratio", "ef", ("debtorDays",)),
    CatalogColumn("inventorydays", "Inventory days", (), "days", "ratio", "ef", ("inventoryDays",)),
    CatalogColumn("dayspayable", "Days payable", (), "days", "ratio", "ef", ("daysPayable",)),
    CatalogColumn("cashconversioncycle", "Cash conversion cycle", (), "days", "ratio", "ef", ("cashConversionCycle",)),
    CatalogColumn("workingcapitaldays", "Working capital days", (), "days", "ratio", "ef", ("workingCapitalDays",)),
    CatalogColumn("revenuegrowth3years", "Sales growth 3Years", ("Sales growth 3Y",), "percent", "metric", "gr", ("revenueGrowth3years",)),
    CatalogColumn("revenuegrowth5years", "Sales growth 5Years", ("Sales growth 5Y",), "percent", "metric", "gr", ("revenueGrowth5years",)),
    CatalogColumn("netincomegrowth3years", "Profit growth 3Years", (), "percent", "metric", "gr", ("netIncomeGrowth3years",)),
    CatalogColumn("netincomegrowth5years", "Profit growth 5Years", (), "percent", "metric", "gr", ("netIncomeGrowth5years",)),
    CatalogColumn("epsgrowth3years", "EPS growth 3Years", (), "percent", "metric", "gr", ("epsGrowth3years",)),
    CatalogColumn("epsgrowth5years", "EPS growth 5Years", (), "percent", "metric", "gr", ("epsGrowth5years",)),
    CatalogColumn("ebitdagrowth3years", "EBITDA growth 3Years", (), "percent", "metric", "gr", ("EBITDAGrowth3years",)),
    CatalogColumn("ebitdagrowth5years", "EBITDA growth 5Years", (), "percent", "metric", "gr", ("EBITDAGrowth5years",)),
    CatalogColumn("assetgrowth3years", "Asset growth 3Years", (), "percent", "metric", "gr", ("assetGrowth3years",)),
    CatalogColumn("bookvaluegrowth3years", "Book value growth 3Years", (), "percent", "metric", "gr", ("bookValueGrowth3Years",)),
    CatalogColumn("cfogrowth3years", "CFO growth 3Years", (), "percent", "metric", "gr", ("cfoGrowth3years",)),
    CatalogColumn("roe3yearsavg", "Average return on equity 3Years", ("ROE 3Y",), "percent", "metric", "av", ("roe3yearsAvg",)),
    CatalogColumn("roe5yearsavg", "Average return on equity 5Years", ("ROE 5Y",), "percent", "metric", "av", ("roe5yearsAvg",)),
    CatalogColumn("roce3yearsavg", "Average return on capital employed 3Years", ("ROCE 3Y",), "percent", "metric", "av", ("roce3yearsAvg",)),
    CatalogColumn("roce5yearsavg", "Average return on capital employed 5Years", (), "percent", "metric", "av", ("roce5yearsAvg",)),
    CatalogColumn("roa3yearsavg", "Average return on assets 3Years", (), "percent", "metric", "av", ("roa3yearsAvg",)),
    CatalogColumn("netmarginpct3yrsavg", "Average net margin 3Years", (), "percent", "metric", "av", ("netMarginPct3YrsAvg",)),
    CatalogColumn("operatingmarginpct3yrsavg", "Average operating margin 3Years", (), "percent", "metric", "av", ("operatingMarginPct3YrsAvg",)),
    CatalogColumn("dividendpayoutpct3yrsavg", "Average dividend payout 3Years", (), "percent", "metric", "av", ("dividendPayoutPct3YrsAvg",)),
    CatalogColumn("dividendpayoutpct5yrsavg", "Average dividend payout 5Years", (), "percent", "metric", "av", ("dividendPayoutPct5YrsAvg",)),
    CatalogColumn("fcfaspctofrevenue3yearsavg", "Average FCF to revenue 3Years", (), "percent", "metric", "av", ("fcfAsPctOfRevenue3yearsAvg",)),
    CatalogColumn("operatingcashflow3yearstotal", "Cash from operations 3Years", (), "crore", "metric", "cu", ("operatingCashFlow3yearsTotal",)),
    CatalogColumn("freecashflow3yearstotal", "Free cash flow 3Years", (), "crore", "metric", "cu", ("freeCashFlow3yearsTotal",)),
    CatalogColumn("dividend_yield", "Dividend Yield", (), "percent", "computed", "", ()),
    CatalogColumn("enterprise_value", "Enterprise Value", ("EV",), "crore", "computed", "", ()),
    CatalogColumn("ev_ebitda", "EV to EBITDA", ("EV/EBITDA",), "ratio", "computed", "", ()),
    CatalogColumn("earnings_yield", "Earnings yield", (), "percent", "computed", "", ()),
    CatalogColumn("price_cagr_1y", "Return over 1year", (), "percent", "computed", "", ()),
    CatalogColumn("price_cagr_3y", "Return over 3years", (), "percent", "computed", "", ()),
    CatalogColumn("price_cagr_5y", "Return over 5years", (), "percent", "computed", "", ()),
    CatalogColumn("price_cagr_10y", "Return over 10years", (), "percent", "computed", "", ()),
    CatalogColumn("down_from_52w_high", "Down from 52w high", (), "percent", "computed", "", ()),
    CatalogColumn("up_from_52w_low", "Up from 52w low", (), "percent", "computed", "", ()),
    CatalogColumn("dma_50", "DMA 50", (), "price", "computed", "", ()),
    CatalogColumn("dma_200", "DMA 200", (), "price", "computed", "", ()),
    CatalogColumn("price_to_dma200", "Price to DMA 200", (), "ratio", "computed", "", ()),
    CatalogColumn("avg_traded_value_30d", "Average traded value 30days", (), "crore", "computed", "", ()),
    CatalogColumn("promoter_holding", "Promoter holding", (), "percent", "computed", "", ()),
    CatalogColumn("promoter_pledge", "Pledged percentage", ("Promoter pledge",), "percent", "computed", "", ()),
    CatalogColumn("public_holding", "Public holding", (), "percent", "computed", "", ()),
    CatalogColumn("cfo_to_pat", "CFO to PAT", (), "ratio", "computed", "", ()),
    CatalogColumn("index", "Index", ("Index membership",), "text", "computed", "", ()),
)
# fmt: on
BY_KEY = {c.key: c for c in COLUMNS}


def stored() -> tuple[CatalogColumn, ...]:
    """Entries that are real columns of the snapshot."""
    return tuple(c for c in COLUMNS if c.key not in PSEUDO_KEYS)


def of_source(source: str) -> tuple[CatalogColumn, ...]:
    return tuple(c for c in stored() if c.source == source)


def _plain(name: str) -> str:
    return " ".join(name.lower().replace("_", " ").split())


_LOOKUP = {_plain(name): c for c in COLUMNS for name in c.names()}


def find(name: str) -> CatalogColumn | None:
    """An entry by key, label or alias, whatever the case, spaces or underscores."""
    return _LOOKUP.get(_plain(name))


def resolve(name: str) -> CatalogColumn:
    entry = find(name)
    if entry is None:
        raise UnknownColumn(f'Unknown column: "{name}"')
    return entry


def resolve_all(names: Iterable[str]) -> list[CatalogColumn]:
    """Entries in the order asked for, each once."""
    return list(dict.fromkeys(resolve(n) for n in names))


def col(name: str) -> Column:
    """The snapshot column that a key, label or alias stands for."""
    return F.col(resolve(name).key)


def relabel(df: DataFrame) -> DataFrame:
    """A snapshot with display labels as column names."""
    return df.withColumnsRenamed({c.key: c.label for c in stored() if c.key in df.columns})


def snapshot_schema() -> StructType:
    """Schema of the stored snapshot, made from the catalog so the two cannot differ."""
    return StructType([StructField("symbol", StringType()), *[c.field() for c in stored()]])
