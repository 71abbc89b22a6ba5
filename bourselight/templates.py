"""Statement layouts as data: which rows a statement shows, in which order and unit."""

from __future__ import annotations

from dataclasses import dataclass

# The P&L layout of each statement family. Balance sheets and cash flows use the general layout.
PL_LAYOUTS = {
    "general": "general_pl",
    "bank": "bank_pl",
    "life_insurance": "life_pl",
    "general_insurance": "general_insurance_pl",
}
SHARED_LAYOUTS = {"bs": "general_bs", "cf": "general_cf"}

@dataclass(frozen=True)
class TemplateRow:
    layout: str
    ord: int
    parent: int | None
    label: str
    unit: str
    emphasis: bool
    formula: str | None
    fields: list[str]


def derived(formula: str) -> str:
    """The name under which a period's figures hold the result of a formula."""
    return f"f({formula})"


# Layout, order, order of the parent row, label, unit, emphasis, formula, and fields in order of preference.
# fmt: off
ROWS = (
    TemplateRow("general_pl", 100, None, "Sales", "crore", False, None, ["revenueFromOperations"]),
    TemplateRow("general_pl", 101, 100, "Revenue from sale of product", "crore", False, None, ["revenueFromSaleOfProduct"]),
    TemplateRow("general_pl", 102, 100, "Revenue from sale of services", "crore", False, None, ["revenueFromSaleOfServices"]),
    TemplateRow("general_pl", 103, 100, "Other operating revenue", "crore", False, None, ["otherRevenueFromOperations"]),
    TemplateRow("general_pl", 200, None, "Expenses", "crore", False, "operating_expenses", ["f(operating_expenses)"]),
    TemplateRow("general_pl", 201, 200, "Cost of materials consumed", "crore", False, None, ["costOfMaterialsConsumed"]),
    TemplateRow("general_pl", 202, 200, "Purchases of stock in trade", "crore", False, None, ["purchasesOfStockInTrade"]),
    TemplateRow("general_pl", 203, 200, "Changes in inventories", "crore", False, None, ["changesInInventories"]),
    TemplateRow("general_pl", 204, 200, "Employee benefit expense", "crore", False, None, ["employeeBenefitExpense"]),
    TemplateRow("general_pl", 205, 200, "Other expenses", "crore", False, None, ["otherExpenses"]),
    TemplateRow("general_pl", 300, None, "Operating Profit", "crore", True, "operating_profit", ["f(operating_profit)"]),
    TemplateRow("general_pl", 400, None, "OPM %", "percent", False, "operating_margin", ["f(operating_margin)"]),
    TemplateRow("general_pl", 500, None, "Other Income", "crore", False, None, ["otherIncome"]),
    TemplateRow("general_pl", 501, 500, "Dividend income", "crore", False, None, ["dividendIncome"]),
    TemplateRow("general_pl", 502, 500, "Rental income", "crore", False, None, ["rentalIncome"]),
    TemplateRow("general_pl", 503, 500, "Interest earned", "crore", False, None, ["interestEarned"]),
    TemplateRow("general_pl", 600, None, "Interest", "crore", False, None, ["financeCosts"]),
    TemplateRow("general_pl", 700, None, "Depreciation", "crore", False, None, ["depreciationAndAmortisation"]),
    TemplateRow("general_pl", 800, None, "Profit before tax", "crore", True, None, ["profitBeforeTax"]),
    TemplateRow("general_pl", 900, None, "Tax %", "percent", False, "tax_rate", ["f(tax_rate)"]),
    TemplateRow("general_pl", 1000, None, "Net Profit", "crore", True, None, ["profitLossForPeriod"]),
    TemplateRow("general_pl", 1001, 1000, "Profit from discontinued operations", "crore", False, None, ["profitLossFromDiscontinuedOperationsAfterTax"]),
    TemplateRow("general_pl", 1002, 1000, "Profit of associates", "crore", False, None, ["profitOrLossOfAssociates"]),
    TemplateRow("general_pl", 1003, 1000, "Non-controlling interests", "crore", False, None, ["nonControllingInterests"]),
    TemplateRow("general_pl", 1004, 1000, "Attributable to owners", "crore", False, None, ["profitOrLossAttributableToOwners"]),
    TemplateRow("general_pl", 1100, None, "EPS in Rs", "price", False, None, ["eps"]),
    TemplateRow("general_pl", 1200, None, "Dividend Payout %", "fraction_pct", False, None, ["dividendPayout"]),
    TemplateRow("general_bs", 100, None, "Equity Capital", "crore", False, None, ["equityCapital", "shareCapital"]),
    TemplateRow("general_bs", 200, None, "Reserves", "crore", False, None, ["reserves", "totalReserves"]),
    TemplateRow("general_bs", 300, None, "Borrowings", "crore", False, None, ["borrowingsNoncurrent"]),
    TemplateRow("general_bs", 301, 300, "Long term borrowings", "crore", False, None, ["borrowingsNoncurrent"]),
    TemplateRow("general_bs", 302, 300, "Short term borrowings", "crore", False, None, ["borrowingsCurrent"]),
    TemplateRow("general_bs", 400, None, "Other Liabilities", "crore", False, None, ["noncurrentLiabilities"]),
    TemplateRow("general_bs", 401, 400, "Trade payables", "crore", False, None, ["tradePayablesCurrent"]),
    TemplateRow("general_bs", 402, 400, "Current liabilities", "crore", False, None, ["currentLiabilities"]),
    TemplateRow("general_bs", 403, 400, "Non-current liabilities", "crore", False, None, ["noncurrentLiabilities"]),
    TemplateRow("general_bs", 500, None, "Total Liabilities", "crore", True, None, ["equityAndLiabilities", "liabilities"]),
    TemplateRow("general_bs", 600, None, "Fixed Assets", "crore", False, None, ["propertyPlantAndEquipment", "fixedAssets"]),
    TemplateRow("general_bs", 601, 600, "Intangible assets", "crore", False, None, ["intangibleAssets"]),
    TemplateRow("general_bs", 602, 600, "Right of use assets", "crore", False, None, ["rightOfUseAssets"]),
    TemplateRow("general_bs", 700, None, "CWIP", "crore", False, None, ["capitalWorkInProgress"]),
    TemplateRow("general_bs", 800, None, "Investments", "crore", False, None, ["noncurrentInvestments", "currentInvestments"]),
    TemplateRow("general_bs", 900, None, "Other Assets", "crore", False, None, ["otherNoncurrentAssets", "otherCurrentAssets"]),
    TemplateRow("general_bs", 901, 900, "Inventories", "crore", False, None, ["inventories"]),
    TemplateRow("general_bs", 902, 900, "Trade receivables", "crore", False, None, ["tradeReceivablesCurrent"]),
    TemplateRow("general_bs", 903, 900, "Cash and equivalents", "crore", False, None, ["cashAndCashEquivalents"]),
    TemplateRow("general_bs", 1000, None, "Total Assets", "crore", True, None, ["assets"]),
    TemplateRow("general_cf", 100, None, "Cash from Operating Activity", "crore", False, None, ["cashFlowsFromOperatingActivities"]),
    TemplateRow("general_cf", 200, None, "Cash from Investing Activity", "crore", False, None, ["cashFlowsFromInvestingActivities"]),
    TemplateRow("general_cf", 300, None, "Cash from Financing Activity", "crore", False, None, ["cashFlowsFromFinancingActivities"]),
    TemplateRow("general_cf", 400, None, "Net Cash Flow", "crore", True, None, ["netCashFlow"]),
    TemplateRow("general_cf", 500, None, "Free Cash Flow", "crore", False, None, ["fcf"]),
    TemplateRow("bank_pl", 100, None, "Revenue", "crore", False, None, ["interestEarned"]),
    TemplateRow("bank_pl", 101, 100, "Interest on advances / bills", "crore", False, None, ["interestOrDiscountOnAdvancesOrBills"]),
    TemplateRow("bank_pl", 102, 100, "Income on investments", "crore", False, None, ["revenueOnInvestments"]),
    TemplateRow("bank_pl", 103, 100, "Interest on balances with RBI", "crore", False, None, ["interestOnBalancesWithRBIAndOthers"]),
    TemplateRow("bank_pl", 104, 100, "Other interest", "crore", False, None, ["otherInterest"]),
    TemplateRow("bank_pl", 200, None, "Interest", "crore", False, None, ["interestExpended"]),
    TemplateRow("bank_pl", 300, None, "Expenses", "crore", False, None, ["expenditureExcludingProvisions"]),
    TemplateRow("bank_pl", 301, 300, "Employee cost", "crore", False, None, ["employeesCost"]),
    TemplateRow("bank_pl", 302, 300, "Other operating expenses", "crore", False, None, ["otherOperatingExpenses"]),
    TemplateRow("bank_pl", 400, None, "Financing Profit", "crore", True, "net_interest_income", ["f(net_interest_income)"]),
    TemplateRow("bank_pl", 500, None, "Financing Margin %", "percent", False, "nim", ["f(nim)"]),
    TemplateRow("bank_pl", 600, None, "Other Income", "crore", False, None, ["otherIncome"]),
    TemplateRow("bank_pl", 700, None, "Provisions", "crore", False, None, ["provisionsForLoanLoss"]),
    TemplateRow("bank_pl", 800, None, "Profit before tax", "crore", True, None, ["profitLossBeforeTax"]),
    TemplateRow("bank_pl", 900, None, "Tax %", "percent", False, "tax_rate", ["f(tax_rate)"]),
    TemplateRow("bank_pl", 1000, None, "Net Profit", "crore", True, None, ["profitLossForThePeriod"]),
    TemplateRow("bank_pl", 1100, None, "EPS in Rs", "price", False, None, ["eps"]),
    TemplateRow("bank_pl", 1200, None, "Gross NPA %", "fraction_pct", False, None, ["percentageOfGrossNpa"]),
    TemplateRow("bank_pl", 1300, None, "Net NPA %", "fraction_pct", False, None, ["percentageOfNpa"]),
    TemplateRow("bank_pl", 1400, None, "CET1 Ratio", "fraction_pct", False, None, ["cET1Ratio"]),
    TemplateRow("life_pl", 100, None, "Gross Premium Income", "crore", False, None, ["grossPremiumIncome"]),
    TemplateRow("life_pl", 101, 100, "First year premium", "crore", False, None, ["incomeFirstYearPremium"]),
    TemplateRow("life_pl", 102, 100, "Renewal premium", "crore", False, None, ["incomeRenewalPremium"]),
    TemplateRow("life_pl", 103, 100, "Single premium", "crore", False, None, ["incomeSinglePremium"]),
    TemplateRow("life_pl", 200, None, "Net Premium Income", "crore", True, None, ["netPremiumIncome"]),
    TemplateRow("life_pl", 300, None, "Income from Investments", "crore", False, None, ["incomeFromInvestmentsNet"]),
    TemplateRow("life_pl", 400, None, "Commission", "crore", False, None, ["netCommission", "commission"]),
    TemplateRow("life_pl", 500, None, "Benefits Paid", "crore", False, None, ["benefitsPaidNet"]),
    TemplateRow("life_pl", 600, None, "Change in Actuarial Liability", "crore", False, None, ["changeInActuarialLiability"]),
    TemplateRow("life_pl", 700, None, "Expenses of Management", "crore", False, None, ["expensesOfManagement"]),
    TemplateRow("life_pl", 800, None, "Surplus / Deficit", "crore", True, None, ["surplusDeficit", "netSurplusDeficit"]),
    TemplateRow("life_pl", 900, None, "Profit before tax", "crore", True, None, ["profitLossBeforeTax", "profitOrLossBeforeTax"]),
    TemplateRow("life_pl", 1000, None, "Net Profit", "crore", True, None, ["profitLossAfterTaxAndExtraordinaryItems", "profitLossAfterTaxBeforeExtraordinaryItems"]),
    TemplateRow("life_pl", 1100, None, "EPS in Rs", "price", False, None, ["eps"]),
    TemplateRow("life_pl", 1200, None, "Solvency Ratio", "solvency", False, None, ["solvencyRatio"]),
    TemplateRow("life_pl", 1300, None, "Persistency Ratio", "fraction_pct", False, None, ["persistencyRatio"]),
    TemplateRow("general_insurance_pl", 100, None, "Gross Premiums Written", "crore", False, None, ["grossPremiumsWritten"]),
    TemplateRow("general_insurance_pl", 200, None, "Net Premium Written", "crore", False, None, ["netPremiumWritten"]),
    TemplateRow("general_insurance_pl", 300, None, "Premium Earned", "crore", True, None, ["premiumEarned"]),
    TemplateRow("general_insurance_pl", 400, None, "Income from Investments", "crore", False, None, ["incomeFromInvestmentsNet"]),
    TemplateRow("general_insurance_pl", 500, None, "Claims Incurred", "crore", False, None, ["incurredClaims", "claimsPaid"]),
    TemplateRow("general_insurance_pl", 600, None, "Commission", "crore", False, None, ["netCommission"]),
    TemplateRow("general_insurance_pl", 700, None, "Operating Expenses", "crore", False, None, ["operatingExpensesRelatedToInsuranceBusiness", "operatingExpenses"]),
    TemplateRow("general_insurance_pl", 800, None, "Underwriting Profit", "crore", True, None, ["underwritingProfitOrLoss"]),
    TemplateRow("general_insurance_pl", 900, None, "Profit before tax", "crore", True, None, ["profitLossBeforeTax", "profitOrLossBeforeTax"]),
    TemplateRow("general_insurance_pl", 1000, None, "Net Profit", "crore", True, None, ["profitLossAfterTax"]),
    TemplateRow("general_insurance_pl", 1100, None, "EPS in Rs", "price", False, None, ["eps"]),
    TemplateRow("general_insurance_pl", 1200, None, "Incurred Claim Ratio", "fraction_pct", False, None, ["incurredClaimRatio"]),
    TemplateRow("general_insurance_pl", 1300, None, "Combined Ratio", "fraction_pct", False, None, ["combinedRatio"]),
    TemplateRow("general_insurance_pl", 1400, None, "Solvency Ratio", "solvency", False, None, ["solvencyRatio"]),
)
# fmt: on


MAX_FIELDS = max(len(r.fields) for r in ROWS)


def layout_rows(layout: str) -> list[TemplateRow]:
    return [r for r in ROWS if r.layout == layout]
