"""Which statement family a set of field names belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marker fields per family, in tie-break order.
MARKERS = {
    "bank": (
        "interestExpended", "interestOrDiscountOnAdvancesOrBills", "interestOnBalancesWithRBIAndOthers",
        "provisionsForLoanLoss", "expenditureExcludingProvisions", "cET1Ratio", "grossNonPerformingAssets",
        "percentageOfGrossNpa",
    ),
    "life_insurance": (
        "grossPremiumIncome", "netPremiumIncome", "incomeFirstYearPremium", "incomeRenewalPremium",
        "changeInActuarialLiability", "allocationOfBonusToPolicyholders",
        "transferOfFundsToPolicyholdersAccount", "persistencyRatio", "conservationRatio",
    ),
    "general_insurance": (
        "grossPremiumsWritten", "netPremiumWritten", "premiumEarned", "incurredClaims",
        "incurredClaimRatio", "combinedRatio", "underwritingProfitOrLoss", "netRetentionRatio",
        "premiumDeficiency",
    ),
    "general": (
        "revenueFromOperations", "costofGoodsSold", "costOfMaterialsConsumed", "changesInInventories",
        "purchasesOfStockInTrade", "employeeBenefitExpense", "depreciationAndAmortisation", "financeCosts",
    ),
}

# Fields that every family reports and that tell nothing about it.
NON_DISCRIMINATING = ("eps", "income", "period_start", "period_end", "result_date", "year")

# P&L fields with a known meaning, for the two families where the full set is known.
KNOWN_FIELDS = {
    "general": (
        "changesInInventories", "costOfMaterialsConsumed", "costofGoodsSold", "currentTax", "deferredTax",
        "depreciationAndAmortisation", "dilutedOutstandingShares", "dividendIncome", "employeeBenefitExpense",
        "exceptionalItemsBeforeTax", "expenses", "extraordinaryItems", "feesAndCommission",
        "feesAndCommissionIncome", "financeCosts", "impairmentOnFinancialInstruments", "interestEarned",
        "netGainOnAmortisedDerecognition", "netGainOnFairValueChanges", "netLossOnAmortisedDerecognition",
        "netLossOnFairValueChanges", "nonControllingInterests", "otherComprehensiveIncomeNetOfTaxes",
        "otherExpenses", "otherIncome", "otherRevenueFromOperations", "profitBeforeTax", "profitLossForPeriod",
        "profitLossFromDiscontinuedOperationsAfterTax", "profitOrLossAttributableToOwners",
        "profitOrLossOfAssociates", "purchasesOfStockInTrade", "rentalIncome", "revenueFromOperations",
        "revenueFromSaleOfProduct", "revenueFromSaleOfServices", "taxExpense",
    ),
    "bank": (
        "additionalTier1Ratio", "cET1Ratio", "dilutedOutstandingShares", "employeesCost", "exceptionalItems",
        "expenditureExcludingProvisions", "extraordinaryItems", "grossNonPerformingAssets", "interestEarned",
        "interestExpended", "interestOnBalancesWithRBIAndOthers", "interestOrDiscountOnAdvancesOrBills",
        "nonPerformingAssets", "otherIncome", "otherInterest", "otherOperatingExpenses", "percentageOfGrossNpa",
        "percentageOfNpa", "profitLossBeforeTax", "profitLossForThePeriod", "profitLossOfAssociates",
        "profitLossOfMinorityInterest", "profitOrLossAttributableToOwners", "provisionsForLoanLoss",
        "revenueOnInvestments", "taxExpense",
    ),
}


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def signature(fields: Column) -> Column:
    """Field names that tell families apart."""
    return F.array_except(fields, _texts(NON_DISCRIMINATING))


def marker_hits(fields: Column, family: str) -> Column:
    return F.size(F.array_intersect(signature(fields), _texts(MARKERS[family])))


def classify(fields: Column) -> Column:
    """Best family as a struct (kind, confidence, hits, margin); `unknown` where no marker is present.

    Families score by the share of their markers present, then by the number, then in the order of MARKERS.
    """
    scored = F.sort_array(
        F.array(
            *[
                F.named_struct(
                    F.lit("share"), marker_hits(fields, family) / F.lit(float(len(markers))),
                    F.lit("hits"), marker_hits(fields, family),
                    F.lit("tie"), F.lit(-i),
                    F.lit("kind"), F.lit(family),
                )
                for i, (family, markers) in enumerate(MARKERS.items())
            ]
        ),
        asc=False,
    )
    best, second = F.element_at(scored, 1), F.element_at(scored, 2)
    known = best["hits"] > 0
    return F.named_struct(
        F.lit("kind"), F.when(known, best["kind"]).otherwise("unknown"),
        F.lit("confidence"), F.when(known, F.round(best["share"], 3)).otherwise(0.0),
        F.lit("hits"), F.when(known, best["hits"]).otherwise(0),
        F.lit("margin"), F.when(known, best["share"] - second["share"]).otherwise(0.0),
    )


def unknown_fields(fields: Column, kind: Column) -> Column:
    """Field names without a known meaning in the family; empty where the family's full set is not known."""
    out = F.array().cast("array<string>")
    sig = signature(fields)
    for family, known in KNOWN_FIELDS.items():
        out = F.when(kind == family, F.array_except(sig, _texts(known))).otherwise(out)
    return out


def field_sets(lines: DataFrame) -> DataFrame:
    """Sorted distinct field names per symbol. Names are made distinct first: they come from a small vocabulary."""
    names = lines.select("symbol", "field_name").distinct()
    return names.groupBy("symbol").agg(F.array_sort(F.collect_set("field_name")).alias("fields"))


def families(lines: DataFrame) -> DataFrame:
    """Family per symbol from all P&L fields it ever reported."""
    found = field_sets(lines).withColumn("c", classify(F.col("fields")))
    return found.select("symbol", "fields", "c.kind", "c.confidence", "c.hits", "c.margin")


def clusters(sets: DataFrame) -> DataFrame:
    """Companies with the same field set: signature, number of members, first and last symbol."""
    signed = sets.select("symbol", F.concat_ws(",", F.array_sort(signature(F.col("fields")))).alias("signature"))
    return signed.groupBy("signature").agg(
        F.count("*").alias("size"), F.min("symbol").alias("first_symbol"), F.max("symbol").alias("last_symbol")
    )
