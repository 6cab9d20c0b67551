"""Word lists, patterns and constants that results depend on."""

from __future__ import annotations

# Lexical rerank: words that are no entities.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on",
    "or", "that", "the", "to", "was", "what", "when", "where", "which", "who", "why", "with", "year",
    "did", "do", "does", "were", "had", "has", "have", "within", "between", "during", "reported",
    "report", "show", "shown", "stated", "figure", "value", "total",
)

# Questions that ask for a number.
NUMERIC_PHRASES = (
    "how much", "how many", "what amount", "what proportion", "what percentage", "what percent",
    "what was the total", "what is the total", "number of", "amount of",
)
NUMERIC_TOKENS = (
    "amount", "total", "value", "cost", "spend", "spending", "expenditure", "budget", "deficit", "surplus",
    "income", "assets", "liabilities", "cash", "equivalent", "equivalents", "rate", "ratio", "percent",
    "percentage", "proportion", "count", "number", "overspend", "underspend", "recurring", "nonrecurring",
)

# Tokens and what they count as.
CANONICAL = {
    "spent": "spend", "spending": "spend", "costs": "cost", "amounts": "amount", "totals": "total",
    "figures": "figure", "percentages": "percent", "percent": "percent", "percentage": "percent",
    "proportion": "percent", "proportions": "percent", "values": "value", "deficits": "deficit",
    "surpluses": "surplus", "assets": "asset", "liabilities": "liability", "equivalents": "equivalent",
    "overspent": "overspend", "under-spend": "underspend", "non-recurring": "nonrecurring",
    "one-off": "nonrecurring", "oneoff": "nonrecurring",
}

# Router vocabularies.
FINANCIAL_TARGETS = (
    "resource limit", "revenue resource", "capital resource", "cash requirement", "statutory financial target",
    "core revenue", "non-core revenue", "total revenue", "core capital", "non-core capital", "total capital",
)
FINANCIAL_STATEMENTS = (
    "income", "expenditure", "surplus", "deficit", "total assets", "net assets", "total liabilities",
    "financial position", "financial performance", "balance sheet", "income statement", "statement of",
    "total expenditure", "total income", "operating cost", "operating expenditure",
)
PERFORMANCE = (
    "waiting time", "waiting list", "referral to treatment", "cancer target", "18 weeks", "12 weeks", "4 hours",
    "unscheduled care", "delayed discharge", "bed days", "sickness absence", "readmission", "attendance",
    "drug", "alcohol", "mental health target", "achieve", "performance target", "kpi",
)
STAFF_COSTS = ("staff cost", "staff costs", "employee benefit", "remuneration", "pension cost")
EMISSIONS = ("emission", "emissions", "greenhouse gas", "co2", "carbon")

# Query rewriting: a term and what is added behind a question that has it.
SYNONYMS = {
    "deficit": "overspend / shortfall",
    "surplus": "underspend",
    "staff costs": "employee benefits / remuneration / pension costs",
    "emissions": "greenhouse gas / carbon / co2",
    "integration joint board": "ijb",
    "ijb": "integration joint board",
}

# Section titles in which tables are preferred.
TABLE_SECTIONS = ("performance report", "financial highlights", "performance analysis", "overview")

# Table types and their keywords, in the order that decides ties.
TABLE_TYPES = {
    "cash_flow": ("cash flow", "non-cash transaction", "note 2a", "note 2b", "reconciliation of net cash"),
    "balance_sheet": ("balance sheet", "statement of financial position", "net assets", "total assets"),
    "income_statement": ("statement of comprehensive net expenditure", "socne", "income and expenditure", "operating costs"),
    "staff_costs": ("staff costs", "employee benefit", "remuneration", "pension costs"),
    "property": ("property, plant and equipment", "ppe", "intangible assets", "additions to assets"),
    "provisions": ("provisions", "contingent liabilities", "clinical negligence"),
    "financial_instruments": ("financial instruments", "financial assets", "financial liabilities"),
}

# Typographic characters and what replaces them.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
ZERO_WIDTH = ("​", "‌", "‍", "﻿")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

# Retrieval defaults.
BM25_K1, BM25_B, OKAPI_EPSILON = 1.5, 0.75, 0.25
RRF_K, DENSE_WEIGHT, SPARSE_WEIGHT = 20, 0.5, 2.0
CROSS_ENCODER_WEIGHT = 0.2
BOOST_TABLE, BOOST_ENTITY, BOOST_DENSITY, BOOST_SEGMENT, BOOST_SUBSECTION, CROSS_PAGE_PENALTY = 0.08, 0.04, 0.03, 0.03, 0.05, 0.08
MAX_ENTITIES = 4
LOW_MARGIN = 0.002
KS = (1, 3, 5, 10)

# Windows of words: what stands for 224 and 56 tokens.
WINDOW_WORDS, OVERLAP_WORDS, LEAST_WORDS = 168, 42, 20

#: Words of a question that ask for a share, for money; what a question is about, and what stands near its answer.
PERCENT_WORDS = ("%", "percent", "percentage", "proportion", "share", "rate", "ratio")
CURRENCY_WORDS = ("£", "cost", "spend", "spending", "budget", "deficit", "surplus", "overspend", "shortfall", "income", "expenditure", "funding")
ANSWER_CUES = (
    (("budget", "spending", "spend", "differ", "difference", "underspend", "overspend"), ("variance", "surplus", "deficit", "overspend", "underspend", "budget")),
    (("deficit", "surplus", "overspend", "shortfall"), ("deficit", "surplus", "overspend", "shortfall", "variance")),
    (("total", "overall total", "sum"), ("total",)),
    (("cash requirement",), ("cash requirement",)),
)
