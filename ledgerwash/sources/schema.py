"""Declared schemas (A1, A2) and the fixed values of the cleaning rules.

Raw data lands as text: nothing is cast on arrival; typed columns are added
beside the raw ones by the cleaning pipeline.
"""

from __future__ import annotations

from pyspark.sql import types as T

# A1: the customer dimension; customer_id is the declared primary key.
CUSTOMERS_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("full_name", T.StringType(), True),
    T.StructField("email", T.StringType(), True),
    T.StructField("phone", T.StringType(), True),
    T.StructField("city", T.StringType(), True),
    T.StructField("account_type", T.StringType(), True),
    T.StructField("account_number", T.StringType(), True),
    T.StructField("join_date", T.StringType(), True),
    T.StructField("credit_score", T.IntegerType(), True),
])

# A2: the raw fact, every business column text. ``ingest_seq`` is the
# arrival order (the first arrival of an id wins deduplication); ``k`` is a
# row key that makes ordering ties deterministic.
RAW_TRANSACTIONS_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType(), True),
    T.StructField("customer_id", T.StringType(), True),
    T.StructField("customer_name", T.StringType(), True),
    T.StructField("account_number", T.StringType(), True),
    T.StructField("transaction_date", T.StringType(), True),
    T.StructField("amount", T.StringType(), True),
    T.StructField("currency", T.StringType(), True),
    T.StructField("transaction_type", T.StringType(), True),
    T.StructField("merchant_name", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("location", T.StringType(), True),
    T.StructField("notes", T.StringType(), True),
    T.StructField("ingest_seq", T.LongType(), True),
    T.StructField("k", T.LongType(), True),
])

RAW_TEXT_COLUMNS = [f.name for f in RAW_TRANSACTIONS_SCHEMA.fields][:13]

# Declared VARCHAR limits of the source tables.
CUSTOMER_LENGTH_LIMITS = {
    "customer_id": 12, "full_name": 100, "email": 100, "phone": 15, "city": 50,
    "account_type": 20, "account_number": 20, "join_date": 15,
}
TRANSACTION_LENGTH_LIMITS = {
    "transaction_id": 20, "customer_id": 12, "customer_name": 100, "account_number": 20,
    "transaction_date": 30, "amount": 20, "currency": 10, "transaction_type": 20,
    "merchant_name": 100, "category": 50, "status": 20, "location": 50, "notes": 100,
}

# ---------------------------------------------------------------------------
# These must equal the source rules exactly for equal results.
# ---------------------------------------------------------------------------
UNKNOWN_NAME = "Unknown"
UNCATEGORISED = "Uncategorised"
UNKNOWN_STATUS = "unknown"
UNKNOWN_LOCATION = "Unknown"
NAIRA_SIGN = "₦"
NAIRA_CODE = "NGN"
NA_AMOUNT = "N/A"
ZERO_AMOUNTS = ("0.00", "0")
ZERO_FLAG = "ZERO AMOUNT — EXCLUDE FROM ANALYSIS"
ZERO_MARK = "%ZERO AMOUNT%"
FUTURE_FLAG = "FUTURE DATE — VERIFY"
FUTURE_MARK = "%FUTURE DATE%"
FLAG_SEPARATOR = " | "
# The first future-date attempt: LIKE has no character classes, so these only
# match the literal bracket text (kept as written, see README).
FUTURE_PREFIX_PATTERNS = ("202[6-9]%", "20[3-9]%")
# The final future-date rule: the year text anywhere in the raw date.
FUTURE_YEARS = ("2025", "2026", "2027")
DEBIT = "debit"
CREDIT = "credit"
REVERSED = "reversed"
AMOUNT_TYPE = T.DecimalType(15, 2)

# Merchant canonicalisation: canonical name -> spellings, matched on
# lower(trim(merchant_name)); anything else keeps its original text.
MERCHANT_VARIANTS = {
    "GTBank Transfer": ("gt bank transfer", "gt-bank transfer", "gtbank transfer",
                        "gtbank", "g.t bank", "gt bank", "gt-bank"),
    "Shoprite": ("shoprite", "shop rite", "shoprite ng"),
    "Chicken Republic": ("chicken republic", "chicken-republic", "chickenrepublic"),
    "KFC Nigeria": ("kfc nigeria", "kfc", "kfc nig", "k.f.c nigeria"),
    "Bolt Nigeria": ("bolt nigeria", "bolt", "bolt ng"),
    "MTN Airtime": ("mtn airtime", "mtn", "mtn nigeria"),
    "Jumia Nigeria": ("jumia nigeria", "jumia", "jumia ng"),
    "DSTV": ("dstv", "dstv nigeria", "d.s.t.v"),
    "Zenith Bank Transfer": ("zenith bank transfer", "zenith transfer",
                             "zenith bank", "zenith-bank"),
    "Netflix": ("netflix", "netflix ng"),
}

# Date layouts, tried in this order (first match wins). Each entry:
# (name, anchored pattern, guard separator, guard part, Spark pattern, drop commas).
# A guard means: split on the separator, that 1-based part must be above 12.
DATE_BRANCHES = (
    ("iso_dash", r"^\d{4}-\d{2}-\d{2}\z", None, None, "yyyy-MM-dd", False),
    ("iso_slash", r"^\d{4}/\d{2}/\d{2}\z", None, None, "yyyy/MM/dd", False),
    ("dash_day_first", r"^\d{2}-\d{2}-\d{4}\z", "-", 1, "dd-MM-yyyy", False),
    ("dash_month_first", r"^\d{2}-\d{2}-\d{4}\z", "-", 2, "MM-dd-yyyy", False),
    ("dash_ambiguous", r"^\d{2}-\d{2}-\d{4}\z", None, None, "dd-MM-yyyy", False),
    ("slash_month_first", r"^\d{2}/\d{2}/\d{4}\z", "/", 2, "MM/dd/yyyy", False),
    ("slash_day_first", r"^\d{2}/\d{2}/\d{4}\z", "/", 1, "dd/MM/yyyy", False),
    ("slash_ambiguous", r"^\d{2}/\d{2}/\d{4}\z", None, None, "dd/MM/yyyy", False),
    ("month_abbrev", r"^[A-Za-z]{3} \d{2} \d{4}\z", None, None, "MMM dd yyyy", False),
    ("month_name_comma", r"^\d{2} [A-Za-z]+, \d{4}\z", None, None, "dd MMMM yyyy", True),
)
