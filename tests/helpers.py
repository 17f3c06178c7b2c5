from pyspark.sql import types as T

from ledgerwash.sources.schema import CUSTOMERS_SCHEMA, RAW_TRANSACTIONS_SCHEMA

_DEFAULTS = dict(transaction_id="T1", customer_id="C1", customer_name="Ann", account_number="AC1",
                 transaction_date="2024-01-02", amount="10.00", currency="NGN", transaction_type="debit",
                 merchant_name="Shoprite", category="Food", status="completed", location="Lagos", notes="",
                 ingest_seq=1, k=0)


def tx(spark, *rows):
    """Raw transactions from dicts; unspecified columns take defaults."""
    data = []
    for i, r in enumerate(rows):
        row = dict(_DEFAULTS, k=i, **r)
        data.append(tuple(row[f.name] for f in RAW_TRANSACTIONS_SCHEMA.fields))
    return spark.createDataFrame(data, RAW_TRANSACTIONS_SCHEMA)


def customers(spark, *rows):
    base = dict(customer_id="C1", full_name="Ann", email=None, phone="0", city="Lagos",
                account_type="Savings", account_number=None, join_date="2020-01-01", credit_score=700)
    data = [tuple(dict(base, **r)[f.name] for f in CUSTOMERS_SCHEMA.fields) for r in rows]
    return spark.createDataFrame(data, CUSTOMERS_SCHEMA)


def one_col(spark, values, dtype=T.StringType(), name="v"):
    return spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField(name, dtype, True)]))
