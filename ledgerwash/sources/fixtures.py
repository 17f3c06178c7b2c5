"""Messy ``transactions`` / ``customers`` tables derived from the TESTDATA
star schema (``lineitem`` joined to ``orders``, and ``customer``).

The rules (see FIXTURES.md §2) plant every kind of dirt the cleaning
pipeline repairs: duplicate ids, NULL and blank text, mixed case, merchant
spellings, seven date layouts, future years, ``N/A`` and zero amounts and
reversed rows. Everything is a deterministic function of the source row, so
the DuckDB oracle derives the very same tables from the same parquet files.

The work is one scan of each source table, one join on ``l_orderkey`` and a
narrow projection; the duplicate copies come from an ``explode`` of the same
rows instead of a second pass over the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import CUSTOMERS_SCHEMA, MERCHANT_VARIANTS, RAW_TRANSACTIONS_SCHEMA

# Fixed values of the fixture rules (FIXTURES.md §2), in rule order.
MERCHANT_SPELLINGS = (
    "GTBank Transfer", "gt-bank", "G.T Bank", "Shoprite", "SHOP RITE", "Chicken-Republic",
    "KFC", "K.F.C Nigeria", "bolt ng", "MTN", "Jumia NG ", "D.S.T.V", "zenith-bank",
    "Netflix NG", "Air Peace", "Rent Payment",
)
# Every spelling the merchant rule knows comes after them.
KNOWN_SPELLINGS = tuple(v for variants in MERCHANT_VARIANTS.values() for v in variants)
CURRENCY_SPELLINGS = ("NGN", "ngn", "NGN ", "₦")
ACCOUNT_TYPES = ("Savings", "Current", "Business", "Fixed Deposit")
DUPLICATE_NOTE = "SUSPECTED DUPLICATE"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
TASK_BYTES = 4 << 20


def _s(c: Column) -> Column:
    return c.cast("string")


def _pick(key: Column, values) -> Column:
    """values[key] for a 0-based integer key column; NULL beyond them. A constant array:
    a CASE of as many branches is more code than the JVM compiles."""
    return F.get(F.array(*map(F.lit, values)), key.cast("int"))


def _tasks(spark: SparkSession, path: str) -> int:
    """How many tasks derive rows from the table at ``path``: as many as hold
    ``TASK_BYTES`` of its files each, so that a task's rows, some thirty times wider
    than in the file, are sorted in memory at any size of the table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def _mod(c: Column, m: int) -> Column:
    return c % F.lit(m)


def raw_transactions(spark: SparkSession, sf_dir: str, junk: bool = False) -> DataFrame:
    """The raw fact. ``junk`` adds amounts and dates that no strict cast takes."""
    # Spread by the key of the join that follows: a file with one row group is
    # one task however large. By number, since AQE would merge tasks by the size of
    # these narrow rows, before they become wide ones.
    path = f"{sf_dir}/lineitem.parquet"
    lineitem = spark.read.parquet(path).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").repartition(_tasks(spark, path), "l_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderdate")
    rows = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey, "inner")

    k = (F.col("l_orderkey") * F.lit(1000003) + F.col("l_partkey") * F.lit(9973)
         + F.col("l_suppkey") * F.lit(131) + F.col("l_linenumber")).cast("bigint")
    rows = rows.select("*", k.alias("k"))
    k = F.col("k")
    od = F.col("o_orderdate")
    # Pieces used by several rules are projected once (Catalyst keeps a
    # projection whose non-trivial outputs are referenced more than once).
    rows = rows.select(
        "*",
        _s(F.col("o_custkey")).alias("ck"),
        _s(F.when(_mod(k, 613) == 0, F.lit(2025) + _mod(k, 3))
           .otherwise(F.lit(2022) + _mod(F.year(od), 3))).alias("yy"),
        F.lpad(_s(F.month(od)), 2, "0").alias("mm"),
        F.lpad(_s(F.least(F.dayofmonth(od), F.lit(28))), 2, "0").alias("dd"),
        _pick(F.month(od) - 1, MONTHS).alias("month_name"),
        _pick(F.month(od) - 1, [name[:3] for name in MONTHS]).alias("month_abbrev"),
    )
    ck, yy, mm, dd = F.col("ck"), F.col("yy"), F.col("mm"), F.col("dd")
    month_name, month_abbrev = F.col("month_name"), F.col("month_abbrev")
    layout = _mod(k, 7)
    transaction_date = (
        F.when(_mod(k, 997) == 0, F.concat(yy, F.lit("-1-5")))
        .when(layout == 0, F.concat_ws("-", yy, mm, dd))
        .when(layout == 1, F.concat_ws("/", yy, mm, dd))
        .when(layout == 2, F.concat_ws("/", dd, mm, yy))
        .when((layout == 3) & (_mod(k, 2) == 0), F.concat_ws("-", mm, dd, yy))
        .when(layout == 3, F.concat_ws("-", dd, mm, yy))
        .when(layout == 4, F.concat_ws("/", mm, dd, yy))
        .when(layout == 5, F.concat_ws(" ", month_abbrev, dd, yy))
        .otherwise(F.concat(dd, F.lit(" "), month_name, F.lit(", "), yy)))

    transaction_date = F.when(_mod(k, 911) != 0, transaction_date)
    if junk:
        transaction_date = F.when(_mod(k, 503) == 0, F.lit("2023-02-30")).otherwise(transaction_date)

    price = F.col("l_extendedprice").cast("decimal(15,2)")
    amount = (F.when(_mod(k, 331) == 0, F.lit("N/A"))
              .when(_mod(k, 119) == 0, F.lit("0.00"))
              .when(_mod(k, 1009) == 0, F.lit(" 0 "))
              .when(_mod(k, 101) == 0, _s(price * F.lit(20)))
              .otherwise(_s(price)))
    amount = F.when(_mod(k, 887) != 0, amount)
    if junk:
        amount = F.when(_mod(k, 499) == 0, F.lit("12,50 NGN")).otherwise(amount)

    kind = _mod(k, 10)
    transaction_type = (F.when(_mod(k, 71) == 0, F.lit(None).cast("string")).when(_mod(k, 73) == 0, F.lit(" "))
                        .when(kind <= 2, F.lit("debit")).when(kind <= 5, F.lit("DEBIT"))
                        .when(kind <= 7, F.lit(" Debit")).otherwise(F.lit("Credit")))
    m = _mod(k, 67)
    merchant = (F.when(m < len(MERCHANT_SPELLINGS), _pick(m, MERCHANT_SPELLINGS))
                .when(m == 16, F.lit(None).cast("string"))
                .when(m < 17 + len(KNOWN_SPELLINGS), _pick(m - 17, KNOWN_SPELLINGS))
                .otherwise(F.concat(F.lit("Merchant "), _s(m))))
    category = (F.when(_mod(k, 25) == 0, F.lit(None).cast("string"))
                .when(_mod(k, 53) == 0, F.lit(""))
                .otherwise(F.concat(F.lit("Category "), _s(_mod(k, 14)))))
    status = (F.when(_mod(k, 83) == 0, F.lit(None).cast("string"))
              .when(_mod(k, 89) == 0, F.lit(" "))
              .when(_mod(k, 33) == 0, F.lit("Reversed"))
              .when(_mod(k, 12) == 0, F.lit("PENDING"))
              .when(_mod(k, 26) == 0, F.lit("failed"))
              .otherwise(F.lit("completed")))
    customer_name = (F.when(_mod(k, 37) == 0, F.lit(None).cast("string"))
                     .when(_mod(k, 5) == 0, F.concat(F.lit("  Customer   "), ck, F.lit(" ")))
                     .otherwise(F.concat(F.lit("Customer "), ck)))
    base_notes = (F.when(_mod(k, 4) == 1, F.lit(None).cast("string"))
                  .when(_mod(k, 47) == 0, F.lit("paid at the counter")).otherwise(F.lit("")))

    once = rows.select(
        F.when(_mod(k, 1201) != 0, F.concat_ws("-", F.lit("TXN"), _s(F.col("l_orderkey")), _s(F.col("l_linenumber")),
                                               _s(F.col("l_partkey")), _s(F.col("l_suppkey")))).alias("transaction_id"),
        # Some rows name no customer, or one that the dimension does not have.
        F.when(_mod(k, 1301) == 0, F.lit(None).cast("string"))
         .when(_mod(k, 97) == 0, F.concat(F.lit("GONE-"), F.lpad(ck, 6, "0")))
         .otherwise(F.concat(F.lit("CUST-"), F.lpad(ck, 6, "0"))).alias("customer_id"),
        customer_name.alias("customer_name"),
        F.when(_mod(k, 41) == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("AC"), F.lpad(ck, 8, "0"))).alias("account_number"),
        transaction_date.alias("transaction_date"),
        amount.alias("amount"),
        _pick(_mod(k, 4), CURRENCY_SPELLINGS).alias("currency"),
        transaction_type.alias("transaction_type"),
        merchant.alias("merchant_name"),
        category.alias("category"),
        status.alias("status"),
        F.when(_mod(k, 34) == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("City "), _s(_mod(k, 18)))).alias("location"),
        base_notes.alias("notes"),
        k.alias("k"),
    )
    # A row with k % 61 == 0 arrives twice; the second copy carries a note. The copies are
    # made of whole rows: rules above and below are then methods of their own when Spark
    # compiles the plan, as the JVM leaves too long a method uncompiled.
    seq = F.explode(F.when(_mod(k, 61) == 0, F.array(F.lit(1), F.lit(2)))
                    .otherwise(F.array(F.lit(1)))).alias("ingest_seq")
    out = once.select("*", seq).withColumn(
        "notes", F.when(F.col("ingest_seq") == 2, F.lit(DUPLICATE_NOTE)).otherwise(F.col("notes")))
    return out.select([F.col(f.name).cast(f.dataType) for f in RAW_TRANSACTIONS_SCHEMA.fields])


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey")
    key = F.col("c_custkey")
    kt = _s(key)
    name = F.col("c_name")
    null = F.lit(None).cast("string")
    out = c.select(
        F.concat(F.lit("CUST-"), F.lpad(kt, 6, "0")).alias("customer_id"),
        F.when(_mod(key, 29) == 0, null)
         .when(_mod(key, 4) == 0, F.concat(F.lit("  "), name, F.lit("  x ")))
         .otherwise(name).alias("full_name"),
        F.when(_mod(key, 17) == 0, null).otherwise(F.concat(name, F.lit("@example.org"))).alias("email"),
        F.concat(F.lit("0"), F.lpad(kt, 10, "0")).alias("phone"),
        F.concat(F.lit("City "), _s(F.col("c_nationkey"))).alias("city"),
        F.when(_mod(key, 43) == 0, null).otherwise(_pick(_mod(key, 4), ACCOUNT_TYPES)).alias("account_type"),
        F.when(_mod(key, 31) == 0, null).otherwise(F.concat(F.lit("AC"), F.lpad(kt, 8, "0"))).alias("account_number"),
        F.date_format(F.date_add(F.lit("2019-01-01").cast("date"), _mod(key, 1461).cast("int")),
                      "yyyy-MM-dd").alias("join_date"),
        F.when(_mod(key, 19) == 0, F.lit(None).cast("int"))
         .otherwise((F.lit(300) + _mod(key, 550)).cast("int")).alias("credit_score"),
    )
    return out.select([F.col(f.name).cast(f.dataType) for f in CUSTOMERS_SCHEMA.fields])
