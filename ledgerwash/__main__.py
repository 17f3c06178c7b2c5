"""Run the clean-once workflow on raw files:

    python -m ledgerwash --transactions RAW_TX --customers RAW_CUST --out OUT [--format csv]
    spark-submit --py-files ledgerwash.zip tools/submit_workflow.py ...   (cluster)

Reads both raw tables with the declared schemas, orders rows without
``ingest_seq`` by their place in the files, cleans, checks that customer ids
are unique, and writes the cleaned fact and every report under OUT.

An empty CSV field is read as NULL, so by default a NULL note counts as empty
text (``--null-notes as_empty``); with ``sql`` a row without a note gets no amount.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.marts import publish_workflow, run_workflow
from .session import RUNTIME_CONF
from .sources.raw import load_customers, load_raw


def main(argv: list[str] | None = None) -> list[str]:
    parser = argparse.ArgumentParser(prog="ledgerwash", description=__doc__.splitlines()[0])
    parser.add_argument("--transactions", required=True, help="folder of raw transaction files")
    parser.add_argument("--customers", required=True, help="folder of raw customer files")
    parser.add_argument("--out", required=True, help="shared output folder")
    parser.add_argument("--format", default="csv", choices=["csv", "parquet", "json"])
    parser.add_argument("--null-notes", default="as_empty", choices=["sql", "as_empty"],
                        help="how a NULL note counts in the amount rule; sql leaves such rows without an amount")
    parser.add_argument("--option", action="append", default=[], metavar="NAME=VALUE",
                        help="reader option of the transactions, such as nullValue=\\N or emptyValue=")
    parser.add_argument("--on-error", default="fail", choices=["fail", "null"])
    parser.add_argument("--only", nargs="*", help="write only these reports")
    parser.add_argument("--publish", action="store_true",
                        help="publish the fact and the reports as one new version under OUT (readers never see half of it)")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("ledgerwash").getOrCreate()
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    options = dict(o.split("=", 1) for o in args.option)
    raw = load_raw(spark, args.transactions, args.format, **options)
    customers = load_customers(spark, args.customers, args.format)
    options = {"null_notes": args.null_notes, "on_error": args.on_error, "only": args.only}
    if args.publish:
        version = publish_workflow(spark, raw, customers, args.out, **options)
        written = sorted(version.tables)
        print("version:", version.number)
    else:
        written = run_workflow(spark, raw, customers, args.out, **options)
    print("wrote:", ", ".join(written))
    return written


if __name__ == "__main__":
    main()
