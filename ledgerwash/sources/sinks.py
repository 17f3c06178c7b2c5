"""Sinks (A10): the cleaned fact and the marts, written for BI readers.

Writes go to the shared folder the caller names (on a cluster: a path every
executor reaches, never a machine-local temp folder). A lost executor only
re-runs its tasks. ``mode="overwrite"`` deletes a folder before it writes it, so
readers of that folder see nothing meanwhile; tables that others read while they
are renewed are published as snapshots instead (``sources.publish``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import shuffles_released

Watch = Callable[[DataFrame], DataFrame]


def _write_by_month(df: DataFrame, date_col: str, path: str, mode: str, watch: Watch | None = None) -> None:
    """Parquet in ``year_month`` folders. The rebalance hint lets AQE size the
    writing tasks by data: a large month is split over several, small months
    share one, so the number of files follows the size of the data and not
    the number of tasks. ``watch`` sees the rows in the writing tasks."""
    out = df.withColumn("year_month", F.date_format(date_col, "yyyy-MM")).hint("rebalance", F.col("year_month"))
    with shuffles_released(df.sparkSession):
        (watch(out) if watch else out).write.mode(mode).partitionBy("year_month").parquet(path)


def write_clean_fact(clean: DataFrame, path: str, mode: str = "overwrite", watch: Watch | None = None) -> None:
    """Persist the cleaned fact partitioned by month of the clean date
    (``year_month``), so month filters prune files. Rows without a clean date
    land in the ``__HIVE_DEFAULT_PARTITION__`` partition."""
    _write_by_month(clean, "transaction_date_clean", path, mode, watch)


def read_clean_fact(spark: SparkSession, path: str, months=None) -> DataFrame:
    """Read the cleaned fact back. ``months`` (``"yyyy-MM"`` texts, or
    ``None`` for all; ``"__HIVE_DEFAULT_PARTITION__"`` rows without a date
    are read as NULL) filters on the partition column, so only those month
    folders are listed and scanned."""
    df = spark.read.parquet(path)
    if months is not None:
        df = df.filter(F.col("year_month").isin(list(months)))
    return df.drop("year_month")


def write_marts(marts: dict[str, DataFrame], root: str, mode: str = "overwrite",
                by_month: dict[str, str] | None = None) -> list[str]:
    """Write each mart as parquet under ``root/<name>``. Row-level marts
    named in ``by_month`` (name -> date column) are partitioned by
    ``year_month`` so BI readers prune by month."""
    written = []
    for name, df in marts.items():
        path = f"{root.rstrip('/')}/{name}"
        date_col = (by_month or {}).get(name)
        if date_col:
            _write_by_month(df, date_col, path, mode)
        else:
            with shuffles_released(df.sparkSession):
                df.write.mode(mode).parquet(path)
        written.append(name)
    return written


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint directory the cluster names in
    ``spark.checkpoint.dir`` (else the context's checkpoint folder)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder")
    return f"{base.rstrip('/')}/{name}"
