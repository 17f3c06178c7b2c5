"""A key for results that depend on a row's text alone: equal rows share it, and
rows that merely share an id do not. Joins on it must treat nulls as equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("id", "mark", "size")


def key_columns(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.struct(F.col(id_col).alias("id")).alias("id"), F.xxhash64(text).alias("mark"), F.length(text).alias("size")]


def with_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Key columns and ``text`` (null as empty). The id sits in a struct, in which
    null equals null."""
    return df.select(*key_columns(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
