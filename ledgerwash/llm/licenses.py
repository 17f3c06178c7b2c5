"""License notices by diagonal voting.

All rolling word k-gram hashes of all documents are joined to the positions of
the templates' k-grams. Hits of one document and template on one diagonal
(document position less template position) are votes for the template standing
there; neighbouring diagonals, which words put in or left out set apart, are
merged; and a span is verified by the share of the template's k-grams that voted
for it. The hash has 128 bits, of two independent halves, so a full diagonal of
an exact phrase is that phrase.

The templates' table is written and then joined without a hint: Spark broadcasts
it if it is small and shuffles the k-grams if it is not. Only hits are grouped.

Defined results: null text is empty; a text shorter than k words has no hit; a
template shorter than k words is an error; rows with equal id and text share
their result; null ids are ids like any other; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwash.llm.memo import Memo, forgetful
from ledgerwash.llm.rowkey import KEY, key_columns, with_key
from ledgerwash.llm.scratch import written

K = 3
COVERAGE = 0.8
GAP = 3

# Phrases whose places are reported, and their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# The method's own templates, which may stand with words changed, put in or left out.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "general public license version 3"),
    ("gpl-2", "general public license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-sa", "licensed under cc by sa"),
)

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_WORDS = 200_000  # remembered by a task
_TEXTS = 512
_MUL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BETWEEN = "".join(map(chr, (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))))
_GRAMS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def _rolled(hashes: np.ndarray, k: int, mul: np.uint64) -> np.ndarray:
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ hashes[i:i + n]) * mul
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def kgrams(k: int):
    """UDF: the 128-bit hash of each run of ``k`` words of a text. ``bytes.lower``
    lower-cases A-Z only; every byte of a non-ASCII character is a word's."""
    @F.arrow_udf(_GRAMS)
    @forgetful
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Memo(xxhash.xxh3_128_digest, _WORDS)
        for batch in batches:
            for at in range(0, len(batch), _TEXTS):  # smaller batches go back, which keeps both sides' buffers small
                first, second, ends = [], [], [0]
                for t in batch.slice(at, _TEXTS):
                    words = _WORD.findall(t.as_buffer().to_pybytes().lower()) if t.is_valid else []
                    known.trim()
                    halves = np.frombuffer(b"".join(map(known.__getitem__, words)), "<u8").reshape(-1, 2)
                    first.append(_rolled(halves[:, 0], k, _MUL[0]))
                    second.append(_rolled(halves[:, 1], k, _MUL[1]))
                    ends.append(ends[-1] + len(first[-1]))
                grams = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (first, second)], ["a", "b"])
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), grams)
            if not len(batch):
                yield pa.array([], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
    return run


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES, k: int = K) -> DataFrame:
    """One row per template and k-gram: no, label, base, at, votes (k-grams in all), a, b."""
    rows = [(i, label, i < len(phrases), text) for i, (label, text) in enumerate((*phrases, *notices))]
    if any(len(r[3].split()) < k for r in rows):
        raise ValueError(f"a template needs {k} words at least")
    df = spark.createDataFrame(rows, "no int, label string, base boolean, text string")
    grams = df.select("no", "label", "base", kgrams(k)(F.col("text")).alias("g"))
    return written(grams.select("no", "label", "base", F.size("g").alias("votes"), F.posexplode("g").alias("at", "h"))
                   .select("no", "label", "base", "votes", "at", "h.a", "h.b"), "templates")


def diagonals(docs: DataFrame, marks: DataFrame, k: int = K) -> DataFrame:
    """Votes of each (row key, template, diagonal)."""
    grams = docs.select(*KEY, F.posexplode_outer(kgrams(k)(F.col("text"))).alias("pos", "h")).select(
        *KEY, "pos", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    return grams.join(marks, ["a", "b"]).groupBy(
        *KEY, "no", "label", "base", "votes", (F.col("pos") - F.col("at")).cast("long").alias("diagonal")).agg(
        F.collect_set("at").alias("at"))


def findings(votes: DataFrame, coverage: float = COVERAGE, gap: int = GAP) -> DataFrame:
    """Per row key: exact places of the phrases, labels, and the best coverage."""
    # Repeated rows vote for the same positions again, so these are counted and not the votes.
    exact = F.col("base") & (F.size("at") == F.col("votes"))
    one = Window.partitionBy(*KEY, "no").orderBy("diagonal")
    before = F.lag("diagonal").over(one)
    starts = F.when(before.isNull() | (F.col("diagonal") - before > gap), 1).otherwise(0)
    spans = votes.withColumn("exact", exact).withColumn("new", starts).withColumn("span", F.sum("new").over(one))
    merged = spans.groupBy(*KEY, "no", "label", "base", "votes", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("at")))).alias("seen"),
        F.sum(F.col("exact").cast("long")).alias("places"),
        F.min(F.when(F.col("exact"), F.col("diagonal"))).alias("first"),
        F.max(F.when(F.col("exact"), F.col("diagonal"))).alias("last"))
    share = F.col("seen") / F.col("votes")
    # A phrase stands or does not; only notices may be incomplete.
    holds = F.when(F.col("base"), F.col("places") > 0).otherwise(share >= coverage)
    return merged.withColumn("share", F.when(holds, share)).groupBy(*KEY).agg(
        F.sum("places").alias("n_base"), F.min("first").alias("first_word"), F.max("last").alias("last_word"),
        F.collect_set(F.when(F.col("places") > 0, F.col("label"))).alias("base_labels"),
        F.collect_set(F.when(F.col("share").isNotNull(), F.col("label"))).alias("labels"),
        F.max("share").alias("score"))


def scan(df: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """One row per row of ``df``: its id, n_words and the findings."""
    found = findings(diagonals(with_key(df, id_col, text_col), marks, k), COVERAGE, GAP)
    # Separators become spaces: splitting at one character needs no regular expression.
    spaced = F.translate(F.coalesce(F.col(text_col), F.lit("")), _BETWEEN, " " * len(_BETWEEN))
    words = F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")
    names = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    rows = df.select(*key_columns(id_col, text_col), words.alias("n_words"))
    return rows.join(found, list(KEY), "left").select(
        F.col("id.id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word", "last_word", names("base_labels").alias("base_labels"), names("labels").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
