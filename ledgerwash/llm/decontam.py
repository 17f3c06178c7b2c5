"""Benchmark decontamination: SimHash of item-sized windows.

A window is as many five-word shingles of a document as an item has. Windows that
can reach the similarity hold shingles of an item, so the shingles of all
documents are first joined to the items', and item-sized windows start at the
shared shingles (or end where the document does). That covers windows at all
places, whatever the order of the item's parts: a window that slides right to its
first shared shingle loses none. Of these, windows with too few shared shingles
for the similarity are left out. Each distinct window gets a 64-bit SimHash of its
shingles, repeats included, and is looked up in a multi-index: the bits are cut into
four blocks of 16, and of two fingerprints within the radius of 15 bits one block
differs in three bits at most. So each item, the small side, is entered under every
value within three bits of its blocks (697 a block), each window under its own four:
whatever is within the radius meets, and of unrelated pairs about one in 25 does.
Candidates within the radius are verified by the exact weighted similarity: shingles
weighted by how often they occur, the sum of the smaller weights over the sum of the
larger ones.

Only built-in functions. The items' shingles and the keys of touched documents
are written and then joined without a hint, so Spark broadcasts them only if they
are small. At similarity 0.8 two fingerprints differ in 9.7 bits on average
(standard deviation 2.9): of windows at the very threshold the radius finds 97 in 100,
at 0.85 more than 99. A leaked item has several windows around its best one.

Defined results: words are runs of letters and digits, lower-cased; null text is
empty; a document with fewer shingles than the item is one window; items of fewer
than five words have no shingle and are not searched for; repeated items are all
named; rows of equal id and text share their result; other columns pass through
``clean`` and are ignored by ``leaks``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwash.llm.rowkey import KEY, key_columns, with_key
from ledgerwash.llm.scratch import written

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCKS = 4  # of the fingerprint, 16 bits each


def shingles(text_col: str, size: int = SHINGLE) -> Column:
    """Hashes of the runs of ``size`` words of a text. The words are bound to a
    lambda's variable: Catalyst may copy this expression (into a filter that it
    infers, say), and a column of words would then be split anew for each word."""
    words = f"array_remove(split(lower(`{text_col}`), '[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+'), '')"
    each = ", ".join(f"get(w, i + {j})" for j in range(size))
    return F.expr(f"get(transform(array({words}), w -> CASE WHEN size(w) >= {size} THEN "
                  f"transform(sequence(0, size(w) - {size}), i -> xxhash64({each})) ELSE array() END), 0)")


def with_shingles(df: DataFrame, text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``df`` without the text, with array column ``grams``."""
    return df.select(*(c for c in df.columns if c != text_col), shingles(text_col, size).alias("grams"))


def simhash(grams: str) -> Column:
    """64-bit fingerprint of an array of hashes: a bit is set if it is in over half."""
    ones = f"aggregate({grams}, 0, (n, g) -> n + cast(shiftright(g, b) & 1 AS int))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | CASE WHEN 2 * {ones} > size({grams}) THEN shiftleft(1L, b) ELSE 0L END)")


def blocks(print_: str, count: int = BLOCKS) -> str:
    """SQL: array of (block, bits, width), the 64 bits in ``count`` blocks."""
    at = [64 * i // count for i in range(count + 1)]
    cut = ", ".join(f"struct({i} AS block, shiftrightunsigned({print_}, {a}) & {(1 << b - a) - 1}L AS bits, {b - a} AS width)"
                    for i, (a, b) in enumerate(zip(at, at[1:], strict=False)))
    return f"array({cut})"


def probes(print_: str, radius: int = RADIUS, count: int = BLOCKS) -> Column:
    """Array of (block, bits): every block of every fingerprint that has as few other
    bits in that block as one of ``count`` blocks must have, of ``radius`` in all."""
    width = -(-64 // count)
    masks = [sum(1 << i for i in c) for k in range(radius // count + 1) for c in combinations(range(width), k)]
    listed = ", ".join(f"{m}L" for m in masks)
    # A block of one bit less than the widest has no use for masks of that bit.
    return F.expr(f"flatten(transform({blocks(print_, count)}, b -> transform(filter(array({listed}), m -> m < shiftleft(1L, b.width)), "
                  "m -> struct(b.block AS block, b.bits ^ m AS bits))))")


def overlap(x: str, y: str) -> Column:
    """Sum of the smaller of two arrays' counts of each value."""
    count = lambda a: f"size(filter({a}, z -> z = g))"
    return F.expr(f"aggregate(array_intersect({x}, {y}), 0, (n, g) -> n + least({count(x)}, {count(y)}))")


def _items(bench: DataFrame, size: int) -> DataFrame:
    rows = bench.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    return written(with_shingles(rows, "text", size).withColumn("n", F.size("grams")).where("n > 0"), "items")


def candidates(prints: DataFrame, wanted: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(window_id, n, item_id, p, q): pairs of windows (window_id, n, print) and items
    (item_id, n, print) of one size that meet in the index; all within ``radius`` do."""
    x = prints.select("window_id", "n", F.col("print").alias("p"), F.explode(F.expr(blocks("print"))).alias("b")).select(
        "window_id", "n", "p", "b.block", "b.bits")
    # Written: Spark would guess the size of the unexploded items and broadcast all entries.
    y = written(wanted.select("item_id", "n", F.col("print").alias("q"), F.explode(probes("print", radius)).alias("b")).select(
        "item_id", "n", "q", "b.block", "b.bits"), "probes")
    return x.join(y, ["n", "block", "bits"]).select("window_id", "n", "item_id", "p", "q")


def findings(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
             similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(row key, item_id, similarity) of each document and item it leaks, with the
    best window's similarity."""
    items = _items(bench, size)
    places = items.select("item_id", "n", F.explode(F.array_distinct("grams")).alias("gram"))
    docs = with_key(df, id_col, text_col)
    # The outer form, because Spark adds a filter that computes the shingles again to the plain one.
    spread = with_shingles(docs, "text", size).select(
        *KEY, F.size("grams").alias("held"), F.posexplode_outer("grams").alias("at", "gram"))
    hits = spread.join(places, "gram")
    # The least that a window must share is s / (1 + s) of both sizes.
    need = F.greatest(F.ceil(similarity / (1 + similarity) * (F.col("n") + F.least("n", "held")) - 1e-9), F.lit(1)).cast("int")
    spots = hits.groupBy(*KEY, "item_id", "n", "held").agg(F.array_sort(F.collect_set("at")).alias("at")).withColumn(
        "need", need).where(F.size("at") >= F.col("need")).withColumn("final", F.expr("greatest(held - n, 0)"))
    # A window holds enough if the need-th shared shingle from its start is within it; the last one ends the document.
    starts = F.expr("concat(filter(at, (a, i) -> a < final AND get(at, i + need - 1) < a + n), "
                    "CASE WHEN get(at, size(at) - need) >= final THEN array(final) ELSE array() END)")
    aligned = written(spots.select(*KEY, "n", F.explode(starts).alias("start")).distinct(), "starts")
    touched = written(aligned.select(*KEY).distinct(), "touched")
    texts = docs.join(touched, list(KEY), "left_semi").dropDuplicates(list(KEY))
    windows = with_shingles(texts, "text", size).join(aligned, list(KEY)).select(
        *KEY, "n", F.slice("grams", F.col("start") + 1, F.col("n")).alias("window"))
    windows = written(windows.withColumn("window_id", F.sha1(F.array_join("window", ","))), "windows")
    prints = windows.groupBy("window_id", "n").agg(F.first("window").alias("window")).withColumn("print", simhash("window"))
    wanted = items.withColumn("print", simhash("grams"))
    near = F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= radius
    pairs = candidates(prints, wanted, radius).where(near).select("window_id", "n", "item_id").distinct()
    both = pairs.join(prints.select("window_id", "n", "window"), ["window_id", "n"]).join(
        items.select("item_id", "n", "grams"), ["item_id", "n"])
    both = both.withColumn("common", overlap("window", "grams"))
    share = F.col("common") / (F.size("window") + F.size("grams") - F.col("common"))
    verified = both.select("window_id", "n", "item_id", share.alias("similarity")).where(F.col("similarity") >= similarity)
    return windows.select(*KEY, "window_id", "n").join(verified, ["window_id", "n"]).groupBy(*KEY, "item_id").agg(
        F.max("similarity").alias("similarity"))


def leaks(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per row of ``df``: id, contaminated, n_items, item_ids (comma-joined,
    ascending) and the highest similarity (null if none)."""
    found = findings(df, bench, id_col, text_col, **settings).groupBy(*KEY).agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.max("similarity").alias("similarity"))
    return df.select(*key_columns(id_col, text_col)).join(found, list(KEY), "left").select(
        F.col("id.id").alias(id_col), F.col("items").isNotNull().alias("contaminated"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce(F.array_join("items", ","), F.lit("")).alias("item_ids"), "similarity")


def clean(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``df``, as they were, that leak no item."""
    bad = written(findings(df, bench, id_col, text_col, **settings).select(*KEY).distinct(), "leaks")
    keyed = df.select(F.struct(*df.columns).alias("row"), *key_columns(id_col, text_col))
    return keyed.join(bad, list(KEY), "left_anti").select("row.*")
