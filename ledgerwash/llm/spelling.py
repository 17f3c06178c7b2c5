"""Spelling variants by a dictionary of trie-node pairs.

Words are numbered in sorted order, and each new prefix that a word brings to the
trie of its predecessors gets the next number: a node of the forward trie. The
reversed words number the nodes of suffixes. A word with one position skipped is the
pair (prefix node before it, suffix node behind it); a position where something may
be inserted is the pair (prefix node, suffix node) that meet there. Two words differ
by one replacement if they share a skipped pair, and by one insertion if the skipped
pair of the longer is an inserting pair of the shorter. Integers are joined, never
strings, and equal pairs mean equal strings: neighbours are exact, none is missed.

No pair of words is written out. In the rows of one node pair, a window counts the
others and keeps the two most frequent, so each word learns the number of its
neighbours and the best of them. A replaced pair of words shares one node pair, and a
word is deleted from only at the first of equal neighbouring letters, so nothing is
counted twice. Rows of a node pair are as many as the alphabet has letters.

Words are in sorted blocks of bounded size; a tree scan (``blocks.scan``) hands each
block the path of the word before it, so no task sees more than a block, and long
words cost their length.

Defined results: null and empty texts have no words; a null id is empty in
``<doc_id>:<run>``; of neighbours of equal count the smallest in code-point order is
the form; repeated rows count again; empty tables have no words; a word of any
length is taken whole. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwash.llm.blocks import block_of, numbered, scan
from ledgerwash.llm.memo import forgetful
from ledgerwash.llm.scratch import written

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
DAMAGE = 199
BLOCK = 10  # bits of a word's number within its block
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_HELD = 200_000  # distinct words that a task counts before it hands them on
_WHOLE = 1 << 20  # longer texts are read run by run


def lowered(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(_LOWER)


def told(doc: str, run: str, damage: int = DAMAGE) -> str:
    """The lower-cased run, without one letter where its checksum says so."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % damage:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LEAST_LENGTH,
           count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``length`` letters that occur ``count`` times."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    # A run's letters are taken greedily from its first, so a match is always a maximal run.
    runs = re.compile(f"[{LETTERS}]{{{length},}}")

    def batch_of(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], schema=schema)

    @forgetful
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc, text = doc.as_py(), text.as_py()
                own = runs.findall(text) if len(text) < _WHOLE else (m[0] for m in runs.finditer(text))
                for run, n in Counter(own).items():
                    word = told(doc, lowered(run))
                    if len(word) >= length:
                        found[word] += n
                if len(found) > _HELD:
                    yield batch_of(found)
                    found = Counter()
        yield batch_of(found)

    text = docs.where(F.col(text_col) != "").select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    return text.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def _grown(path: list[int], before: str | None, words: list[str], base: int) -> Iterator[tuple[int, list[int]]]:
    """(inherited nodes, path) of each word: its path in the trie of the words before."""
    for word in words:
        shared = 0 if before is None else len(os.path.commonprefix([before, word])) + 1
        path = path[:shared] + list(range(base + shared, base + len(word) + 1))
        yield shared, path
        base, before = base + len(word) + 1, word


def _before(block: pd.DataFrame, last: pd.DataFrame) -> str | None:
    return last["word"].iloc[0] if len(last) else None


def _summary(block: pd.DataFrame, last: pd.DataFrame) -> pd.DataFrame:
    """What a block does to a path: [numbers used, nodes that stay, nodes behind them]."""
    if block.empty:
        return pd.DataFrame(columns=["key", "block", "value"], dtype=object)
    block = block.sort_values("place")
    words = block["word"].tolist()
    kept, path = len(words[0]) + 1, []
    # Nodes before the block are unknown here; they are stood for by numbers below zero.
    first = 0 if (before := _before(block, last)) is None else len(before) + 1
    for shared, path in _grown([-1] * first, before, words, 0):
        kept = min(kept, shared)
    value = [sum(map(len, words)) + len(words), kept, *path[kept:]]
    return pd.DataFrame({"key": [""], "block": [int(block["block"].iloc[0])], "value": [value]})


def _chained(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.asarray(a), np.asarray(b)
    tail = b[2:] + a[0]
    if b[1] > a[1]:
        tail = np.concatenate([a[2:2 + b[1] - a[1]], tail])
    return np.concatenate([[a[0] + b[0], min(a[1], b[1])], tail])


def _paths(block: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
    if block.empty:
        return pd.DataFrame(columns=["id", "path"], dtype=object)
    block = block.sort_values("place")
    before = info["before"].iloc[0] if len(info) else None
    base, path = (0, []) if before is None else (int(before[0]), [int(x) for x in before[2:]])
    words = block["word"].tolist()
    return pd.DataFrame({"id": block["id"], "path": [p for _, p in _grown(path, _before(block, info), words, base)]})


def trie(order: DataFrame, bits: int = BLOCK) -> DataFrame:
    """(id, path): numbers of the nodes of all prefixes, by length, of each word of
    (id, word, place); ``place`` numbers the words from 0 in sorted order."""
    rows = order.select("id", "word", "place", block_of("place", bits).alias("block"))
    last = rows.groupBy("block").agg(F.max_by("word", "place").alias("word")).select((F.col("block") + 1).alias("block"), "word")
    blocks = written(rows.groupBy("block").cogroup(last.groupBy("block")).applyInPandas(
        _summary, "key string, block bigint, value array<bigint>"), "trie")
    info = scan(blocks, _chained).join(last, "block", "left").select("block", "before", "word")
    return rows.groupBy("block").cogroup(info.groupBy("block")).applyInPandas(_paths, "id bigint, path array<bigint>")


def dictionary(order: DataFrame, bits: int = BLOCK) -> DataFrame:
    """(id, prefix, suffix, skip, head): all node pairs of the words (id, word, place).
    skip: a position is left out between the two, else they meet; head: the first of
    equal neighbouring letters is left out."""
    turned = numbered(order.select("id", F.reverse("word").alias("word")), "word", name="suffixes")
    letters = F.split("word", "")
    heads = F.transform(letters, lambda c, i: (i == 0) | (c != F.element_at(letters, F.greatest(i, F.lit(1)))))
    pair = trie(order, bits).join(trie(turned, bits).select("id", F.reverse("path").alias("back")), "id").join(
        order.select("id", heads.alias("heads")), "id")
    skips = F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("prefix"),
                         F.expr("slice(back, 2, size(back) - 1)").alias("suffix"), "heads")
    meets = F.arrays_zip(F.col("path").alias("prefix"), F.col("back").alias("suffix"))
    named = "transform({}, x -> struct(x.prefix as prefix, x.suffix as suffix, {} as skip, {} as head))"
    both = pair.select("id", skips.alias("skips"), meets.alias("meets")).select("id", F.concat(
        F.expr(named.format("skips", "true", "x.heads")), F.expr(named.format("meets", "false", "false"))).alias("x"))
    return both.select("id", F.explode("x").alias("x")).select("id", "x.*")


def neighbours(order: DataFrame, bits: int = BLOCK) -> DataFrame:
    """(id, n_near, near): how many of the distinct words (id, word, n, place) differ by
    one letter, and the id of the most frequent of them (ties: smallest place), for
    words that have any. ``id`` is the place."""
    rows = dictionary(order, bits).join(order.select("id", "n"), "id")
    pair = Window.partitionBy("prefix", "suffix")
    sorted_ = pair.orderBy(F.col("skip").desc(), F.col("n").desc(), "id")
    whole = sorted_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Greatest first: more frequent, then smaller id.
    rated = F.struct("n", (-F.col("id")).alias("less"))
    one, skip, head = F.count("*").over(pair), F.col("skip"), F.col("skip") & F.col("head")
    seen = rows.select("id", "n", "skip", "head", one.alias("rows"), F.row_number().over(sorted_).alias("at"),
                       F.count_if(skip).over(pair).alias("skips"), F.count_if(head).over(pair).alias("heads"),
                       F.nth_value(rated, 1).over(whole).alias("first"), F.nth_value(rated, 2).over(whole).alias("second"),
                       F.max(F.when(head, rated)).over(pair).alias("longer"),
                       F.max(F.when(~skip, rated)).over(pair).alias("shorter")).where("rows > 1")
    replaced = F.when(F.col("skips") > 1, F.when(F.col("at") == 1, F.col("second")).otherwise(F.col("first")))
    less = F.when(F.col("head"), F.col("shorter"))
    near = F.when(skip, F.col("skips") - 1 + less.isNotNull().cast("long")).otherwise(F.col("heads"))
    best = F.when(skip, F.greatest(replaced, less)).otherwise(F.col("longer"))
    return seen.select("id", near.alias("near"), best.alias("best")).where("near > 0").groupBy("id").agg(
        F.sum("near").alias("n_near"), F.max("best").alias("best")).select("id", "n_near", (-F.col("best.less")).alias("near"))


def _followed(links: DataFrame) -> DataFrame:
    """(id, root) of links (id, form) by pointer doubling; forms are more frequent, so
    nothing goes round."""
    now = written(links.select("id", F.col("form").alias("root")), "roots")
    while True:
        then = now.alias("a").join(now.alias("b"), F.col("a.root") == F.col("b.id"), "left")
        if then.where("b.id IS NOT NULL").isEmpty():
            return now
        now = written(then.select("a.id", F.coalesce("b.root", "a.root").alias("root")), "roots")


def variants(words: DataFrame, ratio: int = RATIO, bits: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n)."""
    order = written(numbered(words.select("word", "n"), "word", name="words").select(
        F.col("place").alias("id"), "word", "n", "place"), "words")
    near = written(neighbours(order, bits), "near")
    own = near.join(order.select("id", "n"), "id").join(
        order.select(F.col("id").alias("near"), F.col("n").alias("form_n")), "near")
    links = written(own.where(F.col("form_n") >= ratio * F.col("n")).select("id", F.col("near").alias("form"), "form_n"), "links")
    name = order.select(F.col("id").alias("x"), F.col("word").alias("name"))
    told_ = links.join(_followed(links), "id")
    told_ = told_.join(name.withColumnRenamed("name", "form_word"), F.col("form") == F.col("x")).drop("x")
    told_ = told_.join(name.withColumnRenamed("name", "root_word"), F.col("root") == F.col("x")).drop("x")
    return order.join(near.select("id", "n_near"), "id", "left").join(
        told_.select("id", "form_word", "root_word", "form_n"), "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def report(docs: DataFrame) -> DataFrame:
    return variants(counts(docs))
