"""SimHash near-duplicates by covering locality-sensitive hashing.

The 64 bits are spread over the non-zero vectors of r+1 dimensions over GF(2),
and each non-zero vector v gives a table whose mask keeps the bits whose vector
has an odd product with v. Up to r differing bits span at most r dimensions, so
some v is orthogonal to them all: its mask drops every differing bit, and the
pair collides in that table. No pair within the radius is missed.

All copies of a text share one fingerprint, so the search runs over distinct
fingerprints. A bucket of more than ``max_bucket`` of them is not paired up:
there each fingerprint emits itself and its one-bit neighbours, and two that are
two bits apart meet in the point between them, where no more than 65 distinct
fingerprints can meet. That is exact too and keeps the work linear.

Null and empty texts have fingerprint zero and are linked like any other. Null
ids take part; a component's id is its smallest non-null one, or null. Repeated
rows give repeated result rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwash.llm import bitmap
from ledgerwash.llm.graph import components
from ledgerwash.llm.memo import forgetful
from ledgerwash.llm.rowkey import KEY, key_columns
from ledgerwash.llm.scratch import written

SHINGLE = 3
RADIUS = 2
MAX_BUCKET = 64
_hash = partial(xxhash.xxh64_intdigest, seed=42)
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of UTF-8 text. ``bytes`` lower-cases A-Z only and
    splits at space and tab to carriage return, which is what is wanted."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams, n = iter([b" ".join(words)]), 1
    else:
        grams, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)))), len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        size = min(_BLOCK, n - at)
        hashes = np.fromiter((h for _, h in zip(range(size), map(_hash, grams))), "<u8", size)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint of a text column as a (signed) long."""
    @F.arrow_udf(T.LongType())
    @forgetful
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_signed(fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle))
                            for t in batch], pa.int64())
    return run(text)


def covering_masks(radius: int) -> list[int]:
    top = 1 << radius + 1
    vector = [1 + i % (top - 1) for i in range(64)]
    return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() & 1) for v in range(1, top)]


def linked_pairs(prints: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct longs in column ``fp`` that differ in
    ``radius`` bits or fewer (0, 1 or 2)."""
    if radius not in (0, 1, 2):
        raise ValueError("radius must be 0, 1 or 2")
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("mask"))
                       for i, m in enumerate(covering_masks(radius))))
    keys = (prints.select("fp", F.explode(tables).alias("x"))
            .select("fp", "x.t", "x.mask", F.col("fp").bitwiseAND(F.col("x.mask")).alias("key")))
    sizes = keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    # In a large bucket: the fingerprint itself and each neighbour in a bit that the mask drops.
    near = F.expr("transform(filter(sequence(0, 63), i -> shiftright(mask, i) & 1 = 0), i -> fp ^ shiftleft(1L, i))")
    points = F.when(F.col("n") <= max_bucket, F.array(F.lit(0).cast("long"))).otherwise(F.concat(F.array("fp"), near))
    spread = keys.join(sizes, ["t", "key"]).select("t", "key", "fp", F.explode(points).alias("point"))
    x, y = spread.alias("x"), spread.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("t", "key", "point")]
    close = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius
    return x.join(y, [*same, F.col("x.fp") < F.col("y.fp"), close]).select(
        F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def roots(prints: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(fp, root) of each distinct ``fp``; fingerprints that are linked, also over
    others, share a root."""
    stars = components(linked_pairs(prints, radius, max_bucket))
    return prints.join(stars, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(id, fp, component_id) for each row of ``df``."""
    prints = written(df.select(F.col(id_col), simhash(F.col(text_col), shingle).alias("fp")), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    tree = classes.join(roots(classes.select("fp"), radius, max_bucket), "fp")
    named = tree.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(tree.join(named, "root").select("fp", "component_id"), "fp").select(
        id_col, "fp", "component_id")


def report(df: DataFrame) -> DataFrame:
    return near_duplicates(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                      "component_id")


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return _orderable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """The row of the smallest id of each component, as it was; of several rows
    with that id and fingerprint the first in the order of their columns (of those
    that have an order: maps have none).

    Texts are fingerprinted once. Rows are then told apart by narrow keys (id, hash and
    length of the text): the keys that go are a minority, and so are those of rows that
    repeat a kept id and fingerprint, which alone are put in order. Rows that a bitmap of
    these keys excludes stay where they are; only the others are shuffled."""
    found = written(df.select(*key_columns(id_col, text_col), simhash(F.col(text_col), shingle).alias("fp")), "fingerprints")
    classes = found.groupBy("fp").agg(F.min("id.id").alias("id"))
    tree = classes.join(roots(classes.select("fp"), radius, max_bucket), "fp")
    best = tree.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("fp"))).alias("s"))
    # One row a fingerprint, with its id if it is the one that stays.
    chosen = tree.join(best, "root").select("fp", F.when(F.col("fp") == F.col("s.fp"), F.struct(F.col("s.id").alias("id"))).alias("stays"))
    keys = found.groupBy(*KEY, "fp").agg(F.count("*").alias("rows")).join(chosen, "fp").withColumn(
        "stays", F.coalesce(F.col("id").eqNullSafe(F.col("stays")), F.lit(False)))
    several = keys.where("stays").groupBy("fp").agg(F.sum("rows").alias("rows")).where("rows > 1").select("fp", F.lit(True).alias("several"))
    other = written(keys.drop("rows").join(several, "fp", "left").where("NOT stays OR several"), "other")
    keyed = df.select(F.struct(*df.columns).alias("row"), *key_columns(id_col, text_col))
    clear, touched = bitmap.split(keyed, other, list(KEY))
    rest = clear.unionByName(touched.join(other.select(*KEY), list(KEY), "left_anti")).select("row.*")
    again = touched.join(other.where("stays").select(*KEY, "fp"), list(KEY))
    columns = [F.col(f"row.`{f.name}`") for f in df.schema.fields if _orderable(f.dataType)]
    order = Window.partitionBy("fp").orderBy(*columns)
    first = again.withColumn("n", F.row_number().over(order)).where("n = 1").select("row.*")
    return rest.unionByName(first)
