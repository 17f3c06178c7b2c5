"""Approximate nearest neighbours by adaptive dimension scanning.

Vectors are scaled to length 1, turned by one random rotation and dealt to the
lists of a k-means quantiser that is fitted on a bounded sample; every vector is
indexed. A query scans its nearest list first, which gives a threshold (the
distance of its k-th candidate there), and then its other probed lists. Within a
list the vectors stand in column blocks: after each block, the partial distance
so far, scaled up to all dimensions, is tested against the threshold, and
candidates that fail the hypothesis "may still be near enough" are abandoned.
Survivors are ranked again by the cosine of the original vectors in double
precision.

How many lists a query probes is calibrated on the sample: as many as it takes
for ``recall``, and two standard errors of its estimate more, of the sample's own true
neighbours; the fewer vectors, the larger that margin. Queries whose lists hold fewer
than ``k`` others probe more lists, four times as many a round and all at the end,
until they have ``k`` or no candidate is left. Lists and queries meet in
blocks of bounded size, so neither a long list nor many queries fill one task. Each
list is cut into blocks by its own length and its own number of queries: a hot list
copies neither the vectors nor the queries of any other, and a list that nobody
probes is not read. There are about as many lists as the root of the vectors, at most
a quarter of the sample; beyond that lists grow with the table, so that the
calibrated recall stays and the cost of a query grows in proportion.
Vectors that are equal are indexed once, with their k+1 smallest ids (no more can
be among a query's k nearest), and equal queries search once.

Defined results: vectors that are null, zero, or hold null or non-finite numbers
take no part, nor do null ids or vectors of another dimension than most (of equal
counts the smaller). Rows that repeat an id and a vector count once; an id with
several vectors is found by each, and its query gets the nearest of all; a query
never finds its own id. Numbers may be of any size: vectors are levelled by powers of
two, so those that differ by such a factor count as equal (their cosines are). With fewer than k other vectors all are returned. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwash.llm.scratch import written

SAMPLE = 16_384  # vectors that the quantiser and the calibration see, at most ...
SAMPLE_BYTES = 64 << 20  # ... and their bytes
MODEL_BYTES = 32 << 20  # of centroids and rotation, which go to every executor
RECALL = 0.96
EPSILON = 2.1  # of the hypothesis test; larger abandons later
COLUMNS = 16
BLOCK = 4096  # vectors, and queries, that meet in one group
COPIES = 1 << 16  # of vectors, one for each list that they probe, in one batch


@dataclass(frozen=True)
class Model:
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int


def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    good = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(vec.isNotNull() & good & F.exists(vec, lambda x: x != 0), F.lit(False))


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, total: int, k: int, recall: float = RECALL, rounds: int = 8) -> Model:
    """Quantiser, rotation and number of probes from sampled unit vectors."""
    rng = np.random.default_rng(7)
    dim = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    turned = sample @ rotation
    most = max(1, MODEL_BYTES // (8 * dim) - dim)
    lists = max(1, min(math.isqrt(total), len(sample) // 4, most))
    centroids = turned[rng.choice(len(turned), lists, replace=False)]
    for _ in range(rounds if lists > 1 else 0):
        owner = _nearest(turned, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, turned)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centroids)
    if lists == 1:
        return Model(rotation, centroids, 1)
    owner = _nearest(turned, centroids, 1)[:, 0]
    tried = rng.choice(len(turned), min(256, len(turned)), replace=False)
    near = turned[tried] @ turned.T
    near[np.arange(len(tried)), tried] = -np.inf
    some = min(k, len(turned) - 1)
    best = np.argpartition(-near, some - 1, axis=1)[:, :some]
    place = np.argsort(np.argsort(-(turned[tried] @ centroids.T), axis=1), axis=1)
    needed = np.sort(place[np.arange(len(tried))[:, None], owner[best]], axis=None)
    # A query's neighbours fail together, so queries count for the error, not pairs.
    goal = min(1.0, recall + 2 * math.sqrt(recall * (1 - recall) / len(tried)))
    return Model(rotation, centroids, int(needed[min(len(needed) - 1, math.ceil(goal * len(needed)))]) + 1)


def _nearest(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    out = []
    for at in range(0, len(x), 1024):
        score = -(x[at:at + 1024] @ centroids.T)
        some = np.argpartition(score, n - 1, axis=1)[:, :n] if n < score.shape[1] else np.argsort(score, axis=1)
        out.append(np.take_along_axis(some, np.argsort(np.take_along_axis(score, some, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, n), int)


def scan(base: np.ndarray, ids: np.ndarray, queries: np.ndarray, limits: np.ndarray, keep: int,
         epsilon: float = EPSILON, columns: int = COLUMNS) -> Iterator[tuple[int, int, float]]:
    """(query number, id, squared distance): up to ``keep`` nearest of ``base`` for each
    query, of those under its limit (a squared distance)."""
    dim = base.shape[1]
    edges = [*range(0, dim, columns), dim]
    parts = [np.ascontiguousarray(base[:, a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    for q, (query, limit) in enumerate(zip(queries, limits, strict=True)):
        alive, dist = None, 0.0
        for part, a, b in zip(parts, edges, edges[1:], strict=False):
            rows = part if alive is None else part[alive]
            step = rows - query[a:b]
            dist = dist + np.einsum("ij,ij->i", step, step)
            slack = (1 + epsilon / math.sqrt(b)) ** 2 if b < dim else 1 + 1e-5
            passed = dist * (dim / b) <= limit * slack
            if not passed.all():
                kept = np.flatnonzero(passed)
                alive = kept if alive is None else alive[kept]
                dist = dist[kept]
            if not len(dist):
                break
        if len(dist):
            found = ids if alive is None else ids[alive]
            for i in np.lexsort((found, dist))[:keep]:
                yield q, int(found[i]), float(dist[i])


def _assigned(rows: DataFrame, model, id_col: str, probes: int) -> DataFrame:
    """(id, list, place, turned): the nearest lists of each vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            step = max(1, min(1024, COPIES // probes))
            for at in range(0, len(ids), step):
                turned = _unit(batch.column(1).slice(at, step).to_pylist()) @ m.rotation
                lists = _nearest(turned, m.centroids, probes)
                flat = np.repeat(turned, probes, axis=0).astype(np.float32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ids[at:at + step], probes)), pa.array(lists.ravel().astype(np.int32)),
                    pa.array(np.tile(np.arange(probes, dtype=np.int32), len(turned))),
                    pa.array(list(flat), pa.list_(pa.float32()))], ["id", "list", "place", "turned"])
    return rows.select(id_col, "vec").mapInArrow(run, "id bigint, list int, place int, turned array<float>")


def _dealt(base: DataFrame, asks: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Vectors and queries with the numbers ``part`` and ``chunk`` of the blocks in
    which they meet: a list's vectors fall into parts and its queries into chunks of
    about ``block``, each vector goes to all chunks of its list and each query to all
    parts. The counts of lists are a row a list, which is bounded by the model."""
    held = base.groupBy("list").agg(F.count("*").alias("held"))
    asked = asks.groupBy("list").agg(F.count("*").alias("asked"))
    counts = F.broadcast(held.join(asked, "list").select(
        "list", F.ceil(F.col("held") / block).alias("parts"), F.ceil(F.col("asked") / block).alias("chunks")))
    one = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    left = base.join(counts, "list").withColumn("part", one("parts")).withColumn("chunk", every("chunks"))
    right = asks.join(counts, "list").withColumn("chunk", one("chunks")).withColumn("part", every("parts"))
    return left.drop("parts", "chunks"), right.drop("parts", "chunks")


def _scanned(base: DataFrame, asks: DataFrame, keep: int, block: int) -> DataFrame:
    """(q, id, dist) of the lists ``base`` and the queries ``asks`` that probe them."""
    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            names = right["id"].to_numpy()
            found = scan(np.stack(left["turned"].to_numpy()).astype(np.float64), left["id"].to_numpy(),
                         np.stack(right["turned"].to_numpy()).astype(np.float64), right["limit"].to_numpy(), keep)
            out = [(names[q], i, d) for q, i, d in found]
        return pd.DataFrame(out, columns=["q", "id", "dist"]).astype({"q": "int64", "id": "int64", "dist": "float64"})

    keys = ["list", "part", "chunk"]
    left, right = _dealt(base, asks, block)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "q bigint, id bigint, dist double")


def _best(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy("dist", "id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)


def _levelled(vec: str) -> Column:
    """The vector times a power of two, which is exact, with a largest component of
    about 1: squares neither overflow nor vanish and cosines stay the same. The power
    comes in two factors, as that of the smallest numbers is beyond a double."""
    doubles = f"transform({vec}, x -> cast(x AS double))"
    power = f"-floor(log2(array_max(transform({doubles}, x -> abs(x)))))"
    factors = f"transform(array({power}), p -> struct(pow(2D, floor(p / 2)) AS a, pow(2D, p - floor(p / 2)) AS b))"
    return F.expr(f"transform({factors}, f -> transform({doubles}, x -> x * f.a * f.b))[0]")


def _exact(a: str, b: str) -> Column:
    total = lambda e: f"aggregate({e}, 0D, (s, x) -> s + x)"
    norm = lambda v: f"sqrt({total(f'transform({v}, x -> x * x)')})"
    return F.expr(f"{total(f'zip_with({a}, {b}, (x, y) -> x * y)')} / ({norm(a)} * {norm(b)})")


def search(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
           recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
    sizes = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("vec") == sizes["dim"]).withColumn("vec", _levelled("vec"))
    # Equal vectors: one entry, their smallest ids as members.
    first = Window.partitionBy("vec").orderBy("id")
    ranked = rows.select("id", "vec").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    members = written(ranked.withColumn("entry", F.min("id").over(Window.partitionBy("vec"))), "vectors")
    entries = members.where("n = 1").select(F.col("entry").alias("id"), "vec")
    total = entries.count()
    sample = entries.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, max(256, SAMPLE_BYTES // (8 * sizes["dim"])))).select("vec").toPandas()["vec"]
    model = fit(_unit(list(sample)), total, k, recall)
    shared = spark.sparkContext.broadcast(model)
    asked = written(rows.where("asks").select("id", "vec").distinct(), "queries")
    questions = asked.groupBy("vec").agg(F.min("id").alias("q"))
    questions = written(questions, "questions")
    base = written(_assigned(entries, shared, "id", 1).drop("place"), "lists")

    def probing(some: DataFrame, probed: int) -> DataFrame:
        return written(_assigned(some, shared, "q", probed), "probes")

    probes = probing(questions, model.probes)
    keep = k + 4  # some more than k: the distances are in single precision
    no_limit = F.lit(float("inf"))
    near = written(_best(_scanned(base, probes.where("place = 0").withColumn("limit", no_limit), keep, block), keep), "near")
    limits = near.groupBy("q").agg(F.max(F.when(F.col("n") == keep, F.col("dist"))).alias("limit"))
    rest = probes.where("place > 0").join(limits, F.col("id") == F.col("q"), "left").withColumn(
        "limit", F.coalesce("limit", no_limit)).drop("q")
    found = written(_best(near.drop("n").unionByName(_scanned(base, rest, keep, block)), keep).select("q", "id"), "found")

    # A query needs k ids besides its own, or all that there are.
    names = members.select(F.col("entry").alias("id"), F.col("id").alias("name"))
    enough = min(k + 1, names.select("name").distinct().limit(k + 1).count())

    def lacking(some: DataFrame, got: DataFrame) -> DataFrame:
        full = got.join(names, "id").groupBy("q").agg(F.count_distinct("name").alias("held")).where(F.col("held") >= enough)
        return written(some.join(full, "q", "left_anti"), "lacking")

    probed, short = model.probes, lacking(questions, found)
    while not short.isEmpty():
        # All lists may be probed already, if one id's vectors fill the places: then more are kept.
        probed, keep = min(4 * probed, len(model.centroids)), keep if probed < len(model.centroids) else 4 * keep
        again = probing(short, probed).withColumn("limit", no_limit)
        more = written(_best(_scanned(base, again, keep, block), keep).select("q", "id"), "found")
        found = found.join(short, "q", "left_anti").unionByName(more)
        short = lacking(short, more)
    scored = (found.join(questions, "q").join(entries.withColumnRenamed("vec", "other"), "id")
              .select("q", F.col("id").alias("entry"), _exact("vec", "other").alias("score")))
    named = scored.join(members.select("entry", F.col("id").alias("vec_id")), "entry")
    mine = asked.join(questions, "vec").select("q", F.col("id").alias("query_id"))
    pairs = mine.join(named, "q").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
