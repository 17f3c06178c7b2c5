"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source, document after document in the order of a hash, are cut into
blocks of equal length. A source's target is its share by weight of all words, at most
``EPOCHS`` times its own (what is above goes to the others by weight), and its quota
that many blocks. The mix is a number of shards of equal size:

* Splitting tree: the root holds all quotas; each node draws how many blocks of each
  source go to its left half (a multivariate-hypergeometric draw, source after source
  from exact univariate ones by inversion) and leaves the rest to the right, down to
  one shard. Draws use hashes of node and source, so reruns agree. Each node also
  knows how many blocks of a source stand left of it, so shards draw disjoint runs.
* Permuted blocks: each time round (epoch), a source's blocks are sorted by a hash.
  A shard takes its run of that order; its pieces of documents are shuffled locally
  by a hash.

Only DataFrame functions are used. Sources are spread over hash buckets, blocks and
pieces are joined by keys of bounded size (a block holds ``BLOCK`` words at most), and
equal rows are one row with a count until the words are dealt, so neither a hot
source nor a group of copies meets in one task. Over all sources goes only a window
of one row a source.

Defined results: the size of null, empty and blank texts is 0, they are never taken,
and a source without words has the target 0; a null source is one, ordered last; null
ids and repeated rows are dealt row by row; an empty table gives none. Very long
texts are cut at blocks. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwash.llm.blocks import numbered
from ledgerwash.llm.scratch import written

WEIGHTS = (5, 2, 1)
EPOCHS = 3
BLOCK = 4096  # words of a block; less in sources of fewer than FINE blocks
FINE = 1024
SHARD = 1024  # blocks of a shard
BUCKET = 1 << 12  # documents of a hash bucket, about
CHUNK = 1 << 12  # numbers counted out of one row at a time
SEED = 12


def words_in(text: Column) -> Column:
    """Number of runs of ``[^\\x20\\x09-\\x0D]``."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def counted_out(rows: DataFrame, n: str, name: str) -> DataFrame:
    """Each row ``n`` times, with ``name`` 0, 1, ...; a row of many is counted out by
    many tasks."""
    chunk = rows.where(F.col(n) > 0).withColumn("_c", F.explode(F.expr(f"sequence(0, ({n} - 1) div {CHUNK})")))
    chunk = chunk.repartition(*(F.col(c) for c in chunk.columns))
    return chunk.withColumn(name, F.explode(F.expr(
        f"sequence(_c * {CHUNK}, least({n}, (_c + 1) * {CHUNK}) - 1)"))).drop("_c")


def source_plan(items: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, block: int = BLOCK,
                fine: int = FINE) -> DataFrame:
    """A row a source of ``items`` (source struct, size, copies): number s, source_size,
    target, block words, blocks, quota, rounds begun, and first (blocks of earlier
    sources' rounds)."""
    own = items.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"),
                                      F.count("*").alias("items"))
    order = Window.orderBy(F.col("source.source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    own = own.withColumn("s", F.row_number().over(order)).withColumn("weight", weight.cast("double"))
    everything = Window.partitionBy()
    own = own.withColumn("most", F.lit(epochs) * F.col("source_size")).withColumn("total", F.sum("source_size").over(everything))
    # Sources stop in the order of most / weight: those before have stopped, the others share what they leave.
    stops = Window.orderBy(F.col("most") / F.col("weight"), "s")
    before = F.coalesce(F.sum("most").over(stops.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sharing = F.sum("weight").over(stops.rowsBetween(0, Window.unboundedFollowing))
    level = ((F.col("total") - before) / sharing).alias("level")
    own = own.select("*", level).withColumn("level", F.min(F.when(
        F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("s"), F.col("level")))
        ).over(everything)["level"])
    own = own.withColumn("target", F.least(F.col("level") * F.col("weight"), F.col("most").cast("double")))
    own = own.withColumn("words", F.greatest(F.lit(1), F.least(F.lit(block), F.ceil(F.col("source_size") / fine))).cast("long"))
    own = own.withColumn("blocks", F.ceil(F.col("source_size") / F.col("words")).cast("long"))
    own = own.withColumn("quota", F.least(F.round(F.col("target") / F.col("words")).cast("long"), epochs * F.col("blocks")))
    own = own.withColumn("rounds", F.when(F.col("blocks") > 0, F.ceil(F.col("quota") / F.greatest("blocks", F.lit(1)))).otherwise(0).cast("long"))
    turns = F.col("rounds") * F.col("blocks")
    return own.withColumn("first", F.sum(turns).over(Window.orderBy("s")) - turns).drop("most", "total", "level")


def _hypergeometric(pool: str, own: str, want: str, u: str) -> str:
    """SQL: how many of ``want`` blocks drawn from ``pool`` are of the ``own`` marked
    ones, by inversion at ``u``. The masses are summed over 12 standard deviations to
    either side, beyond which lies less than 1e-30 of them."""
    p, k, n = (f"cast({x} as double)" for x in (pool, own, want))
    mean = f"({n} * {k} / {p})"
    spread = f"(12 * sqrt({mean} * (1 - {k} / {p}) * ({p} - {n}) / greatest({p} - 1, 1)) + 12)"
    low = f"greatest(0, {want} - ({pool} - {own}), cast(floor({mean} - {spread}) as bigint))"
    high = f"least({own}, {want}, cast(ceil({mean} + {spread}) as bigint))"
    up = f"({k} - x) * ({n} - x) / ((x + 1) * ({p} - {k} - {n} + x + 1))"
    start = "named_struct('mass', 1D, 'sum', 0D, 'at', cast(0 as bigint))"
    total = f"aggregate(sequence({low}, {high}), {start}, (m, x) -> named_struct('mass', m.mass * {up}, 'sum', m.sum + m.mass, 'at', x)).sum"
    return (f"if({want} <= 0 or {own} <= 0, cast(0 as bigint), if({own} >= {pool}, {want}, aggregate(sequence({low}, {high}), "
            f"named_struct('mass', 1D, 'sum', 0D, 'at', cast(-1 as bigint), 'goal', {u} * {total}), (m, x) -> if(m.at >= 0 and m.sum > m.goal, m, "
            f"named_struct('mass', m.mass * {up}, 'sum', m.sum + m.mass, 'at', x, 'goal', m.goal))).at))")


def splitting_tree(plan: DataFrame, shards: int, blocks: int, seed: int = SEED) -> DataFrame:
    """(shard, s, own, start): ``own`` blocks of source s go to the shard, after the
    ``start`` that go to shards before it."""
    quotas = F.array_sort(F.collect_list(F.struct("s", F.col("quota").alias("own"), F.lit(0).cast("long").alias("start"))))
    node = plan.where("quota > 0").agg(quotas.alias("q")).select(
        F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "q")
    u = f"(shiftrightunsigned(xxhash64({seed}, lo, hi, b.s), 11) + 0.5D) / {float(1 << 53)}D"
    draw = _hypergeometric("a.pool", "b.own", "a.want", u)
    left = f"""aggregate(q, named_struct('pool', aggregate(q, cast(0 as bigint), (n, b) -> n + b.own), 'want',
        {blocks} * mid div {shards} - {blocks} * lo div {shards}, 'got', cast(array() as array<bigint>)),
        (a, b) -> transform(array({draw}), x -> named_struct('pool', a.pool - b.own, 'want', a.want - x,
        'got', concat(a.got, array(x))))[0]).got"""
    halves = """array(struct(lo as lo, mid as hi, filter(transform(q, (b, i) -> struct(b.s as s, l[i] as own, b.start as start)), b -> b.own > 0) as q),
        struct(mid as lo, hi as hi, filter(transform(q, (b, i) -> struct(b.s as s, b.own - l[i] as own, b.start + l[i] as start)), b -> b.own > 0) as q))"""
    for _ in range((shards - 1).bit_length()):
        split = node.where("hi - lo > 1").withColumn("mid", F.expr("(lo + hi) div 2")).withColumn("l", F.expr(left))
        # Written: the next level reads a node twice.
        node = written(split.select(F.explode(F.expr(halves)).alias("h")).select("h.*").unionByName(node.where("hi - lo = 1")),
                       "split").repartition("lo")
    return node.select(F.col("lo").alias("shard"), F.explode("q").alias("b")).select("shard", "b.*")


def _dealt(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = docs.select(F.struct(F.col(source_col).alias("source")).alias("source"), F.struct(F.col(id_col).alias("id")).alias("doc"),
                       words_in(F.col(text_col)).alias("size"))
    return rows.groupBy("source", "doc", "size").agg(F.count("*").alias("copies"))


def laid_out(items: DataFrame, plan: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(s, words, doc, size, copies, start) of the items that have words: ``start``
    words of the source stand before them."""
    told = items.where("size > 0").join(plan.select("source", "s", "words", "items"), "source")
    told = told.withColumn("hash", F.xxhash64(F.lit(SEED), "doc", "size"))
    told = told.withColumn("bucket", F.expr(f"pmod(hash, 1 + items div {bucket})"))
    length = F.col("size") * F.col("copies")
    lengths = told.groupBy("s", "bucket").agg(F.sum(length).alias("all"))
    starts = lengths.select("s", "bucket", (F.sum("all").over(Window.partitionBy("s").orderBy("bucket")) - F.col("all")).alias("before"))
    within = Window.partitionBy("s", "bucket").orderBy("hash", "doc", "size")
    return told.withColumn("within", F.sum(length).over(within) - length).join(starts, ["s", "bucket"]).select(
        "s", "words", "doc", "size", "copies", (F.col("before") + F.col("within")).alias("start"))


def drawn(plan: DataFrame, shard_blocks: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, s, block, round): the blocks of the mix. ``plan`` is written."""
    blocks = plan.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, -(-blocks // shard_blocks))
    runs = splitting_tree(plan, shards, blocks, seed)
    places = counted_out(runs, "own", "i").select("shard", "s", (F.col("start") + F.col("i")).alias("at"))
    turns = counted_out(plan.select("s", "blocks", F.explode(F.expr("if(rounds > 0, sequence(1, rounds), array())")).alias("round")), "blocks", "block")
    order = numbered(turns.select("s", "round", F.xxhash64(F.lit(seed), "s", "round", "block").alias("hash"), "block"),
                     "s", "round", "hash", "block", name="permuted")
    taken = order.join(plan.select("s", "first", "quota"), "s").withColumn("at", F.col("place") - F.col("first")).where("at < quota")
    return taken.select("s", "round", "block", "at").join(places, ["s", "at"]).select("shard", "s", "block", "round")


def mix(items: DataFrame, plan: DataFrame, shard_blocks: int = SHARD, bucket: int = BUCKET, seed: int = SEED) -> DataFrame:
    """(shard, place, s, doc, size, copy, start, first, length, round): pieces of
    documents, ``length`` words from ``first``, in the order ``place`` of their shard.
    ``copy`` numbers equal rows; (s, start, copy) names a row."""
    rows = counted_out(laid_out(items, plan, bucket), "copies", "copy")
    begin = F.col("start") + F.col("copy") * F.col("size")
    covered = F.explode(F.sequence(F.expr("begin div words"), F.expr("(begin + size - 1) div words")))
    cover = rows.withColumn("begin", begin).withColumn("block", covered)
    first = F.greatest(F.lit(0), F.col("block") * F.col("words") - F.col("begin"))
    until = F.least("size", (F.col("block") + 1) * F.col("words") - F.col("begin"))
    pieces = cover.select("s", "doc", "size", "copy", "start", "block", first.alias("first"), (until - first).alias("length")).join(
        drawn(plan, shard_blocks, seed), ["s", "block"])
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "s", "start", "copy", "first", "round"), "s", "start", "copy", "first", "round")
    return pieces.withColumn("place", F.row_number().over(shuffled)).drop("block")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           shard_blocks: int = SHARD, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(id, size, source_size, target, taken) of each row."""
    items = written(_dealt(docs, id_col, text_col, source_col), "items")
    plan = written(source_plan(items, block=block), "sources")
    taken = mix(items, plan, shard_blocks, bucket).groupBy("s", "doc", "size", "copy").agg(F.sum("length").alias("taken"))
    every = counted_out(items.join(plan.select("source", "s", "source_size", "target"), "source"), "copies", "copy")
    return every.join(taken, ["s", "doc", "size", "copy"], "left").select(
        F.col("doc.id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
