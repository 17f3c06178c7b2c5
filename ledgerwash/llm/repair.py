"""Conversation structure repair by prefix-doubling path ranking.

A conversation should read: an optional system turn, then user and assistant in
turns (role initials ``(s?(ua)+)?``). Rows may be kept (0), given the role user or
assistant that fits (3), deleted (4; blank and duplicate rows must be), and empty
turns inserted anywhere (3); a truncated row that stays costs 3 more. Of the
cheapest edits those with the least audit win: the initials of Delete, Insert, Keep
and Rerole in order.

Rows are put in one global order and dealt to blocks, so no task holds a whole
conversation. A node is a place between rows with the state of the grammar there.

* Cost DP: a row is a 4 x 4 matrix of costs, a block the least-plus product of its
  rows. A tree scan over the blocks of conversations that cross a border gives each
  block the cost-to-go behind it, and then each place its own.
* Path ranking: the arcs that reach a node's cost are optimal. Nodes are ranked by
  the least audit of 1, 2, 4 ... letters that their optimal arcs can spell: the
  rank of a double length is the rank of (own rank, least rank of the nodes that
  the first half can end at), and only ends of that rank stay as doubled pointers.
  These pointers spell the least path of the start, half by half.
* A block spells the path of each state that it may be entered in, and a second scan
  (of maps from state to state) picks the one that is.

Defined results: null roles and texts are empty; nulls first in the order by turn,
rows of equal turn by role and text; a null conversation is one like any other.
Roles count by their first character; an empty role or one of another initial fits
nowhere and is rerole or deleted. Repeated rows are duplicates. Empty tables give
none. Very long conversations are spread over blocks. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwash.llm.blocks import BLOCK, block_of, numbered, scan
from ledgerwash.llm.scratch import written

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
FORCED = [USER, USER, ASSISTANT, USER]  # the state after an inserted or rerole turn, and so its role
ROLE = {USER: "user", ASSISTANT: "assistant"}
FAULTS = ("fine", "blank", "duplicate", "truncated")
DELETE, INSERT, KEPT, REROLE = 1, 2, 3, 4  # in the order of the letters
LETTERS = " DIKR"
FAR = 1 << 40
NOT_SPACE = r"[^\x20\x09-\x0D]"


def _arcs(initial: str, fault: int) -> list[tuple[int, int, int, int]]:
    """(state, letter, next state, cost) of the edits of a row."""
    arcs = [(q, DELETE, q, 4) for q in range(STATES)]
    if fault not in (1, 2):
        more = 3 * (fault == 3)
        arcs += [(q, KEPT, to, more) for q, to in KEEP.get(initial, {}).items()]
        arcs += [(q, REROLE, FORCED[q], 3 + more) for q in range(STATES)]
    return arcs


# A row's kind: 4 * its initial's number + its fault.
INITIALS = ("", "s", "u", "a")
KINDS = [_arcs(i, f) for i in INITIALS for f in range(len(FAULTS))]
INSERTED = np.array([[0, FAR, 3, 6], [FAR, 0, 3, 6], [FAR, FAR, 0, 3], [FAR, FAR, 3, 0]])
ENDED = np.array([0, 6, 3, 0])  # cost of a grammatical end from each state, insertions included


def _least_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), FAR)


def _row_matrix(kind: int) -> np.ndarray:
    m = np.full((STATES, STATES), FAR)
    for q, _, to, cost in KINDS[kind]:
        m[q, to] = min(m[q, to], cost)
    return _least_plus(INSERTED, m)


ROWS = np.array([_row_matrix(k) for k in range(len(KINDS))])


def product(kinds: np.ndarray) -> np.ndarray:
    """Least-plus product of the rows' matrices, pairwise."""
    m = ROWS[kinds]
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        m = np.concatenate([np.minimum((m[:-1:2, :, :, None] + m[1::2, None]).min(axis=2), FAR), odd])
    return m[0]


def least_paths(src: np.ndarray, letter: np.ndarray, dst: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The levels of the ranking of ``n`` nodes: per level each node's rank by its
    least path of 2^k letters, and a node behind that path whose next 2^k letters are
    least. Nodes without arcs end; a path that ended sorts before its extensions."""
    least = np.full(n, len(LETTERS))
    np.minimum.at(least, src, letter)
    ends = np.flatnonzero(least == len(LETTERS))
    least[ends] = 0
    best = letter == least[src]
    here, there = np.concatenate([src[best], ends]), np.concatenate([dst[best], ends])
    rank, levels = least, []
    while True:
        ahead = np.full(n, n + len(LETTERS))
        np.minimum.at(ahead, here, rank[there])
        chosen = rank[there] == ahead[here]
        here, there = np.divmod(np.unique(here[chosen] * n + there[chosen]), n)
        first = np.searchsorted(here, np.arange(n))
        levels.append((rank, there[first]))
        if not ahead.any():  # every path ends within this level
            return levels
        rank = np.unique(rank * (n + len(LETTERS) + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        # Pointers of twice the length: the pairs chained.
        count = np.diff(np.append(first, len(here)))
        reach = count[there]
        step = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        here, there = np.repeat(here, reach), there[np.repeat(first[there], reach) + step]


def spelled(levels: list[tuple[np.ndarray, np.ndarray]], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the start, node, end): the nodes of each start's least path in
    order, without its end, and each path's end."""
    end = starts
    for _, pointer in reversed(levels):
        end = pointer[end]
    nodes, of, at = starts, np.arange(len(starts)), np.zeros(len(starts), np.int64)
    letters = levels[0][0]
    for k in range(len(levels) - 1, -1, -1):
        half = levels[k][1][nodes]
        nodes, of, at = np.concatenate([nodes, half]), np.concatenate([of, of]), np.concatenate([at, at + (1 << k)])
        live = letters[nodes] > 0
        nodes, of, at = nodes[live], of[live], at[live]
    order = np.lexsort((at, of))
    return of[order], nodes[order], end


def _segments(keys: pd.Series) -> list[tuple[int, int]]:
    """Runs [a, b) of equal neighbours."""
    cuts = np.flatnonzero((keys != keys.shift()).to_numpy()).tolist()
    return list(zip(cuts, [*cuts[1:], len(keys)], strict=True))


def _borders(block: pd.DataFrame) -> pd.DataFrame:
    """The products of a block's first and last conversation, which may cross borders."""
    block = block.sort_values("place")
    kinds, runs = block["kind"].to_numpy(), _segments(block["key"])
    ends = sorted({runs[0], runs[-1]})
    return pd.DataFrame({"key": [block["key"].iloc[a] for a, _ in ends], "block": int(block["block"].iloc[0]),
                         "value": [product(kinds[a:b]).ravel() for a, b in ends]})


_PATHS = ("key string, block bigint, entry int, exit int, cost bigint, edits array<string>, places array<bigint>, "
          "roles array<string>")
_COLUMNS = [part.split()[0] for part in _PATHS.split(", ")]


def _paths(block: pd.DataFrame, crossing: pd.DataFrame) -> pd.DataFrame:
    """Least paths of a block's conversations: from the start or, for those that come
    from the block before, from each state."""
    if block.empty:
        return pd.DataFrame(columns=_COLUMNS, dtype=object)
    block = block.sort_values("place")
    number, kinds, places = int(block["block"].iloc[0]), block["kind"].tolist(), block["place"].tolist()
    known = {r.key: r for r in crossing.itertuples()}
    src, letter, dst, row_of, begun, costs = [], [], [], [], [], []
    for a, b in _segments(block["key"]):
        own, layer = known.get(block["key"].iloc[a]), len(row_of)
        onwards = own is not None and own.after is not None
        here = np.array(own.after) if onwards else ENDED
        cost = [here.tolist()]
        for kind in reversed(kinds[a:b]):
            here = (ROWS[kind] + here).min(axis=1)
            cost.append(here.tolist())
        cost.reverse()
        for i, (now, at) in enumerate(zip(cost, range(layer * STATES, (layer + len(cost)) * STATES, STATES), strict=True)):
            last = i == b - a
            arcs = [] if last and onwards else [(q, INSERT, at + FORCED[q], 3 + now[FORCED[q]]) for q in range(STATES)]
            if not last:
                arcs += [(q, edit, at + STATES + to, c + cost[i + 1][to]) for q, edit, to, c in KINDS[kinds[a + i]]]
            for q, edit, to, c in arcs:
                if c == now[q]:
                    src.append(at + q), letter.append(edit), dst.append(to)
            row_of.append(-1 if last else a + i)
        costs += cost
        states = range(STATES) if own is not None and own.inside else [START]
        begun += [(block["key"].iloc[a], q, layer * STATES + q) for q in states]
    levels = least_paths(np.array(src, np.int64), np.array(letter, np.int64), np.array(dst, np.int64), len(row_of) * STATES)
    of, nodes, ends = spelled(levels, np.array([node for _, _, node in begun]))
    cut, letters = np.searchsorted(of, np.arange(len(begun) + 1)), levels[0][0]
    out = []
    for n, (key, entry, start) in enumerate(begun):
        end = int(ends[n])
        path = [(letters[v], *divmod(int(v), STATES)) for v in nodes[cut[n]:cut[n + 1]]]
        out.append((key, number, entry, end % STATES, costs[start // STATES][entry] - costs[end // STATES][end % STATES],
                    [LETTERS[x] for x, _, _ in path], [None if x == INSERT else places[row_of[at]] for x, at, _ in path],
                    [ROLE[FORCED[q]] if x in (INSERT, REROLE) else None for x, _, q in path]))
    return pd.DataFrame(out, columns=_COLUMNS)


def _key(conv_id: Column) -> Column:
    """Text of a conversation's id, in which null is a value like any other."""
    return F.to_json(F.struct(conv_id.alias("id")))


def judged(rows: DataFrame, bits: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(placed, turns) of rows (conv_id, turn, role, text), both written: placed has
    key, place, block, copy, turn, initial, fault and kind in the order of the
    conversations, turns the texts by ``copy``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = rows.select(_key(F.col("conv_id")).alias("key"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    # Equal rows of one turn may be many: their number in the scan spreads them over the sort's partitions.
    turns = written(told.withColumn("copy", F.monotonically_increasing_id()), "turns")
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    marked = turns.select("key", "turn", "role", "text", "copy", F.substring("role", 1, 1).alias("initial"),
                          (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), said.alias("said"))
    order = numbered(marked, "key", "turn", "role", "text", "copy", without=("role", "text"))
    first = order.where("NOT blank").groupBy("key", "said").agg(F.min("place").alias("place")).select(
        "place", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), 1).when(F.col("new").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    number = F.coalesce(F.array_position(F.array(*map(F.lit, INITIALS[1:])), F.col("initial")), F.lit(0))
    return written(order.join(first, "place", "left").select(
        "key", "place", block_of("place", bits).alias("block"), "copy", "turn", "initial", fault.alias("fault"),
        (number * len(FAULTS) + fault).cast("int").alias("kind")), "judged"), turns


def edits(placed: DataFrame) -> DataFrame:
    """(key, block, cost, edits, places, roles): the cheapest edits of each
    conversation, a row a block; ``places`` holds the edited rows' places (null for
    insertions), ``roles`` the new roles. ``placed``: of ``judged``."""
    narrow = placed.select("key", "place", "block", "kind")
    border = written(narrow.groupBy("block").applyInPandas(_borders, "key string, block bigint, value array<bigint>"), "borders")
    crossing = written(border.join(border.groupBy("key").agg(F.min("block").alias("from"), F.max("block").alias("to"))
                                   .where("from < to"), "key"), "crossing")

    def chained(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _least_plus(a.reshape(STATES, STATES), b.reshape(STATES, STATES)).ravel()

    behind = scan(crossing, chained, last_first=True)
    goal = F.array(*(F.lit(int(c)) for c in ENDED))
    rest = F.expr(f"transform(sequence(0, {STATES - 1}), q -> array_min(transform(sequence(0, {STATES - 1}), "
                  f"r -> before[q * {STATES} + r] + goal[r])))")
    known = crossing.join(behind, ["key", "block"]).withColumn("goal", goal).select(
        "key", "block", (F.col("block") > F.col("from")).alias("inside"),
        F.when(F.col("block") < F.col("to"), F.when(F.col("before").isNull(), F.col("goal")).otherwise(rest)).alias("after"))
    paths = written(narrow.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(_paths, _PATHS), "paths")
    several = crossing.select("key", "block", "from")
    maps = (paths.join(several, ["key", "block"]).groupBy("key", "block", "from")
            .agg(F.array_sort(F.collect_list(F.struct("entry", "exit"))).alias("m"))
            .select("key", "block", F.when(F.col("block") > F.col("from"), F.col("m.exit"))
                    .otherwise(F.array_repeat(F.col("m")[0]["exit"], STATES)).cast("array<bigint>").alias("value")))
    entered = scan(written(maps, "maps"), lambda a, b: b[a]).select(
        "key", "block", F.coalesce(F.col("before")[START], F.lit(START)).cast("int").alias("entry"), F.lit(True).alias("known"))
    return paths.join(entered, ["key", "block", "entry"], "left").join(
        several.select("key", "block", F.lit(True).alias("crosses")), ["key", "block"], "left").where(
        "crosses IS NULL OR known").select("key", "block", "cost", "edits", "places", "roles")


def repaired(placed: DataFrame, turns: DataFrame, chosen: DataFrame) -> DataFrame:
    """(key, block, at, role, text): the turns of the repaired conversations, in
    order of block and at."""
    step = chosen.select("key", "block", F.posexplode(F.arrays_zip("edits", "places", "roles")).alias("at", "s")).select(
        "key", "block", "at", "s.edits", "s.places", "s.roles").where("edits <> 'D'")
    own = step.where("places IS NOT NULL").join(placed.select(F.col("place").alias("places"), "copy"), "places").join(
        turns.select("copy", "role", "text"), "copy")
    return own.select("key", "block", "at", F.coalesce("roles", "role").alias("role"), "text").unionByName(
        step.where("places IS NULL").select("key", "block", "at", F.col("roles").alias("role"), F.lit("").alias("text")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of ``role:text`` lines of each conversation in sorted rows; holds one
    batch and one digest at a time, however long the conversation."""
    key, digest, done = None, None, []
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "role", "text")]
        for k, role, text in zip(*columns, strict=True):
            line = f"{role}:{text}"
            if k == key:
                digest.update(("\n" + line).encode())
            else:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(line.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], ["key", "repaired_sha256"])
            done = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "repaired_sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """(key, repaired_sha256). A digest is sequential: one conversation's text passes
    through one task, as a stream."""
    return turns.repartition("key").sortWithinPartitions("key", "block", "at").mapInArrow(
        _digests, "key string, repaired_sha256 string")


def report(original: DataFrame, rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of each conversation of ``original``, after
    ``rows`` (the same or a damaged table) are repaired."""
    placed, turns = judged(rows)
    chosen = written(edits(placed), "edits")
    faults = placed.groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        *(F.count_if(F.col("fault") == n).alias(FAULTS[n]) for n in (1, 2, 3)))
    pair = placed.alias("a").join(placed.alias("b"), F.col("b.place") == F.col("a.place") + 1).where("a.key = b.key")
    illegal = pair.where(~F.concat("a.initial", "b.initial").isin("su", "ua", "au")).groupBy(
        F.col("a.key").alias("key")).agg(F.count("*").alias("illegal"))
    pieces = F.array_sort(F.collect_list(F.struct("block", F.array_join("edits", "").alias("audit"))))
    audits = chosen.groupBy("key").agg(F.sum("cost").alias("cost"), F.array_join(pieces["audit"], "").alias("audit"))
    found = faults.join(audits, "key").join(illegal, "key", "left").join(
        digests(repaired(placed, turns, chosen)), "key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    every = original.select("conv_id").distinct().withColumn("key", _key(F.col("conv_id")))
    return every.join(found, "key", "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by crc32 of ``conv_id:turn``
    (nulls: one space) modulo 20: 0 drops a row, 1 empties its text, 2 removes its
    ``[.!?]``, 3 repeats it, 4 makes its role user."""
    space = F.lit(" ")
    told = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    told = told.withColumn("fate", F.crc32(name) % 20).where("fate <> 0")
    return told.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")
