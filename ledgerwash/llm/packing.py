"""Sequence packing by minimum bin slack.

Each scan partition tokenises its documents in a stream and packs them as it
goes, so nothing is shuffled and a retried task gives the same rows. A document
longer than a sequence gives full sequences first; what is left of every
document is a *remaining length*, and the lengths form a multiset.

A window takes the largest remaining length, then a subset-sum dynamic program
over a bitset (bit s: some multiset of lengths sums to s; a length with count c
enters as 1, 2, 4 ... copies) finds the multiset that fills the window closest
to its capacity, and the counts are read back from the steps. Should slack
remain, a piece of the longest remaining document fills it. At the end of a
partition the last, shorter window is cut into sequences whose lengths are
powers of two, which need no padding.

Memory is bounded: packing starts whenever ``chunk_tokens`` have gathered and
leaves about ``carry_windows`` windows for the next chunk, so that there is a
choice of lengths. Only a single document is held whole.

Null text counts as empty: one piece, the end id alone. Repeated rows and ids
are documents of their own. An empty table gives no piece.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerwash.llm.memo import Memo, forgetful

CAPACITY = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"

# A run of Latin-1 letters and then marks: the tokenizer splits it in just
# these two, lower-cases the first, and nothing crosses white space.
_MARKS = "%*#$&.,;:!?|"
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
# str.split() also splits at these four, which are no white space to the tokenizer.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_WORDS, _UNITS = 120_000, 350_000  # remembered by a task


class WordTokenizer:
    """Ids of whole texts, word by word with a bounded cache."""

    def __init__(self, file: str):
        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level BPE
        rest = iter(range(256, 512))
        self.byte_chars = {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}
        self.units = Memo(self._unit, _UNITS)  # ids as 4-byte unsigned integers
        self.words = Memo(self._word, _WORDS)

    def _unit(self, unit: str) -> bytes:
        chars = unit if unit.isascii() else "".join(map(self.byte_chars.__getitem__, unit.encode()))
        return array("I", [t.id for t in self.model.tokenize(chars)]).tobytes()

    def _word(self, word: str) -> bytes:
        letters = word.rstrip(_MARKS)
        if letters.isascii() and letters.isalpha() or _LETTERS.fullmatch(letters):
            marks = word[len(letters):]
            return self.units[letters.lower()] + self.units[marks] if marks else self.units[letters.lower()]
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def forget(self) -> None:
        self.words.clear()
        self.units.clear()

    def ids(self, text: str) -> np.ndarray:
        words = _SPACE.split(text) if _SEPARATORS.search(text) else text.split()
        self.words.trim()
        self.units.trim()
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.uint32)


@lru_cache(maxsize=1)
def _words(file: str) -> WordTokenizer:
    """One for all tasks of a Python worker: its vocabulary takes a while to read."""
    return WordTokenizer(file)


def min_slack(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (with counts, no more than are there) whose sum
    is the largest one up to ``capacity``."""
    reach, mask, steps = 1, (1 << capacity + 1) - 1, []
    for length in sorted((n for n in counts if n <= capacity), reverse=True):
        left, copies = min(counts[length], capacity // length), 1
        while left:
            take = min(copies, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left -= take
            copies *= 2
        if reach >> capacity:
            break
    total, chosen = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] += take
            total -= length * take
    return chosen


class Packer:
    """Gathers documents and yields finished sequences: lists of
    (document, start, length)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rest: dict[int, list[tuple[object, int]]] = defaultdict(list)
        self.tokens = 0

    def add(self, doc: object, size: int) -> Iterator[list]:
        start = 0
        while size - start >= self.capacity:
            yield [(doc, start, self.capacity)]
            start += self.capacity
        self._keep(doc, start, size - start)

    def _keep(self, doc: object, start: int, length: int) -> None:
        if length:
            self.rest[length].append((doc, start))
            self.tokens += length

    def _take(self, length: int) -> tuple[object, int, int]:
        doc, start = self.rest[length].pop()
        if not self.rest[length]:
            del self.rest[length]
        self.tokens -= length
        return doc, start, length

    def windows(self, leave: int) -> Iterator[list]:
        """Full windows, until ``leave`` tokens or fewer than a window are left."""
        while self.tokens >= max(leave, self.capacity):
            window = [self._take(max(self.rest))]
            room = self.capacity - window[0][2]
            for length, n in min_slack({k: len(v) for k, v in self.rest.items()}, room).items():
                window += [self._take(length) for _ in range(n)]
                room -= length * n
            if room:  # all that is left is longer than the slack
                doc, start, length = self._take(max(self.rest))
                window.append((doc, start, room))
                self._keep(doc, start + room, length - room)
            yield window

    def last(self) -> Iterator[list]:
        """The rest, as sequences whose lengths are powers of two."""
        yield from self.windows(0)
        pieces = [self._take(length) for length in sorted(self.rest, reverse=True) for _ in range(len(self.rest[length]))]
        total = sum(p[2] for p in pieces)
        for size in (1 << b for b in reversed(range(total.bit_length())) if total >> b & 1):
            window = []
            while size:
                doc, start, length = pieces.pop(0)
                n = min(length, size)
                window.append((doc, start, n))
                size -= n
                if n < length:
                    pieces.insert(0, (doc, start + n, length - n))
            yield window


def _packed(tokenizer: str, capacity: int, end_id: int, chunk_tokens: int, carry_windows: int, with_ids: bool,
            schema: pa.Schema) -> Callable:
    @forgetful
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = _words(tokenizer), Packer(capacity)
        sequence = TaskContext.get().partitionId() << 40
        out: list[tuple] = []

        def rows(windows: Iterator[list]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            for window in windows:
                offset = 0
                for (doc_id, ids), start, length in window:
                    piece = ids[start:start + length].astype("<u4")
                    out.append((doc_id, start, length, zlib.crc32(piece.tobytes()), len(ids), sequence, offset,
                                *([piece] if with_ids else [])))
                    offset += length
                sequence += 1
                if len(out) >= 20_000:
                    yield flushed()

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*out), schema, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(words.ids(text.as_py() or ""), np.uint32(end_id))
                yield from rows(packer.add((doc_id.as_py(), ids), len(ids)))
                if packer.tokens >= chunk_tokens:
                    yield from rows(packer.windows(carry_windows * capacity))
        yield from rows(packer.last())
        if out:
            yield flushed()
        words.forget()

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         capacity: int = CAPACITY, end_id: int = END_ID, chunk_tokens: int = 1 << 21, carry_windows: int = 64,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: the document's id, where the piece starts in the
    document's ids (``start``), its ``length``, ``ids_crc32``, ``doc_tokens``, and its
    place (``sequence_id``, ``offset``). ``with_ids`` adds the ids themselves.
    ``tokenizer``: a file every executor can read."""
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType
    schema = (f"doc_id {id_type.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
              "sequence_id bigint, offset bigint" + ", ids array<bigint>" * with_ids)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    run = _packed(tokenizer or public_tokenizers.path(TOKENIZER), capacity, end_id, chunk_tokens, carry_windows,
                  with_ids, arrow)
    return source.mapInArrow(run, schema)
