"""Cost-balanced packing of token sequences.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n`` (projections, and
attention within the piece).  Pieces are assigned in descending cost to the
lowest-cost sequence that still has room for them; when none has, the piece is
cut to fill the lowest-cost one that is not full.  Documents over the capacity
are first cut into full sequences.

Each task packs its own stream in blocks of ``BLOCK`` sequences and carries
what does not fill a sequence to its next block, so nothing is shuffled and
memory is bounded by a block.  A task's last block ends in sequences of
descending powers of two, which need no padding.

Defined results: null or empty texts are documents of the end id alone (one
piece).  A text of any length is encoded whole and cut into as many sequences
as it fills; its task holds its ids until then.  Repeated rows and ids are separate documents.  An empty table gives
an empty result.  Sequence ids are unique over tasks, not consecutive: the
task's number in the upper bits, the sequence's in the lower 33.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, whole_text
from .tokens import default_vocabulary, encoder

CAPACITY = 4096
BLOCK = 256
#: Cost of a token for itself, and for each token that it attends to, of which there are n in a piece (figures of a model 4096 wide).
LINEAR, QUADRATIC = 12 * 4096, 2

#: A piece to pack: document number, start in it, length.
Piece = tuple[int, int, int]


def cost(length: int) -> int:
    return LINEAR * length + QUADRATIC * length * length


def assign(pieces: list[Piece], capacities: list[int]) -> list[list[Piece]]:
    """Pieces of exactly the capacities' sum, cut where they must be."""
    rooms = np.array(capacities, dtype=np.int64)
    costs = np.zeros(len(capacities), dtype=np.float64)
    out: list[list[Piece]] = [[] for _ in capacities]
    waiting = [(-n, number, start) for number, start, n in pieces]
    heapq.heapify(waiting)
    while waiting:
        n, number, start = heapq.heappop(waiting)
        n = -n
        fits = rooms >= n
        if fits.any():
            best = int(np.where(fits, costs, np.inf).argmin())
        else:
            best = int(np.where(rooms > 0, costs, np.inf).argmin())
            part = int(rooms[best])
            heapq.heappush(waiting, (-(n - part), number, start + part))
            n = part
        out[best].append((number, start, n))
        rooms[best] -= n
        costs[best] += cost(n)
    return out


def capacities_of(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Full sequences, then the rest as descending powers of two."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]


def pack_block(pieces: list[Piece], last: bool, capacity: int = CAPACITY) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences of one block, and the pieces left for the next."""
    tokens = sum(n for _, _, n in pieces)
    if last:
        return assign(pieces, capacities_of(tokens, capacity)), []
    held: list[Piece] = []
    over = tokens % capacity
    pieces = list(pieces)
    while over:  # the latest pieces wait, the last of them cut
        number, start, n = pieces.pop()
        if n > over:
            pieces.append((number, start, n - over))
            held.append((number, start + n - over, over))
            break
        held.append((number, start, n))
        over -= n
    return assign(pieces, [capacity] * (tokens // capacity)), held


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit integers.
    """
    path = vocabulary or default_vocabulary()
    names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        own = encoder(path)
        tail = np.array([end_id], dtype=own.dtype).tobytes()
        base = TaskContext.get().partitionId() << 33
        held: list[Piece] = []
        known: dict[int, tuple[int | None, bytes]] = {}  # documents with pieces in hand
        count = tokens = sequence = 0

        def emit(sequences: list[list[Piece]]) -> Iterator[dict]:
            nonlocal sequence
            rows: list[tuple] = []
            for members in sequences:
                offset = 0
                for number, start, n in sorted(members):
                    doc_id, ids = known[number]
                    part = np.frombuffer(ids, dtype=own.dtype, offset=start * own.dtype.itemsize, count=n)
                    rows.append((doc_id, start, n, part.astype("<u4").tobytes(), len(ids) // own.dtype.itemsize, base + sequence, offset))
                    offset += n
                sequence += 1
            if rows:
                yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"], _encoded(own, batch["text"]), strict=True):
                ids += tail
                n = len(ids) // own.dtype.itemsize
                known[count] = doc_id, ids
                for start in range(0, n, capacity):
                    held.append((count, start, min(capacity, n - start)))
                count += 1
                tokens += n
                if tokens >= BLOCK * capacity:
                    sequences, held = pack_block(held, False, capacity)
                    yield from emit(sequences)
                    kept = {number for number, _, _ in held}
                    known = {number: known[number] for number in kept}
                    tokens = sum(n for _, _, n in held)
        yield from emit(pack_block(held, True, capacity)[0])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("text")), work, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _encoded(own, texts: list[bytes]) -> Iterator[bytes]:
    for start in range(0, len(texts), 1000):
        yield from own.encode(texts[start : start + 1000])


def pack_rows(docs: DataFrame) -> DataFrame:
    """The query's digest: each piece's ids as their crc32."""
    packed = pack(docs)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
