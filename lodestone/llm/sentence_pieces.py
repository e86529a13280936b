"""SentencePiece encoding by sampling from the piece lattice, and decoding.

A text, with a space before it, is cut into units, each a run of spaces and
what follows up to the next one; pieces that have a space mark after another
character (word-spanning ones) are not used, so no piece spans two units.  A
unit's lattice has an edge for each piece that matches and, for characters
without a piece, one for its UTF-8 bytes.  Forward filtering sums the weights
of all ways to each position, backward sampling draws a way from its end, so
a segmentation comes up in proportion to the product of its pieces' weights:
(rank + 2) ** -alpha, as BPE scores are ranks.

Draws are hashes of (seed, row key, unit number, step): the same row gives the
same pieces in any batch, partition or attempt.  Lattices are built once for
each distinct unit of a group, all of a group in step, and sampled for all
its units together in numpy.

A group holds units of ``GROUP_BYTES``, so a long text is sampled in several.
A unit of more than ``LONG_UNIT`` bytes (a text without spaces) is read
alone, in windows of ``WINDOW`` characters that carry the sums of the places a
piece reaches back to.  There each place has a draw of its own (hashed from its
number), so the piece that would end there is drawn on the way, and the way
back only follows them: five bytes a character are kept, and the time is
linear.

Decoding joins the pieces' bytes, turns space marks of pieces to spaces and
drops the first; it gives back every text exactly, control characters, runs
of spaces and the mark's own character included.

Defined results: null and empty texts have no pieces and decode to empty.  A
null row key is a key of its own; rows that repeat key and text have the same
pieces.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, whole_text
from .shingles import _tables, mix

MARK = "▁"
ALPHA = 0.7
#: Bytes of text whose units are sampled together.
GROUP_BYTES = 1 << 20
#: Bytes from which a unit is read alone, and characters of a window.
LONG_UNIT, WINDOW = 4096, 1 << 14
#: Places of lattices that a worker keeps of units that come again (128 bytes each).
KEPT_NODES = 1 << 18
_UNIT = re.compile(rb"\x20+[^\x20]*")
_U64 = np.uint64
#: Weight per character that keeps sums near one, and of an edge over bytes.
_SCALE, _BYTES = 2.2, 1e-7
_EMPTY = np.uint64(0)
_BY_BYTES = 1 << 24


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """The pieces of a model with their weights."""

    def __init__(self, model: str, alpha: float = ALPHA):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=model)
        size = own.get_piece_size()
        pieces = [own.id_to_piece(i) for i in range(size)]
        usual = [i for i in range(size) if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i)) and MARK not in pieces[i].lstrip(MARK)]
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(size):
            if own.is_byte(i):
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        self.longest = max(len(pieces[i]) for i in usual)
        self.bytes_of = [b""] * size
        for i in usual:
            self.bytes_of[i] = pieces[i].replace(MARK, " ").encode()
        for value, i in enumerate(self.byte_ids.tolist()):
            self.bytes_of[i] = bytes([value])
        self.spelled = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.sizes = np.array([len(b) for b in self.bytes_of])
        self.begins = np.cumsum(self.sizes) - self.sizes
        ranks = np.array([max(0.0, -own.get_score(i)) for i in usual])
        lengths = np.array([len(pieces[i]) for i in usual])
        self.weights = np.zeros(size)
        self.weights[usual] = np.exp(alpha * (_SCALE * lengths - np.log(ranks + 2)))
        hashes = self._hash_all([pieces[i] for i in usual])
        bits = 3 + max(4, len(usual).bit_length())
        self.shift, self.keys, self.ids = _U64(64 - bits), np.zeros(1 << bits, _U64), np.zeros(1 << bits, np.int32)
        for key, i in zip(hashes, usual, strict=True):
            slot = int(key >> self.shift)
            while self.keys[slot] != _EMPTY:
                if self.keys[slot] == key:
                    raise ValueError("two pieces share a hash")
                slot = (slot + 1) % len(self.keys)
            self.keys[slot], self.ids[slot] = key, i

        self.kept: dict[bytes, int] = {}
        self.kept_tables = np.zeros(0, np.int64), np.zeros(0, np.int64), np.ones((0, self.longest), np.float32), np.zeros((0, self.longest), np.int32)
        self.met: set[bytes] = set()

    @staticmethod
    def _hash_all(texts: list[str]) -> np.ndarray:
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(t) for t in texts])
        return _span_hashes(_prefix(points), ends - [len(t) for t in texts], ends)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of span hashes, -1 where there is none."""
        slots = (hashes >> self.shift).astype(np.int64)
        held = self.keys[slots]
        out = np.where(held == hashes, self.ids[slots], -1)
        open_ = np.flatnonzero((held != hashes) & (held != _EMPTY))
        while len(open_):
            slots[open_] = (slots[open_] + 1) % len(self.keys)
            held = self.keys[slots[open_]]
            right = held == hashes[open_]
            out[open_[right]] = self.ids[slots[open_[right]]]
            open_ = open_[~right & (held != _EMPTY)]
        return out

    def build(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First node and length of each unit; cumulative chances and ids of the pieces that end at each node, by length."""
        order = np.argsort(np.fromiter(map(len, units), np.int64, len(units)), kind="stable")[::-1].tolist()
        lengths = np.array([len(units[i]) for i in order])
        points = np.frombuffer("".join([units[i] for i in order]).encode("utf-32-le"), "<u4")
        firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        bases = firsts + np.arange(len(units))  # a unit has one node more than characters
        inside = np.arange(len(points)) - np.repeat(firsts, lengths)
        node = np.arange(len(points)) + np.repeat(np.arange(len(units)), lengths) + 1
        prefix = _prefix(_marked(points))
        span = self.longest
        nodes = len(points) + len(units)
        ids = np.full((nodes, span), -1, np.int32)
        weight = np.zeros((nodes, span))
        for size in range(1, span + 1):
            at = np.flatnonzero(inside >= size - 1)
            if not len(at):
                break
            found = self._find(_span_hashes(prefix, at - (size - 1), at + 1))
            ids[node[at], size - 1] = found
            hit = np.flatnonzero(found >= 0)
            weight[node[at[hit]], size - 1] = self.weights[found[hit]]
        bare = np.flatnonzero(ids[node, 0] < 0)
        ids[node[bare], 0] = _BY_BYTES + points[bare].astype(np.int32)
        weight[node[bare], 0] = _BYTES
        chance = np.ones((nodes, span), np.float32)
        alpha = np.zeros(nodes + span)
        alpha[bases] = 1.0
        back = np.arange(1, span + 1)
        shorter = -lengths  # ascending
        for step in range(1, int(lengths[0]) + 1 if len(lengths) else 0):
            own = bases[: int(np.searchsorted(shorter, -step, side="right"))] + step
            reach = min(step, span)  # no piece begins before its unit
            total = alpha[own[:, None] - back[:reach]]
            total *= weight[own, :reach]
            np.cumsum(total, axis=1, out=total)
            alpha[own] = last = total[:, -1].copy()
            total /= last[:, None]
            chance[own, :reach] = total
            if step % 8 == 0:  # only ratios within a piece's reach matter
                window = own[:, None] - np.arange(min(span, step + 1))
                alpha[window] /= alpha[own][:, None]
        place = np.empty(len(units), np.int64)
        place[order] = np.arange(len(units))
        return bases[place], lengths[place], chance, ids

    def sample(self, texts: list[bytes], keys: list[int | None], seed: int = 0) -> list[np.ndarray]:
        """Sampled ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        group: list[tuple[int, int, list[bytes]]] = []  # text, number of its first unit, units without their first space
        held = 0
        rows = np.array([_row_hash(k, seed) for k in keys], dtype=_U64)
        for at, text in enumerate(texts):
            if not text:
                continue
            plain = b"  " not in text and not text.startswith(b" ") and not text.endswith(b" ")
            units = text.split(b" ") if plain else [u[1:] for u in _UNIT.findall(b" " + text)]
            if len(text) <= GROUP_BYTES and (len(text) <= LONG_UNIT or max(map(len, units)) <= LONG_UNIT):
                group.append((at, 0, units))
                held += len(text)
            else:
                low = 0
                for number, unit in enumerate(units):
                    if len(unit) > LONG_UNIT or held > GROUP_BYTES:
                        group.append((at, low, units[low:number]))
                        self._sample_group(group, rows, out)
                        group, held, low = [], 0, number
                    if len(unit) > LONG_UNIT:
                        out[at].append(self._sample_long(" " + unit.decode(), _states(rows[at : at + 1], np.array([number]))[0]))
                        low = number + 1
                    else:
                        held += len(unit) + 1
                group.append((at, low, units[low:]))
            if held > GROUP_BYTES:
                self._sample_group(group, rows, out)
                group, held = [], 0
        self._sample_group(group, rows, out)
        return [parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32) for parts in out]

    def _lattices(self, flat: list[bytes]) -> tuple[np.ndarray, ...]:
        """Number of each unit's lattice; the lattices as ``build`` gives them, units that came before not built again."""
        distinct = dict.fromkeys(flat)
        fresh = [w for w in distinct if w not in self.kept]
        index = self.kept | {w: i for i, w in enumerate(fresh, len(self.kept))}
        unit = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
        held = self.kept_tables
        if not fresh:
            return unit, *held
        bases, lengths, chance, ids = self.build([" " + w.decode() for w in fresh])
        room = KEPT_NODES - len(held[2])
        tables = np.append(held[0], bases + len(held[2])), np.append(held[1], lengths), np.concatenate([held[2], chance]), np.concatenate([held[3], ids])
        # Units of two groups in a row are kept while there is room.
        again = [i for i, w in enumerate(fresh) if w in self.met] if room > 0 else []
        if again:
            again = np.array(again)[np.cumsum(lengths[again] + 1) <= room]
            nodes = np.repeat(bases[again] - np.append(0, np.cumsum(lengths[again] + 1))[:-1], lengths[again] + 1) + np.arange(int((lengths[again] + 1).sum()))
            firsts = np.append(0, np.cumsum(lengths[again] + 1))[:-1] + len(held[2])
            self.kept |= {fresh[i]: number for number, i in enumerate(again.tolist(), len(self.kept))}
            self.kept_tables = np.append(held[0], firsts), np.append(held[1], lengths[again]), np.concatenate([held[2], chance[nodes]]), np.concatenate([held[3], ids[nodes]])
        self.met = set(distinct) if room > 0 else set()
        return unit, *tables

    def _sample_group(self, group: list[tuple[int, int, list[bytes]]], rows: np.ndarray, to: list[list[np.ndarray]]) -> None:
        """Append the ids of the group's units to those of their texts."""
        flat = [w for *_, units in group for w in units]
        if not flat:
            return
        counts = np.array([len(units) for *_, units in group])
        unit, bases, lengths, chance, ids = self._lattices(flat)
        numbers = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts - np.array([first for _, first, _ in group]), counts)
        state = _states(np.repeat(rows[[at for at, *_ in group]], counts), numbers)
        start = bases[unit]
        now = start + lengths[unit]
        active = np.arange(len(flat))
        pieces = np.zeros(len(flat), np.int64)
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        step = 0
        while len(active):
            step += 1
            at = now[active]
            draw = (mix(state[active] + _U64(step * 0x8CB92BA72F3D8DD7 & (1 << 64) - 1)) >> _U64(40)).astype(np.float32) / np.float32(1 << 24)
            size = np.minimum((chance[at] <= draw[:, None]).sum(axis=1), self.longest - 1)
            drawn.append((active, ids[at, size]))
            now[active] = at - size - 1
            pieces[active] += 1
            active = active[now[active] > start[active]]
        ends = np.cumsum(pieces)
        out = np.empty(int(ends[-1]), np.int32)
        for number, (own, found) in enumerate(drawn):
            out[ends[own] - 1 - number] = found
        out, cuts = self._spell(out, np.append(0, ends)[np.append(0, np.cumsum(counts))])
        for (at, *_), a, b in zip(group, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            to[at].append(out[a:b])

    def _sample_long(self, unit: str, state: np.uint64) -> np.ndarray:
        """Ids of one unit of any length."""
        length, span = len(unit), self.longest
        sizes = np.zeros(length, np.uint8)
        ids = np.zeros(length, np.int32)
        sums = [1.0]  # of the last places, the latest last
        for low in range(0, length, WINDOW):
            high = min(length, low + WINDOW)
            before = min(low, span - 1)
            points = np.frombuffer(unit[low - before : high].encode("utf-32-le"), "<u4")
            prefix = _prefix(_marked(points))
            ends = np.arange(before + 1, len(points) + 1)
            found = np.full((high - low, span), -1, np.int32)
            for size in range(1, span + 1):
                at = np.flatnonzero(ends >= size)
                found[at, size - 1] = self._find(_span_hashes(prefix, ends[at] - size, ends[at]))
            bare = np.flatnonzero(found[:, 0] < 0)
            weight = np.where(found >= 0, self.weights[found], 0.0)
            found[bare, 0] = _BY_BYTES + points[before:][bare].astype(np.int32)
            weight[bare, 0] = _BYTES
            place, size = np.nonzero(found >= 0)
            edges = np.searchsorted(place, np.arange(high - low + 1)).tolist()
            steps, weights = size.tolist(), weight[place, size].tolist()
            number = np.arange(low, high).astype(_U64)
            draws = ((mix(state + (number + _U64(1)) * _U64(0x8CB92BA72F3D8DD7)) >> _U64(11)).astype(np.float64) / (1 << 53)).tolist()
            chosen = []
            for at in range(high - low):
                first, last = edges[at], edges[at + 1]
                ways = [sums[-1 - steps[e]] * weights[e] for e in range(first, last)]
                total = sum(ways)
                left = draws[at] * total
                pick = last - 1
                for e, way in enumerate(ways, first):
                    left -= way
                    if left < 0:
                        pick = e
                        break
                chosen.append(steps[pick])
                sums.append(total)
                if not 1e-100 < total < 1e100:  # only ratios matter
                    sums = [s / total for s in sums[-span:]]
                elif len(sums) > 4 * span:
                    del sums[:-span]
            sizes[low:high] = chosen
            ids[low:high] = found[np.arange(high - low), sizes[low:high]]
        ends_at, at, back = [], length, sizes
        while at > 0:
            ends_at.append(at - 1)
            at -= int(back[at - 1]) + 1
        out = ids[np.array(ends_at[::-1])]
        return self._spell(out, np.array([0, len(out)]))[0]

    def _spell(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the ids of their bytes."""
        marked = np.flatnonzero(ids >= _BY_BYTES)
        points = ids[marked] - _BY_BYTES
        sizes = np.ones(len(ids), np.int64)
        sizes[marked] += (points >= 0x80).astype(int) + (points >= 0x800) + (points >= 0x10000)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(int(ends[-1]), np.int32)
        out[ends[:-1]] = ids
        for point in np.unique(points).tolist():
            where = ends[marked[points == point]]
            for i, value in enumerate(chr(point).encode()):
                out[where + i] = self.byte_ids[value]
        return out, ends[cuts]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of its pieces."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.spelled[np.arange(int(ends[-1])) + np.repeat(self.begins[ids] - ends + sizes, sizes)].tobytes()[1:].decode()


def _marked(points: np.ndarray) -> np.ndarray:
    """What is looked up: spaces as marks; the mark's own character is text, for which there are bytes."""
    out = points.copy()
    out[points == ord(MARK)] = 0
    out[points == 32] = ord(MARK)
    return out


def _states(rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return mix(rows + numbers.astype(_U64) * _U64(0xD1B54A32D192ED03))


def _prefix(points: np.ndarray) -> np.ndarray:
    power, _ = _tables(len(points) + 1)
    return np.concatenate([[_EMPTY], np.cumsum((points.astype(_U64) + _U64(1)) * power[: len(points)], dtype=_U64)])


def _span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inverse = _tables(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts]) | _U64(1)


def _row_hash(key: int | None, seed: int) -> int:
    low = (1 << 64) - 1
    mixed = ((0 if key is None else key * 2 + 1) * 0x9E3779B97F4A7C15 + seed * 0xC2B2AE3D27D4EB4F) & low
    return (mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9 & low


_LATTICES: dict[tuple[str, float], Lattice] = {}


def lattice(model: str, alpha: float = ALPHA) -> Lattice:
    if (model, alpha) not in _LATTICES:
        _LATTICES[model, alpha] = Lattice(model, alpha)
    return _LATTICES[model, alpha]


def encode(docs: DataFrame, model: str | None = None, alpha: float = ALPHA, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and the sampled ids as little-endian 32-bit integers."""
    path = model or default_model()

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        own = lattice(path, alpha)
        for batch in batches:
            low = held = 0
            for at, text in enumerate(batch["text"]):
                if held and held + len(text) > GROUP_BYTES:
                    yield _encoded(own, batch, low, at, seed)
                    low, held = at, 0
                held += len(text)
            yield _encoded(own, batch, low, len(batch["text"]), seed)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
    return map_batches(rows, work, "doc_id long, ids binary")


def _encoded(own: Lattice, batch: dict, low: int, high: int, seed: int) -> dict:
    ids = own.sample(batch["text"][low:high], batch["doc_id"][low:high], seed)
    return {"doc_id": batch["doc_id"][low:high], "ids": [i.astype("<i4").tobytes() for i in ids]}


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Rows of ``encode`` as doc_id, ids and their text."""
    path = model or default_model()

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        own = lattice(path)
        for batch in batches:
            texts = [own.decode(np.frombuffer(i, "<i4")) for i in batch["ids"]]
            yield {"doc_id": batch["doc_id"], "ids": batch["ids"], "text": texts}

    return map_batches(encoded, work, "doc_id long, ids binary, text string")


def op8(docs: DataFrame) -> DataFrame:
    """The query's digest: pieces of each row, and the text decoded from them."""
    rows = decode(encode(docs))
    return rows.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("text_sha256"))
