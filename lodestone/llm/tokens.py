"""Token ids of whole texts with the tokenizers library, one vocabulary file.

``ChunkEncoder`` encodes each distinct run of non-space bytes and keeps its
ids; a text's ids are its runs' ids joined.  That is exact for tokenizers that
drop white space and never merge across it (checked when the file is loaded),
and several times as fast as encoding every text afresh.

The cache holds at most ``CACHE_BYTES``.  When it is full, runs that were met
again since it was last full stay and the others go, so the frequent runs of a
corpus are learned once however many rare ones pass by.  Runs of more than
``LONG_RUN`` bytes are never kept.  Texts are encoded in groups of
``BATCH_BYTES``; a longer one alone, whole, with memory in proportion to it.
"""

from __future__ import annotations

import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

#: Bytes that one worker's cache holds at most, those of a kept run beside its own and its ids', and the longest run kept.
CACHE_BYTES = 160_000_000
RUN_BYTES = 200
LONG_RUN = 256
#: Bytes of texts that are encoded together.
BATCH_BYTES = 2_000_000

#: Letters up to U+012F, composed and lowered one by one, and some ASCII marks after them.
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf])+[!-/:-@\[-`{-~]{0,6}").fullmatch
#: Words that are encoded as one line.
WORDS_A_LINE = 200
#: Distinct marks that are kept.
MARKS = 10_000


def default_vocabulary() -> str:
    """The vocabulary that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    """Encodes UTF-8 texts to little-endian ids of ``dtype``."""

    def __init__(self, vocabulary: str, capacity: int = CACHE_BYTES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.capacity = capacity
        self.cache: dict[bytes, bytes] = {}
        self.again: set[bytes] = set()
        self.held = 0
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_run = self._drops_space()
        self.lowers = self._library("Zebra CAKE") == self._library("zebra cake")
        # Plain runs need neither the normaliser nor the pattern: one word each, ended by a word-end piece.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(size + 1, bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        for piece, number in self.tokenizer.get_vocab().items():
            self.ends[number] = bool(suffix) and piece.endswith(suffix)
        self.marks: dict[bytes, bytes] = {}
        probe = [w.encode() for w in ("Zebra", "straße,", "ÉLAN.", "naïve...", "ĉapo')", "įlanka,***", "it's'", "a_-_b")]
        probe = list(filter(_PLAIN, probe))
        self.simple = self.lowers and self.by_run and bool(self.ends.any())
        self.simple = self.simple and list(self._learn_plain(probe).values()) == [self._library(w.decode()) for w in probe]

    def _drops_space(self) -> bool:
        whole = self._library("Aa bb's\n cc1,.. \t\x0b\x0c\rdd é Éx")
        return whole == b"".join(map(self._library, "Aa bb's cc1,.. dd é Éx".split(" ")))

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _learn(self, runs: set[bytes]) -> dict[bytes, bytes]:
        plain = list(filter(_PLAIN, runs)) if self.simple else []
        odd = list(runs.difference(plain))
        found = self._learn_plain(plain) if plain else {}
        for run, own in zip(odd, self.tokenizer.encode_batch_fast([r.decode() for r in odd], add_special_tokens=False), strict=True):
            found[run] = np.array(own.ids, dtype=self.dtype).tobytes()
        return found

    def _learn_plain(self, runs: list[bytes]) -> dict[bytes, bytes]:
        stems = [run.rstrip(_MARKS) for run in runs]
        words = list(dict.fromkeys(stems))
        lines = [b" ".join(words[low : low + WORDS_A_LINE]).decode().lower() for low in range(0, len(words), WORDS_A_LINE)]
        found = self.words.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.array(line.ids, dtype=self.dtype) for line in found])
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
        if len(cuts) != len(words):
            raise ValueError("a word did not end in one word-end piece")
        flat = ids.tobytes()
        of = dict(zip(words, [flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))
        mark = self._mark
        return {run: of[stem] if len(run) == len(stem) else of[stem] + mark(run[len(stem) :]) for run, stem in zip(runs, stems, strict=True)}

    def _mark(self, mark: bytes) -> bytes:
        if mark not in self.marks:
            if len(self.marks) >= MARKS:
                self.marks.clear()
            self.marks[mark] = self._library(mark.decode())
        return self.marks[mark]

    def encode(self, texts: list[bytes | str | None]) -> list[bytes]:
        """Ids of each text (as UTF-8 or str) as bytes of ``dtype``; null counts as empty."""
        out: list[bytes] = []
        group: list[bytes] = []
        held = 0
        for text in texts:
            raw = text.encode() if isinstance(text, str) else text or b""
            if group and held + len(raw) > BATCH_BYTES:
                out += self._encode(group)
                group, held = [], 0
            group.append(raw)
            held += len(raw)
        return out + self._encode(group)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_run:
            found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [np.array(x.ids, dtype=self.dtype).tobytes() for x in found]
        split = [self._lowered(t).split() for t in texts]
        runs = set().union(*split)
        own = dict(zip(runs, map(self.cache.get, runs), strict=True))
        fresh = {run for run, ids in own.items() if ids is None}
        self.again.update(runs.difference(fresh))
        own.update(found := self._learn(fresh))
        get = own.__getitem__
        out = [b"".join(map(get, parts)) for parts in split]
        for run in fresh:
            if len(run) > LONG_RUN:
                del found[run]
        self.cache.update(found)
        self.held += _size(found)
        if self.held > self.capacity:
            kept = {run: self.cache[run] for run in self.again}
            self.held = _size(kept)
            if self.held > self.capacity // 2:
                kept, self.held = {}, 0
            self.cache, self.again = kept, set()
        return out

    def _lowered(self, text: bytes) -> bytes:
        # A special token counts as written, so a text that would have one only when lowered stays as it is.
        if not self.lowers:
            return text
        low = text.lower()
        return text if any(s in low for s in self.specials) else low


def _size(found: dict[bytes, bytes]) -> int:
    return RUN_BYTES * len(found) + sum(map(len, found)) + sum(map(len, found.values()))


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(vocabulary: str) -> ChunkEncoder:
    """This worker's encoder; Python workers are reused between tasks."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = ChunkEncoder(vocabulary)
    return _ENCODERS[vocabulary]
