"""Maximal periodic runs of words, by the method of Kolpakov and Kucherov.

A run is a stretch of consecutive words with smallest period q and at least
``max(shortest, 2 * q)`` words that no neighbouring word extends keeping
period q.  A text's runs are found in time linear in its words:

1. Words that occur once in the text lie in no run and cut it into stretches;
   each stretch of at least ``shortest`` words goes on by itself.
2. A suffix automaton of the stretch gives its Lempel-Ziv factors, each the
   longest beginning of the rest that starts at an earlier word too (it may
   overlap itself), or one new word.
3. A run that touches the border of two factors, with its last word in the
   right one, has a period under both lengths' sum and begins at most twice
   the left length and once the right one before the border (Main); longest
   common extensions by Z-functions in that window give all of them.  As a run
   has ``shortest`` words, borders of shorter factors are left out.
4. Runs strictly inside a factor are copied from its earlier occurrence.

Defined results: a null or blank text has no words and no run.  Texts of any
length are taken whole, each in one task, in memory in proportion to the words
of the longest stretch.  Rows are independent: repeated rows and ids give
equal rows, a null id is kept.  ``row`` of ``with_runs`` holds all columns of
the input, so names clash with nothing.  An empty table gives an empty result.
"""

from __future__ import annotations

import gc
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, whole_text

#: Words of the shortest run that counts.
SHORTEST = 12

#: First word, word after the last, smallest period.
Run = tuple[int, int, int]


def factors(x: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, length, start of an earlier occurrence or -1) of the Lempel-Ziv factors."""
    # The automaton: a state's transitions, link, length, and last word of its first occurrence.
    goes: list[dict[int, int]] = [{}]
    link, length, first = [-1], [0], [-1]
    last = 0
    for k, word in enumerate(x):
        own = len(goes)
        goes.append({})
        length.append(k + 1)
        first.append(k)
        state = last
        while state >= 0 and word not in (go := goes[state]):
            go[word] = own
            state = link[state]
        last = own
        if state < 0:
            link.append(0)
            continue
        other = go[word]
        if length[other] == length[state] + 1:
            link.append(other)
            continue
        copy = own + 1
        link.append(copy)
        goes.append(goes[other].copy())
        length.append(length[state] + 1)
        first.append(first[other])
        link.append(link[other])
        link[other] = copy
        while state >= 0 and (go := goes[state]).get(word) == other:
            go[word] = copy
            state = link[state]
    at, n = 0, len(x)
    while at < n:
        state, k, seen = 0, at, -1
        while k < n:
            state = goes[state][x[k]]
            if first[state] >= k:
                break
            seen = first[state]
            k += 1
        if k == at:
            yield at, 1, -1
            at += 1
        else:
            yield at, k - at, seen - (k - at) + 1
            at = k


def z_function(x: list[int]) -> list[int]:
    """How far the list from each place agrees with its own beginning; the whole length at 0."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    low = high = 0
    for i in range(1, n):
        k = min(z[i - low], high - i) if i < high else 0
        if k == 0 or i + k >= high:
            while i + k < n and x[k] == x[i + k]:
                k += 1
            if i + k > high:
                low, high = i, i + k
        z[i] = k
    return z


def _at_border(x: list[int], border: int, before: int, after: int, found: dict[tuple[int, int], int], shortest: int) -> None:
    """Add the runs that touch ``border``, between factors of these lengths, and end in the right one."""
    start = max(0, border - 2 * before - after)
    stop = border + after
    left, right = x[start:border], x[border:stop]
    back = left[::-1]
    nl, nr = len(left), len(right)
    own_right = z_function(right)
    own_left = z_function(back)
    # Agreement with ``right`` of the places of ``left``, and of its end's beginning with the places of ``right``.
    to_right = z_function([*right, -1, *left, *right])
    to_left = z_function([*back, -1, *right[::-1], *back])
    spans: list[Run] = []
    for period in range(1, min(nr, before + after - 1) + 1):  # a whole period lies right of the border
        ahead = own_right[period] if period < nr else 0
        behind = to_left[nl + 1 + nr - period]
        if ahead + behind >= period and ahead + behind + period >= shortest:
            spans.append((border - behind, border + period + ahead, period))
    for period in range(1, min(nl, before + after - 1) + 1):  # a whole period lies left of it
        ahead = min(to_right[nr + 1 + nl - period], nr)
        behind = own_left[period] if period < nl else 0
        if ahead + behind >= period and ahead + behind + period >= shortest:
            spans.append((border - period - behind, border + ahead, period))
    for low, high, period in spans:
        # What goes on beyond the window is found at another border.
        if (high == stop < len(x) and x[high] == x[high - period]) or (low == start > 0 and x[low - 1] == x[low - 1 + period]):
            continue
        if period < found.get((low, high), period + 1):
            found[low, high] = period


def runs_of_stretch(x: list[int], shortest: int = SHORTEST) -> list[Run]:
    """All runs of a list of non-negative numbers, by start and period."""
    parts = list(factors(x))
    found: dict[tuple[int, int], int] = {}
    before = 0
    for at, length, _ in parts:
        if at and 2 * (before + length) > shortest:
            _at_border(x, at, before, length, found, shortest)
        before = length
    if 2 * before > shortest:
        _at_border(x, len(x), before, 0, found, shortest)
    starting: dict[int, list[tuple[int, int]]] = {}
    for (low, high), period in found.items():
        starting.setdefault(low, []).append((high, period))
    if starting:
        for at, length, earlier in parts:
            if length < shortest + 2:
                continue
            ahead, stop = at - earlier, at + length
            for low in range(at + 1, stop - shortest):
                for high, period in starting.get(low - ahead, ()):
                    if high + ahead < stop and (low, high + ahead) not in found:
                        found[low, high + ahead] = period
                        starting.setdefault(low, []).append((high + ahead, period))
    return sorted(((low, high, period) for (low, high), period in found.items()), key=lambda r: (r[0], r[2]))


def runs(words: list, shortest: int = SHORTEST) -> list[Run]:
    """All runs of a list of words (anything hashable), by start and period."""
    count = Counter(words)
    number = {word: i for i, word in enumerate(count)}
    out: list[Run] = []
    start = 0
    stretch: list[int] = []
    for place, word in enumerate([*words, None]):
        if word is not None and count[word] > 1:
            stretch.append(number[word])
            continue
        if len(stretch) >= shortest:
            out += [(start + low, start + high, period) for low, high, period in runs_of_stretch(stretch, shortest)]
        start = place + 1
        stretch = []
    return out


def collapsed(words: list, found: list[Run]) -> list:
    """The words that stay: of each run its first period, unless another run drops that too."""
    if not found:
        return words
    out, at = [], 0
    for low, high in sorted((low + period, high) for low, high, period in found):
        if low > at:
            out += words[at:low]
        at = max(at, high)
    return out + words[at:]


def unrolled(words: list, doc_id: int | None) -> list:
    """The words as the query takes them: by the id's checksum, a tenth of the texts end in a period."""
    n = len(words)
    mark = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if mark % 10 or not n:
        return words
    rest = mark // 10
    at = rest % n
    period = 1 + (n - at) // (3 + rest % 8)
    return words[:at] + [words[at + k % period] for k in range(n - at)]


_FOUND = "runs array<struct<start:long,length:long,period:long>>, collapsed string"


def with_runs(docs: DataFrame, text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(row, runs, collapsed) of every row: its columns as a struct, its runs by start, its text without repeats.

    ``collapsed`` holds the words that stay, joined by one space.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    schema = f"row {docs.select(row.alias('row')).schema['row'].dataType.simpleString()}, {_FOUND}"

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            lists, texts = [], []
            for text in batch["text"]:
                words = text.split()  # bytes split at ASCII white space only
                found = runs(words, shortest)
                lists.append([{"start": low, "length": high - low, "period": period} for low, high, period in found])
                texts.append(b" ".join(collapsed(words, found)).decode())
            yield {"row": batch["row"], "runs": lists, "collapsed": texts}

    return map_batches(docs.select(row.alias("row"), whole_text(f"`{text_col}`").cast("binary").alias("text")), work, schema)


def _digest(words: list, found: list[Run]) -> tuple:
    best = max(found, key=lambda r: (r[1] - r[0], -r[0], -r[2])) if found else None
    shown = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    listed = "".join(f"{low},{high - low},{period}\n" for low, high, period in found)
    return len(found), *shown, sha256(listed.encode()).hexdigest(), sha256(b" ".join(collapsed(words, found))).hexdigest()


_DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def op11(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The query's digest of every document's runs, after ``unrolled``."""
    names = [column.split()[0] for column in _DIGEST.split(", ")]

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        gc.disable()  # the automaton holds no cycles, and scanning its states costs more than making them
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = unrolled(text.split(), doc_id)
                rows.append((doc_id, *_digest(words, runs(words))))
            yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    return map_batches(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(f"`{text_col}`").cast("binary").alias("text")), work, _DIGEST)
