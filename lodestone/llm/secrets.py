"""Secret scan: fixed patterns plus assignment-aware lexing.

The lexer reads source and configuration syntax as statements that give names
a value: around each ``=``, ``:=``, ``=>`` and ``:``, of ``#define``, ``ENV``
and the like, and of elements in angle brackets.  A value is an expression of
literals and names, joined by an operator or side by side, over several lines
in parentheses; literals may be triple-quoted or block scalars of YAML.  A
name's value is kept, so a constant that is used under a sensitive name is
found where its literal was written, before or after its use.  A name's words
give a sensitivity (a key such as ``value`` has that of the key it is under),
a value's length, alphabet and entropy a strength; their product must reach
``THRESHOLD``.

Spans are (kind, start, end) in code points, end exclusive.  Base kinds are
``assign``, ``access`` and ``hex``; the lexer adds ``literal`` for a value that
no base span covers whole.  Of ``name: type = value`` and ``name type = value``
the name is a target too, whatever the type.

Defined results: null or empty texts have no spans; ids, repeated rows and
other columns don't matter.  Of several definitions of a name the last one
before a use counts, else the first after it.  Texts, names, blanks and values
have no greatest length: the time is linear, as joined values are shared, not
copied, each with counts of all its characters, its beginning and its end, and
an expression in a skipped comment ends with the comment's line.

Further targets: all of ``a, b = x, y``, arrays (``name[] =``), the first
argument of a call that is a value, setters (``setName(x)``), ``value`` after
``name`` or ``key``, and passwords of addresses (``scheme://user:x@host``).
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, whole_text

Span = tuple[str, int, int]

# The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "literal")

#: A text without any of these has no ``assign`` match.
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Sensitivity of a name's words.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "auth": 0.6, "bearer": 0.8,
    "signature": 0.4, "salt": 0.5, "key": 0.45, "cookie": 0.5, "session": 0.4, "dsn": 0.6,
}
THRESHOLD = 0.6

_SEPARATOR = re.compile(r"(?<![=!<>:+\-*/])(?::=|=>|=(?![=>])|:(?![:/]))")
#: Statements that name a value without a separator.
_DEFINE = re.compile(r"(?m)^[\x20\t]*(?:\#[\x20\t]*define|setenv|ENV|ARG)[\x20\t]+([A-Za-z_][A-Za-z0-9_.\-]*)[\x20\t]+")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:\-]*)(?:\s[^<>]*)?>(?:\s*<!\[CDATA\[)?([^<>]*)(?:\]\]>\s*)?</")
_SETTER = re.compile(r"(?<![A-Za-z0-9])(?:set|with)_?([A-Za-z][A-Za-z0-9_]*)[\x20\t]*\([\x20\t]*")
_ADDRESS = re.compile(r"""://[^\s:/@"'<>]*:([^\s@/"'<>]+)@""")
_ARRAY = re.compile(r"\[[0-9]*\]")
_QUOTED = re.compile(r"""(?s)"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'""")
_BARE = re.compile(r"[A-Za-z0-9+/_.=\-$@!%^&*~]+")
_LONG_QUOTES = ('"""', "'''", "`")
_BLANKS, _BLANKS_LINES = re.compile(r"[\x20\t]*"), re.compile(r"(?:[\x20\t\r\n\\]|//[^\n]*\n|\#[^\n]*\n)*")
_JOIN = re.compile(r"(?:\+|\.\.?|&)(?=[\x20\t\r\n(\"'`A-Za-z_$])")
_REFERENCE = re.compile(r"\$?[A-Za-z_][A-Za-z0-9_.]*\Z")
_VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_.]*)[^}\n]*\}")
_BLOCK = re.compile(r"[\x20\t]*[|>][+\-0-9]*[\x20\t]*\r?\n")
_LINE = re.compile(r"[^\n]*\n?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_TYPE_NAME = re.compile(r"""["']?[A-Za-z_][A-Za-z0-9_.:]*["']?""")
_TYPE_MARKS = re.compile(r"(?:mut|dyn|const|final|readonly|unsigned|signed|'[a-z_]+)\Z")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
#: As the word before a separator these are types, so the word before them is the name.
_TYPE_WORDS = frozenset("str string text char varchar nvarchar byte bytes rune int int32 int64 long float double bool boolean any object".split())
#: Keys that stand for the key that they are under.
_NEUTRAL = frozenset("value values data default plain raw content text literal current string stringdata".split())
#: Keys whose value names what a following ``value`` holds.
_NAMING = frozenset(("name", "key"))
_PLACEHOLDER = re.compile(r"(?i)(?:change.?me|your|example|placeholder|todo|dummy|(?:none|null|true|false)\Z)")
_BRACED = (("<", ">"), ("${", "}"), ("{{", "}}"))
_FILLERS = tuple(map(frozenset, ("xX", "*", ".", "-", "_")))
_PHRASE_PART = re.compile(r"([^\W\d_]*)((?:[ \-_][^\W\d_]{2,})*)(?:[ \-_]([^\W\d_]?))?\Z")
#: Padding, which counts as one character, so a key can't hide in it.
_PADDING = re.compile(r"(?s)(.)\1{3,}")
#: What placeholders begin with is no longer than this.
HEAD = 16
#: Counts are scaled by this where they might lose digits; only shares matter.
_GREAT = 2.0**50


def base_matches(text: str) -> list[tuple[Span, int]]:
    """Matches of the fixed patterns that pass their length rules, and where the secret itself begins."""
    found: list[tuple[Span, int]] = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(("assign", *m.span()), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(("access", *m.span()), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(("hex", *m.span()), m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: _order(f[0]))


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def name_weight(name: str) -> float:
    """Sensitivity of a target name from its words and adjacent word pairs."""
    words = [w.lower() for w in _WORDS.findall(name)]
    pairs = [a + b for a, b in zip(words, words[1:], strict=False)]
    return max((NAME_WEIGHTS.get(w, 0.0) for w in words + pairs), default=0.0)


class Phrase(NamedTuple):
    """Words and single gaps between them: letters (two for more) before the first gap and after the last, and gaps."""

    lead: int
    trail: int
    gaps: int

    @classmethod
    def of(cls, text: str) -> Phrase | None:
        """None where the text can't be part of a phrase."""
        if (found := _PHRASE_PART.match(text)) is None:
            return None
        lead, gaps = min(len(found[1]), 2), sum(map(text.count, " -_"))
        return cls(lead, lead if not gaps else 2 if found[3] is None else len(found[3]), gaps)

    def __add__(self, other: Phrase) -> Phrase | None:
        middle = min(self.trail + other.lead, 2)
        if self.gaps and other.gaps and middle < 2:
            return None
        return Phrase(self.lead if self.gaps else middle, other.trail if other.gaps else middle, self.gaps + other.gaps)


class Stats(NamedTuple):
    """What a value is judged by; the stats of joined values follow from theirs."""

    counts: dict[str, float]
    kinds: int
    head: str
    tail: str
    spaced: bool
    phrase: Phrase | None

    @classmethod
    def of(cls, counts: Counter, head: str, tail: str, phrase: Phrase | None) -> Stats:
        kinds = sum(1 << i for i, test in enumerate((str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum())) if any(map(test, counts)))
        return cls(_folded(counts), kinds, head, tail, any(map(str.isspace, counts)), phrase)

    @classmethod
    def joined(cls, parts: list[Stats]) -> Stats:
        counts: dict[str, float] = {}
        phrase: Phrase | None = Phrase(0, 0, 0)
        for part in parts:
            for c, n in part.counts.items():
                counts[c] = counts.get(c, 0.0) + n
            phrase = phrase + part.phrase if phrase is not None and part.phrase is not None else None
        if sum(counts.values()) > _GREAT:
            counts = {c: n / _GREAT for c, n in counts.items()}
        head = tail = ""
        kinds, spaced = 0, False
        for part in parts:
            head = head if len(head) >= HEAD else (head + part.head)[:HEAD]
            tail = (tail + part.tail)[-2:]
            kinds |= part.kinds
            spaced |= part.spaced
        return cls(counts, kinds, head, tail, spaced, phrase)

    def placeholder(self) -> bool:
        if any(self.counts.keys() <= filler for filler in _FILLERS):
            return True
        return "\n" not in self.counts and (_PLACEHOLDER.match(self.head) is not None or any(self.head.startswith(a) and self.tail.endswith(b) for a, b in _BRACED))


class Value:
    """A literal, or literals and other values joined; joins share what they join."""

    __slots__ = ("start", "end", "quoted", "parts", "length", "_text", "_stats")

    def __init__(self, start: int, end: int, quoted: bool, text: str, stats: Stats | None = None):
        self.start, self.end, self.quoted, self.parts = start, end, quoted, ()
        self.length, self._text, self._stats = end - start, text, stats

    @classmethod
    def joined(cls, parts: list[Value]) -> Value:
        parts = list(dict.fromkeys(parts))
        if len(parts) == 1:
            return parts[0]
        out = cls.__new__(cls)
        out.start = out.end = -1
        out.parts, out.quoted = tuple(parts), any(p.quoted for p in parts)
        out.length = min(sum(p.length for p in parts), 1 << 30)  # lengths over 40 are judged alike
        out._text, out._stats = "", Stats.joined([p.stats for p in parts])
        return out

    @property
    def stats(self) -> Stats:
        if self._stats is None:
            text = self._text
            self._stats = Stats.of(Counter(_PADDING.sub(r"\1", text)), text[:HEAD], text[-2:], Phrase.of(text))
        return self._stats

    def strength(self, phrase: bool = False) -> float:
        """0 to 1: how much this looks like generated key material or, for names that may hold one, a phrase."""
        if self.length < (8 if self.quoted else 12):
            return 0.0
        stats = self.stats
        if phrase and self.quoted and stats.phrase is not None and stats.phrase.gaps >= 3 and stats.phrase.lead == stats.phrase.trail == 2:
            return 1.0
        if stats.spaced or stats.placeholder():
            return 0.0
        total = sum(stats.counts.values())
        entropy = -sum(n / total * math.log2(n / total) for n in stats.counts.values() if n)
        kinds = stats.kinds.bit_count()
        if kinds < 2 or not stats.kinds & 4 or entropy < 2.5:
            return 0.0
        return min(1.0, 0.25 * (kinds - 1) + entropy / 5 + min(self.length, 40) / 100)

    def literals(self, seen: set[Value]) -> Iterator[tuple[int, int]]:
        """Spans of the literals that no call with the same ``seen`` gave before."""
        waiting = [self]
        while waiting:
            value = waiting.pop()
            if value not in seen:
                seen.add(value)
                waiting.extend(value.parts)
                if value.end > value.start:
                    yield value.start, value.end


def _folded(counts: Counter) -> dict[str, float]:
    """Characters above Latin-1 as 64 of them, so joins cost the same whatever they join."""
    out: dict[str, float] = {}
    for c, n in counts.items():
        own = c if c < "Ā" else chr(0x400 + ord(c) % 64)
        out[own] = out.get(own, 0.0) + n
    return out


def value_strength(value: str, quoted: bool) -> float:
    return Value(0, len(value), quoted, value).strength()


def _before_blanks(text: str, at: int, low: int) -> int:
    while at > low and text[at - 1] in " \t":
        at -= 1
    return at


def _name_before(text: str, at: int, low: int) -> tuple[str, int] | None:
    """The name that ends at ``at``, but for a quote and a bracket, and its start."""
    if at > low and text[at - 1] == "]" and (opened := text.rfind("[", max(low, at - 12), at)) > low and _ARRAY.fullmatch(text, opened, at):
        at = opened
    for _ in range(2):
        if at > low and text[at - 1] in "\"']":
            at -= 1
    end = at
    while at > low and text[at - 1] in _NAME_CHARS:
        at -= 1
    while at < end and not (text[at].isalpha() or text[at] == "_"):
        at += 1
    return (text[at:end], at) if at < end else None


def _names_before(text: str, at: int, low: int) -> list[str]:
    """Names that commas separate from the one that begins at ``at``, in order."""
    names: list[str] = []
    while True:
        at = _before_blanks(text, at, low)
        if at <= low or text[at - 1] != ",":
            return names[::-1]
        at = _before_blanks(text, at - 1, low)
        if at <= low or text[at - 1] not in _NAME_CHARS or (found := _name_before(text, at, low)) is None:
            return names[::-1]
        names.append(found[0])
        at = found[1]


def _stripped(text: str, start: int, end: int) -> tuple[int, int]:
    own = text[start:end]
    return (start + len(own) - len(own.lstrip()), end - len(own) + len(own.rstrip())) if own.strip() else (start, start)


def _is_type(text: str) -> bool:
    """One type, or several joined by | or &, with marks and bracketed arguments."""
    flat, depth = [], 0
    for c in text:
        depth += (c in "[<(") - (c in "])>")
        if c == "\n" or depth < 0:
            return False
        if not depth and c not in "])>":
            flat.append(" " if c in "*?!" else c)
    parts = [p.split() for p in "".join(flat).replace("&", "|").split("|")]
    words = [p for p in parts if p]
    return depth == 0 and bool(words) and all(_TYPE_NAME.fullmatch(p[-1]) and all(map(_TYPE_MARKS.match, p[:-1])) for p in words)


def _declared(text: str, at: int, low: int) -> tuple[str | None, bool]:
    """The name before a type that ends at ``at``, and whether that surely is one."""
    sure = at > low and text[at - 1] in ")]>"
    if sure:  # VARCHAR(50), Array<String>
        at = _before_brackets(text, at, low)
    end = at
    while at > low and (text[at - 1].isalnum() or text[at - 1] in "_."):
        at -= 1
    sure |= text[at:end].lower() in _TYPE_WORDS
    if at == end:
        return None, False
    while at > low and text[at - 1] in "*&])":  # *string, []byte
        at = _before_brackets(text, at, low) if text[at - 1] in "])" else at - 1
    gap = _before_blanks(text, at, low)
    name = _name_before(text, gap, low) if gap < at else None
    return (name[0] if name and name[1] + len(name[0]) == gap else None), sure


def _before_brackets(text: str, at: int, low: int) -> int:
    depth = 0
    for i in range(at - 1, low - 1, -1):
        depth += (text[i] in ")]>") - (text[i] in "([<")
        if text[i] == "\n":
            break
        if not depth:
            return i
    return low


class Lexer:
    """The assignments of a text: (names, weight, terms) in order.

    A term is a literal's ``Value`` or (name, literal) of a word that may stand
    for another value.  Every expression is read once; a separator within a
    literal reads no further than that literal, so the time is linear.
    """

    def __init__(self, text: str):
        self.text = text
        self.inside: list[int] = []  # ends of the literals that enclose the place
        self.bare = (0, 0)  # the last run of bare characters
        self.counted = (0, 0)  # the last one with separators, and what is in it
        self.counts: Counter = Counter()
        self.skipped = self.line_end = 0  # up to where comments were skipped, and the line end there
        self.statements: list[tuple[list[str], float, bool, list]] = []
        self.keys: list[tuple[int, str]] = []  # keys of the lines that enclose this one, by indentation
        self.last_name = ""

    def read(self) -> list[tuple[list[str], float, bool, list]]:
        text = self.text
        if "=" in text or ":" in text:
            self._separators()
        if "define" in text or "setenv" in text or "ENV" in text or "ARG" in text:
            self.skipped = self.line_end = 0
            for found in _DEFINE.finditer(text):
                self.inside.clear()
                self._note([found[1]], "", self._terms(found.end(), self._limit(found.end(), len(text))))
        if "</" in text:
            for found in _ELEMENT.finditer(text):
                self._literal_of([found[1]], *_stripped(text, *found.span(2)))
        if "set" in text or "with" in text:
            for found in _SETTER.finditer(text):
                if (term := self._literal(found.end(), len(text))) is not None:
                    self._literal_of([found[1]], *term[:2])
        if "://" in text:
            for found in _ADDRESS.finditer(text):
                self._literal_of(["password"], *found.span(1))
        return self.statements

    def _literal_of(self, names: list[str], start: int, end: int) -> None:
        if start < end:
            self._note(names, "", [Value(start, end, True, self.text[start:end])])

    def _limit(self, at: int, limit: int) -> int:
        """Where an expression at ``at`` must end: in comments that were skipped, with the line."""
        if at >= self.skipped:
            return limit
        if at > self.line_end:
            end = self.text.find("\n", at)
            self.line_end = end if end >= 0 else len(self.text)
        return min(limit, self.line_end)

    def _separators(self) -> None:
        text = self.text
        colon: tuple[str, int] | None = None
        low = 0
        seen: set[str] = set()
        naming = ""  # what the statement before this one names
        for separator in _SEPARATOR.finditer(text):
            last, low = low, separator.end()
            while self.inside and self.inside[-1] <= separator.start():
                self.inside.pop()
            limit = self._limit(low, self.inside[-1] if self.inside else len(text))
            typed, colon = colon, None
            stop = _before_blanks(text, separator.start(), last)
            target = _name_before(text, stop, last)
            names = [target[0]] if target else []
            under = ""
            if separator[0] == ":":
                if target:
                    colon = (target[0], separator.end())
                    under = self._under(target[0], target[1], last)
            elif typed and separator[0] in ("=", ":=") and _is_type(text[typed[1] : separator.start()]):
                names = [typed[0]]
            else:
                name, sure = _declared(text, stop, last)
                if name and (sure or name not in seen):
                    names.append(name)
            self.last_name = names[0] if names else ""
            named, naming = naming, ""
            if names and (terms := self._terms(separator.end(), limit)):
                seen.update(names)
                key = names[0].lower()
                self._note(names, named if named and key == "value" else under, terms)
                if target and separator[0] in ("=", ":="):
                    self._others(_names_before(text, target[1], last), names[:1], terms, limit)
                if key in _NAMING and len(terms) == 1:
                    naming = terms[0][0] if isinstance(terms[0], tuple) else text[terms[0].start : terms[0].end]

    def _others(self, names: list[str], name: list[str], terms: list, limit: int) -> None:
        """Pairs of ``a, b = x, y``, if there are as many values as names."""
        if not names:
            return
        values = [terms]
        text = self.text
        outer = len(self.inside) - sum(isinstance(t, Value) and t.quoted for t in terms)
        while len(values) <= len(names):
            at = _BLANKS.match(text, self.expression_end, limit).end()
            if text[at : at + 1] != "," or at >= limit:
                break
            values.append(self._terms(at + 1, limit))
        self.inside[outer:] = sorted(self.inside[outer:], reverse=True)
        if len(values) != len(names) + 1:
            return
        at = _BLANKS.match(text, self.expression_end, limit).end()
        if at >= limit or text[at] in "\r\n;#/":
            for own, value in zip(names + name, values, strict=True):
                if value:
                    self._note([own], "", value)

    def _under(self, name: str, start: int, last: int) -> str:
        """The key that this one is under, by indentation or as the first in its braces."""
        text = self.text
        if last and "\n" not in text[last:start]:
            opened = text[last:start].strip(" \t\"'")
            return self.last_name if opened == "{" else ""
        begin = text.rfind("\n", last, start) + 1
        if text[begin:start].strip(" \t\"'{-"):
            return ""
        depth = start - begin
        while self.keys and self.keys[-1][0] >= depth:
            self.keys.pop()
        under = self.keys[-1][1] if self.keys else ""
        self.keys.append((depth, name))
        return under

    def _note(self, names: list[str], under: str, terms: list) -> None:
        weight = max(map(name_weight, names))
        if under and any(n.rsplit(".", 1)[-1].lower() in _NEUTRAL for n in names):
            weight = max(weight, name_weight(under))
        phrase = any("phrase" in n.lower() or "mnemonic" in n.lower() for n in (*names, under))
        self.statements.append((names, weight, phrase, terms))

    def _terms(self, at: int, limit: int) -> list:
        """The literals and words of the expression at ``at``."""
        text = self.text
        self.expression_end = at
        if text[at - 1 : at] == ":" and (block := _BLOCK.match(text, at, limit)) is not None:
            return self._block(at, block.end(), limit)
        out: list = []
        self.expression_end = self._expression(at, limit, out)
        # The nearest end comes off the list first.
        self.inside += [t.end for t in reversed(out) if isinstance(t, Value) and t.quoted]
        return out

    def _expression(self, at: int, limit: int, out: list) -> int:
        """Adds the terms; where they end."""
        text = self.text
        depth = 0
        quoted = joined = False
        while True:
            at = (_BLANKS_LINES if depth else _BLANKS).match(text, at, limit).end()
            if depth:
                self.skipped = max(self.skipped, at)
            c = text[at : at + 1] if at < limit else ""
            if c == "(" and not (out and not joined):
                depth += 1
                at += 1
                continue
            if c == ")" and depth:
                depth -= 1
                at += 1
                quoted = True
                continue
            if out and not joined:
                join = _JOIN.match(text, at, limit) if quoted or text[at - 1 : at] in (" ", "\t", "\n") else None
                if join is not None:
                    at, joined = join.end(), True
                    continue
                if not (quoted and c and c in "\"'`"):
                    return at
            term = self._literal(at, limit)
            if term is not None:
                start, end, after = term
                out.append(Value(start, end, True, text[start:end]))
                at, quoted, joined = after, True, False
                continue
            if c == "$" and (variable := _VARIABLE.match(text, at, limit)) is not None:
                out.append((variable[1], None))
                at, quoted, joined = variable.end(), True, False
                continue
            # A run that began earlier ends where that one did.
            end = self.bare[1] if self.bare[0] <= at < self.bare[1] <= limit else bare.end() if (bare := _BARE.match(text, at, limit)) else at
            if end == at:
                return at
            if text[end : end + 1] == "(" and end < limit and _REFERENCE.match(word := text[at:end]) and not word.startswith("$"):
                at = end  # a call: of its arguments the first
                joined = True
                continue
            if not self.bare[0] <= at < self.bare[1]:
                self.bare = at, end
            out += self._words(at, end)
            at, quoted, joined = end, False, False

    def _words(self, start: int, end: int) -> list:
        text = self.text
        if "=" in text[start : start + 1] or text.find("=", start, end) >= 0:
            return [Value(start, end, False, "", self._bare_stats(start, end))]
        own = text[start:end]
        if "+" in own and all(map(_REFERENCE.match, own.split("+"))):
            return [(name.lstrip("$"), None) for name in own.split("+")]
        literal = Value(start, end, False, own)
        return [(own.lstrip("$"), literal)] if _REFERENCE.match(own) else [literal]

    def _bare_stats(self, start: int, end: int) -> Stats:
        """Stats of a run with separators: runs that end alike are counted once and shortened."""
        text = self.text
        if end == self.counted[1] and self.counted[0] <= start:
            self.counts = self.counts - Counter(text[self.counted[0] : start])
        else:
            self.counts = Counter(text[start:end])
        self.counted = start, end
        return Stats.of(self.counts, text[start : min(end, start + HEAD)], text[max(start, end - 2) : end], None)

    def _literal(self, at: int, limit: int) -> tuple[int, int, int] | None:
        """Start and end of the quoted literal here, and where it is over."""
        text = self.text
        for quote in _LONG_QUOTES:
            if text.startswith(quote, at, limit):
                end = text.find(quote, at + len(quote), limit)
                if end >= 0:
                    return at + len(quote), end, end + len(quote)
        if (found := _QUOTED.match(text, at, limit)) is None:
            return None
        start, end = found.span(found.lastindex)
        return start, end, found.end()

    def _block(self, colon: int, at: int, limit: int) -> list:
        """The lines that are indented more than the line of the key."""
        text = self.text
        begin = text.rfind("\n", 0, colon) + 1
        depth = len(text[begin:colon]) - len(text[begin:colon].lstrip(" "))
        out: list = []
        while at < limit:
            line = _LINE.match(text, at, limit)
            bare = line[0].strip()
            indent = len(line[0]) - len(line[0].lstrip(" "))
            if bare and indent <= depth:
                break
            if bare and "-----" not in bare:
                out.append(Value(at + indent, at + indent + len(bare), True, bare))
            at = line.end()
        return out


def _value(terms: list, known: dict[str, Value]) -> Value | None:
    """What terms join to; of a word without a value its literal, if it may be one."""
    parts = [known.get(t[0], t[1]) if isinstance(t, tuple) else t for t in terms]
    parts = [p for p in parts if p is not None]
    return Value.joined(parts) if parts else None


def literal_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name, directly or through constants."""
    statements = Lexer(text).read()
    if not statements:
        return []
    seen: set[Value] = set()
    found: set[tuple[int, int]] = set()
    known: dict[str, Value] = {}
    waiting: list[tuple[list[str], float, bool, list]] = []
    for names, weight, phrase, terms in statements:
        terms = [known.get(t[0], t) if isinstance(t, tuple) else t for t in terms]
        if any(isinstance(t, tuple) for t in terms):
            waiting.append((names, weight, phrase, terms))
        if value := _value(terms, {}):
            known.update(dict.fromkeys(names, value))
            if weight and weight * value.strength(phrase) >= THRESHOLD:
                found.update(value.literals(seen))
        if waiting and waiting[-1][0] is not names:
            waiting.append((names, 0.0, False, terms))
    # Names that nothing before them defines, from the end: the first definition after them is the last one met.
    known = {}
    for names, weight, phrase, terms in reversed(waiting):
        if value := _value(terms, known):
            known.update(dict.fromkeys(names, value))
            if weight and weight * value.strength(phrase) >= THRESHOLD:
                found.update(value.literals(seen))
    return [("literal", a, b) for a, b in sorted(found)]


def _extra(text: str, base: list[Span]) -> list[Span]:
    """The lexer's spans unless one base span holds them whole."""
    starts = [a for _, a, _ in base]
    reach = list(accumulate((b for _, _, b in base), max))
    extra = []
    for span in literal_spans(text):
        before = bisect_right(starts, span[1])
        if not before or reach[before - 1] < span[2]:
            extra.append(span)
    return extra


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans)."""
    base = [span for span, _ in base_matches(text)]
    extra = _extra(text, base)
    return base, sorted(base + extra, key=_order) if extra else base


def _quote_end(text: str, begin: int, end: int) -> int:
    """The end of the literal that begins with a secret, else the secret's."""
    if begin and text[begin - 1] in "\"'" and (found := _QUOTED.match(text, begin - 1)) is not None:
        return max(end, found.end() - 1)
    return end


def redact(text: str, mask: str = "[SECRET]") -> str:
    """The text with every secret (overlapping ones as one) replaced; names and quotes around it stay."""
    base = base_matches(text)
    spans = [(begin, _quote_end(text, begin, span[2])) for span, begin in base] + [span[1:] for span in _extra(text, [span for span, _ in base])]
    out, done, end = [], 0, 0
    for a, b in sorted(spans):
        if a >= end:
            out += [text[done:a], mask]
        end = done = max(end, b)
    return "".join(out) + text[done:] if out else text


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of base spans, their digest, all spans as text."""

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            found = [all_spans(t) for t in batch["text"]]
            yield {
                "doc_id": batch["doc_id"],
                **{f"n_{k}": [sum(s[0] == k for s in every) for _, every in found] for k in KINDS},
                "base_sha256": [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found],
                "spans": [written(every) for _, every in found],
            }

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return map_batches(rows, work, "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every secret masked; null stays null."""
    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(redact, na_action="ignore")

    return docs.withColumn(text_col, masked(F.col(text_col)))
