"""Secret scan by assignment-aware lexing.

Source and configuration text is lexed into assignments (name, expression).  An
expression is made of string literals, bare values and names; names that the text
itself assigns are replaced by their values (constants propagate through any number
of steps, and a name that is assigned several times stands for each of its values).
Every literal that reaches a target is scored by the target's name and by its own shape,
and literals over the threshold are reported with their own place.

The work is linear in a text.  A name passes the strongest target that it reaches on to
all its values, each name once, strongest targets first.  Where an expression joins
several terms, its names stand for their first values; their further values are scored by
themselves.  Values of any length count whole: what is put together is scored from the
shapes of its parts (counts of characters, words, edges), each name's shape made once, and
the bare values that end one run of characters are scored in one pass over it.

Three plain patterns (``assign``, ``access``, ``hex``) are always reported as well.
Offsets are code points, ends exclusive.

Defined cases: a null text is empty; an empty text has no spans; names that are
assigned in a circle have no value where they are met again; a text of any length is lexed in one pass, and
bare values, quoted literals, names and what names are joined to may have any length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlens.llm.common import map_texts

#: Value (none for a long bare value, which is read in the text), start, end, quoted.
Term = tuple[str | None, int, int, bool]
#: Start and end of a literal, or a name that stands for its first value.
Part = tuple[int, int] | str

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "literal")
SCHEMA = "spans array<struct<kind:string,start:long,end:long,score:double,name:string>>"
THRESHOLD = 0.5
#: Longest bare value that is taken out of the text (names are at any length).
VALUE_CHARS = 2048
_SPAN_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("name", pa.string())])
)

_ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
_HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)

_NAME = r"[A-Za-z_$][A-Za-z0-9_$.-]*+"
_TARGET = re.compile(rf"""(?<![A-Za-z0-9_$.-])(["']?)({_NAME})\1[\x20\t]*+(?::=|=>|[:=](?!=))[\x20\t]*+""", re.ASCII)
_QUOTED = re.compile(
    r'"""(?P<a>.*?)"""|\'\'\'(?P<b>.*?)\'\'\'|"(?P<c>(?:\\.|[^"\\\n])*)"|\'(?P<d>(?:\\.|[^\'\\\n])*)\'|`(?P<e>[^`\n]*)`', re.DOTALL
)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>#+]+""")
_BARE_END = re.compile(r"""[\s"'`,;(){}\[\]<>#+]|\Z""")
_PLUS = re.compile(r"[\x20\t]*(?:\+|\.\.|&)[\x20\t]*(?:\\?\n[\x20\t]*)?|[\x20\t]+(?=[\"'])")
_TYPED = re.compile(r"[\x20\t]*+(?:\[[^\]\n]*\])?[\x20\t]*+=(?!=)[\x20\t]*")
_WHOLE_NAME = re.compile(_NAME, re.ASCII)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.ASCII)

#: How strongly a word in a target's name speaks for a secret.
NAME_WEIGHTS = {
    "password": 1.0,
    "passwd": 1.0,
    "passphrase": 1.0,
    "pwd": 0.9,
    "pass": 0.8,
    "secret": 1.0,
    "token": 0.9,
    "apikey": 1.0,
    "credential": 0.9,
    "credentials": 0.9,
    "bearer": 0.8,
    "auth": 0.6,
    "authorization": 0.7,
    "private": 0.6,
    "key": 0.5,
    "api": 0.4,
    "access": 0.4,
    "signing": 0.4,
    "encryption": 0.4,
    "salt": 0.5,
    "webhook": 0.5,
    "dsn": 0.5,
}
#: Words that mark a literal as no secret.
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "dummy", "xxxx", "****", "none", "null", "true", "false", "todo", "${", "{{", "<")


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PART.findall(name)]
    return min(1.0, sum(NAME_WEIGHTS.get(p, 0.0) for p in dict.fromkeys(parts)))


_KINDS_OF_CHARACTERS = tuple(re.compile(p, re.ASCII) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^\w\s]"))
#: Characters at either end by which a placeholder across two parts is found.
_EDGE = max(map(len, PLACEHOLDERS)) - 1
#: From so many words on, prose outweighs all else.
_MANY_WORDS = 1000


def _weighed(n: int, bits: float, kinds: int, words: int) -> float:
    return max(0.0, min(1.0, bits / 4 * 0.6 + kinds * 0.15 + (n >= 16) * 0.15 - 0.3 * (words - 1)))


class Shape:
    """What the score of a text depends on, for texts that are put together."""

    __slots__ = ("n", "counts", "kinds", "words", "blank", "placeholder", "head", "tail")

    def __init__(self, value: str = ""):
        low = value.lower()
        self.n, self.counts = len(value), Counter(value)
        self.kinds = frozenset(i for i, p in enumerate(_KINDS_OF_CHARACTERS) if p.search(value))
        self.words = len(value.split())
        self.blank = value[:1].isspace(), value[-1:].isspace()
        self.placeholder = any(p in low for p in PLACEHOLDERS)
        self.head, self.tail = low[:_EDGE], low[-_EDGE:]

    def add(self, other: Shape, before: bool = False) -> None:
        """Become the shape of this text with the other behind (or before) it."""
        if not other.n:
            return
        a, b = (other, self) if before else (self, other)
        across = a.n > 0 and b.n > 0 and not a.blank[1] and not b.blank[0]
        words = min(_MANY_WORDS, a.words + b.words - across)
        placeholder = a.placeholder or b.placeholder or any(p in a.tail + b.head for p in PLACEHOLDERS)
        blank = (a if a.n else b).blank[0], (b if b.n else a).blank[1]
        head, tail = (a.head + b.head)[:_EDGE], (a.tail + b.tail)[-_EDGE:]
        self.kinds |= other.kinds
        self.counts.update(other.counts)
        self.n += other.n
        self.words, self.placeholder, self.blank, self.head, self.tail = words, placeholder, blank, head, tail

    def score(self, bits: float | None = None) -> float:
        """0 to 1 by length, variety of characters and absence of prose or placeholders."""
        if self.n < 6 or self.placeholder:
            return 0.0
        if bits is None:  # names doubled often make counts that only divide as integers
            bits = -sum(p * math.log2(p) for c in self.counts.values() if (p := c / self.n))
        return _weighed(self.n, bits, len(self.kinds), self.words)


def literal_score(value: str) -> float:
    if len(value) < 6 or any(p in value.lower() for p in PLACEHOLDERS):
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return _weighed(n, bits, sum(bool(p.search(value)) for p in _KINDS_OF_CHARACTERS), len(value.split()))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def _expression(text: str, at: int, ends: list[int]) -> tuple[list[Term], int]:
    """Terms (value, start, end, quoted) of the expression at an offset, and its end.

    ``ends`` holds the end of the last run of bare characters: a run that many targets
    lie in is measured once, and is taken out of the text only up to ``VALUE_CHARS`` or
    if it is a name (no other target lies in a name, so names are read once).
    """
    terms: list[Term] = []
    while True:
        if m := _QUOTED.match(text, at):
            group = next(g for g in "abcde" if m[g] is not None)
            terms.append((m[group], *m.span(group), True))
            at = m.end()
        elif _BARE.match(text, at, at + 1):
            if at >= ends[0]:
                ends[0] = _BARE_END.search(text, at).start()
            end = ends[0]
            if text[end : end + 1] in ("(", "["):
                return [], end  # a call or a look-up is no literal
            whole = end - at <= VALUE_CHARS or ((name := _WHOLE_NAME.match(text, at)) and name.end() == end)
            terms.append((text[at:end] if whole else None, at, end, False))
            at = end
        else:
            return terms, at
        if not (more := _PLUS.match(text, at)):
            return terms, at
        at = more.end()


def assignments(text: str) -> list[tuple[str, list[Term]]]:
    """All (name, terms) in order of appearance."""
    out, at, ends = [], 0, [0]
    while m := _TARGET.search(text, at):
        terms, end = _expression(text, m.end(), ends)
        if len(terms) == 1 and not terms[0][3] and (typed := _TYPED.match(text, end)):
            terms, _ = _expression(text, typed.end(), ends)  # name: type = value
        if terms:
            out.append((m[2], terms))
        # Go on behind the operator: a value may hold assignments of its own.
        at = m.end()
    return out


def _names(terms: list[Term], known: dict[str, list[list[Term]]]) -> list[str]:
    return [value for value, _, _, quoted in terms if not quoted and value in known]


def _long_values(text: str, single: list[Term], joined: list[Term]) -> tuple[dict[tuple[int, int], float], dict[tuple[int, int], Shape]]:
    """By place, the scores of long bare values, and the shapes of those in ``joined``.

    Values with one end are suffixes of each other: from the last on, each adds only the
    characters before the one behind it.
    """
    kept = {(start, end) for value, start, end, _ in joined if value is None}
    runs: dict[int, set[int]] = defaultdict(set)
    for value, start, end, _ in (*single, *joined):
        if value is None:
            runs[end].add(start)
    scores, shapes = {}, {}
    for end, starts in runs.items():
        shape, total, cut = Shape(), 0.0, end  # total: sum of count * log2(count)
        for start in sorted(starts, reverse=True):
            piece = Shape(text[start:cut])
            for c, more in piece.counts.items():
                had = shape.counts.get(c, 0)
                total += (had + more) * math.log2(had + more) - (had * math.log2(had) if had else 0.0)
            shape.add(piece, before=True)
            cut = start
            scores[start, end] = shape.score(math.log2(shape.n) - total / shape.n)
            if (start, end) in kept:
                shapes[start, end] = copy = Shape()
                copy.add(shape)
    return scores, shapes


class _FirstValues:
    """What joined names stand for: the shapes of their first values, once names in them
    are replaced, and the parts that these are made of.

    Shapes are let go after their last use, by ``names`` and ``joins`` (all expressions
    to be asked for).
    """

    def __init__(self, known: dict[str, list[list[Term]]], names: set[str], joins: list[list[Term]], long: dict[tuple[int, int], Shape]):
        self.known, self.long = known, long
        self.parts: dict[str, list[Part]] = {}
        self.shapes: dict[str, Shape] = {}
        self.uses = Counter(n for terms in joins for n in _names(terms, known))
        for name in names:
            self.uses.update(_names(known[name][0], known))

    def put_together(self, terms: list[Term]) -> tuple[Shape, list[Part]]:
        shape, parts = Shape(), []
        for value, start, end, quoted in terms:
            if quoted or value not in self.known:
                shape.add(self.long[start, end] if value is None else Shape(value))
                parts.append((start, end))
                continue
            if value in self.shapes:
                shape.add(self.shapes[value])
                parts.append(value)
            self.uses[value] -= 1
            if not self.uses[value]:
                self.shapes.pop(value, None)
        return shape, parts

    def of(self, terms: list[Term], once: list[Term]) -> tuple[Shape, list[Part]]:
        """Shape and parts of an expression, given whole and without names that come again;
        names that stand for themselves in the end have no value where they are met again."""
        for wanted in _names(terms, self.known):
            waiting, open_names = [wanted], set()
            while waiting:
                name = waiting[-1]
                if name in self.parts:
                    waiting.pop()
                    continue
                first = self.known[name][0]
                if name not in open_names:
                    open_names.add(name)
                    if more := [n for n in _names(first, self.known) if n not in self.parts and n not in open_names]:
                        waiting.extend(reversed(more))
                        continue
                shape, self.parts[name] = self.put_together(first)
                if self.uses[name]:
                    self.shapes[name] = shape
                waiting.pop()
        return self.put_together(once)


def _once(name: str, terms: list[Term], known: dict[str, list[list[Term]]]) -> list[Term]:
    """The terms of what a target receives: itself, and a name that comes again, left out."""
    seen, out = {name}, []
    for term in terms:
        if term[3] or term[0] not in known:
            out.append(term)
        elif term[0] not in seen:
            seen.add(term[0])
            out.append(term)
    return out


def _reachable(known: dict[str, list[list[Term]]], names: list[str]) -> set[str]:
    """The names, and those that their first values are made of."""
    found, waiting = set(names), list(names)
    while waiting:
        more = [n for n in dict.fromkeys(_names(known[waiting.pop()][0], known)) if n not in found]
        found.update(more)
        waiting.extend(more)
    return found


def _strengths(known: dict[str, list[list[Term]]]) -> dict[str, tuple[float, str]]:
    """Per name the strongest target (weight, name) that one of its values reaches."""
    weights = {name: name_score(name) for name in known}
    reached: dict[str, tuple[float, str]] = {}
    for target in sorted((n for n in known if weights[n] >= THRESHOLD), key=lambda n: -weights[n]):
        waiting = [target]
        while waiting:
            name = waiting.pop()
            if name not in reached:
                reached[name] = weights[target], target
                for terms in known[name]:
                    waiting.extend(n for n in _names(terms, known) if n not in reached)
    return reached


def literal_spans(text: str) -> list[tuple[str, int, int, float, str]]:
    """("literal", start, end, score, target name) of what sensitive targets receive."""
    if ":" not in text and "=" not in text:
        return []
    pairs = assignments(text)
    known: dict[str, list[list[Term]]] = {}
    for name, terms in pairs:
        known.setdefault(name, []).append(terms)
    reached = _strengths(known)
    asked = [(name, terms) for name, terms in pairs if name in reached and not (len(terms) == 1 and _names(terms, known))]
    joins = [(terms, _once(name, terms, known)) for name, terms in asked if len(terms) > 1]
    inner = _reachable(known, list(dict.fromkeys(n for terms, _ in joins for n in _names(terms, known))))
    in_joins = [t for terms in (*(once for _, once in joins), *(known[n][0] for n in inner)) for t in terms]
    scores, shapes = _long_values(text, [t for _, terms in asked for t in terms if len(terms) == 1], in_joins)
    first = _FirstValues(known, inner, [once for _, once in joins], shapes)
    each = iter(joins)
    found: list[tuple[float, str, list[Part]]] = []
    for name, terms in asked:  # a lone name's values are scored where they are assigned
        weight, target = reached[name]
        if len(terms) > 1:
            shape, parts = first.of(*next(each))
            s = shape.score()
        else:
            ((value, start, end, _),) = terms
            s, parts = scores[start, end] if value is None else literal_score(value), [(start, end)]
        if s and (score := weight * (0.5 + 0.5 * s)) >= THRESHOLD:
            found.append((score, target, parts))
    best: dict[tuple[int, int], tuple[float, str]] = {}
    opened: set[str] = set()
    for score, target, waiting in sorted(found, key=lambda x: -x[0]):  # the best score of a part comes first
        while waiting:
            part = waiting.pop()
            if not isinstance(part, str):
                if part[1] > part[0]:
                    best.setdefault(part, (score, target))
            elif part not in opened:
                opened.add(part)
                waiting.extend(first.parts[part])
    return [("literal", a, b, score, name) for (a, b), (score, name) in best.items()]


def spans(text: str) -> list[dict]:
    """Base spans, and literals that no base span covers, by start and kind."""
    base = sorted((a, KINDS.index(k), b, 1.0, "") for k, a, b in base_spans(text))
    starts, reach = [x[0] for x in base], list(accumulate((x[2] for x in base), max))
    found = list(base)
    for _, a, b, score, name in literal_spans(text):
        before = bisect_right(starts, a)
        if not before or reach[before - 1] < b:
            found.append((a, KINDS.index("literal"), b, score, name))
    return [{"kind": KINDS[k], "start": a, "end": b, "score": s, "name": n} for a, k, b, s, n in sorted(found)]


def find_secrets(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and ``spans`` of every text."""

    def make():
        return lambda texts: [pa.array([spans(t) if t else [] for t in texts.to_pylist()], _SPAN_TYPE)]

    return map_texts(docs, make, SCHEMA, carry=carry)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for s in spans(text):
        if s["start"] >= at:
            out += [text[at : s["start"]], mark]
        at = max(at, s["end"])
    return "".join([*out, text[at:]]) if out else text


def redact_secrets(docs: DataFrame, carry: Sequence[str], mark: str = "[SECRET]") -> DataFrame:
    """``carry`` columns and ``redacted``, the text without its secrets (null stays null)."""

    def make():
        return lambda texts: [pa.array([redact(t, mark) if t else t for t in texts.to_pylist()], pa.string())]

    return map_texts(docs, make, "redacted string", carry=carry)


def joined(found: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
