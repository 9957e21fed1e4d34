"""Boolean trigram queries derived from regular expressions.

A regex is parsed and every node gets what is known of the strings that it matches: all of them
while they are few, else what they may begin and end with, and the trigrams that each must hold.
Trigrams are lower-cased, so one query serves both cases.  What the derivation doesn't follow
(large classes, look-around, back-references) counts as any string, which only weakens the query.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product
from re import _constants as C  # type: ignore[attr-defined]
from re import _parser  # type: ignore[attr-defined]

#: An OR of ANDs of trigrams; the empty AND holds of every text.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset({frozenset()})
#: Strings that a node may list, characters that a class may, and ANDs that a query may have before it is weakened.
STRINGS, CLASS, ANDS = 64, 8, 64


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _simple(found: Iterable[frozenset[str]]) -> Query:
    """Without ANDs that another one, asking for less, makes needless; too many become ANY."""
    sets = sorted(set(found), key=len)
    out: list[frozenset[str]] = []
    for s in sets:
        if not any(o <= s for o in out):
            out.append(s)
    return frozenset(out) if len(out) <= ANDS else ANY


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > ANDS * ANDS:
        return a if ANY != a else b
    made = _simple(x | y for x, y in product(a, b))
    return made if made != ANY else (a if a != ANY else b)


@dataclass(frozen=True)
class Known:
    """``exact``: all strings, or None; else ``head`` and ``tail``: what they begin and end with."""

    exact: frozenset[str] | None
    head: frozenset[str]
    tail: frozenset[str]
    need: Query

    @property
    def query(self) -> Query:
        return self.need if self.exact is None else _simple(trigrams(s) for s in self.exact)


_EMPTY = frozenset({""})
_UNKNOWN = Known(None, _EMPTY, _EMPTY, ANY)


def _strings(found: Iterable[str]) -> Known:
    all_of = frozenset(found)
    if len(all_of) <= STRINGS:
        return Known(all_of, all_of, all_of, ANY)
    return Known(None, frozenset(s[:2] for s in all_of), frozenset(s[-2:] for s in all_of), _simple(map(trigrams, all_of)))


def _edges(found: Iterable[str], end: bool) -> frozenset[str]:
    cut = frozenset(s[-2:] if end else s[:2] for s in found)
    return cut if len(cut) <= STRINGS else _EMPTY


def _joined(a: Known, b: Known) -> Known:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= STRINGS:
        return _strings(x + y for x, y in product(a.exact, b.exact))
    across = _simple(trigrams(x[-2:] + y[:2]) for x, y in product(a.tail, b.head))
    head = [x + y for x, y in product(a.exact, b.head)] if a.exact is not None else a.head
    tail = [x + y for x, y in product(a.tail, b.exact)] if b.exact is not None else b.tail
    return Known(None, _edges(head, False), _edges(tail, True), _both(_both(a.query, b.query), across))


def _either(parts: list[Known]) -> Known:
    if all(p.exact is not None for p in parts):
        return _strings(s for p in parts for s in p.exact or ())
    return Known(None, _edges((s for p in parts for s in p.head), False), _edges((s for p in parts for s in p.tail), True), _simple(s for p in parts for s in p.query))


def _class(items: list) -> Known:
    found: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            found.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < 4 * CLASS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:  # negation, a category, a long range
            return _UNKNOWN
    return _strings(found) if len(found) <= CLASS else _UNKNOWN


def _known(nodes: Iterable) -> Known:
    out = _strings([""])
    for op, value in nodes:
        if op is C.LITERAL:
            part = _strings([chr(value).lower()])
        elif op is C.IN:
            part = _class(value)
        elif op is C.SUBPATTERN:
            part = _known(value[3])
        elif op is C.BRANCH:
            part = _either([_known(x) for x in value[1]])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, inner = value
            once = _known(inner)
            part = _strings([""])
            for _ in range(min(least, 4)):
                part = _joined(part, once)
            if (least, most) == (0, 1):
                part = _either([part, once])
            elif most != least or least > 4:
                # more of the same may follow: the tail is the last one's
                part = _joined(part, _UNKNOWN)
                if least:
                    part = Known(part.exact, part.head, _edges(once.tail, True), part.need)
        elif op is C.AT:
            continue
        else:
            part = _UNKNOWN
        out = _joined(out, part)
    return out


def derive(pattern: str) -> Query:
    """The weakest it can be is ``ANY``: the regex has no mandatory trigram, and its rule scans all texts."""
    return _known(_parser.parse(pattern, re.DOTALL)).query
