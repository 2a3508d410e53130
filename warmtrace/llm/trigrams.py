"""Boolean trigram queries that every match of a regular expression satisfies."""

from __future__ import annotations

import re
from itertools import product
from re import _constants as c
from re import _parser as parser

# A set of exact strings is followed up to this size, a class of characters up to the smaller one.
MOST_STRINGS = 64
MOST_CHARACTERS = 8

# A query is a set of clauses, each a set of trigrams: one clause must be there whole.  The empty
# clause holds always.
Query = frozenset
ANY: Query = frozenset([frozenset()])


def _either(a: Query, b: Query) -> Query:
    """Only clauses that contain no other: those are implied."""
    both = a | b
    return frozenset(x for x in both if not any(y < x for y in both))


def _both(a: Query, b: Query) -> Query:
    out: Query = frozenset()
    for x, y in product(a, b):
        out = _either(out, frozenset([x | y]))
    return out if len(out) <= MOST_STRINGS else min(a, b, key=lambda q: (q == ANY, len(q)))


def _needs(strings: set[str]) -> Query:
    out: Query = frozenset()
    for s in strings:
        out = _either(out, frozenset([frozenset(s[i:i + 3] for i in range(len(s) - 2))]))
    return out


class _Seen:
    """What is known of a part: all its strings, or else only a query."""

    def __init__(self, strings: set[str] | None, query: Query = ANY):
        self.strings, self.query = strings, query

    def needs(self) -> Query:
        return self.query if self.strings is None else _needs(self.strings)


def _characters(items) -> set[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is c.LITERAL:
            out.add(chr(value).lower())
        elif kind is c.RANGE and value[1] - value[0] < MOST_CHARACTERS:
            out.update(chr(x).lower() for x in range(value[0], value[1] + 1))
        else:
            return None
    return out if len(out) <= MOST_CHARACTERS else None


def _part(kind, value) -> _Seen:
    if kind is c.LITERAL:
        return _Seen({chr(value).lower()})
    if kind is c.IN:
        return _Seen(_characters(value))
    if kind is c.SUBPATTERN:
        return _sequence(value[3])
    if kind is c.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(p.strings is not None for p in parts):
            strings = set().union(*[p.strings for p in parts])
            if len(strings) <= MOST_STRINGS:
                return _Seen(strings)
        query: Query = frozenset()
        for p in parts:
            query = _either(query, p.needs())
        return _Seen(None, query)
    if kind in (c.MAX_REPEAT, c.MIN_REPEAT):
        least, most, inner = value
        seen = _sequence(inner)
        if (least, most) == (0, 1) and seen.strings is not None:
            return _Seen(seen.strings | {""})
        if (least, most) == (1, 1):
            return seen
        return _Seen(None, seen.needs() if least else ANY)
    if kind is c.AT:
        return _Seen({""})
    return _Seen(None)


def _sequence(items) -> _Seen:
    strings: set[str] = {""}
    query, whole = ANY, True
    for kind, value in items:
        seen = _part(kind, value)
        if seen.strings is not None and len(strings) * len(seen.strings) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in seen.strings}
            continue
        query, whole = _both(query, _needs(strings)), False
        if seen.strings is None:
            query, strings = _both(query, seen.query), {""}
        else:
            strings = seen.strings
    return _Seen(strings) if whole else _Seen(None, _both(query, _needs(strings)))


def trigram_query(pattern: str) -> Query:
    """Clauses of lower-case trigrams; a text with a match has, in lower case, all of some clause.

    ``ANY``, with the empty clause, for a pattern that has no mandatory trigram.
    """
    return _sequence(parser.parse(pattern, re.IGNORECASE)).needs()
