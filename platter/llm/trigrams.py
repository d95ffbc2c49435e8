"""Boolean trigram queries of regular expressions.

A query is a list of alternatives, each a set of trigrams that every match of that alternative contains, all in lower case;
an alternative without trigrams, and so a query that has one, holds for every text. The expression is read by Python's own
parser. Small sets of strings that a part can match are carried through concatenation, and turned into trigrams where they
end; whatever cannot be bounded is taken to match anything, which only makes the query weaker.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from itertools import product

Query = list[frozenset[str]]

ANY: Query = [frozenset()]
#: Strings, alternatives and members of a character class that are carried at most.
MOST = 64
MOST_CLASS = 8


def _simplified(query: Query) -> Query:
    """Without alternatives that another one's trigrams imply."""
    kept: Query = []
    for one in sorted(set(query), key=lambda s: (len(s), sorted(s))):
        if not any(k <= one for k in kept):
            kept.append(one)
    return kept


def _both(a: Query, b: Query) -> Query:
    joined = _simplified([x | y for x, y in product(a, b)])
    return joined if len(joined) <= MOST else min(a, b, key=len)


def _of(strings: set[str]) -> Query:
    return _simplified([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


def _characters(items) -> set[str] | None:
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 256:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= MOST_CLASS else None


def _item(kind, value) -> tuple[set[str] | None, Query]:
    """(all strings that the part can match, or None; the query of the part)."""
    if kind is op.LITERAL:
        return {chr(value).lower()}, ANY
    if kind is op.IN:
        return _characters(value), ANY
    if kind is op.AT:
        return {""}, ANY
    if kind is op.SUBPATTERN:
        return _sequence(value[-1])
    if kind is op.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST:
            return set().union(*(s for s, _ in parts)), ANY
        whole = _simplified([x for s, q in parts for x in (q if s is None else _both(q, _of(s)))])
        return None, whole if len(whole) <= MOST else ANY
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, part = value
        strings, query = _sequence(part)
        if strings is not None and most == 1:
            return strings | {""} if least == 0 else strings, ANY
        if least == 0:
            return None, ANY
        return None, query if strings is None else _of(strings)
    return None, ANY


def _sequence(parts) -> tuple[set[str] | None, Query]:
    held: set[str] = {""}
    query, exact = ANY, True
    for kind, value in parts:
        strings, part = _item(kind, value)
        if strings is None or len(held) * len(strings) > MOST:
            query, exact = _both(_both(query, _of(held)), part), False
            held = {""} if strings is None else strings
        else:
            held = {a + b for a, b in product(held, strings)}
    return (held, ANY) if exact else (None, _both(query, _of(held)))


def query(pattern: str) -> Query:
    """The trigram query of a pattern without flags."""
    strings, found = _sequence(parser.parse(pattern))
    return found if strings is None else _of(strings)
