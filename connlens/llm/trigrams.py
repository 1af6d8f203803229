"""Boolean trigram queries of regular expressions.

A query is a set of clauses, each a set of lower-case trigrams; a text can
match only if it holds all trigrams of at least one clause. The empty clause
means that nothing is mandatory.
"""

from __future__ import annotations

from itertools import product
from re import _constants as K
from re import _parser

ANY: frozenset[frozenset[str]] = frozenset([frozenset()])
#: Alternatives of a stretch that are spelled out; a wider stretch ends the run of known characters.
SPELLED = 16


def _both(a, b):
    return _simple({x | y for x, y in product(a, b)})


def _simple(clauses):
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _of_strings(strings) -> frozenset:
    return _simple({frozenset(s[i : i + 3] for i in range(len(s) - 2) if s[i : i + 3].isascii()) for s in strings})


def _spelled(node) -> set[str] | None:
    """All strings of a node when they are few, else None."""
    kind, value = node
    if kind is K.LITERAL:
        return {chr(value).lower()}
    if kind is K.IN:
        out = set()
        for part, what in value:
            if part is K.LITERAL:
                out.add(chr(what).lower())
            elif part is K.RANGE and what[1] - what[0] < SPELLED:
                out |= {chr(c).lower() for c in range(what[0], what[1] + 1)}
            else:
                return None
        return out if len(out) <= SPELLED else None
    if kind is K.SUBPATTERN:
        return _spelled_all(value[-1])
    if kind is K.BRANCH:
        options = [_spelled_all(x) for x in value[1]]
        return None if None in options else set().union(*options)
    if kind is K.MAX_REPEAT and value[1] <= 4:
        one = _spelled_all(value[2])
        return None if one is None else {"".join(x) for n in range(value[0], value[1] + 1) for x in product(one, repeat=n)}
    return {""} if kind is K.AT else None


def _spelled_all(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        some = _spelled(node)
        if some is None or len(out) * len(some) > 4 * SPELLED:
            return None
        out = {a + b for a in out for b in some}
    return out


def _query(nodes) -> frozenset:
    out, run = ANY, {""}
    for node in nodes:
        some = _spelled(node)
        if some is not None and len(run) * len(some) <= 4 * SPELLED:
            run = {a + b for a in run for b in some}
            continue
        out, run = _both(out, _of_strings(run)), {""}
        kind, value = node
        if some is not None:
            run = some
        elif kind is K.SUBPATTERN:
            out = _both(out, _query(value[-1]))
        elif kind is K.BRANCH:
            out = _both(out, _simple(set().union(*[_query(x) for x in value[1]])))
        elif kind is K.MAX_REPEAT and value[0] > 0:
            out = _both(out, _query(value[2]))
    return _both(out, _of_strings(run))


def trigram_query(regex: str) -> frozenset[frozenset[str]]:
    return _query(_parser.parse(regex))
