"""Boolean trigram queries from regular expressions.

A query is a conjunction of disjunctions of conjunctions: every match of the pattern
contains, for each member of the outer list, all trigrams of one of its alternatives.
It is derived from Python's parse tree of the pattern: every part of a pattern has
either the finite set of strings it matches, or required trigrams only.
"""

from __future__ import annotations

from re import _constants as op
from re import _parser as parser

#: A part with more exact strings, or longer ones, keeps its trigrams only.
MOST_STRINGS, LONGEST = 64, 48

#: alternatives, each a set of trigrams that a match must have
Clause = frozenset[frozenset[str]]


class Part:
    """What a part of a pattern matches: exact strings (or None if unbounded) and clauses."""

    def __init__(self, exact: set[str] | None, clauses: list[Clause] | None = None):
        self.exact, self.clauses = exact, clauses or []


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _clause(strings: set[str]) -> list[Clause]:
    alternatives = frozenset(trigrams(s) for s in strings)
    return [alternatives] if alternatives and all(alternatives) else []


def _sequence(items: list[Part]) -> Part:
    run: set[str] | None = {""}
    clauses: list[Clause] = []
    whole = True
    for x in items:
        clauses += x.clauses
        joined = None
        if x.exact is not None and run is not None:
            joined = {a + b for a in run for b in x.exact} if len(run) * len(x.exact) <= MOST_STRINGS else None
            if joined and max(map(len, joined)) > LONGEST:
                joined = None
        if joined is None:
            whole = False
            clauses += _clause(run or set())
            run = x.exact if x.exact is not None else {""}
        else:
            run = joined
    if whole:
        return Part(run, clauses)
    return Part(None, clauses + _clause(run or set()))


def _members(items: list) -> set[str] | None:
    out: set[str] = set()
    for kind, arg in items:
        if kind is op.LITERAL:
            out.add(chr(arg))
        elif kind is op.RANGE and arg[1] - arg[0] < 4:
            out |= {chr(i) for i in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _part(tree: list) -> Part:
    return _sequence([_one(kind, arg) for kind, arg in tree])


def _one(kind: object, arg: object) -> Part:
    if kind is op.LITERAL:
        return Part({chr(arg)})
    if kind is op.IN:
        return Part(_members(arg))
    if kind is op.SUBPATTERN:
        return _part(arg[-1])
    if kind is op.ATOMIC_GROUP:
        return _part(arg)
    if kind is op.BRANCH:
        parts = [_part(x) for x in arg[1]]
        if all(p.exact is not None for p in parts):
            return Part(set().union(*[p.exact for p in parts]))
        # an alternative that requires something only through its strings still counts
        own = [p.clauses + (_clause(p.exact) if p.exact is not None else []) for p in parts]
        if all(own):
            return Part(None, [frozenset(a for clauses in own for a in clauses[0])])
        return Part(None)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, inner = arg
        p = _part(inner)
        if (low, high) == (0, 1) and p.exact is not None:
            return Part({""} | p.exact)
        if low == high == 1:
            return p
        if low >= 1:
            if p.exact is not None and low * max(map(len, p.exact), default=0) <= LONGEST and len(p.exact) ** low <= MOST_STRINGS:
                start = _sequence([p] * low)
                return start if low == high else Part(None, _clause(start.exact or set()))
            return Part(None, p.clauses)
        return Part(None)
    if kind is op.AT:
        return Part({""})
    return Part(None)


def query(pattern: str) -> list[Clause]:
    """Clauses over lower-cased trigrams; empty if the pattern has no mandatory one."""
    p = _part(parser.parse(pattern))
    clauses = p.clauses + (_clause(p.exact) if p.exact is not None else [])
    lower = [{frozenset(t.lower() for t in alt) for alt in c} for c in clauses]
    # an alternative that asks for more than another one adds nothing
    return list(dict.fromkeys(frozenset(a for a in c if not any(b < a for b in c)) for c in lower))
