"""Boolean trigram queries, derived from regular expressions.

A query is a nested tuple: ``("and", q, ...)``, ``("or", q, ...)``, a trigram, or ``True`` where nothing is mandatory.
Each node of the parsed pattern is either a small set of exact strings or a query; runs of exact strings are multiplied
out while they stay small, and every string of a run gives the conjunction of its trigrams.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser

MOST = 64  # exact strings that are kept apart


def conj(*qs):
    flat = []
    for q in qs:
        if q is True:
            continue
        flat += q[1:] if isinstance(q, tuple) and q[0] == "and" else [q]
    flat = list(dict.fromkeys(flat))
    return True if not flat else flat[0] if len(flat) == 1 else ("and", *flat)


def disj(*qs):
    if not qs or any(q is True for q in qs):
        return True
    flat = []
    for q in qs:
        flat += q[1:] if isinstance(q, tuple) and q[0] == "or" else [q]
    flat = list(dict.fromkeys(flat))
    return flat[0] if len(flat) == 1 else ("or", *flat)


def of_strings(strings: set[str]):
    return disj(*[conj(*[s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _node(op, arg):
    """(exact strings or None, query)."""
    if op is C.LITERAL:
        return {chr(arg)}, True
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        got = [_sequence(x) for x in arg[1]]
        if all(e is not None for e, _ in got) and len(union := set().union(*[e for e, _ in got])) <= MOST:
            return union, True
        return None, disj(*[q if e is None else of_strings(e) for e, q in got])
    if op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 4:
        return {chr(c) for _, c in arg}, True
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, body = arg
        exact, query = _sequence(body)
        if exact is not None and low == 0 and high == 1:
            return exact | {""}, True
        if exact is not None and low == high and low <= 4:
            out = {""}
            for _ in range(low):
                out = {a + b for a in out for b in exact}
            return (out, True) if len(out) <= MOST else (None, True)
        return None, True if low == 0 else query if exact is None else of_strings(exact)
    if op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
        return {""}, True
    return None, True


def _sequence(nodes):
    run, query, whole = {""}, True, True
    for op, arg in nodes:
        exact, q = _node(op, arg)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = {a + b for a in run for b in exact}
            continue
        query = conj(query, of_strings(run), q)
        whole, run = False, exact if exact is not None else {""}
    return (run, True) if whole else (None, conj(query, of_strings(run)))


def derive(pattern: str, fold: bool = False):
    """The trigram query that any text with a match of ``pattern`` satisfies; over lower-cased text if ``fold``."""
    exact, query = _sequence(parser.parse(pattern))
    query = query if exact is None else of_strings(exact)

    def lower(q):
        return q.lower() if isinstance(q, str) else q if q is True else (q[0], *map(lower, q[1:]))

    return lower(query) if fold else query


def grams(query) -> list[str]:
    """All trigrams of a query."""
    if query is True:
        return []
    return [query] if isinstance(query, str) else sorted({g for q in query[1:] for g in grams(q)})
