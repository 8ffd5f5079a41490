"""Boolean trigram queries derived from regular expressions.

A query is True (nothing is mandatory), a trigram, or a tuple ("and" | "or", [queries]). Every text that the
expression matches, lower-cased, satisfies the query.
"""

from __future__ import annotations

from itertools import product
from re import _constants as C
from re import _parser as parser

#: Exact alternatives followed side by side before they are turned into trigrams.
MOST = 64


def trigram_query(pattern: str):
    """The Boolean query of a pattern; True if it has no mandatory trigram."""
    exact, query = _walk(parser.parse(pattern.replace(r"\x20", " ")))
    return _and([query, _of(exact)]) if exact is not None else query


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _and(parts: list):
    parts = [p for p in dict.fromkeys(map(_frozen, parts)) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(parts: list):
    parts = list(dict.fromkeys(map(_frozen, parts)))
    if True in parts:
        return True
    parts = [p for p in parts if not any(q is not p and trigrams(q) < trigrams(p) and "or" not in (q[0], p[0]) for q in parts)]
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _frozen(query):
    return query if query is True or isinstance(query, str) else (query[0], tuple(query[1]))


def _of(strings: set[str]):
    """What one of these strings being there implies: of a long string, four trigrams spread over it."""
    spots = lambda n: range(n) if n <= 4 else sorted({0, n // 3, 2 * n // 3, n - 1})
    return _or([_and([s[i : i + 3] for i in spots(len(s) - 2)]) for s in sorted(strings)])


def _walk(items) -> tuple[set[str] | None, object]:
    """The strings that items match, if few, and a query that holds besides."""
    run, found, whole = {""}, [], True
    for op, arg in items:
        exact, query = _item(op, arg)
        found.append(query)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = {a + b for a, b in product(run, exact)}
            continue
        found.append(_of(run))
        whole, run = False, exact or {""}
    if whole:
        return run, _and(found)
    return None, _and([*found, _of(run)])


def _item(op, arg) -> tuple[set[str] | None, object]:
    if op is C.LITERAL:
        return {chr(arg).lower()}, True
    if op is C.AT:
        return {""}, True
    if op is C.SUBPATTERN:
        return _walk(arg[-1])
    if op is C.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= MOST:
            return set().union(*(e for e, _ in parts)), _or([q for _, q in parts])
        return None, _or([_and([q, True if e is None else _of(e)]) for e, q in parts])
    if op is C.MAX_REPEAT:
        least, most, inner = arg
        exact, query = _walk(inner)
        if exact is not None and len(exact) ** int(most if most is not C.MAXREPEAT else 9) <= MOST and most is not C.MAXREPEAT:
            return {"".join(x) for n in range(least, most + 1) for x in product(exact, repeat=n)}, query if least else True
        return None, _and([query, True if exact is None else _of(exact)]) if least else True
    if op is C.IN and all(k is C.LITERAL for k, _ in arg) and len(arg) <= 8:
        return {chr(c).lower() for _, c in arg}, True
    return None, True
