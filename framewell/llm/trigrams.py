"""Boolean trigram queries derived from regular expressions.

A query is True (any text may match), a trigram, or ("and" | "or", [queries]). Text and trigrams are lower case,
so a query asks for no more than the expression does, in either case.
"""

from __future__ import annotations

from re import _parser as sre

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings that a part of an expression may expand to before it is cut.
MOST = 16


def _and(parts: list) -> object:
    flat = [p for part in parts for p in (part[1] if isinstance(part, tuple) and part[0] == "and" else [part]) if p is not True]
    flat = list(dict.fromkeys(map(_frozen, flat)))
    return True if not flat else flat[0] if len(flat) == 1 else ("and", flat)


def _or(parts: list) -> object:
    if any(p is True for p in parts):
        return True
    flat = list(dict.fromkeys(map(_frozen, parts)))
    return flat[0] if len(flat) == 1 else ("or", flat)


def _frozen(query: object) -> object:
    return (query[0], tuple(query[1])) if isinstance(query, tuple) else query


def _of_strings(strings: set[str]) -> object:
    return _or([_and([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _charset(items: list) -> set[str] | None:
    found: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < MOST:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= MOST else None


def _walk(nodes: object) -> tuple[set[str] | None, object]:
    """(the strings it can match, if they are few; what any match must contain)."""
    strings, needs, whole = {""}, [], True

    def cut() -> None:
        nonlocal strings, whole
        needs.append(_of_strings(strings))
        strings, whole = {""}, False

    def follow(new: set[str] | None, need: object = True) -> None:
        nonlocal strings
        if new is None:
            cut()
            needs.append(need)
        else:
            if len(strings) * len(new) > MOST:
                cut()
            strings = {a + b for a in strings for b in new}

    for op, value in nodes:
        if op is sre.LITERAL:
            follow({chr(value).lower()})
        elif op is sre.IN:
            follow(_charset(value))
        elif op is sre.SUBPATTERN:
            follow(*_walk(value[3]))
        elif op is sre.BRANCH:
            branches = [_walk(b) for b in value[1]]
            every = None if any(s is None for s, _ in branches) else set().union(*(s for s, _ in branches))
            follow(every if every is None or len(every) <= MOST else None, _or([n if s is None else _of_strings(s) for s, n in branches]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = value
            some, need = _walk(inner)
            if (least, most) == (0, 1):
                follow(None if some is None else some | {""})
            elif least:
                follow(some, need)
                if (least, most) != (1, 1):
                    cut()
            else:
                cut()
        elif op is sre.AT:
            continue
        else:
            cut()
    return (strings if whole else None), _and([*needs, _of_strings(strings)])


def trigram_query(pattern: str) -> object:
    """What the trigrams of any text that matches must satisfy."""
    strings, need = _walk(sre.parse(pattern))
    return _of_strings(strings) if strings is not None else need


def trigrams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def matching(query: object, lists: dict[str, Column]) -> Column:
    """The documents that satisfy a query other than True, from the posting list of each trigram: lists are intersected and united."""
    if isinstance(query, str):
        return lists[query]
    first, *rest = [matching(q, lists) for q in query[1]]
    for q in rest:
        first = F.array_intersect(first, q) if query[0] == "and" else F.array_union(first, q)
    return first
