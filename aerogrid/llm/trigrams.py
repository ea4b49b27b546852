"""Boolean trigram queries derived from regular expressions.

A query is a list of clauses, each a set of trigrams: a text can match the expression only if it holds
all trigrams of at least one clause.  An expression without mandatory trigrams has no query (None).
Trigrams are in lower case; the text they are looked up in must be as well.
"""

from __future__ import annotations

from re import _constants as op
from re import _parser as parser

MAX_STRINGS = 32  # exact strings followed through a sequence before they are cut into trigrams
MAX_CLASS = 8  # characters of a class that are followed one by one
MAX_CLAUSES = 64


def trigrams_of(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _both(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
    """Clauses of "a and b"; `a` alone, which asks for less, if there would be too many."""
    joined = list(dict.fromkeys(x | y for x in a for y in b))
    return joined if len(joined) <= MAX_CLAUSES else a


class _Sequence:
    """Walks the parts of an expression, keeping the strings that the text before this point must end in."""

    def __init__(self):
        self.clauses: list[frozenset[str]] = [frozenset()]
        self.ends = {""}
        self.exact = True  # nothing but `ends` has been read

    def cut(self) -> None:
        """What follows is unknown: turn the strings at hand into trigrams."""
        self.clauses = _both(self.clauses, [trigrams_of(s) for s in sorted(self.ends)])
        self.ends, self.exact = {""}, False

    def append(self, strings: set[str]) -> None:
        if len(self.ends) * len(strings) > MAX_STRINGS:
            self.cut()
        self.ends = {a + b for a in self.ends for b in strings}

    def also(self, clauses: list[frozenset[str]]) -> None:
        self.cut()
        self.clauses = _both(self.clauses, clauses)


def _class_members(items) -> set[str] | None:
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < MAX_CLASS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= MAX_CLASS else None


def _walk(nodes) -> _Sequence:
    seq = _Sequence()
    for kind, value in nodes:
        if kind is op.LITERAL:
            seq.append({chr(value).lower()})
        elif kind is op.IN and (members := _class_members(value)):
            seq.append(members)
        elif kind is op.SUBPATTERN:
            _add(seq, _walk(value[3]))
        elif kind is op.BRANCH:
            branches = [_walk(b) for b in value[1]]
            strings = set().union(*(b.ends for b in branches))
            if all(b.exact for b in branches) and len(strings) <= MAX_STRINGS:
                seq.append(strings)
            else:
                for b in branches:
                    b.cut()
                seq.also(list(dict.fromkeys(c for b in branches for c in b.clauses)))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, body = value
            inner = _walk(body)
            if (least, most) == (0, 1) and inner.exact:
                seq.append(inner.ends | {""})
            elif least == 0:
                seq.cut()
            else:
                for _ in range(min(least, MAX_CLASS)):
                    _add(seq, _walk(body))
                if most != least or least > MAX_CLASS:
                    seq.cut()
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue  # reads nothing
        else:
            seq.cut()
    return seq


def _add(seq: _Sequence, inner: _Sequence) -> None:
    if inner.exact:
        seq.append(inner.ends)
    else:
        inner.cut()
        seq.also(inner.clauses)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of the pattern, or None if a match may hold no known trigram at all."""
    seq = _walk(parser.parse(pattern))
    seq.cut()
    clauses = [c for c in seq.clauses if not any(o < c for o in seq.clauses)]
    return None if frozenset() in clauses else clauses
