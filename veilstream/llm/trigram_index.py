"""Boolean trigram queries derived from regular expressions, and an inverted index that answers them.

Every text that a pattern matches holds the trigrams its query asks for, so the query never loses a match; what
it lets through is verified with the pattern itself.  Trigrams are bytes of the text with A-Z in lower case.
"""

from __future__ import annotations

import re
from itertools import product
from re import _constants as C
from re import _parser as parser

import numpy as np

#: A query: None (no condition), ("all", parts) or ("any", parts); a part is a query or a trigram.
Query = tuple | bytes | None
_MANY = 24


def _both(op: str, parts: list[Query]) -> Query:
    """Conjunction or disjunction, flattened; no condition is true."""
    if op == "any" and any(p is None for p in parts):
        return None
    flat: list[Query] = []
    for p in parts:
        if p is not None:
            flat += p[1] if isinstance(p, tuple) and p[0] == op else [p]
    flat = list(dict.fromkeys(flat))
    return None if not flat else flat[0] if len(flat) == 1 else (op, tuple(flat))


def _of_strings(strings: set[bytes]) -> Query:
    return _both("any", [_both("all", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _set_of(items: list) -> set[bytes] | None:
    """The characters of a class, if they are few."""
    out: set[bytes] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).encode().lower())
        elif op is C.RANGE and arg[1] - arg[0] < 4:
            out |= {chr(c).encode().lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(items) -> tuple[set[bytes] | None, Query]:
    """The strings a sequence can be, if they are few, and else None; and a query for it."""
    exact: set[bytes] = {b""}
    whole, queries = True, []

    def flush(keep: set[bytes] | None = None):
        nonlocal exact, whole
        queries.append(_of_strings(exact))
        exact, whole = keep or {b""}, False

    for op, arg in items:
        strings: set[bytes] | None = None
        query: Query = None
        if op is C.LITERAL:
            strings = {chr(arg).encode().lower()}
        elif op is C.IN:
            strings = _set_of(arg)
        elif op is C.SUBPATTERN:
            strings, query = _walk(arg[-1])
        elif op is C.BRANCH:
            both = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in both):
                strings = set().union(*(s for s, _ in both))
            query = _both("any", [_of_strings(s) if s is not None else q for s, q in both])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, inner = arg
            own, inner_query = _walk(inner)
            if most is not C.MAXREPEAT and most <= 3 and own is not None:
                strings = {b"".join(x) for n in range(least, int(most) + 1) for x in product(sorted(own), repeat=n)}
            elif least:
                query = _of_strings(own) if own is not None else inner_query
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        if strings is not None and len(exact) * len(strings) <= _MANY:
            exact = {a + b for a, b in product(exact, strings)}
        else:
            flush(strings if strings is not None and len(strings) <= _MANY else None)
            if strings is None:
                queries.append(query)
    if whole:
        return exact, _of_strings(exact)
    queries.append(_of_strings(exact))
    return None, _both("all", queries)


def query(pattern: re.Pattern) -> Query:
    """The trigram query of a pattern; None if it has no mandatory trigram."""
    return _walk(parser.parse(pattern.pattern, pattern.flags))[1]


def trigrams(q: Query) -> set[bytes]:
    if q is None:
        return set()
    return {q} if isinstance(q, bytes) else set().union(*(trigrams(p) for p in q[1]))


_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32


class TrigramIndex:
    """Postings (numbers of the texts) of the wanted trigrams over a batch of texts."""

    def __init__(self, texts: list[bytes], wanted: set[bytes]):
        self.n = len(texts)
        self.wanted = wanted
        start = np.cumsum([0, *(len(x) + 1 for x in texts)])
        buf = _TO_LOWER[np.frombuffer(b"\xff".join(texts) + b"\xff\xff\xff", np.uint8)]
        codes = sorted(int.from_bytes(t, "big") for t in wanted)
        asked = np.zeros(1 << 24, bool)
        asked[codes] = True
        places, found = [], []
        for s in range(0, max(0, len(buf) - 2), 1 << 18):
            part = buf[s : s + (1 << 18) + 2].astype(np.uint32)
            code = part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]
            at = np.flatnonzero(asked[code])
            places.append(at + s)
            found.append(code[at])
        place, code = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, found))
        text = np.searchsorted(start, place, "right") - 1
        both = np.unique(code.astype(np.int64) << 32 | text)
        code, text = both >> 32, both & 0xFFFFFFFF
        edge = np.searchsorted(code, [*codes, 1 << 24])
        self.postings = {c.to_bytes(3, "big"): text[i:j] for c, i, j in zip(codes, edge[:-1], edge[1:], strict=True)}

    def ask(self, q: Query) -> np.ndarray:
        """Numbers of the texts that meet the query, ascending."""
        if q is None:
            return np.arange(self.n)
        if isinstance(q, bytes):
            return self.postings[q]
        parts = [self.ask(p) for p in q[1]]
        if q[0] == "any":
            return np.unique(np.concatenate(parts))
        out = min(parts, key=len)
        for p in parts:
            if p is not out:
                out = np.intersect1d(out, p, assume_unique=True)
        return out
