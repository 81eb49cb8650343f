"""Responses that come in pieces: all but the last bytes are released at once, and scanned piece by piece.

The fold is one function; the batch form runs it over each stream's chunks, the streaming form keeps its buffer as
state until the stream ends or breaks off.  Scanning is then stateless (``inspect`` with response=True) on the pieces,
and a blocked piece ends its stream.

A fixed number of bytes still cuts what is longer or begins earlier.  Given detectors, a piece ends only where none of
their matches is under way: ``regex`` tells whether the end of the buffer may be the beginning of a match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilstream.functions.spans import AROUND
from veilstream.operators.detectors import ODD, PII, SECRETS, Detector
from veilstream.streaming.state import IDLE_SECONDS, Fold, folded, folded_table

HOLD_BACK = 512
PIECES = "stream_id string, piece_no long, text string"
#: characters behind a match that may still change it, and characters that are held for a match under way at most
SETTLED, LONGEST = 64, 1 << 16


def release(buffer: bytes, chunk: bytes, last: bool, hold: int = HOLD_BACK, whole: tuple[str, ...] = ()) -> tuple[bytes, bytes]:
    """(what may go, what stays); whole: patterns whose matches are not cut."""
    buffer += chunk
    n = len(buffer) if last else max(0, len(buffer) - hold)
    if whole and not last and n:
        n = _outside_matches(buffer, n, whole)
    return buffer[:n], buffer[n:]


class _Watch:
    """Patterns by where their matches can begin, from what the detectors tell of them (``Detector.gaps``).

    No match without white space goes beyond a word, and one with white space holds what it needs before it: a match
    begins in a word that holds a digit or literal, or (a match under way) in the last word.  Others are looked for
    everywhere.
    """

    def __init__(self, patterns: tuple[str, ...]):
        import regex

        known = {d.pattern: d for d in [*SECRETS, *PII] if d.gaps != "any"}
        self.digit = regex.compile(r"\d")
        self.anywhere, self.in_word, self.from_word, self.worded = [], [], [], []
        for p in patterns:
            d, compiled = known.get(p), regex.compile(p)
            if d is None or not (d.digits or d.needs):
                self.anywhere.append(compiled)
            elif d.digits:
                (self.in_word if d.gaps == "none" else self.from_word).append(compiled)
            else:
                self.worded.append((compiled, d.needs))
        self.literals = sorted({w for _, needs in self.worded for words in needs for w in words})
        self.last_word, self.digit_word = lru_cache(maxsize=1 << 14)(self._last_word), lru_cache(maxsize=1 << 14)(self._digit_word)

    def _last_word(self, word: str) -> tuple[tuple[int, object], ...]:
        """(start, pattern) of the matches that may be under way in a last word, the first of each pattern."""
        out = []
        for p in [*self.in_word, *self.from_word, *(p for p, _ in self.worded)]:
            start = next((m.start() for m in p.finditer(word, partial=True) if m.partial), len(word))
            if start < len(word):
                out.append((start, p))
        return tuple(sorted(out, key=lambda x: x[0]))

    def _digit_word(self, word: str, ends: bool) -> tuple[tuple[int, int, bool], ...]:
        """(start, end, whether it is under way) of the matches within a word that holds a digit; ends: with the text."""
        return tuple((*m.span(), m.partial) for p in self.in_word for m in p.finditer(word, partial=ends))

    def matches(self, text: str, last: int) -> list[tuple[int, int, bool]]:
        """(start, end, whether it is under way) of all matches; last: where the last word begins."""
        out = []

        def look(p, begin: int = 0) -> None:
            out.extend((*m.span(), m.partial) for m in p.finditer(text, begin, partial=True))

        for p in self.anywhere:
            look(p)
        low = None if any(c in text for c in ODD) else text.lower()
        held = {w for w in self.literals if low is None or w in low}
        searched = set()  # patterns whose matches in the last word are among those found
        if held:
            for p, needs in self.worded:
                if not any(held.isdisjoint(words) for words in needs):
                    look(p)
                    searched.add(p)
        digit = self.digit.search(text)
        if digit is not None:
            for p in self.from_word:
                look(p, _behind_space(text, digit.start()))
            searched.update(self.from_word)
        while digit is not None:
            begin, space = _behind_space(text, digit.start()), _SPACE.search(text, digit.end())
            end = len(text) if space is None else space.start()
            if end == len(text):
                searched.update(self.in_word)
            in_word = self.digit_word if end - begin <= _SHORT else self._digit_word
            out += [(begin + a, begin + b, under_way) for a, b, under_way in in_word(text[begin:end], end == len(text))]
            digit = self.digit.search(text, end)
        if last < len(text):
            word = text[last:]
            begun = self.last_word(word) if len(word) <= _SHORT else self._last_word(word)
            start = next((at for at, p in begun if p not in searched), None)
            if start is not None:
                out.append((last + start, len(text), True))
        return out


_watch = lru_cache(maxsize=8)(_Watch)
_SPACE = re.compile(r"\s")
#: characters of words that are remembered
_SHORT = 64


def _outside_matches(buffer: bytes, n: int, patterns: tuple[str, ...]) -> int:
    """The last place up to n, behind white space, that no match (with what stands around it) reaches over."""
    text = buffer.decode("utf-8", "surrogateescape")
    upto = len(text) if n == len(buffer) else len(buffer[:n].decode("utf-8", "surrogateescape"))
    cut = _behind_space(text, min(upto, len(text) - AROUND))
    floor = max(0, len(text) - LONGEST)
    if cut > floor:
        last = len(text) if text[-1].isspace() else len(text) - len(text.rsplit(None, 1)[-1])
        reach = []
        for start, end, under_way in _watch(patterns).matches(text, last):
            growing = under_way or end + SETTLED > len(text) or end >= last
            reach.append((start - AROUND, len(text) + 1 if growing else end + AROUND))
        while cut > 0:  # a place that is clear of one match may lie in an earlier one
            over = min((s for s, e in reach if s < cut < e), default=None)
            if over is None:
                break
            cut = _behind_space(text, over)
    return len(text[: max(cut, floor)].encode("utf-8", "surrogateescape"))


def _behind_space(text: str, at: int) -> int:
    """The last place up to there that stands behind white space."""
    while at > 0 and not text[at - 1].isspace():
        at -= 1
    return max(at, 0)


def patterns_of(detectors: list[Detector] | None) -> tuple[str, ...]:
    return tuple(dict.fromkeys(d.pattern for d in detectors or []))


def pieces_of(chunks: Iterator[tuple[bytes, bool]], hold: int = HOLD_BACK, whole: tuple[str, ...] = ()) -> list[str]:
    buffer, out = b"", []
    for chunk, last in chunks:
        piece, buffer = release(buffer, chunk, last, hold, whole)
        if piece:
            out.append(piece.decode("utf-8", "replace"))
    return out


def pieces(chunks: DataFrame, hold: int = HOLD_BACK, whole: list[Detector] | None = None) -> DataFrame:
    """Batch: chunks (stream_id, chunk_no, bytes) to pieces (stream_id, piece_no, text).

    whole: detectors whose matches, up to LONGEST characters, stand in one piece with what their context needs.
    """
    return folded_table(chunks, _Pieces(hold, patterns_of(whole)))


class _Pieces(Fold):
    state, output = "buffer binary, n long", "piece_no long, text string"

    def __init__(self, hold: int, whole: tuple[str, ...]):
        self.hold, self.whole = hold, whole

    def begin(self) -> tuple:
        return b"", 0

    def step(self, state, chunk_no, chunk, last):
        piece, buffer = release(bytes(state[0]), chunk, last, self.hold, self.whole)
        return ([(state[1], piece.decode("utf-8", "replace"))], (buffer, state[1] + 1)) if piece else ([], (buffer, state[1]))

    def broken_off(self, state):
        return self.step(state, -1, b"", True)[0]


def pieces_stream(chunks: DataFrame, hold: int = HOLD_BACK, whole: list[Detector] | None = None, idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """Streaming: chunks (stream_id, chunk_no, bytes, last) to pieces; chunks of a stream come in order of chunk_no.  A
    stream without chunks for so many seconds has broken off: what was held back goes out, and its state ends."""
    return folded(chunks, _Pieces(hold, patterns_of(whole)), idle_seconds)


def until_blocked(scanned: DataFrame) -> DataFrame:
    """Scanned pieces (stream_id, piece_no, action) before the first blocked one of their stream."""
    before = Window.partitionBy("stream_id").orderBy("piece_no")
    stopped = F.max(F.col("action").isin("Block", "RequireApproval").cast("int")).over(before)
    return scanned.withColumn("_stopped", stopped).where("_stopped = 0").drop("_stopped")
