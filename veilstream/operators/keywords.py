"""Custom keywords: literal, whole-word, each rule against every text.

A few rules are unrolled into one expression.  A long list goes to the tasks as one packed automaton, which finds the
places of all keywords in one pass over a text; the plan then has one size whatever the list's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilstream.functions.spans import spans
from veilstream.operators.detectors import FINDING, FINDINGS


@dataclass(frozen=True)
class KeywordRule:
    pattern: str
    action: str = "Redact"
    case_sensitive: bool = False


_WORD_CHAR = r"[\p{IsAlphabetic}\p{N}_]"
#: rules that are unrolled
UNROLLED = 16


def _rule_findings(text: Column, rule: KeywordRule) -> Column:
    literal = ("" if rule.case_sensitive else "(?iu)") + "".join(re.escape(c) if c.isascii() else c for c in rule.pattern)
    masked = f"[REDACTED_{rule.pattern.upper().replace(' ', '_')}]"
    within = F.lit(_WORD_CHAR)

    def alone(s: Column) -> Column:
        return ~F.rlike(F.right(s["before"], F.lit(1)), within) & ~F.rlike(F.left(s["after"], F.lit(1)), within)

    def finding(s: Column) -> Column:
        return F.struct(
            F.lit("CustomKeyword").alias("category"), F.lit(rule.pattern).alias("match_name"), s["snippet"].alias("snippet"), F.lit("MEDIUM").alias("severity"), F.lit(masked).alias("redacted_replacement")
        ).cast(FINDING)

    return F.when(F.rlike(text, F.lit(literal)), F.transform(F.filter(spans(text, literal), alone), finding)).otherwise(F.array().cast(FINDINGS))


@lru_cache(maxsize=1 << 16)
def _simple_fold(c: str) -> str:
    """The one character that stands for a character and its other cases."""
    if c == "\u0130":  # its lower case of one character
        return "i"
    up = c.upper()
    low = (up if len(up) == 1 else c).lower()
    return low if len(low) == 1 else c


def fold(text: str) -> str:
    """Text without regard to case, of the same length."""
    return text.lower() if text.isascii() else "".join(map(_simple_fold, text))


_IN_WORD = regex.compile(r"[\p{Alphabetic}\p{N}_]")


class KeywordAutomaton:
    """All rules of a list; findings come by rule, and by place within one."""

    def __init__(self, rules: list[KeywordRule]):
        self.rules = rules
        self.exact, self.folded = (self._packed(rules, sensitive) for sensitive in (True, False))

    @staticmethod
    def _packed(rules: list[KeywordRule], sensitive: bool) -> ahocorasick.Automaton | None:
        numbers: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            if r.pattern and r.case_sensitive == sensitive:
                numbers.setdefault(r.pattern if sensitive else fold(r.pattern), []).append(i)
        if not numbers:
            return None
        packed = ahocorasick.Automaton()
        for word, own in numbers.items():
            packed.add_word(word, (len(word), own))
        packed.make_automaton()
        return packed

    def places(self, text: str) -> list[tuple[int, int, int]]:
        """(rule, start, end).  Of one rule's places that overlap the first counts, be it within a word or not."""
        found: dict[tuple[bool, int], list] = {}
        for sensitive, packed, read in ((True, self.exact, text), (False, self.folded, None)):
            if packed is None:
                continue
            for end, (size, own) in packed.iter(fold(text) if read is None else read):
                last = found.setdefault((sensitive, own[0]), [-1, own])
                start = end + 1 - size
                if start >= last[0]:
                    last[0] = end + 1
                    if not (start and _IN_WORD.match(text[start - 1])) and not (end + 1 < len(text) and _IN_WORD.match(text[end + 1])):
                        last.append((start, end + 1))
        return sorted((rule, a, b) for _, own, *spans in found.values() for rule in own for a, b in spans)

    def findings(self, text: str) -> list[dict]:
        return [
            {"category": "CustomKeyword", "match_name": (p := self.rules[rule].pattern), "snippet": text[a:b], "severity": "MEDIUM", "redacted_replacement": f"[REDACTED_{p.upper().replace(' ', '_')}]"}
            for rule, a, b in self.places(text)
        ]


@lru_cache(maxsize=4)
def _automaton(rules: tuple[KeywordRule, ...]) -> KeywordAutomaton:
    """One a process and list."""
    return KeywordAutomaton(list(rules))


_ARROW = pa.list_(pa.struct([(n, pa.string()) for n in ("category", "match_name", "snippet", "severity", "redacted_replacement")]))


def _packed_findings(text: Column, rules: list[KeywordRule]) -> Column:
    own = tuple(rules)

    def find(texts: pa.Array) -> pa.Array:
        automaton = _automaton(own)
        return pa.array((automaton.findings(t) if t else [] for t in texts.to_pylist()), _ARROW)

    return F.arrow_udf(find, FINDINGS)(text)


def keyword_findings(text: Column, rules: list[KeywordRule]) -> Column:
    """Findings in the order of the rules; a hit within a word is passed over, and the search goes on behind it.

    text: as ``detectors.prepared`` gives it.
    """
    rules = [rule for rule in rules if rule.pattern]
    if len(rules) > UNROLLED:
        return _packed_findings(text, rules)
    parts = [_rule_findings(text, rule) for rule in rules]
    return F.concat(*parts) if parts else F.array().cast(FINDINGS)
