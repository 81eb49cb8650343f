"""Masking: every occurrence of a finding's snippet is replaced, findings in order, each seeing the earlier ones' output.

Few findings of a short text are replaced one after the other in SQL.  For all others a ``Masker`` gives the same
result in time linear in the text: where no replacement can touch a snippet, all replacements fall on the text as it
was, so one Aho-Corasick pass finds every place of every snippet, and the places are claimed in the order of the findings.
"""

from __future__ import annotations

import json
import re

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Extensions of formats that stay valid when their text is replaced.
TEXT_EXTENSIONS = ["txt", "md", "csv", "json", "log", "yaml", "yml", "xml", "html", "htm"]
#: characters that SQL reads again for each finding of a text: findings times length
IN_SQL = 1 << 20
#: findings that are replaced one by one in Python too
FEW = 8


class Masker:
    """The replacements of a list of (snippet, replacement), for any number of texts.

    A snippet is free if no replacement can be part of one of its later occurrences: it does not stand in a
    replacement, holds none, begins with no end of one and ends with no beginning of one.  A free snippet then only
    ever occurs where the text is still as it was, and once it has been replaced it never occurs again, so of
    equal ones the first counts.  Neighbouring free snippets are claimed together; one that is not free is replaced
    in the whole text, unless nothing has changed since it last had no effect.
    """

    def __init__(self, pairs: list[tuple[str, str | None]]):
        pairs = [(s, r) for s, r in pairs if s and r is not None]
        self.few = pairs if len(pairs) <= FEW else None
        if self.few is None:
            self.steps = self._steps(pairs)

    @staticmethod
    def _steps(pairs: list[tuple[str, str]]) -> list[tuple]:
        masks = {r for _, r in pairs}
        begins = {r[:k] for r in masks for k in range(1, len(r) + 1)}
        ends = {r[-k:] for r in masks for k in range(1, len(r) + 1)}
        sizes = range(1, max(map(len, masks)) + 1)
        whole = re.compile("|".join(map(re.escape, sorted(masks))))
        # an empty replacement joins what stood apart: then nothing is free
        inside = None if "" in masks else "\0".join(sorted(masks))

        def free(s: str) -> bool:
            if inside is None or s in inside or whole.search(s):
                return False
            return not any(s[-k:] in begins or s[:k] in ends for k in sizes if k < len(s))

        steps: list[tuple] = []
        known: dict[str, bool] = {}
        for s, r in pairs:
            if s not in known:
                known[s] = free(s)
                if known[s]:
                    if not steps or steps[-1][0] is None:
                        steps.append((ahocorasick.Automaton(), []))
                    automaton, replacements = steps[-1]
                    automaton.add_word(s, (len(replacements), len(s)))
                    replacements.append(r)
            if not known[s]:
                steps.append((None, (s, r)))
        for automaton, _ in steps:
            if automaton is not None:
                automaton.make_automaton()
        return steps

    def __call__(self, text: str) -> str:
        if self.few is not None:
            for s, r in self.few:
                text = text.replace(s, r)
            return text
        version, without_effect = 0, {}
        for automaton, what in self.steps:
            if automaton is not None:
                new = _claimed(text, automaton, what)
            else:
                if without_effect.get(what) == version:
                    continue
                new = text.replace(*what)
                if new == text:
                    without_effect[what] = version
            version += new != text
            text = new
        return text


def _claimed(text: str, automaton: ahocorasick.Automaton, replacements: list[str]) -> str:
    """Each place goes to the first snippet in order, and of one snippet's places to the leftmost, as far as it is free."""
    places = [(number, end - size + 1, end + 1) for end, (number, size) in automaton.iter(text)]
    if not places:
        return text
    places.sort()
    taken, kept = bytearray(len(text)), []
    for number, start, end in places:
        if taken.find(1, start, end) < 0:
            taken[start:end] = b"\1" * (end - start)
            kept.append((start, end, number))
    kept.sort()
    out, at = [], 0
    for start, end, number in kept:
        out += [text[at:start], replacements[number]]
        at = end
    return "".join([*out, text[at:]])


def _masker(findings) -> Masker:
    return Masker([(f["snippet"], f["redacted_replacement"]) for f in (findings if findings is not None else [])])


@F.arrow_udf(T.StringType())
def _mask_many(text: pa.Array, findings: pa.Array) -> pa.Array:
    return pa.array((None if t is None else _masker(fs)(t) for t, fs in zip(text.to_pylist(), findings.to_pylist(), strict=True)), pa.string())


def redact(text: Column, findings: Column) -> Column:
    """Plain text.  Only texts for which many findings would be looked for are sent to Python, others as nulls."""
    usable = F.filter(findings, lambda f: f["redacted_replacement"].isNotNull() & (F.length(f["snippet"]) > 0))
    many = (F.size(findings) > FEW) & (F.size(findings) * F.length(text).cast("long") > IN_SQL)
    few = F.aggregate(usable, text, lambda t, f: F.replace(t, f["snippet"], f["redacted_replacement"]))
    return F.when(many, _mask_many(F.when(many, text), F.when(many, findings))).otherwise(few)


def mask_value(value, findings: list | Masker) -> object:
    """String leaves of a JSON value with the findings masked; keys, numbers and structure stay."""
    mask = findings if isinstance(findings, Masker) else _masker(findings)
    if isinstance(value, str):
        return mask(value)
    if isinstance(value, list):
        return [mask_value(v, mask) for v in value]
    if isinstance(value, dict):
        return {k: mask_value(v, mask) for k, v in value.items()}
    return value


@F.pandas_udf(T.StringType())
def _redact_json(text: pd.Series, findings: pd.Series) -> pd.Series:
    def one(t, fs):
        if t is None:
            return None
        try:
            value = json.loads(t)
        except ValueError:
            return None
        return json.dumps(mask_value(value, _masker(fs)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    return pd.Series([one(t, fs) for t, fs in zip(text, findings, strict=True)], dtype=object)


def redact_any(text: Column, findings: Column) -> Column:
    """JSON documents leaf by leaf (compact, keys sorted), everything else as plain text.

    Only texts that can be JSON and have something to mask are sent to Python, others as nulls.
    """
    maybe = F.rlike(text, F.lit(r'^\s*[\[{"0-9tfn-]')) & (F.size(findings) > 0)
    return F.coalesce(_redact_json(F.when(maybe, text), F.when(maybe, findings)), redact(text, findings))
