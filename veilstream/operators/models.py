"""Slots for models that find, judge or translate: functions that run in Arrow batches, none of them shipped.

A model that finds gets texts and gives, for each, entities (type, start, end, score); what is sure enough becomes
findings.  ``slot`` makes it a scanner for ``inspect(scanners=[...])``, or a verifier column for ``verified``.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: an entity below this score is no finding
THRESHOLD = 0.4

_FINDINGS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("category", "match_name", "snippet", "severity", "redacted_replacement")]))


def entity_findings(text: str, entities: list[dict], category: str = "Pii", severity: str = "MEDIUM", threshold: float = THRESHOLD) -> list[dict]:
    return [
        {"category": category, "match_name": e["type"], "snippet": text[e["start"] : e["end"]], "severity": severity, "redacted_replacement": f"[REDACTED_{e['type']}]"}
        for e in entities
        if round(e["score"], 2) >= threshold and 0 <= e["start"] < e["end"] <= len(text)
    ]


def slot(model: Callable[[list[str]], list[list[dict]]], **options) -> Callable[[Column], Column]:
    """A scanner out of a model that takes a batch of texts; a model that fails on a batch finds nothing in it, which
    the executor's log tells.  With strict=True the failure is the job's."""
    strict = options.pop("strict", False)

    @F.pandas_udf(_FINDINGS)
    def scan(text: pd.Series) -> pd.Series:
        texts = [t or "" for t in text]
        try:
            found = model(texts)
        except Exception:  # a broken model must not stop the other detectors
            if strict:
                raise
            logging.getLogger(__name__).exception("a model failed on %d texts; nothing is found in them", len(texts))
            found = [[] for _ in texts]
        return pd.Series([entity_findings(t, es, **options) for t, es in zip(texts, found, strict=True)])

    return lambda text: scan(text)


#: provider -> (request, response) translation of JSON bodies; providers of the common form need none
Translation = Callable[[str], str]
TRANSLATIONS: dict[str, tuple[Translation, Translation]] = {}


def translated(provider: Column, body: Column, response: bool = False) -> Column:
    """Bodies in the provider's form; those of providers without a translation reach Python as nulls only."""
    use = {k: v[response] for k, v in TRANSLATIONS.items()}
    if not use:
        return body

    @F.pandas_udf(T.StringType())
    def run(who: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([use[w](t) if t is not None else None for w, t in zip(who, text, strict=True)], dtype=object)

    own = provider.isin(list(use))
    return F.when(own, run(provider, F.when(own, body))).otherwise(body)


def status(p: dict, versions: dict, n_profiles: int, now: int) -> dict:
    """The engine's state in one record: what the policy holds, where it came from, and whether it is paused."""
    left = max((p["paused_until"] or 0) - now, 0)
    return {"applications": len(p["applications"]), "keywords": len(p["keywords"]), "rules": len(p["rules"]), "profiles": n_profiles, "pause_left": left or None, **versions}
