"""Policy: which categories count, what each of them leads to, and what rules add."""

from __future__ import annotations

import json
from copy import deepcopy

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilstream.operators.keywords import UNROLLED, KeywordRule
from veilstream.operators.rules import ACTIONS, action_of, matched, rank

# The default action of each category.
CATEGORY_ACTION = {"Secret": "Redact", "Pii": "Redact", "Financial": "Redact", "Internal": "Redact", "CustomKeyword": "Redact", "PromptInjection": "Block", "Toxicity": "Warn"}

DEFAULT = {
    "default_action": "Allow",
    "detectors": dict.fromkeys(CATEGORY_ACTION, True),
    "actions": CATEGORY_ACTION,
    "unmaskable_file_action": "Block",
    "paused_until": None,
    "keywords": [],
    "rules": [],
    "applications": [],
    "uploads": {},
    "response_scan": True,
    "entropy": False,
}


def policy(**changes) -> dict:
    """The default policy with changes; maps are merged, all else is replaced."""
    out = deepcopy(DEFAULT)
    for k, v in changes.items():
        if k not in out:
            raise ValueError(f"unknown part of a policy: {k}")
        out[k] = {**out[k], **v} if isinstance(out[k], dict) else v
    for action in (out["default_action"], *out["actions"].values(), *(r["action"] for r in out["rules"])):
        if action not in ACTIONS:
            raise ValueError(f"unknown action {action}")
    return out


def payment_pack(base: dict) -> dict:
    """Card data is blocked, and a named rule says so."""
    rule = {"name": "pci_dss_v1: block cardholder data", "condition": {"category": "Financial"}, "action": "Block"}
    return {**base, "actions": {**base["actions"], "Financial": "Block"}, "rules": [*base["rules"], rule]}


def keyword_rules(p: dict) -> list[KeywordRule]:
    return [k if isinstance(k, KeywordRule) else KeywordRule(**k) for k in p["keywords"]]


def active(findings: Column, p: dict) -> Column:
    """Findings whose category is not switched off; a category the policy does not know is on."""
    off = [c for c, on in p["detectors"].items() if not on]
    return F.filter(findings, lambda f: ~f["category"].isin(off)) if off else findings


def finding_action(f: Column, p: dict) -> Column:
    """A keyword's own action (first rule of that pattern), else its category's, else the default."""
    out = F.when(F.lit(False), F.lit(""))
    rules = keyword_rules(p)
    if len(rules) > UNROLLED:  # one constant, however many
        first = {rule.pattern: rule.action for rule in reversed(rules)}
        own = F.try_element_at(F.from_json(F.lit(json.dumps(first)), "map<string,string>"), f["match_name"])
        out = out.when((f["category"] == "CustomKeyword") & own.isNotNull(), own)
        rules = []
    for rule in rules:
        out = out.when((f["category"] == "CustomKeyword") & (f["match_name"] == rule.pattern), F.lit(rule.action))
    for category, action in p["actions"].items():
        out = out.when(f["category"] == category, F.lit(action))
    return out.otherwise(F.lit(p["default_action"]))


def category_action(findings: Column, p: dict) -> Column:
    """Strongest action of the active findings; Allow without any."""
    ranks = F.transform(active(findings, p), lambda f: rank(finding_action(f, p)))
    return action_of(F.coalesce(F.array_max(ranks), F.lit(0)))


def decide(findings: Column, p: dict, row: dict[str, Column]) -> Column:
    """struct<action, matched_rules>; rules see all findings and win only if they are stronger."""
    held = matched(p["rules"], {**row, "findings": findings})
    own = rank(category_action(findings, p))
    ruled = F.array_max(F.transform(held, lambda r: rank(r["action"])))
    return F.struct(action_of(F.greatest(own, F.coalesce(ruled, F.lit(-1)))).alias("action"), F.transform(held, lambda r: r["name"]).alias("matched_rules"))
