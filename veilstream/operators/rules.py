"""Rules over findings and risk: a condition tree is compiled on the driver to one boolean Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilstream.operators.risk import band_rank

# Actions from weakest to strongest.
ACTIONS = ["Allow", "Audit", "Warn", "Redact", "RequireApproval", "Block"]


def rank(action: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, ACTIONS)), action) - 1).cast("int")


def action_of(rank_: Column) -> Column:
    return F.get(F.array(*map(F.lit, ACTIONS)), rank_)


def enforced(action: Column) -> Column:
    """Approval cannot be waited for, so it blocks."""
    return F.when(action == "RequireApproval", F.lit("Block")).otherwise(action)


def compile_condition(condition: dict, row: dict[str, Column]) -> Column:
    """A condition such as {"all": [{"category": "Pii"}, {"not": {"risk_at_least": 50}}]}.

    row: columns findings, and, where conditions ask for them, risk (struct), public_app, device_violations,
    user_violations.  Without a risk score, conditions on it are false.
    """
    (kind, arg), *rest = condition.items()
    if rest:
        raise ValueError(f"a condition has one kind: {condition}")
    if kind == "all":
        return reduce(lambda a, b: a & b, (compile_condition(c, row) for c in arg), F.lit(True))
    if kind == "any":
        return reduce(lambda a, b: a | b, (compile_condition(c, row) for c in arg), F.lit(False))
    if kind == "not":
        return ~compile_condition(arg, row)
    if kind == "category":
        return F.exists(row["findings"], lambda f: f["category"] == arg)
    if kind == "category_count":
        name, least = arg
        return F.size(F.filter(row["findings"], lambda f: f["category"] == name)) >= least
    if kind == "public_app":
        return F.coalesce(row.get("public_app", F.lit(False)), F.lit(False)) == F.lit(bool(arg))
    if kind == "risk_at_least":
        return F.coalesce(row["risk"]["total"] >= arg, F.lit(False)) if "risk" in row else F.lit(False)
    if kind == "band_at_least":
        return F.coalesce(band_rank(row["risk"]["band"]) >= band_rank(F.lit(arg)), F.lit(False)) if "risk" in row else F.lit(False)
    if kind in ("device_violations", "user_violations"):
        return F.coalesce(row.get(kind, F.lit(0)), F.lit(0)) >= arg
    raise ValueError(f"unknown condition {kind}")


def matched(rules: list[dict], row: dict[str, Column]) -> Column:
    """array<struct<name, action>> of the rules that hold, in their order."""
    if not rules:
        return F.array().cast("array<struct<name:string,action:string>>")
    held = [F.when(compile_condition(r["condition"], row), F.struct(F.lit(r["name"]).alias("name"), F.lit(r["action"]).alias("action"))) for r in rules]
    return F.filter(F.array(*held), lambda x: x.isNotNull())


def worst(actions: Column) -> Column:
    """Strongest action of an array of actions; null if it is empty."""
    return action_of(F.array_max(F.transform(actions, rank)))
