"""Inspection of texts under a policy: findings, risk, rules, action and masked text, all within the row.

Requests look for secrets, injection, personal data, tone, pluggable scanners, entropy and keywords, in this order,
and mask only if the action is Redact.  Responses do not look for injection and always mask.  Categories that are
switched off are neither shown nor masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.operators import detectors as D
from veilstream.operators.keywords import keyword_findings
from veilstream.operators.policy import active, decide, keyword_rules
from veilstream.operators.redact import redact, redact_any
from veilstream.operators.risk import context_points, score

_IN_RESPONSES = [*D.SECRETS, *D.PII, *D.GUARDRAILS]


def findings_of(text: Column, p: dict, response: bool = False, scanners: list | None = None, known: Column | None = None, early: list | None = None) -> Column:
    """text, known: as ``detectors.prepared`` and ``detectors.seen`` give them.

    Pluggable models are functions from the text column to a findings column: early ones (a second look for
    injection, requests only) come before personal data, scanners after tone.
    """
    parts = [D.detect(text, D.SECRETS, known)]
    if not response:
        parts.append(D.detect(text, D.INJECTION, known))
        parts += [scan(text) for scan in early or []]
    parts += [D.detect(text, D.PII, known), D.detect(text, D.GUARDRAILS, known)]
    parts += [scan(text) for scan in scanners or []]
    if p["entropy"]:
        parts.append(D.entropy_findings(text))
    parts.append(keyword_findings(text, keyword_rules(p)))
    return F.concat(*parts)


def inspect(df: DataFrame, p: dict, text: str = "text", response: bool = False, context: dict[str, Column] | None = None, now: Column | None = None, scanners: list | None = None, json_aware: bool = False, early: list | None = None) -> DataFrame:
    """df with findings, risk, action, matched_rules, sanitized.

    context: columns public_app, device_violations, user_violations, sensitivity.  now: unix seconds, for policies
    that are paused until a time; a paused policy allows everything and finds nothing.
    """
    context = context or {}
    if response and not p["response_scan"]:
        return _unscanned(df, text)
    clean = df.withColumn("_text", D.prepared(F.col(text))).withColumn("_seen", D.seen(F.col("_text"), _IN_RESPONSES if response else None))
    found = clean.withColumn("findings", findings_of(F.col("_text"), p, response, scanners, F.col("_seen"), early)).drop("_text", "_seen")
    around = context_points(context.get("public_app"), context.get("device_violations"), context.get("user_violations"), context.get("sensitivity"))
    scored = found.withColumn("risk", score(F.col("findings"), around))
    row = {"risk": F.col("risk"), **{k: v for k, v in context.items() if k != "sensitivity"}}
    decided = scored.withColumn("_decision", decide(F.col("findings"), p, row))
    kept = active(F.col("findings"), p)
    masked = (redact_any if json_aware else redact)(F.col(text), kept)
    out = decided.withColumns(
        {
            "action": F.col("_decision.action"),
            "matched_rules": F.col("_decision.matched_rules"),
            "findings": kept,
            "sanitized": masked if response else F.when(F.col("_decision.action") == "Redact", masked).otherwise(F.col(text)),
        }
    ).drop("_decision")
    if p["paused_until"] is None:
        return out
    paused = (now if now is not None else F.unix_timestamp()) < F.lit(p["paused_until"])
    idle = _unscanned(df, text).where(paused)
    return out.where(~paused).unionByName(idle)


def _unscanned(df: DataFrame, text: str) -> DataFrame:
    none = F.array().cast(D.FINDINGS)
    return df.withColumns({"findings": none, "risk": score(none), "action": F.lit("Allow"), "matched_rules": F.array().cast("array<string>"), "sanitized": F.col(text)})


def verified(df: DataFrame, verifier: Column, for_file: bool = False) -> DataFrame:
    """Where the action is Allow, a second opinion: verifier is a findings column (a model's); any finding of it
    turns the action to Redact (Block for files), takes the place of the findings and is masked."""
    doubt = (F.col("action") == "Allow") & (F.size(verifier) > 0)
    return (
        df.withColumn("_more", F.when(doubt, verifier))
        .withColumn("action", F.when(F.col("_more").isNotNull(), F.lit("Block" if for_file else "Redact")).otherwise(F.col("action")))
        .withColumn("sanitized", F.when(F.col("_more").isNotNull(), redact(F.col("sanitized"), F.col("_more"))).otherwise(F.col("sanitized")))
        .withColumn("findings", F.coalesce("_more", "findings"))
        .drop("_more")
    )


def explode_findings(df: DataFrame, key: str) -> DataFrame:
    """A row for each finding: key, seq (scan order from 0), category, match_name, snippet, severity, redacted_replacement."""
    # outer: the inner form would first test the size of the array, and so detect everything twice
    return df.select(key, F.posexplode_outer("findings").alias("seq", "f")).where("f is not null").select(key, "seq", "f.*")
