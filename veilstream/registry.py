"""Registered queries of the engine and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilstream.catalog import ORACLES, QUERIES, Query, query
from veilstream.functions import checks
from veilstream.functions import small as W
from veilstream.operators import audit as A
from veilstream.operators import detectors as D
from veilstream.operators import lookups as L
from veilstream.operators import metrics as M
from veilstream.operators.inspect import explode_findings, inspect
from veilstream.operators.keywords import KeywordRule, keyword_findings
from veilstream.operators.policy import category_action, decide, payment_pack, policy
from veilstream.operators.redact import redact
from veilstream.operators.risk import score_rows
from veilstream.operators.rules import matched
from veilstream.plans import cases as C
from veilstream.plans import oracle as O
from veilstream.plans import planted as P
from veilstream.sources import bodies as B
from veilstream.sources import files as S
from veilstream.streaming import holdback as H
from veilstream.streaming import limits as T
from veilstream.streaming import live as V

NOW = "2024-01-31 00:00:00"
PEOPLE, CASES, AUDIT, FOUND = (f"({x})" for x in (P.people_sql(), C.sql(), P.audit_sql(), P.findings_sql()))


def queries() -> dict[str, Query]:
    from veilstream import registry_values  # noqa: F401  (adds its own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: ORACLES[k] for k in queries() if k in ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document inspected under the default policy."""
    docs = P.spread(_documents(spark, sf_dir))
    out = inspect(docs, policy(entropy=True))
    return out.select("doc_id", "action", F.size("findings").alias("n_findings"), F.col("risk.total").alias("risk"), F.col("risk.band").alias("band"), "sanitized")


# ---- detectors ------------------------------------------------------------------------------------

_SHOWN = ["category", "match_name", "snippet", "severity", "redacted_replacement"]


def _found(df: DataFrame, findings, detectors: list[D.Detector] | None = None) -> DataFrame:
    ready = df.withColumn("_text", D.prepared(F.col("text"))).withColumn("_seen", D.seen(F.col("_text"), detectors))
    return explode_findings(ready.withColumn("findings", findings(F.col("_text"))), "doc_id").drop("seq")


def _findings_query(name: str, detectors: list[D.Detector], relation: str, source) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _found(source(spark, sf_dir), lambda t: D.detect(t, detectors, F.col("_seen")), detectors)

    run.__name__ = name
    query(f"SELECT doc_id, {', '.join(_SHOWN)} FROM ({O.findings(relation, detectors)})")(run)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.load(spark, sf_dir, "documents").select("doc_id", "text")


def _named(*names: str) -> list[D.Detector]:
    return [d for d in D.PII if d.name in names]


_findings_query("pii_findings", D.PII, PEOPLE, P.people)
_findings_query("secret_findings", D.SECRETS, PEOPLE, P.people)
_findings_query("injection_findings", D.INJECTION, PEOPLE, P.people)
_findings_query("tone_findings", D.GUARDRAILS, PEOPLE, P.people)
_findings_query("document_email_findings", _named("EMAIL_ADDRESS"), "documents", _documents)
_findings_query("document_card_findings", _named("CREDIT_CARD"), "documents", _documents)
_findings_query("document_phone_findings", _named("PHONE_NUMBER"), "documents", _documents)
_findings_query("document_secret_findings", D.SECRETS, "documents", lambda spark, sf_dir: P.spread(_documents(spark, sf_dir)))
_findings_query("card_luhn", _named("CREDIT_CARD"), PEOPLE, P.people)
_findings_query("iban_mod97", _named("IBAN_CODE"), PEOPLE, P.people)
_findings_query("routing_checksum", _named("ABA_ROUTING_NUMBER"), PEOPLE, P.people)
_findings_query("verhoeff_checksum", _named("AADHAAR_NUMBER"), PEOPLE, P.people)
_findings_query("gst_checksum", _named("GSTIN"), PEOPLE, P.people)
_findings_query("planted_pii", D.PII, CASES, P.cases)
_findings_query("planted_secrets", D.SECRETS, CASES, P.cases)
_findings_query("planted_injection", D.INJECTION, CASES, P.cases)
_findings_query("planted_tone", D.GUARDRAILS, CASES, P.cases)
_findings_query("near_word_findings", [d for d in D.PII if d.near], PEOPLE, P.people)

_H = "list_sum(list_transform(list_distinct(string_split(snippet, '')), lambda c: -1.0 * len(list_filter(string_split(snippet, ''), lambda y: y = c)) / length(snippet) * log2(1.0 * len(list_filter(string_split(snippet, ''), lambda z: z = c)) / length(snippet))))"


@query(f"SELECT doc_id, snippet, CAST(round({_H}, 6) AS DOUBLE) AS bits FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{D.HEX_SHAPE}')) AS snippet FROM documents)")
def entropy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hexadecimal runs with their entropy (below and above the limit)."""
    runs = _documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(D.UNICODE + D.HEX_SHAPE), F.lit(0))).alias("snippet"))
    return runs.select("doc_id", "snippet", F.round(checks.entropy(F.col("snippet")), 6).alias("bits"))


@query(f"SELECT doc_id, 'HIGH_ENTROPY_HEX' AS match_name, snippet FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{D.HEX_SHAPE}')) AS snippet FROM {PEOPLE}) WHERE {_H} >= {D.HEX_BITS}")
def high_entropy_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(P.people(spark, sf_dir), D.entropy_findings).where("match_name = 'HIGH_ENTROPY_HEX'").select("doc_id", "match_name", "snippet")


_RUNS = f"SELECT doc_id, unnest(regexp_extract_all(text, '{D.BASE64_SHAPE}')) AS snippet FROM {CASES}"


@query(
    f"SELECT doc_id, 'HIGH_ENTROPY_HEX' AS match_name, snippet FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{D.HEX_SHAPE}')) AS snippet FROM {CASES}) WHERE {_H} >= {D.HEX_BITS}"
    f" UNION ALL SELECT doc_id, 'HIGH_ENTROPY_BASE64' AS match_name, snippet FROM ({_RUNS}) WHERE {_H} >= {D.BASE64_BITS} AND NOT regexp_full_match(snippet, '[0-9a-fA-F]+')"
)
def planted_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(P.cases(spark, sf_dir), D.entropy_findings).select("doc_id", "match_name", "snippet")


@query(f"SELECT doc_id, unnest(regexp_extract_all(text, '\\b(falcon|[Pp]roject)\\b')) AS snippet FROM {PEOPLE}")
def custom_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [KeywordRule("Falcon", "Block"), KeywordRule("project"), KeywordRule("absent"), KeywordRule("")]
    return _found(P.people(spark, sf_dir), lambda t: keyword_findings(t, rules)).select("doc_id", "snippet")


_ALL = [*D.SECRETS, *D.INJECTION, *D.PII, *D.GUARDRAILS]


@query(f"SELECT category, severity, count(*) AS n FROM ({O.findings(PEOPLE, _ALL)}) GROUP BY category, severity")
def findings_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(P.people(spark, sf_dir), lambda t: D.detect(t, _ALL, F.col("_seen"))).groupBy("category", "severity").agg(F.count("*").alias("n"))


@query(f"SELECT lang, count(*) AS n, count(DISTINCT doc_id) AS documents FROM ({O.findings('documents', _named('EMAIL_ADDRESS', 'PHONE_NUMBER'))}) JOIN documents USING (doc_id) GROUP BY lang")
def findings_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = P.load(spark, sf_dir, "documents")
    found = docs.withColumn("_text", D.prepared(F.col("text"))).select("doc_id", "lang", F.explode_outer(D.detect(F.col("_text"), _named("EMAIL_ADDRESS", "PHONE_NUMBER"))).alias("f")).where("f is not null")
    return found.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


# ---- masking, risk, rules, policy -----------------------------------------------------------------

_MASKED = _named("EMAIL_ADDRESS", "PHONE_NUMBER", "PAN_CARD", "US_SSN")


def _nested(x: str) -> str:
    for d in _MASKED:
        x = f"regexp_replace({x}, {O.text(d.pattern)}, {O.text(d.replacement)}, 'g')"
    return x


@query(f"SELECT doc_id, {_nested('text')} AS sanitized FROM {PEOPLE}")
def redact_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.people(spark, sf_dir).withColumn("findings", D.detect(F.col("text"), _MASKED))
    return rows.select("doc_id", redact(F.col("text"), F.col("findings")).alias("sanitized"))


@query(f"SELECT doc_id, length({_nested('text')}) AS n_chars, md5({_nested('text')}) AS digest FROM documents")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).withColumn("_seen", D.seen(F.col("text"), _MASKED)).withColumn("findings", D.detect(F.col("text"), _MASKED, F.col("_seen"))).withColumn("sanitized", redact(F.col("text"), F.col("findings")))
    return rows.select("doc_id", F.length("sanitized").cast("long").alias("n_chars"), F.md5(F.col("sanitized").cast("binary")).alias("digest"))


_RISK = f"SELECT doc_id, CAST(least(sum(p), 100) AS INT) AS total FROM (SELECT doc_id, {O.points('category', 'severity', '(row_number() OVER (PARTITION BY doc_id, category ORDER BY seq) - 1)')} AS p FROM {FOUND}) GROUP BY doc_id"


@query(f"SELECT doc_id, total, {O.band('total')} AS band FROM ({_RISK})")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_rows(P.findings(spark, sf_dir), "doc_id")


@query(f"SELECT {O.band('total')} AS band, count(*) AS n FROM ({_RISK}) GROUP BY 1")
def risk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_rows(P.findings(spark, sf_dir), "doc_id").groupBy("band").agg(F.count("*").alias("n"))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("seq", "category", "severity")))
    shaped = F.transform(rows, lambda r: F.struct(r["category"].alias("category"), F.lit("X").alias("match_name"), F.lit("").alias("snippet"), r["severity"].alias("severity"), F.lit(None).cast("string").alias("redacted_replacement")))
    return P.findings(spark, sf_dir).groupBy("doc_id").agg(shaped.alias("findings"))


_RULES = [
    {"name": "many personal", "condition": {"category_count": ["Pii", 3]}, "action": "Redact"},
    {"name": "secret and tone", "condition": {"all": [{"category": "Secret"}, {"not": {"category": "Toxicity"}}]}, "action": "RequireApproval"},
    {"name": "none or always", "condition": {"any": [{"all": []}, {"category": "Nothing"}]}, "action": "Audit"},
]
_HAS = {c: f"count(*) FILTER (category = '{c}')" for c in ("Pii", "Secret", "Toxicity")}


@query(
    f"SELECT doc_id, array_to_string(list_filter([CASE WHEN {_HAS['Pii']} >= 3 THEN 'many personal' END, CASE WHEN {_HAS['Secret']} > 0 AND {_HAS['Toxicity']} = 0 THEN 'secret and tone' END, 'none or always'], lambda x: x IS NOT NULL), '|') AS rules FROM {FOUND} GROUP BY doc_id"
)
def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = matched(_RULES, {"findings": F.col("findings")})
    return _grouped(spark, sf_dir).select("doc_id", F.array_join(F.transform(held, lambda r: r["name"]), "|").alias("rules"))


@query(f"SELECT doc_id, {O.rank_action('r')} AS action FROM (SELECT doc_id, max({O.action_rank(O.category_action('category'))}) AS r FROM {FOUND} GROUP BY doc_id)")
def policy_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).select("doc_id", category_action(F.col("findings"), policy()).alias("action"))


@query(f"SELECT doc_id, {O.rank_action('coalesce(r, 0)')} AS action FROM (SELECT doc_id, max({O.action_rank(O.category_action('category'))}) FILTER (category NOT IN ('PromptInjection', 'Toxicity')) AS r FROM {FOUND} GROUP BY doc_id)")
def disabled_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = policy(detectors={"PromptInjection": False, "Toxicity": False})
    return _grouped(spark, sf_dir).select("doc_id", category_action(F.col("findings"), p).alias("action"))


@query(
    f"SELECT doc_id, {O.rank_action('greatest(r, a)')} AS action FROM (SELECT doc_id, max({O.action_rank(O.category_action('category'))}) FILTER (category <> 'PromptInjection') AS r0, coalesce(r0, 0) AS r, CASE WHEN {_HAS['Secret']} > 0 AND {_HAS['Toxicity']} = 0 THEN 4 WHEN {_HAS['Pii']} >= 3 THEN 3 ELSE 1 END AS a FROM {FOUND} GROUP BY doc_id)"
)
def rule_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = policy(detectors={"PromptInjection": False}, rules=_RULES)
    return _grouped(spark, sf_dir).select("doc_id", decide(F.col("findings"), p, {})["action"].alias("action"))


@query(f"SELECT doc_id, {O.rank_action('r')} AS action FROM (SELECT doc_id, max(CASE WHEN category = 'Financial' THEN 5 ELSE {O.action_rank(O.category_action('category'))} END) AS r FROM {FOUND} GROUP BY doc_id)")
def payment_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).select("doc_id", decide(F.col("findings"), payment_pack(policy()), {})["action"].alias("action"))


def _inspect_oracle(detectors: list[D.Detector], relation: str = PEOPLE, response: bool = False, off: tuple[str, ...] = ()) -> str:
    """off: categories that are switched off: they count for the risk, but neither act, show nor are masked."""
    on = f"category NOT IN ({', '.join(map(O.text, off))})" if off else "true"
    rows = f"SELECT *, {O.points('category', 'severity', '(row_number() OVER (PARTITION BY doc_id, category ORDER BY det, pos) - 1)')} AS p FROM ({O.findings(relation, detectors)})"
    shown = f"list(snippet || chr(2) || redacted_replacement ORDER BY det, pos) FILTER ({on} AND redacted_replacement IS NOT NULL)"
    per = f"SELECT doc_id, count(*) FILTER ({on}) AS n_findings, CAST(least(sum(p), 100) AS INT) AS risk, max({O.action_rank(O.category_action('category'))}) FILTER ({on}) AS r, {shown} AS shown FROM ({rows}) GROUP BY doc_id"
    masked = f"CASE WHEN shown IS NULL THEN text ELSE {O.masked('text', 'shown')} END"
    if not response:
        masked = f"CASE WHEN {O.rank_action('coalesce(r, 0)')} = 'Redact' THEN {masked} ELSE text END"
    return f"SELECT doc_id, {O.rank_action('coalesce(r, 0)')} AS action, CAST(coalesce(n_findings, 0) AS INT) AS n_findings, coalesce(risk, 0) AS risk, {O.band('coalesce(risk, 0)')} AS band, {masked} AS sanitized FROM {relation} LEFT JOIN ({per}) USING (doc_id)"


def _inspected(docs: DataFrame, response: bool = False, **changes) -> DataFrame:
    out = inspect(docs, policy(**changes), response=response)
    return out.select("doc_id", "action", F.size("findings").alias("n_findings"), F.col("risk.total").alias("risk"), F.col("risk.band").alias("band"), "sanitized")


_ANSWER = [*D.SECRETS, *D.PII, *D.GUARDRAILS]


@query(_inspect_oracle(_ALL))
def inspect_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inspected(P.people(spark, sf_dir))


@query(_inspect_oracle(_ANSWER, response=True))
def inspect_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inspected(P.people(spark, sf_dir), True)


@query(_inspect_oracle(_ALL, CASES))
def inspect_odd_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that every detector hits and misses, control characters, overlaps, empty texts."""
    return _inspected(P.cases(spark, sf_dir))


@query(_inspect_oracle(_ANSWER, CASES, response=True))
def inspect_odd_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inspected(P.cases(spark, sf_dir), True)


@query(_inspect_oracle(_ALL, CASES, off=("Pii", "Toxicity")))
def inspect_switched_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inspected(P.cases(spark, sf_dir), detectors={"Pii": False, "Toxicity": False})


# ---- audit ----------------------------------------------------------------------------------------

_KEPT = "id, tenant_id, event_type, action_taken, domain, user_identity, finding_count, synced"


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.audit(spark, sf_dir).withColumn("findings", F.array().cast(D.FINDINGS))


def _kept(df: DataFrame) -> DataFrame:
    return df.select(*_KEPT.split(", "))


@query(f"SELECT id, event_type, action_taken, domain FROM {AUDIT} WHERE tenant_id = 'tenant1' AND timestamp BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'")
def audit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    since, until = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-10 00:00:00", "2024-01-12 00:00:00"))
    return A.window(_audit(spark, sf_dir), "tenant1", since, until).select("id", "event_type", "action_taken", "domain")


_RECENT = f"FROM {AUDIT} WHERE tenant_id = 'tenant2' AND timestamp >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND timestamp <= TIMESTAMP '{NOW}' AND action_taken = 'Block' AND contains(lower(domain), 'example')"


@query(f"SELECT id, event_type, action_taken, domain {_RECENT} ORDER BY timestamp DESC, id LIMIT 20 OFFSET 5")
def audit_recent_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.recent(_audit(spark, sf_dir), "tenant2", F.lit(NOW).cast("timestamp_ntz"), limit=20, offset=5, action="Block", domain="EXAMPLE").select("id", "event_type", "action_taken", "domain")


@query(f"SELECT greatest(least(n - 5, 20), 0) AS returned, n AS total_matching, 5 AS offset, n > 5 + greatest(least(n - 5, 20), 0) AS has_more, 7 AS window_days FROM (SELECT count(*) AS n {_RECENT})")
def audit_recent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.recent_summary(_audit(spark, sf_dir), "tenant2", F.lit(NOW).cast("timestamp_ntz"), limit=20, offset=5, action="Block", domain="EXAMPLE")


@query(f"SELECT {_KEPT} FROM {AUDIT} WHERE tenant_id = 'tenant0' AND synced = 0 ORDER BY timestamp, id LIMIT 100")
def audit_unsynced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(A.unsynced(_audit(spark, sf_dir), "tenant0", 100))


@query(f"SELECT tenant_id, count(*) AS events, count(*) FILTER (synced = 0) AS unsynced FROM {AUDIT} GROUP BY tenant_id")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.counts(_audit(spark, sf_dir))


@query(f"SELECT id, tenant_id, event_type, action_taken, domain, user_identity, finding_count, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 1 ELSE synced END AS synced FROM {AUDIT}")
def audit_mark_synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _audit(spark, sf_dir)
    return _kept(A.mark_synced(events, events.where(F.col("id").cast("long") % 5 == 0).select("id")))


@query(f"SELECT {_KEPT} FROM {AUDIT} WHERE timestamp >= TIMESTAMP '2024-01-20 00:00:00'")
def audit_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(A.purge_before(_audit(spark, sf_dir), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")))


@query(f"SELECT {_KEPT} FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY timestamp DESC, id) AS r FROM {AUDIT}) WHERE r <= 250")
def audit_keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(A.keep_newest(_audit(spark, sf_dir), 250))


@query(f"SELECT {_KEPT} FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY timestamp DESC, id) AS r FROM {AUDIT} WHERE timestamp >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY) WHERE r <= 500")
def audit_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(A.retain(_audit(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"), 10, 500))


@query(
    f"""SELECT id, id || ',' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || 'Z,' || event_type || ',' || action_taken || ',' || app_name || ',' || CASE WHEN regexp_matches(domain, '[,"\\n]') THEN '"' || replace(domain, '"', '""') || '"' ELSE domain END || ',' || user_identity || ',' || CAST(finding_count AS VARCHAR) AS line FROM {AUDIT} WHERE tenant_id = 'tenant1' AND timestamp >= TIMESTAMP '{NOW}' - INTERVAL 3 DAY AND timestamp <= TIMESTAMP '{NOW}'"""
)
def audit_csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _audit(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return A.export(events, "csv", "tenant1", F.lit(f"{NOW} UTC").cast("timestamp"), 3)


@query(f"SELECT doc_id, true AS same, true AS hidden FROM {PEOPLE}")
def audit_sealed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings encrypted and read back; the nonce differs each time, so only the round trip can be compared."""
    rows = P.people(spark, sf_dir).withColumn("findings", D.detect(F.col("text"), D.SECRETS)).withColumn("sealed", A.sealed(F.col("findings"), "key"))
    return rows.select("doc_id", (A.unsealed(F.col("sealed"), "key") == F.col("findings")).alias("same"), A.unsealed(F.col("sealed"), "other", strict=False).isNull().alias("hidden"))


# ---- metrics --------------------------------------------------------------------------------------

@query(f"SELECT event_type, action_taken, count(*) AS requests FROM {AUDIT} GROUP BY event_type, action_taken")
def requests_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.requests_total(_audit(spark, sf_dir))


@query(f"SELECT 'requests_total{{event_type=\"' || event_type || '\",action_taken=\"' || action_taken || '\"}} ' || CAST(count(*) AS VARCHAR) AS line FROM {AUDIT} GROUP BY event_type, action_taken")
def requests_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.exposition(M.requests_total(_audit(spark, sf_dir)), "requests_total", ["event_type", "action_taken"], "requests")


@query(" UNION ALL ".join([*(f"SELECT '{b:g}' AS le, count(*) FILTER (value / 50 <= {b}) AS n FROM events" for b in M.BOUNDS), "SELECT '+Inf' AS le, count(value) AS n FROM events"]))
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latency_histogram(P.load(spark, sf_dir, "events").select((F.col("value") / 50).alias("seconds")))


@query(f"SELECT user_identity, CAST(epoch_us(max(timestamp)) AS BIGINT) AS last_seen, max(timestamp) > TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 3 HOUR AS fresh FROM {AUDIT} GROUP BY user_identity")
def heartbeat_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = M.last_seen(_audit(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp")), "user_identity", "timestamp")
    now = F.lit("2024-01-30 20:00:00").cast("timestamp")
    return seen.select("user_identity", F.unix_micros("last_seen").alias("last_seen"), (F.unix_micros("last_seen") > F.unix_micros(now) - 3 * 3600 * 1_000_000).alias("fresh"))


@query("SELECT event_id, CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS violations_before FROM events")
def prior_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.violations_before(P.load(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "error").select("event_id", "violations_before")


# ---- lookups --------------------------------------------------------------------------------------

_APPS = [
    {"id": "net", "domains": ["example.net", "m.example.com"], "enabled": True, "connect_proxy": True},
    {"id": "com", "domains": ["EXAMPLE.com"], "enabled": False},
    {"id": "late", "domains": ["example.net", "example.org"], "enabled": True},
]
_HOST = "regexp_extract(url, '^https?://([^/:?#]+)', 1)"


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host"))


def _below(domain: str) -> str:
    return f"(host = '{domain}' OR ends_with(host, '.{domain}'))"


@query(f"SELECT page_id, host, CASE WHEN {_below('example.net')} OR {_below('m.example.com')} THEN 'net' WHEN {_below('example.com')} THEN 'com' WHEN {_below('example.org')} THEN 'late' END AS app_id FROM (SELECT page_id, lower({_HOST}) AS host FROM pages)")
def application_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.resolve_application(_hosts(spark, sf_dir), L.application_rows({"applications": _APPS}, spark)).select("page_id", "host", "app_id")


@query(f"SELECT page_id FROM (SELECT page_id, lower({_HOST}) AS host FROM pages) WHERE {_below('example.org')}")
def hosts_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.in_domains(_hosts(spark, sf_dir), spark.sql("SELECT ' Example.org ' AS domain")).select("page_id")


@query(f"WITH d AS (SELECT DISTINCT lower({_HOST}) AS domain, page_id % 2 AS k FROM pages) SELECT domain, 'add' AS change FROM d WHERE k = 0 AND domain NOT IN (SELECT domain FROM d WHERE k = 1) UNION SELECT domain, 'remove' AS change FROM d WHERE k = 1 AND domain NOT IN (SELECT domain FROM d WHERE k = 0)")
def domain_set_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _hosts(spark, sf_dir).select(F.col("host").alias("domain"), (F.col("page_id") % 2).alias("k")).distinct()
    return L.domain_changes(d.where("k = 0").select("domain"), spark.sql("SELECT 'none' AS domain"), d.where("k = 1").select("domain"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'allow' ELSE 'inspect' END AS upload FROM events")
def upload_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, [".EXE", "txt", "pdf", "..png", ""])), (F.col("event_id") % 5 + 1).cast("int"))
    return P.load(spark, sf_dir, "events").select("event_id", L.upload_action(ext, {"exe": "block", ".TXT": "allow"}).alias("upload"))


_MODELS = [("GPT-4o", "openai"), ("claude-x", "anthropic"), ("my-perplexity", "perplexity"), ("codestral-1", "mistral"), ("x/openrouter", "openrouter"), ("llama3", "ollama"), ("what", "openai")]


@query(f"SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'custom' ELSE [{', '.join(repr(p) for _, p in _MODELS)}][event_id % 7 + 1] END AS provider FROM events")
def provider_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.element_at(F.array(*(F.lit(m) for m, _ in _MODELS)), (F.col("event_id") % 7 + 1).cast("int"))
    header = F.when(F.col("event_id") % 11 == 0, F.lit("Custom"))
    return P.load(spark, sf_dir, "events").select("event_id", L.provider(header, model).alias("provider"))


_HEADS = [("89504E470D0A1A0A00", "png"), ("FFD8FFE0", "jpg"), ("47494638396100", "gif"), ("255044462D31", "pdf"), ("424D00", "bmp"), ("49492A00", "tif"), ("524946460000000057454250", "webp"), ("00", None)]


@query(f"SELECT event_id, [{', '.join('NULL' if e is None else repr(e) for _, e in _HEADS)}][event_id % 8 + 1] AS ext FROM events")
def file_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(*(F.lit(h) for h, _ in _HEADS)), (F.col("event_id") % 8 + 1).cast("int"))
    return P.load(spark, sf_dir, "events").select("event_id", S.sniffed(F.unhex(head)).alias("ext"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Block' ELSE 'Redact' END AS action FROM events")
def unmaskable_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.load(spark, sf_dir, "events").select("event_id", F.lit("Redact").alias("action"), F.when(F.col("event_id") % 2 == 0, "pdf").otherwise("json").alias("ext"))
    return S.unmaskable(rows, policy(unmaskable_file_action="Redact")).select("event_id", "action")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message fields out of JSON bodies."""
    bodies = P.load(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"id":"x","message":{"content_type":"text","parts":["'), F.get_json_object("props", "$.k"), F.lit('"]}}')).alias("body"))
    return B.extract_content(bodies).select("event_id", F.col("text").cast("long").alias("k"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def joined_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.join_parts(P.load(spark, sf_dir, "conversations").withColumnRenamed("turn", "part_no"), "conv_id")


@query("SELECT event_id, CASE WHEN event_id % 4 < 2 THEN event_id % 4 = 1 ELSE event_id % 4 = 3 END AS newer FROM events")
def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("event_id") % 4 + 1).cast("int"))
    return P.load(spark, sf_dir, "events").select("event_id", W.is_newer(pick("1.9", "1.10", "1.x.0", "2"), pick("1.10", "1.9", "1.0.0", "1.9.9")).alias("newer"))


@query(f"SELECT id, action_taken IN ('Block', 'RequireApproval') AS stop, action_taken = 'Redact' AS redact, CASE action_taken WHEN 'Allow' THEN NULL WHEN 'RequireApproval' THEN 'block' ELSE lower(action_taken) END AS notice FROM {AUDIT}")
def verdict_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.outcome(F.col("action_taken"))
    return _audit(spark, sf_dir).select("id", out["stop"].alias("stop"), out["redact"].alias("redact"), out["notice"].alias("notice"))


@query("SELECT c_custkey, upper(substr(h, 1, 4)) || '-' || upper(substr(h, 5, 4)) || '-' || upper(substr(h, 9, 4)) || '-' || upper(substr(h, 13, 4)) AS fingerprint FROM (SELECT c_custkey, sha256(CAST(c_custkey AS VARCHAR) || '|' || c_name) AS h FROM customer)")
def machine_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.load(spark, sf_dir, "customer").select("c_custkey", W.fingerprint(F.col("c_custkey").cast("string"), F.col("c_name")).alias("fingerprint"))


_WORDS = "regexp_extract_all(lower(text), '[a-z]{4,}')"
_LISTED = f"SELECT DISTINCT unnest({_WORDS}) AS word FROM benchmark"


@query(
    f"SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS n_findings, coalesce(words, '') AS words FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(DISTINCT word, ',' ORDER BY word) AS words"
    f" FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS word FROM documents) JOIN ({_LISTED}) USING (word) GROUP BY doc_id) USING (doc_id)"
)
def many_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of four letters and more of the benchmark as a keyword of its own, looked for in all documents."""
    words = P.load(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word")).distinct()
    rules = [KeywordRule(r["word"]) for r in words.orderBy("word").toLocalIterator()]  # a policy's list of keywords
    found = P.spread(_documents(spark, sf_dir)).withColumn("f", keyword_findings(D.prepared(F.col("text")), rules))
    named = F.array_join(F.array_sort(F.array_distinct(F.transform("f", lambda f: f["match_name"]))), ",")
    return found.select("doc_id", F.size("f").alias("n_findings"), named.alias("words"))


# ---- streams --------------------------------------------------------------------------------------

@query(f"SELECT tenant_id, CAST(epoch(date_trunc('hour', timestamp)) AS BIGINT) AS hour, count(*) AS events, CAST(sum(finding_count) AS BIGINT) AS findings FROM {AUDIT} GROUP BY 1, 2")
def audit_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.hourly(_audit(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))).select("tenant_id", F.unix_timestamp("hour").alias("hour"), "events", "findings")


_GAPS = f"SELECT user_identity, timestamp, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY user_identity ORDER BY timestamp) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM {AUDIT}"


@query(f"SELECT user_identity, CAST(min(epoch_us(timestamp)) AS BIGINT) AS opened, count(*) AS events FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_identity ORDER BY timestamp) AS s FROM ({_GAPS})) GROUP BY user_identity, s")
def audit_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sessions(_audit(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))).select("user_identity", F.unix_micros("opened").alias("opened"), "events")


_STREAM = f"SELECT CAST(doc_id AS VARCHAR) AS stream_id, repeat(text || ' ', 25) AS text FROM {CASES}"
_CHUNK = 300
_UPTO = f"least(k * {_CHUNK}, n)"
_LET = lambda upto: f"CASE WHEN {upto} = n THEN n ELSE greatest({upto} - {H.HOLD_BACK}, 0) END"


@query(
    f"WITH s AS (SELECT *, length(text) AS n FROM ({_STREAM})), c AS (SELECT *, unnest(range(1, CAST(ceil(n / {_CHUNK}.0) AS BIGINT) + 1)) AS k FROM s WHERE n > 0),"
    f" p AS (SELECT stream_id, k, text, {_LET(f'least((k - 1) * {_CHUNK}, n)')} AS a, {_LET(_UPTO)} AS b FROM c)"
    " SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY k) - 1 AS piece_no, substr(text, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT)) AS text FROM p WHERE b > a"
)
def holdback_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as streams of chunks: what is let go of each, the last 512 bytes being held back until the end."""
    docs = P.cases(spark, sf_dir).select(F.col("doc_id").cast("string").alias("stream_id"), F.repeat(F.concat("text", F.lit(" ")), F.lit(25)).alias("text"))
    return H.pieces(_chunks(docs, _CHUNK))


def _chunks(docs: DataFrame, size: int) -> DataFrame:
    last = F.greatest(F.floor((F.length("text") - 1) / size), F.lit(0)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.cast("long").alias("chunk_no"), F.encode(F.substr("text", i * size + 1, F.lit(size)), "UTF-8").alias("bytes")))
    return docs.select("stream_id", F.inline(parts))


_SCANNED = "SELECT CAST(user_id AS VARCHAR) AS stream_id, event_id AS piece_no, CASE WHEN event_id % 61 = 7 THEN 'Block' WHEN event_id % 67 = 9 THEN 'RequireApproval' WHEN event_id % 3 = 0 THEN 'Redact' ELSE 'Allow' END AS action FROM events"


@query(f"WITH s AS ({_SCANNED}), x AS (SELECT stream_id, min(piece_no) AS stop FROM s WHERE action IN ('Block', 'RequireApproval') GROUP BY stream_id) SELECT s.* FROM s LEFT JOIN x USING (stream_id) WHERE stop IS NULL OR piece_no < stop")
def stream_until_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = spark.sql(_SCANNED.replace("VARCHAR", "STRING").replace("FROM events", "FROM {events}"), events=P.load(spark, sf_dir, "events"))
    return H.until_blocked(scanned)


@query()
def stream_holdback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as streams of 700-character chunks, held back, scanned as responses, cut at the first blocked piece."""
    docs = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("stream_id"), F.coalesce("text", F.lit("")).alias("text"))
    scanned = inspect(H.pieces(_chunks(docs, 700)), policy(), response=True)
    return H.until_blocked(scanned).select("stream_id", "piece_no", "action", "sanitized")


_FILLER = "rpad('', CAST(doc_id % 97 AS INT), 'lorem ipsum ')"
_LONG = f"(SELECT doc_id, repeat('dolor sit amet ', 20) || {_FILLER} || ' ' || text || ' ' || repeat('consetetur elitr ', 20) AS text FROM {PEOPLE})"
_KEPT_WHOLE = [*D.SECRETS, *D.PII]


@query(f"SELECT CAST(doc_id AS VARCHAR) AS stream_id, sanitized FROM ({_inspect_oracle(_ANSWER, _LONG, response=True)})")
def stream_masked_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted values at every offset to the borders of chunks and pieces: what the pieces give together, masked one by
    one, is the whole answer masked."""
    docs = spark.sql(_LONG.replace("FROM customer", "FROM {customer}")[1:-1], customer=P.spread(P.load(spark, sf_dir, "customer").select("c_custkey"))).select(F.col("doc_id").cast("string").alias("stream_id"), "text")
    scanned = inspect(H.pieces(_chunks(docs, 90), 0, _KEPT_WHOLE), policy(), response=True)
    parts = F.array_sort(F.collect_list(F.struct("piece_no", "sanitized")))  # a stream of this query has some ten pieces
    return scanned.groupBy("stream_id").agg(F.array_join(F.transform(parts, lambda p: p["sanitized"]), "").alias("sanitized"))


def _windows(key: str, seconds: int, out: str) -> str:
    """The windows of each key, one after the other, and the requests numbered in them."""
    w = seconds * 1_000_000
    return (
        f"WITH RECURSIVE t AS (SELECT {key} AS k, epoch_us(ts) AS us, event_id, user_id FROM events),"
        f" w AS (SELECT k, min(us) AS opened FROM t GROUP BY k UNION ALL SELECT t.k, min(t.us) AS opened FROM w JOIN t ON t.k = w.k AND t.us >= w.opened + {w} GROUP BY t.k, w.opened)"
        f" SELECT {out} FROM t ASOF JOIN w ON t.k = w.k AND t.us >= w.opened"
    )


@query(_windows("user_id", 86400, "event_id, user_id, row_number() OVER (PARTITION BY t.k, opened ORDER BY us, event_id) <= 3 AS allowed"))
def rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a user within a day: three, from the one that opens the window on."""
    events = P.load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return T.limited(events, "user_id", most=3, seconds=86400).select("event_id", "user_id", "allowed")


@query(_windows("CAST(user_id AS VARCHAR)", 86400, "t.k AS nonce, us, row_number() OVER (PARTITION BY t.k, opened ORDER BY us, event_id) = 1 AS fresh"))
def nonce_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = P.load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("nonce"), F.col("ts").cast("timestamp").alias("ts"))
    return T.first_uses(events, seconds=86400).select("nonce", F.unix_micros("ts").alias("us"), "fresh")
