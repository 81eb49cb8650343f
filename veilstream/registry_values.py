"""Registered queries of the smaller functions: values of a row, uploads, bodies, metrics, exports."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream import registry as R
from veilstream.catalog import query
from veilstream.functions import small as W
from veilstream.operators import audit as A
from veilstream.operators import audit_table as S_
from veilstream.operators import detectors as D
from veilstream.operators import lookups as L
from veilstream.operators import metrics as M
from veilstream.operators import models as X
from veilstream.operators.asof import as_of
from veilstream.operators.inspect import inspect, verified
from veilstream.operators.keywords import KeywordRule, keyword_findings
from veilstream.operators.policy import policy
from veilstream.operators.redact import redact_any
from veilstream.operators.risk import context_points, score
from veilstream.operators.rules import matched
from veilstream.plans import boxes as N
from veilstream.plans import oracle as O
from veilstream.plans import planted as P
from veilstream.sources import bodies as B
from veilstream.sources import files as S
from veilstream.sources import multipart as U
from veilstream.sources.shared import shared_folder
from veilstream.streaming import limits as T
from veilstream.streaming import live as V
from veilstream.streaming import sse as E

AUDIT, CASES, PEOPLE, NOW = R.AUDIT, R.CASES, R.PEOPLE, R.NOW
_NOW_S = 1_706_659_200  # NOW as seconds


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.load(spark, sf_dir, "events")


def _pick(values: list, column: str = "event_id", kind: str = "string") -> Column:
    """The values in turn."""
    return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), (F.col(column) % len(values) + 1).cast("int"))


def _turn(values: list, column: str = "event_id") -> str:
    """The same in SQL."""
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v) if not isinstance(v, str) else O.text(v)}" for i, v in enumerate(values)) + " END"


# ---- values of a row ------------------------------------------------------------------------------

@query(f"SELECT event_id, CAST(floor((floor(epoch(ts)) + (event_id % 40) * 86400 + 2 * 86400 - {_NOW_S}) / 86400) AS INT) AS days, CAST(floor(epoch(ts)) AS BIGINT) + (event_id % 40) * 86400 AS lease_end FROM events")
def license_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days left of a term with grace, and the end of a lease."""
    issued = F.col("ts").cast("timestamp")
    end = W.lease_end(issued, F.col("event_id") % 40)
    return _events(spark, sf_dir).select("event_id", W.days_left(end, F.timestamp_seconds(F.lit(_NOW_S)), 2).alias("days"), F.unix_timestamp(end).alias("lease_end"))


_KINDS = ["Application/JSON; charset=utf-8", "text/html", "image/png", None, "application/x-www-form-urlencoded", "TEXT/plain"]


@query(f"SELECT event_id, {_turn([True, True, False, False, False, True])} AS scannable, CASE WHEN event_id % 100 > 30 THEN CAST(event_id % 100 - 30 AS VARCHAR) END AS pause, coalesce({_turn([None, 'env'])}, {_turn([None, None, 'file'])}, 'default') AS setting FROM events")
def request_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a content type is scanned, what is left of a pause, and the first setting that is given."""
    setting = W.first_set(_pick([None, "env"]), _pick([None, None, "file"]), F.lit("default"))
    return _events(spark, sf_dir).select("event_id", W.scannable_type(_pick(_KINDS)).alias("scannable"), W.pause_left(F.col("event_id") % 100, F.lit(30)).cast("string").alias("pause"), setting.alias("setting"))


@query(f"SELECT doc_id, sha256(text) AS digest, CASE WHEN substr(place, 2, 1) = ':' THEN 'sqlite:///' ELSE 'sqlite://' END || replace(place, chr(92), '/') || '?mode=rwc' AS url FROM (SELECT doc_id, text, {_turn(['C:' + chr(92) + 'data' + chr(92) + 'x.db', '/var/x.db', 'x.db', 'D:/x.db'], 'doc_id')} AS place FROM {CASES})")
def digests_and_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _pick(["C:\\data\\x.db", "/var/x.db", "x.db", "D:/x.db"], "doc_id")
    return P.cases(spark, sf_dir).select("doc_id", W.digest(F.col("text")).alias("digest"), W.local_database_url(place).alias("url"))


_FRIENDLY = "CASE match_name " + " ".join(f"WHEN {O.text(k)} THEN {O.text(v)}" for k, v in W.FRIENDLY.items()) + " ELSE lower(replace(match_name, '_', ' ')) END"


@query(f"SELECT doc_id, coalesce(array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ', '), 'sensitive content') AS described FROM {CASES} LEFT JOIN (SELECT doc_id, list({_FRIENDLY} ORDER BY det, pos) AS names FROM ({O.findings(CASES, [*D.SECRETS, *D.PII])}) GROUP BY doc_id) USING (doc_id)")
def described_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.cases(spark, sf_dir).withColumn("_seen", D.seen(F.col("text"))).withColumn("f", D.detect(F.col("text"), [*D.SECRETS, *D.PII], F.col("_seen")))
    return rows.select("doc_id", W.described(F.col("f")).alias("described"))


@query(f"SELECT doc_id, category, match_name, severity FROM ({O.findings(CASES, D.SECRETS)}) UNION ALL SELECT doc_id, 'CustomKeyword' AS category, 'custom keyword' AS match_name, 'MEDIUM' AS severity FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\bkey\\b')) FROM {CASES})")
def loggable_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as a log may show them: no snippets, no names of custom keywords."""
    rows = P.cases(spark, sf_dir).withColumn("_seen", D.seen(F.col("text")))
    found = F.concat(D.detect(F.col("text"), D.SECRETS, F.col("_seen")), keyword_findings(F.col("text"), [KeywordRule("key")]))
    return rows.withColumn("f", found).select("doc_id", F.inline(W.loggable(F.col("f"))))


# ---- risk, rules, policy --------------------------------------------------------------------------

_RISK = "CASE WHEN event_id % 2 = 0 THEN 10 ELSE 0 END + least((event_id % 3 + event_id % 4) * 3, 15) + CAST(round((event_id % 101) * 0.15) AS INT)"


@query(f"SELECT event_id, CAST({_RISK} AS INT) AS total, {O.band(f'({_RISK})')} AS band FROM events")
def context_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of what surrounds a text."""
    i = F.col("event_id")
    around = context_points(i % 2 == 0, (i % 3).cast("int"), (i % 4).cast("int"), (i % 101).cast("int"))
    return _events(spark, sf_dir).withColumn("r", score(F.array().cast(D.FINDINGS), around)).select("event_id", F.col("r.total").alias("total"), F.col("r.band").alias("band"))


_CONTEXT_RULES = [
    {"name": "public", "condition": {"public_app": True}, "action": "Warn"},
    {"name": "risky", "condition": {"risk_at_least": 40}, "action": "Block"},
    {"name": "band", "condition": {"band_at_least": "Medium"}, "action": "Audit"},
    {"name": "device", "condition": {"device_violations": 2}, "action": "Audit"},
    {"name": "user", "condition": {"not": {"user_violations": 3}}, "action": "Audit"},
]


@query("SELECT event_id, concat_ws('|', CASE WHEN event_id % 2 = 0 THEN 'public' END, CASE WHEN event_id % 100 >= 40 THEN 'risky' END, CASE WHEN event_id % 100 > 24 THEN 'band' END, CASE WHEN event_id % 3 >= 2 THEN 'device' END, CASE WHEN event_id % 5 < 3 THEN 'user' END) AS rules FROM events")
def context_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.operators.risk import band

    i = F.col("event_id")
    total = (i % 100).cast("int")
    row = {"findings": F.array().cast(D.FINDINGS), "risk": F.struct(total.alias("total"), band(total).alias("band")), "public_app": i % 2 == 0, "device_violations": i % 3, "user_violations": i % 5}
    return _events(spark, sf_dir).select("event_id", F.array_join(F.transform(matched(_CONTEXT_RULES, row), lambda r: r["name"]), "|").alias("rules"))


_PAUSED = 700


@query(f"SELECT doc_id, CASE WHEN doc_id < {_PAUSED} THEN 'Allow' ELSE action END AS action, CASE WHEN doc_id < {_PAUSED} THEN 0 ELSE n_findings END AS n_findings, CASE WHEN doc_id < {_PAUSED} THEN text ELSE sanitized END AS sanitized FROM ({R._inspect_oracle(R._ALL, CASES)}) JOIN {CASES} USING (doc_id)")
def paused_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pause until second 700, asked at the second of the row's number."""
    out = inspect(P.cases(spark, sf_dir), policy(paused_until=_PAUSED), now=F.col("doc_id"))
    return out.select("doc_id", "action", F.size("findings").alias("n_findings"), "sanitized")


@query(f"SELECT doc_id, CASE WHEN action = 'Allow' AND contains(text, 'nothing') THEN 'Redact' ELSE action END AS action, CASE WHEN action = 'Allow' THEN replace(sanitized, 'nothing', '[SEEN]') ELSE sanitized END AS sanitized FROM ({R._inspect_oracle(R._ALL)}) JOIN {PEOPLE} USING (doc_id)")
def second_opinion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is allowed is seen by a verifier, whose findings mask."""
    seen = F.array(F.struct(F.lit("Pii").alias("category"), F.lit("SEEN").alias("match_name"), F.lit("nothing").alias("snippet"), F.lit("LOW").alias("severity"), F.lit("[SEEN]").alias("redacted_replacement")))
    return verified(inspect(P.people(spark, sf_dir), policy()), F.when(F.contains("text", F.lit("nothing")), seen)).select("doc_id", "action", "sanitized")


@query(f"SELECT doc_id, 'MODEL_user' AS match_name, 'user' AS snippet, '[REDACTED_MODEL_user]' AS redacted_replacement FROM {PEOPLE} WHERE contains(text, 'user')")
def model_scanner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pluggable model as a scanner: entities of a score that suffices become findings."""

    def model(texts: list[str]) -> list[list[dict]]:
        return [[{"type": f"MODEL_{w}", "start": t.find(w), "end": t.find(w) + len(w), "score": s} for w, s in (("user", 0.4), ("mail", 0.39)) if w in t] for t in texts]

    rows = P.people(spark, sf_dir).withColumn("f", X.slot(model)(F.col("text")))
    return rows.select("doc_id", F.inline("f")).select("doc_id", "match_name", "snippet", "redacted_replacement")


@query(f"SELECT event_id, 'v1:' || {_turn(['open', 'own', 'open'])} AS body FROM events WHERE event_id % 3 <> 1 UNION ALL SELECT event_id, 'V1:OWN' AS body FROM events WHERE event_id % 3 = 1")
def translated_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of a provider with a form of its own."""
    rows = _events(spark, sf_dir).select("event_id", _pick(["open", "own", "open"]).alias("who")).withColumn("body", F.concat(F.lit("v1:"), "who"))
    X.TRANSLATIONS["own"] = (str.upper, str.lower)
    try:
        return rows.select("event_id", X.translated(F.col("who"), F.col("body")).alias("body"))
    finally:
        del X.TRANSLATIONS["own"]


@query(f"SELECT doc_id, array_to_string(list_concat(CASE WHEN contains(text, 'user') THEN ['MODEL_user'] ELSE [] END, coalesce(names, [])), '|') AS names FROM {PEOPLE} LEFT JOIN (SELECT doc_id, list(match_name ORDER BY det, pos) AS names FROM ({O.findings(PEOPLE, [*D.PII, *D.GUARDRAILS])}) GROUP BY doc_id) USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM ({O.findings(PEOPLE, [*D.SECRETS, *D.INJECTION])}))"
       f" UNION ALL SELECT DISTINCT doc_id, 'secret or injection' AS names FROM ({O.findings(PEOPLE, [*D.SECRETS, *D.INJECTION])})")
def early_scanner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second look for injection comes before personal data; texts with findings before it are only named."""

    def model(texts: list[str]) -> list[list[dict]]:
        return [[{"type": "MODEL_user", "start": t.find("user"), "end": t.find("user") + 4, "score": 1.0}] if "user" in t else [] for t in texts]

    found = inspect(P.people(spark, sf_dir), policy(), early=[X.slot(model)])
    first = F.exists("findings", lambda f: f["category"].isin("Secret", "PromptInjection"))
    names = F.array_join(F.transform("findings", lambda f: f["match_name"]), "|")
    return found.select("doc_id", F.when(first, "secret or injection").otherwise(names).alias("names"))


# ---- lookups --------------------------------------------------------------------------------------

@query("SELECT CAST(ord AS INT) AS ord, domain FROM (VALUES (0, 'example.net'), (1, 'm.example.com'), (2, 'example.net')) AS t(ord, domain)")
def enabled_app_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three domains of the enabled applications, in the policy's order."""
    found = L.enabled_domains(L.application_rows({"applications": R._APPS}, spark), most=3)
    return found.select((F.row_number().over(R.Window.orderBy("app_ord", "domain_ord")) - 1).alias("ord"), "domain")


@query("SELECT CAST(0 AS INT) AS app_ord, domain FROM (VALUES ('example.net'), ('m.example.com')) AS t(domain)")
def proxied_app_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.enabled_domains(L.application_rows({"applications": R._APPS}, spark), proxied=True).select("app_ord", "domain")


_TOOLS = ["fs.read", "fs.write", "web", "db.query", "fs.delete.all"]


@query(f"SELECT event_id, decision, CASE decision WHEN 'Block' THEN 'Block' WHEN 'RequireApproval' THEN 'Warn' ELSE 'Allow' END AS action, CASE WHEN decision = 'Allow' THEN 0 ELSE 1 END AS n_findings FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'RequireApproval' ELSE {_turn(['Allow', 'Block', 'Block', 'Allow', 'Block'])} END AS decision FROM events)")
def tool_call_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on tools, the audit action they become, and their reasons as findings."""
    decided = L.tool_decision(_pick(_TOOLS), ["fs.write", "fs.delete.*"], ["fs.*", "db.query"])
    decision = F.when(F.col("event_id") % 7 == 0, "RequireApproval").otherwise(decided)
    rows = _events(spark, sf_dir).select("event_id", decision.alias("decision"))
    reasons = F.when(F.col("decision") != "Allow", F.array(F.lit("not allowed")))
    return rows.select("event_id", "decision", A.tool_event_action(F.col("decision")).alias("action"), F.size(A.tool_findings(reasons)).alias("n_findings"))


@query("SELECT user_id, CAST(min_ts AS BIGINT) AS opened, calls, calls > 2 AS over FROM (SELECT user_id, floor(epoch(ts) / 86400) * 86400 AS min_ts, count(*) AS calls FROM events GROUP BY 1, 2)")
def tool_call_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return V.tool_calls(calls, session="user_id", seconds=86400, most=2).select("user_id", F.unix_timestamp("opened").alias("opened"), "calls", "over")


# ---- files ----------------------------------------------------------------------------------------

_NAMES = ["a.TXT", "noname", "x.tar.GZ", "pic", ".env", "report.docx", "blob", "empty"]
_MIMES = ["text/plain", "IMAGE/JPEG; q=1", "application/zip", "image/x-odd", None, "text/csv", "application/pdf", "what/ever"]
_BYTES = ["616263", "FFD8FFE000", "1F8B", "89504E470D0A1A0A", "4142", "504B0304", "D0CF11E0A1B1", "00"]


@query(f"SELECT event_id, {_turn(['txt', None, 'gz', None, 'env', 'docx', None, None])} AS own, {_turn(['txt', 'jpg', 'bin', 'png', 'bin', 'csv', 'pdf', 'bin'])} AS declared, {_turn(['txt', 'jpg', 'gz', 'png', 'env', 'docx', 'doc', 'bin'])} AS ext FROM events")
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type by the name, by what is declared, and by both and the first bytes."""
    name, mime, content = _pick(_NAMES), _pick(_MIMES), F.unhex(_pick(_BYTES))
    return _events(spark, sf_dir).select("event_id", S.extension(name).alias("own"), S.from_mime(mime).alias("declared"), S.resolved_extension(name, content, mime).alias("ext"))


def _box() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("word/document.xml"), "<w:p><w:t>a &amp;lt; b</w:t><w:t/><w:t xml:space='x'>c</w:t></w:p>")
    return out.getvalue()


_FILES = [("a.txt", "636166E9"), ("b.docx", _box().hex()), ("c.docx", "504B0304"), ("d.pdf", "255044462D312E37"), ("e.weird", "00"), ("f.json", "7B7D")]


@query(f"SELECT event_id, {_turn(['caf�', 'a < b c ', None, 'a layer of text that is long enough', None, '{}'])} AS text, {_turn([None, None, 'c.docx: BadZipFile', None, 'e.weird: no extractor for ' + chr(39) + 'weird' + chr(39), None])} AS error FROM events")
def extracted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of files: lossy text, an office document, a damaged one, a PDF by its layer, one that nothing reads."""
    rows = _events(spark, sf_dir).select("event_id", _pick([n for n, _ in _FILES]).alias("filename"), F.unhex(_pick([b for _, b in _FILES])).alias("content"))
    readers = {"pdf": S.pdf_extractor(lambda b: "a layer of text that is long enough", lambda b, n: "by sight")}
    return S.extract_text(rows.withColumn("ext", S.extension(F.col("filename"))), readers).select("event_id", "text", "error")


@query(f"SELECT event_id, {_turn(['read by OCR', 'sparse', 'sparse', 'sparse'])} AS text FROM events")
def scanned_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse text layer: OCR reads it, finds nothing, fails, or is not there."""

    def fails(content: bytes, pages: int) -> str:
        raise RuntimeError

    engines = {"p0": lambda b, n: "read by OCR", "p1": lambda b, n: " ", "p2": fails, "p3": None}
    rows = _events(spark, sf_dir).select("event_id", F.concat(F.lit("p"), (F.col("event_id") % 4).cast("string")).alias("ext"), F.unhex(F.lit("00")).alias("content")).withColumn("filename", F.col("ext"))
    return S.extract_text(rows, {k: S.pdf_extractor(lambda b: "sparse", o) for k, o in engines.items()}).select("event_id", "text")


_LINES = "array_to_string(list_transform(string_split(text, chr(10)), lambda x: {}), chr(10))"
_ROW = "split_part(x, ' ', 1) || chr(9) || chr(9) || substr(x, length(split_part(x, ' ', 1)) + 2)"
_FORMS_OF = {"xlsx": _LINES.format(_ROW), "ods": _LINES.format("CASE WHEN x = '' THEN 'row' ELSE 'row' || chr(9) || x END")}
_IN_OFFICE = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN {_FORMS_OF.get(e, 'text')}" for i, (e, _) in enumerate(N.OFFICE)) + " END"


def _read_back(spark: SparkSession, sf_dir: str, makers: list) -> DataFrame:
    read = S.extract_text(N.packed(P.load(spark, sf_dir, "documents").select("doc_id", "text"), makers))
    return read.select("doc_id", "ext", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"), "error")


@query(f"SELECT doc_id, {_turn([e for e, _ in N.OFFICE], 'doc_id')} AS ext, length(text) AS n_chars, md5(text) AS digest, CAST(NULL AS VARCHAR) AS error FROM (SELECT doc_id, {_IN_OFFICE} AS text FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))")
def office_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a sheet, as slides or in an open format, read back."""
    return _read_back(spark, sf_dir, N.OFFICE)


@query("SELECT doc_id, 'pdf' AS ext, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS digest, CAST(NULL AS VARCHAR) AS error FROM documents")
def pdf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a PDF (tables or streams of references, escaped or hexadecimal strings, damaged ones), read back."""
    return _read_back(spark, sf_dir, N.PDF)


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 400 ELSE 200 END AS status, CASE WHEN event_id % 3 <> 2 THEN CAST(event_id AS VARCHAR) END AS content, CASE WHEN event_id % 2 = 0 THEN 'chat.example.com (f.txt)' ELSE 'f.txt' END AS label FROM events")
def file_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base64 payloads, malformed ones among them, and the label of their events."""
    data = F.when(F.col("event_id") % 3 == 2, F.lit("%%%")).otherwise(F.base64(F.col("event_id").cast("string").cast("binary")))
    rows = _events(spark, sf_dir).select("event_id", F.lit("f.txt").alias("filename"), data.alias("data_base64"), _pick(["chat.example.com", "", "chat.example.com", None]).alias("domain"))
    return S.uploads(rows).select("event_id", "status", F.col("content").cast("string").alias("content"), "label")


@query("SELECT user_id, coalesce(bool_or(event_id % 7 = 0 AND event_id % 5 <> 0), false) AS stopped, count(*) FILTER (event_id % 7 = 1 AND event_id % 5 <> 0) AS masked, count(*) FILTER (event_id % 5 = 0) AS skipped FROM events GROUP BY user_id")
def multi_file_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", F.when(F.col("event_id") % 7 == 0, "Block").when(F.col("event_id") % 7 == 1, "Redact").otherwise("Allow").alias("action"), F.when(F.col("event_id") % 5 == 0, "too large").alias("error"))
    return S.request_stops(rows, "user_id")


# ---- bodies ---------------------------------------------------------------------------------------

@query(f"SELECT doc_id, CASE WHEN masked = text THEN '{{\"b\": [\"' || text || '\"], \"a\": 1}}' ELSE '{{\"a\":1,\"b\":[\"' || masked || '\"]}}' END AS body FROM (SELECT doc_id, text, {R._nested('text')} AS masked FROM {PEOPLE})")
def masked_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON masked leaf by leaf; what holds nothing to mask stays as it was written."""
    rows = P.people(spark, sf_dir).select("doc_id", F.concat(F.lit('{"b": ["'), "text", F.lit('"], "a": 1}')).alias("body"), D.detect(F.col("text"), R._MASKED).alias("f"))
    return rows.select("doc_id", redact_any(F.col("body"), F.col("f")).alias("body"))


_BODIES = ['{"a":1,"text":"x"}', '{"parts":["x","z"]}', "x=1", '{"m":{"prompt":"q"}}']


@query(f"SELECT event_id, replace({_turn(['{\"a\":1,\"text\":\"#\"}', '{\"parts\":[\"x\",\"z\"]}', '#', '{\"m\":{\"prompt\":\"#\"}}'])}, '#', CAST(event_id AS VARCHAR)) AS body FROM events")
def substituted_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", _pick(_BODIES).alias("body"), F.col("event_id").cast("string").alias("sanitized"))
    return rows.select("event_id", B.substituted(F.col("body"), F.col("sanitized")).alias("body"))


_CODED = ["a%20b+c", "bad %zz", "%41%c3%a9", "plain", "100%", "%F0%9F%98%80"]
_CHUNKED = ["4;x=1\r\nWiki\r\n3\r\nabc\r\n0\r\n", "ff\r\nshort", "0\r\n", "A\r\n0123456789\r\n0\r\n\r\n"]


@query(f"SELECT event_id, {_turn(['a b+c', 'bad %zz', 'Aé', 'plain', '100%', '😀'])} AS decoded, {_turn(['Wikiabc', None, '', '0123456789'])} AS body, {_turn(['postgres://u:***@h/db', 'postgresql://u:***@h', 'sqlite://x', 'postgres://h/db'])} AS place FROM events")
def decoded_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL-encoded text, chunked transfer bodies, addresses without their passwords."""
    body = W.dechunked_bytes(F.unhex(_pick([x.encode().hex() for x in _CHUNKED]))).cast("string")
    place = B.masked_location(_pick(["postgres://u:p@h/db", "postgresql://u:p:q@h", "sqlite://x", "postgres://h/db"]))
    return _events(spark, sf_dir).select("event_id", B.url_decoded(_pick(_CODED)).alias("decoded"), body.alias("body"), place.alias("place"))


_PART = "--B\r\nContent-Disposition: form-data; name=\"f\"; filename=\"{0}\"\r\nContent-Type: text/plain\r\n\r\nmail {1}@x.com\r\n"
_FIELD = "--B\r\nContent-Disposition: form-data; name=\"g\"\r\n\r\nfree {1}\r\n"
_FORMS = [_PART.replace("{0}", "a.txt") + _FIELD, _FIELD, _PART.replace("{0}", "a.skip") + _FIELD, _PART.replace("{0}", "a.exe") + _FIELD, _FIELD + _PART.replace("{0}", "a.bin")]


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.replace(_pick([x + "--B--\r\n" for x in _FORMS]), F.lit("{1}"), F.col("event_id").cast("string"))
    return _events(spark, sf_dir).select(F.col("event_id").cast("string").alias("request_id"), body.cast("binary").alias("body"), F.lit("B").alias("boundary"))


@query(f"SELECT CAST(event_id AS VARCHAR) AS request_id, replace({_turn(['mail #@x.com\nfree #\n', 'free #\n', 'free #\n', 'free #\n', 'free #\n'])}, '#', CAST(event_id AS VARCHAR)) AS text, {_turn(['Block', 'Allow', 'Allow', 'Block', 'Allow'])} AS action FROM events")
def multipart_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the upload policy, text parts beside them; what would be masked is blocked."""
    return U.scanned(_forms(spark, sf_dir), policy(uploads={"exe": "block", "skip": "allow"})).select("request_id", "text", "action")


_SIZES = [2, 1, 2, 2, 2]
_HAS_FILE = [0, None, 0, 0, 1]


@query(f"SELECT CAST(event_id AS VARCHAR) AS request_id, CAST(n AS INT) AS part_no, CASE WHEN n = {_turn(_HAS_FILE)} THEN 'f' ELSE 'g' END AS name, CASE WHEN n = {_turn(_HAS_FILE)} THEN {_turn(['a.txt', None, 'a.skip', 'a.exe', 'a.bin'])} END AS filename, CASE WHEN n = {_turn(_HAS_FILE)} THEN 'mail ' || CAST(event_id AS VARCHAR) || '@x.com' ELSE 'free ' || CAST(event_id AS VARCHAR) END AS content FROM (SELECT event_id, unnest(range({_turn(_SIZES)})) AS n FROM events)")
def multipart_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.parse_parts(_forms(spark, sf_dir)).select("request_id", "part_no", "name", "filename", F.col("content").cast("string").alias("content"))


_OPEN = "doc_id % 4 IN (1, 2)"


@query(f"SELECT doc_id, {_turn([None, 'gzip', 'zlib', 'gzip'], 'doc_id')} AS kind, CASE WHEN {_OPEN} THEN action ELSE 'Allow' END AS action, {_OPEN} AND action = 'Redact' AS masked, CASE WHEN {_OPEN} AND action IN ('Block', 'RequireApproval') THEN NULL WHEN {_OPEN} THEN sanitized ELSE text END AS sent, NOT ({_OPEN} AND action IN ('Block', 'Redact', 'RequireApproval')) AS same FROM ({R._inspect_oracle(R._ALL, CASES)}) JOIN {CASES} USING (doc_id)")
def compressed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed JSON bodies, masked and written back in their own form; plain ones and telemetry as they were."""
    out = U.masked_bodies(N.packed(P.cases(spark, sf_dir), N.BODIES), policy())

    def opened(frames):
        for pdf in frames:
            bodies = [None if x is None else json.loads(B.inflate(bytes(x))[1] or bytes(x)) for x in pdf["sent"]]
            pdf["same"] = [x is not None and bytes(x) == bytes(y) for x, y in zip(pdf["sent"], pdf["content"], strict=True)]
            pdf["sent"] = [None if x is None else x.get("prompt", x.get("note")) for x in bodies]
            yield pdf.drop(columns="content")

    return out.select("doc_id", "kind", "action", "masked", "sent", "content").mapInPandas(opened, "doc_id long, kind string, action string, masked boolean, sent string, same boolean")


# ---- audit, metrics, streams ----------------------------------------------------------------------

@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, 't' AS tenant_id, 'prompt' AS event_type, action AS action_taken, 'unknown' AS app_name, 'unknown' AS domain, 'unknown' AS user_identity, n_findings AS finding_count, 0 AS synced FROM ({R._inspect_oracle(R._ALL, CASES)})")
def built_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events of inspected texts."""
    found = inspect(P.cases(spark, sf_dir), policy())
    events = A.build_events(found, "t", "prompt", F.lit(None).cast("string"), now=F.lit(NOW).cast("timestamp"), new_id=F.col("doc_id").cast("string"))
    return events.drop("findings", "timestamp")


def _with_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.lit("Pii"), F.concat(F.lit("N"), "id"), F.lit("hidden"), F.lit("LOW"), F.lit("[N]")).cast(D.FINDING)
    return P.audit(spark, sf_dir).withColumn("findings", F.array_repeat(one, F.col("finding_count")))


@query(f"SELECT ord, id, shown FROM (SELECT row_number() OVER (ORDER BY timestamp DESC, id) - 1 AS ord, id, repeat('Pii:N' || id || ':LOW;', finding_count) AS shown FROM {AUDIT} WHERE tenant_id = 'tenant0' AND timestamp >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND timestamp <= TIMESTAMP '{NOW}') WHERE ord < 50")
def audit_recent_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page in its order, with findings but not their snippets."""
    page = A.recent(_with_findings(spark, sf_dir), "tenant0", F.lit(NOW).cast("timestamp_ntz"))
    shown = F.concat_ws("", F.transform("findings", lambda f: F.concat_ws("", f["category"], F.lit(":"), f["match_name"], F.lit(":"), f["severity"], F.lit(";"))))
    order = R.Window.orderBy(F.col("timestamp").desc(), "id")
    return page.select((F.row_number().over(order) - 1).cast("long").alias("ord"), "id", shown.alias("shown"))


_LINE = (
    "'{\"id\":\"' || id || '\",\"timestamp\":\"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '\",\"event_type\":\"' || event_type || '\",\"action_taken\":\"' || action_taken"
    " || '\",\"app_name\":\"' || app_name || '\",\"domain\":' || CAST(to_json(domain) AS VARCHAR) || ',\"user_identity\":\"' || user_identity || '\",\"finding_count\":' || CAST(finding_count AS VARCHAR) || '}'"
)
_ARRAY = f"SELECT tenant_id, '[' || string_agg({_LINE}, ',' ORDER BY timestamp, id) || ']' AS events FROM {AUDIT} WHERE timestamp >= TIMESTAMP '2024-01-10 00:00:00' AND timestamp < TIMESTAMP '2024-01-11 00:00:00' GROUP BY tenant_id"
_KEY = b"archive key"
_PADS = ["".join(f"{b ^ pad:02x}" for b in _KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C)]


def _mac(message: str) -> str:
    return f"sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode({message}))))"


@query(f"SELECT tenant_id, events, {_mac('events')} AS signature FROM ({_ARRAY})")
def audit_signed_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's events of each tenant as a JSON array with a keyed digest."""
    t = F.col("timestamp")
    rows = P.audit(spark, sf_dir).where((t >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")) & (t < F.lit("2024-01-11 00:00:00").cast("timestamp_ntz")))
    return A.signed_arrays(rows, _KEY)


_EXPORTED = f"SELECT '[' || string_agg({_LINE}, ',' ORDER BY timestamp, id) || ']' AS events FROM {AUDIT} WHERE tenant_id = 'tenant2' AND timestamp >= TIMESTAMP '{NOW}' - INTERVAL 2 DAY AND timestamp <= TIMESTAMP '{NOW}'"


@query(f"SELECT 'tenant2' AS tenant_id, events, {_mac('events')} AS signature FROM ({_EXPORTED})")
def audit_signed_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two days of a tenant, as the export gives them."""
    return A.export(P.audit(spark, sf_dir), "signed", "tenant2", F.lit(NOW).cast("timestamp_ntz"), 2, _KEY)


@query(
    f"SELECT id, tenant_id, CAST(CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 1 ELSE synced END AS INT) AS synced, finding_count FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY timestamp DESC, id) AS nth FROM {AUDIT} WHERE timestamp >= TIMESTAMP '2024-01-08 06:30:00') WHERE nth <= 2000"
)
def audit_stored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit table on disk: written, marked, purged, cut to its newest rows by tenant, read back."""
    path = shared_folder(spark, "audit")
    events = _with_findings(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    A.write_audit(events, path, "key")
    S_.mark_synced(spark, path, events.select("id").where("CAST(id AS BIGINT) % 5 = 0"))
    S_.purge_before(spark, path, F.lit("2024-01-08 06:30:00 UTC"))
    S_.keep_newest(spark, path, 2000)
    back = A.read_audit(spark, path, "key")
    return back.select("id", "tenant_id", "synced", F.size("findings").alias("finding_count"))


@query(f"SELECT event_id AS id, event_id % 2 = 0 AND row_number() OVER (PARTITION BY event_id % 2 = 0, user_id, opened ORDER BY now, event_id) = 1 AS allowed FROM (WITH RECURSIVE t AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS now FROM events), g AS (SELECT * FROM t WHERE event_id % 2 = 0), w AS (SELECT user_id, min(now) AS opened FROM g GROUP BY user_id UNION ALL SELECT g.user_id, min(g.now) AS opened FROM w JOIN g ON g.user_id = w.user_id AND g.now >= w.opened + 60 GROUP BY g.user_id, w.opened) SELECT t.*, w.opened FROM t ASOF LEFT JOIN w ON t.user_id = w.user_id AND t.now >= w.opened)")
def signed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed requests: every second one is too old or wrongly signed; nonces are the users' numbers."""
    now = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("id"), now.alias("now"), (now - F.when(F.col("event_id") % 4 == 1, 61).otherwise(60)).alias("ts"), F.col("user_id").cast("string").alias("nonce"))
    right = T.signature(F.col("ts"), F.col("nonce"), b"key")
    return T.authorised(rows.withColumn("signature", F.when(F.col("id") % 4 == 3, F.reverse(right)).otherwise(right)), b"key").select("id", "allowed")


_BUCKETS = [f"'request_duration_seconds_bucket{{le=\"{b:g}\"}} ' || CAST(count(*) FILTER (value / 64 <= {b}) AS VARCHAR)" for b in M.BOUNDS]
_FAMILY = ", ".join([*_BUCKETS, "'request_duration_seconds_bucket{le=\"+Inf\"} ' || CAST(count(value) AS VARCHAR)", "'request_duration_seconds_count ' || CAST(count(value) AS VARCHAR)"])


@query(
    f"SELECT 0 AS family, row_number() OVER (ORDER BY line) - 1 AS ord, line FROM (SELECT 'requests_total{{event_type=\"' || event_type || '\",action_taken=\"' || action_taken || '\"}} ' || CAST(count(*) AS VARCHAR) AS line FROM {AUDIT} GROUP BY event_type, action_taken)"
    f" UNION ALL SELECT 1 AS family, row_number() OVER (ORDER BY line) - 1 AS ord, line FROM (SELECT 'provider_requests_total{{provider=\"' || p || '\"}} ' || CAST(count(*) AS VARCHAR) AS line FROM (SELECT {_turn(['openai', 'legacy_upstream', 'openai'])} AS p FROM events) GROUP BY p)"
    f" UNION ALL SELECT 2 AS family, CASE WHEN n = {len(M.BOUNDS) + 2} THEN n ELSE n - 1 END AS ord, line FROM (SELECT unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM (SELECT [{_FAMILY}] AS lines FROM events))"
)
def metrics_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three families of metrics as text, in order; the sum, whose last digits depend on the order of adding, apart."""
    events = _events(spark, sf_dir)
    found = M.all_families(P.audit(spark, sf_dir), events.select(_pick(["openai", "legacy_upstream", "openai"]).alias("provider")), events.select((F.col("value") / 64).alias("seconds")))
    return found.where("line NOT LIKE '%_sum %'")


@query("SELECT round(sum(value) / 64, 3) AS total FROM events")
def latency_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = M.latency_lines(_events(spark, sf_dir).select((F.col("value") / 64).alias("seconds")), "d").where("line LIKE 'd_sum %'")
    return lines.select(F.round(F.substring_index("line", " ", -1).cast("double"), 3).alias("total"))


_AT = "list_position(list_transform(b, lambda c: c >= q * n), true)"
_WITHIN = f"CASE WHEN i IS NULL THEN {M.BOUNDS[-1]} ELSE low + (bounds[i] - low) * (q * n - below) / (b[i] - below) END"
_COUNTED = f"SELECT event_type, [{', '.join(f'count(*) FILTER (value / 64 <= {b})' for b in M.BOUNDS)}] AS b, count(value) AS n, {M.BOUNDS} AS bounds FROM events GROUP BY event_type"


@query(f"SELECT event_type, n, max(CASE WHEN q = 0.5 THEN v END) AS p50, max(CASE WHEN q = 0.95 THEN v END) AS p95 FROM (SELECT event_type, n, q, round({_WITHIN}, 6) AS v FROM (SELECT *, CASE WHEN i > 1 THEN bounds[i - 1] ELSE 0 END AS low, CASE WHEN i > 1 THEN b[i - 1] ELSE 0 END AS below FROM (SELECT *, {_AT} AS i FROM ({_COUNTED}), (VALUES (0.5), (0.95)) AS t(q)))) GROUP BY event_type, n")
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles by type of event, read off bucket counters that were made by user and then merged."""
    rows = P.load(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 7).alias("part"), (F.col("value") / 64).alias("seconds"))
    merged = M.merged_counters(M.latency_counters(rows, ["event_type", "part"]), ["event_type"])
    return merged.select("event_type", "n", F.round(M.quantile(0.5), 6).alias("p50"), F.round(M.quantile(0.95), 6).alias("p95"))


@query("SELECT profile_id, max(last_seen) AS last_seen FROM (SELECT CAST(user_id AS VARCHAR) AS profile_id, event_id AS last_seen FROM events WHERE event_id % 3 = 0 UNION ALL SELECT CAST(user_id AS VARCHAR), event_id FROM events WHERE event_id % 3 = 1) GROUP BY profile_id")
def heartbeat_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known profiles and more beats, a third of them of no profile."""
    rows = _events(spark, sf_dir).select(F.when(F.col("event_id") % 3 < 2, F.col("user_id").cast("string")).alias("profile_id"), F.col("event_id").alias("last_seen"))
    return M.upserted(rows.where("last_seen % 3 = 0"), rows.where("last_seen % 3 <> 0"))


@query("SELECT event_id, age < 150 AS open, age BETWEEN 0 AND 150 AS closed FROM (SELECT event_id, event_id % 301 - 5 AS age FROM events)")
def fresh_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    last, now = F.timestamp_seconds(1000 - (F.col("event_id") % 301 - 5)), F.timestamp_seconds(F.lit(1000))
    return _events(spark, sf_dir).select("event_id", M.fresh(last, now).alias("open"), M.fresh(last, now, closed=True).alias("closed"))


@query(f"SELECT id, 'DLP_EVENT [' || event_type || ']: Action=' || action_taken || ', App=' || app_name || ', Domain=' || domain || ', Findings=' || CAST(finding_count AS VARCHAR) AS line FROM {AUDIT}")
def event_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.log_lines(_with_findings(spark, sf_dir))


@query("SELECT seq, version FROM (SELECT event_id AS seq, event_id % 4 = 3 AS central, lag(event_id % 4 = 3) OVER (ORDER BY event_id) AS before, event_id AS version FROM events) WHERE central AND NOT before")
def policy_overwrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Central updates that put an end to local edits."""
    changes = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 3, "central").otherwise("local").alias("kind"), F.col("event_id").alias("version"))
    return W.overwrites(changes)


_POLICIES = "SELECT user_id % 5 AS tenant, ts AS since, event_id AS version, CASE event_id % 3 WHEN 0 THEN 'Block' WHEN 1 THEN 'Redact' ELSE 'Warn' END AS action FROM events WHERE event_type = 'signup'"


@query(f"SELECT e.event_id, coalesce(p.version, -1) AS version, coalesce(p.action, 'none') AS action FROM (SELECT event_id, ts, user_id % 5 AS tenant FROM events) e ASOF LEFT JOIN ({_POLICIES}) p ON e.tenant = p.tenant AND e.ts >= p.since")
def policy_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event beside the policy version of its tenant that was in force at its time; -1 before the first."""
    events = P.load(spark, sf_dir, "events")
    versions = spark.sql(_POLICIES.replace("FROM events", "FROM {events}"), events=events)
    rows = events.select("event_id", "ts", (F.col("user_id") % 5).alias("tenant"))
    return as_of(rows, versions, "ts", "since", "version", ["tenant"]).select("event_id", F.coalesce("in_force.version", F.lit(-1)).alias("version"), F.coalesce("in_force.action", F.lit("none")).alias("action"))


@query("SELECT tenant, seq, version FROM (SELECT user_id % 5 AS tenant, event_id AS seq, event_id % 4 = 3 AS central, lag(event_id % 4 = 3) OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS before, event_id AS version FROM events) WHERE central AND NOT before")
def tenant_policy_overwrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Central updates that put an end to local edits, for each tenant's own policy."""
    kind = F.when(F.col("event_id") % 4 == 3, "central").otherwise("local").alias("kind")
    changes = P.load(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("tenant"), F.col("event_id").alias("seq"), kind, F.col("event_id").alias("version"))
    return W.overwrites(changes, ["tenant"])


@query("SELECT event_id, (SELECT max(event_id) FROM events) AS version FROM events")
def events_with_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events beside the latest version of a policy table."""
    events = _events(spark, sf_dir)
    joined = V.with_policy(events.select("event_id"), events.select(F.col("event_id").alias("version")))
    return joined.select("event_id", F.col("policy.version").alias("version"))


@query("WITH c AS (SELECT event_id AS seq, event_id % 4 = 3 AS central FROM events), l AS (SELECT max(seq) AS s FROM c WHERE central) SELECT CASE WHEN n > 0 THEN 'local' ELSE 'central' END AS source, s + n AS version, n > 0 AS local_override FROM (SELECT s, (SELECT count(*) FROM c WHERE NOT central AND seq > s) AS n FROM l)")
def policy_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 3, "central").otherwise("local").alias("kind"), F.when(F.col("event_id") % 4 == 3, F.col("event_id")).alias("version"))
    return W.provenance(changes)


@query("SELECT CAST(doc_id AS VARCHAR) AS stream_id, repeat('data: <' || text || '>' || chr(10) || chr(10), 3) || 'data: [DONE]' || chr(10) || chr(10) AS text FROM (SELECT doc_id, trim(replace(text, chr(10), ' ')) AS text FROM " + CASES + ") WHERE text <> '' UNION ALL SELECT CAST(doc_id AS VARCHAR) AS stream_id, 'data: [DONE]' || chr(10) || chr(10) AS text FROM " + CASES + " WHERE trim(text) = ''")
def translated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a stream that is cut every 70 characters, in a form of their own."""
    docs = P.cases(spark, sf_dir).select(F.col("doc_id").cast("string").alias("stream_id"), F.repeat(F.concat(F.lit("data: "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n\n")), F.lit(3)).alias("text"))
    out = E.translated(R._chunks(docs, 70), lambda data: b"<" + data + b">")
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", F.col("bytes").cast("string").alias("text"))))
    return out.groupBy("stream_id").agg(F.concat_ws("", F.transform(ordered, lambda x: x["text"])).alias("text"))
