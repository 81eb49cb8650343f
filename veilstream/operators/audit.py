"""Audit history: window queries, paging, synchronisation marks, retention, exports.

The table: id, tenant_id, timestamp, event_type, action_taken, app_name, domain, user_identity, findings,
finding_count, synced.  Partition it by tenant and day on disk; every read filters by tenant first.
"""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstream.functions.small import hmac_sha256
from veilstream.operators.detectors import FINDING, FINDINGS

COLUMNS = ["id", "timestamp", "event_type", "action_taken", "app_name", "domain", "user_identity", "findings"]
PAGE, MOST_PAGE, WINDOW_DAYS, EXPORT_DAYS, KEEP_DAYS, KEEP_ROWS = 50, 200, 7, 30, 90, 500_000


def build_events(scanned: DataFrame, tenant: str, event_type: str, domain: Column, now: Column | None = None, new_id: Column | None = None) -> DataFrame:
    """Events of inspected rows; time and id can be given, so that a rerun gives the same rows."""
    return scanned.select(
        (new_id if new_id is not None else F.uuid()).alias("id"),
        F.lit(tenant).alias("tenant_id"),
        (now if now is not None else F.current_timestamp()).alias("timestamp"),
        F.lit(event_type).alias("event_type"),
        F.col("action").alias("action_taken"),
        F.lit("unknown").alias("app_name"),
        F.coalesce(domain, F.lit("unknown")).alias("domain"),
        F.lit("unknown").alias("user_identity"),
        "findings",
        F.size("findings").alias("finding_count"),
        F.lit(0).alias("synced"),
    )


def tool_event_action(decision: Column) -> Column:
    """Tool-call decisions as event actions: what waits for approval is a warning."""
    return F.when(decision == "Block", "Block").when(decision == "RequireApproval", "Warn").otherwise("Allow")


def tool_findings(reasons: Column) -> Column:
    """The reasons of a tool-call decision as findings."""
    made = F.transform(reasons, lambda r: F.struct(F.lit("CustomKeyword"), F.lit("mcp_policy_reason"), r, F.lit("INFO"), F.lit(None).cast("string")).cast(FINDING))
    return F.coalesce(made, F.array().cast(FINDINGS))


def log_lines(events: DataFrame) -> DataFrame:
    """id, line: what a log says about an event; no more of its findings than their number."""
    return events.select("id", F.format_string("DLP_EVENT [%s]: Action=%s, App=%s, Domain=%s, Findings=%d", "event_type", "action_taken", "app_name", "domain", F.size("findings")).alias("line"))


def window(events: DataFrame, tenant: str, since, until) -> DataFrame:
    """Events of a tenant between two times (both included), newest first."""
    t = F.col("timestamp")
    return events.where((F.col("tenant_id") == tenant) & (t >= F.lit(since)) & (t <= F.lit(until))).select(*COLUMNS).orderBy(t.desc(), "id")


def unsynced(events: DataFrame, tenant: str, limit: int) -> DataFrame:
    """The oldest events that were not sent yet."""
    return events.where((F.col("tenant_id") == tenant) & (F.col("synced") == 0)).orderBy("timestamp", "id").limit(limit)


def counts(events: DataFrame) -> DataFrame:
    """Per tenant: all events and those not sent yet."""
    return events.groupBy("tenant_id").agg(F.count("*").alias("events"), F.count_if(F.col("synced") == 0).alias("unsynced"))


def mark_synced(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Events with the given ids (a table with a column id) marked as sent."""
    seen = ids.select(F.col("id").alias("_seen")).distinct()
    return events.join(seen, F.col("id") == F.col("_seen"), "left").withColumn("synced", F.when(F.col("_seen").isNotNull(), 1).otherwise(F.col("synced"))).drop("_seen")


def purge_before(events: DataFrame, cutoff) -> DataFrame:
    """What stays when all tenants' events before a time go."""
    return events.where(F.col("timestamp") >= F.lit(cutoff))


def keep_newest(events: DataFrame, most: int = KEEP_ROWS, tenant: str | None = None, few_days: bool = False) -> DataFrame:
    """At most so many events a tenant, the newest.  few_days: tenants by days are few enough to be broadcast.

    A tenant may hold most of the rows, so no tenant is sorted in one task: counts a day tell which days stay
    whole, and only the day in which the limit falls is ranked.
    """
    day = F.to_date("timestamp")
    per_day = events.groupBy("tenant_id", day.alias("_day")).agg(F.count("*").alias("_n"))
    newer = Window.partitionBy("tenant_id").orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    room = per_day.withColumn("_room", F.lit(most) - F.coalesce(F.sum("_n").over(newer), F.lit(0))).withColumnRenamed("tenant_id", "_tenant")
    same = F.col("tenant_id").eqNullSafe(F.col("_tenant")) & day.eqNullSafe(F.col("_day"))  # without a time: the oldest
    placed = events.join(F.broadcast(room) if few_days else room, same)
    if tenant is not None:
        placed = placed.withColumn("_room", F.when(F.col("tenant_id") == tenant, F.col("_room")).otherwise(F.col("_n")))
    whole = placed.where(F.col("_room") >= F.col("_n"))
    by = Window.partitionBy("tenant_id", "_day").orderBy(F.col("timestamp").desc(), "id")
    part = placed.where((F.col("_room") > 0) & (F.col("_room") < F.col("_n"))).withColumn("_rank", F.row_number().over(by)).where("_rank <= _room")
    return whole.select(*events.columns).unionByName(part.select(*events.columns))


def retain(events: DataFrame, now: Column, days: int = KEEP_DAYS, most: int = KEEP_ROWS) -> DataFrame:
    """The daily job: first by age, then by number."""
    return keep_newest(events.where(F.col("timestamp") >= now - F.make_interval(days=F.lit(days))), most)


def page_bounds(days=None, limit=None, offset=None) -> tuple[int, int, int]:
    return max(1, days if days is not None else WINDOW_DAYS), min(max(1, limit if limit is not None else PAGE), MOST_PAGE), max(0, offset or 0)


def recent_filter(events: DataFrame, tenant: str, now: Column, days: int = WINDOW_DAYS, action: str | None = None, domain: str | None = None) -> DataFrame:
    out = events.where((F.col("tenant_id") == tenant) & (F.col("timestamp") >= now - F.make_interval(days=F.lit(days))) & (F.col("timestamp") <= now))
    if action is not None:
        out = out.where(F.col("action_taken") == action)
    if domain is not None:
        out = out.where(F.contains(F.lower("domain"), F.lit(domain.lower())))
    return out


def recent(events: DataFrame, tenant: str, now: Column, days=None, limit=None, offset=None, action: str | None = None, domain: str | None = None) -> DataFrame:
    """A page of recent events, newest first; of findings only category, name and severity are shown."""
    days, limit, offset = page_bounds(days, limit, offset)
    shown = F.transform("findings", lambda f: F.struct(f["category"].alias("category"), f["match_name"].alias("match_name"), f["severity"].alias("severity")))
    rows = recent_filter(events, tenant, now, days, action, domain).orderBy(F.col("timestamp").desc(), "id").offset(offset).limit(limit)
    return rows.select("id", "timestamp", "event_type", "action_taken", "app_name", "domain", "user_identity", shown.alias("findings"))


def recent_summary(events: DataFrame, tenant: str, now: Column, days=None, limit=None, offset=None, action: str | None = None, domain: str | None = None) -> DataFrame:
    """One row: returned, total_matching, offset, has_more, window_days of the same page."""
    days, limit, offset = page_bounds(days, limit, offset)
    n = recent_filter(events, tenant, now, days, action, domain).agg(F.count("*").alias("total_matching"))
    returned = F.greatest(F.least(F.col("total_matching") - offset, F.lit(limit)), F.lit(0))
    return n.select(returned.alias("returned"), "total_matching", F.lit(offset).alias("offset"), (F.col("total_matching") > offset + returned).alias("has_more"), F.lit(days).alias("window_days"))


# ---- exports --------------------------------------------------------------------------------------

def csv_field(x: Column) -> Column:
    return F.when(F.rlike(x, F.lit('[,"\n]')), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


CSV_HEADER = "id,timestamp,event_type,action_taken,app_name,domain,user_identity,finding_count"


def csv_lines(events: DataFrame) -> DataFrame:
    """A line for each event, quoted where it must be; write them under CSV_HEADER."""
    names = CSV_HEADER.split(",")
    at = F.col("timestamp")
    if dict(events.dtypes)["timestamp"] == "timestamp":  # whatever the session's time zone
        at = F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz"))
    text = [csv_field(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")) if c == "timestamp" else F.col(c).cast("string")) for c in names]
    return events.select("id", F.concat_ws(",", *(F.coalesce(t, F.lit("")) for t in text)).alias("line"))


def json_lines(events: DataFrame) -> DataFrame:
    return events.select("id", F.to_json(F.struct(*(c for c in events.columns if c != "synced"))).alias("line"))


def json_array(events: DataFrame, by: str = "tenant_id", most: int = KEEP_ROWS) -> DataFrame:
    """Per tenant: its events as one JSON array, oldest first.  A tenant with more events than are ever kept is an error:
    an array is one value."""
    shown = F.struct(*(c for c in events.columns if c not in ("synced", by)))
    few = events.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    checked = few.where(F.when(F.col("_n") > most, F.raise_error(F.lit(f"more than {most} events in an export"))).otherwise(F.lit(True)))
    bounded = events.join(checked, events[by].eqNullSafe(F.col("_by")), "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("timestamp", "id", shown.alias("e"))))
    return bounded.groupBy(by).agg(F.to_json(F.transform(ordered, lambda x: x["e"]), {"timestampFormat": TIME, "timestampNTZFormat": TIME}).alias("events"))


#: times in JSON, in the session's time zone
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def signed_arrays(events: DataFrame, secret: bytes, by: str = "tenant_id") -> DataFrame:
    """Per tenant: the array and a keyed digest of it."""
    return json_array(events, by).withColumn("signature", hmac_sha256(F.col("events"), secret))


def sign_archive(events_json: list[dict], exported_at: str, secret: bytes) -> dict:
    """A bounded export with an HMAC over its events."""
    body = json.dumps(events_json, sort_keys=True, separators=(",", ":"))
    return {"exported_at": exported_at, "events": events_json, "signature": hmac.new(secret, body.encode(), hashlib.sha256).hexdigest()}


def archive_is_genuine(archive: dict, secret: bytes) -> bool:
    return hmac.compare_digest(sign_archive(archive["events"], archive["exported_at"], secret)["signature"], archive["signature"])


def export(events: DataFrame, kind: str, tenant: str, now: Column, days: int = EXPORT_DAYS, secret: bytes | None = None) -> DataFrame:
    """csv: a line for each event; json: one array; signed: the array and its keyed digest, which needs a secret."""
    rows = recent_filter(events, tenant, now, max(1, days))
    if kind == "csv":
        return csv_lines(rows)
    if kind == "json":
        return json_array(rows)
    if kind == "signed":
        if secret is None:
            raise PermissionError("signed exports need a secret")
        return signed_arrays(rows, secret)
    raise ValueError(f"unknown export format {kind}")


# ---- findings at rest -----------------------------------------------------------------------------

def sealed(findings: Column, secret: str) -> Column:
    """Findings as encrypted text (AES-GCM under the secret's SHA-256; a new nonce each time)."""
    return F.base64(F.aes_encrypt(F.to_json(findings), F.unhex(F.sha2(F.lit(secret), 256)), F.lit("GCM")))


def unsealed(x: Column, secret: str, strict: bool = True) -> Column:
    """A wrong secret is an error, or null if not strict."""
    read = F.aes_decrypt if strict else F.try_aes_decrypt
    return F.from_json(read(F.unbase64(x), F.unhex(F.sha2(F.lit(secret), 256)), F.lit("GCM")).cast("string"), FINDINGS)


def write_audit(events: DataFrame, path: str, secret: str) -> None:
    """Append events, findings sealed, by tenant and day."""
    rows = events.withColumn("findings_encrypted", sealed(F.col("findings"), secret)).drop("findings").withColumn("day", F.to_date("timestamp"))
    rows.write.mode("append").partitionBy("tenant_id", "day").parquet(path)


def read_audit(spark, path: str, secret: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("findings", unsealed(F.col("findings_encrypted"), secret)).drop("findings_encrypted", "day")
