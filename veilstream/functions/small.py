"""Small data-shaped functions: versions, dates, digests, names for people, settings."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilstream.operators.risk import _chosen


def version_key(version: Column) -> Column:
    """Dotted version as an array of numbers, which compares as versions do; a part that is no number counts 0."""
    return F.transform(F.split(version, "[.]"), lambda p: F.coalesce(p.try_cast("long"), F.lit(0).cast("long")))


def is_newer(candidate: Column, current: Column) -> Column:
    return version_key(candidate) > version_key(current)


def days_left(until: Column, now: Column, grace: int = 0) -> Column:
    """Whole days until a date plus days of grace."""
    return F.floor((F.unix_timestamp(until) + grace * 86_400 - F.unix_timestamp(now)) / 86_400).cast("int")


def lease_end(issued: Column, days: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(issued) + days * 86_400)


def fingerprint(machine: Column, host: Column) -> Column:
    """First eight bytes of a SHA-256 as upper-case groups of four."""
    x = F.upper(F.substring(F.sha2(F.concat_ws("|", machine, host), 256), 1, 16))
    return F.concat_ws("-", *(F.substring(x, i, 4) for i in (1, 5, 9, 13)))


def digest(x: Column) -> Column:
    """SHA-256 of bytes or text, as lower-case hexadecimal digits."""
    return F.sha2(x.cast("binary"), 256)


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """Keyed digest of bytes or text, inside the JVM: the hash of the outer pad and the hash of the inner pad and the message."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def local_database_url(location: Column) -> Column:
    """A file's place as a database address: drive letters need one slash more."""
    path = F.replace(location, F.lit("\\"), F.lit("/"))
    return F.concat(F.when(F.substring(path, 2, 1) == ":", "sqlite:///").otherwise("sqlite://"), path, F.lit("?mode=rwc"))


# Names of findings as people read them.
FRIENDLY = {
    "AWS_ACCESS_KEY": "AWS access key",
    "OPENAI_API_KEY": "OpenAI API key",
    "ANTHROPIC_API_KEY": "Anthropic API key",
    "GCP_API_KEY": "GCP API key",
    "AZURE_SECRET": "Azure secret",
    "PASSWORD_CONTEXT": "password",
    "DB_CONNECTION_STRING": "database connection string",
    "JWT_BEARER_TOKEN": "JWT / bearer token",
    "PRIVATE_RSA_KEY": "private key",
    "CRYPTO_WALLET": "crypto wallet address",
}


def described(findings: Column) -> Column:
    """Distinct names of findings in their order, for people."""
    names = F.transform(findings, lambda f: F.coalesce(_chosen(f["match_name"], FRIENDLY, None), F.lower(F.replace(f["match_name"], F.lit("_"), F.lit(" ")))))
    return F.when(F.size(findings) == 0, F.lit("sensitive content")).otherwise(F.array_join(F.array_distinct(names), ", "))


def outcome(action: Column) -> Column:
    """struct<stop, redact, notice> of what is done about an action at the place of use."""
    notice = _chosen(action, {"Block": "block", "RequireApproval": "block", "Redact": "redact", "Warn": "warn", "Audit": "audit"}, None)
    return F.struct(action.isin("Block", "RequireApproval").alias("stop"), (action == "Redact").alias("redact"), notice.alias("notice"))


def loggable(findings: Column) -> Column:
    """Findings fit for a log: no snippets, and no names of custom keywords."""
    return F.transform(findings, lambda f: F.struct(f["category"].alias("category"), F.when(f["category"] == "CustomKeyword", F.lit("custom keyword")).otherwise(f["match_name"]).alias("match_name"), f["severity"].alias("severity")))


def scannable_type(content_type: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return F.contains(kind, F.lit("json")) | F.contains(kind, F.lit("text/"))


def pause_left(until: Column, now: Column) -> Column:
    """Seconds until a pause ends; null when it is over or there is none."""
    return F.nullif(F.greatest(until - now, F.lit(0)), F.lit(0))


def first_set(*values: Column) -> Column:
    """The first setting that is given: environment, file, default."""
    return F.coalesce(*values)


def dechunked(body: str, most: int = 25 << 20) -> str:
    """The data of a chunked transfer body (sizes in hexadecimal, extensions ignored)."""
    out, at, size = [], 0, 0
    while True:
        end = body.find("\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size")
        n = int(body[at:end].split(";")[0].strip(), 16)
        if n == 0:
            return "".join(out)
        size += n
        if size > most or end + 2 + n > len(body):
            raise ValueError("a chunk is larger than allowed or than the body")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


@F.pandas_udf(T.BinaryType())
def dechunked_bytes(body: pd.Series) -> pd.Series:
    """The same over a column of bodies; null for one that is damaged or larger than allowed."""

    def one(b):
        try:
            return None if b is None else dechunked(bytes(b).decode("latin-1")).encode("latin-1")
        except ValueError:
            return None

    return pd.Series([one(b) for b in body], dtype=object)


def settings(text: str, defaults: dict) -> dict:
    """A JSON document of settings over its defaults, section by section."""

    def over(base, new):
        return {k: over(base[k], new[k]) if isinstance(base.get(k), dict) and isinstance(new.get(k), dict) else new.get(k, base.get(k)) for k in {**base, **new}}

    return over(defaults, json.loads(text))


def settings_file(spark, path: str, defaults: dict) -> dict:
    """The same out of a file, or a folder of one file, anywhere that Spark reads from."""
    return settings(spark.read.text(path, wholetext=True).first()["value"], defaults)


def overwrites(changes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Central updates (seq) that put an end to a local edit, which is worth a warning; keys part policies of their own."""
    from veilstream.operators.asof import with_previous

    told = with_previous(changes, "seq", F.struct("kind"), keys)
    return told.where("kind = 'central' AND previous.kind = 'local'").select(*(keys or []), "seq", "version")


def provenance(changes: DataFrame) -> DataFrame:
    """The policy in force after local edits and central updates (seq, kind, version): source, version, local_override.

    A local edit counts the version up from the last central one; a central update sets it.
    """
    last = changes.where("kind = 'central'").agg(F.max("seq").alias("s"), F.max_by("version", "seq").alias("v"))
    after = changes.join(F.broadcast(last), F.lit(True)).where("kind = 'local' AND seq > coalesce(s, -1)").agg(F.count("*").alias("n"))
    return last.join(F.broadcast(after), F.lit(True)).select(
        F.when(F.col("n") > 0, "local").when(F.col("s").isNotNull(), "central").otherwise("local").alias("source"), (F.coalesce("v", F.lit(0)) + F.col("n")).cast("long").alias("version"), (F.col("n") > 0).alias("local_override")
    )
