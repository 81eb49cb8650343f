"""Request bodies: JSON with message fields, URL-encoded forms, compressed data, parts."""

from __future__ import annotations

import json
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys that hold what a person wrote.
CONTENT_KEYS = frozenset(["parts", "prompt", "text", "message", "query", "input", "content"])


def url_decoded(x: Column) -> Column:
    """Percent sequences decoded, '+' left alone; malformed input stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def content_places(value) -> list[tuple]:
    """Paths to the strings that a content key holds (directly or in its list); those at the top win over nested ones."""
    found: list[tuple] = []

    def walk(node, path, in_list):
        if isinstance(node, str):
            if in_list or path and path[-1] in CONTENT_KEYS:
                found.append(path)
        elif isinstance(node, list):
            inherits = bool(path) and path[-1] in CONTENT_KEYS
            for i, x in enumerate(node):
                walk(x, (*path, i), inherits)
        elif isinstance(node, dict):
            for k, x in node.items():
                walk(x, (*path, k), False)

    walk(value, (), False)
    top = [p for p in found if len(p) == 1]
    return top or found


def value_at(value, path: tuple):
    for k in path:
        value = value[k]
    return value


def substitute(body: str, sanitized: str) -> str:
    """The masked text in place of the one content field; JSON with none or several stays, other bodies are replaced."""
    try:
        value = json.loads(body)
    except ValueError:
        return sanitized
    places = content_places(value)
    if len(places) == 1:
        value_at(value, places[0][:-1])[places[0][-1]] = sanitized
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


#: bytes that a compressed body may hold
MOST_INFLATED = 25 << 20


def inflate(body: bytes, most: int = MOST_INFLATED) -> tuple[str | None, str | None]:
    """(kind, text) of a gzip or zlib body; (None, None) for others: without a known head, cut off or with bytes behind
    the end, of another encoding than UTF-8, or larger than allowed."""
    kind = "gzip" if body[:2] == b"\x1f\x8b" else "zlib" if len(body) > 2 and body[0] & 15 == 8 and (body[0] << 8 | body[1]) % 31 == 0 else None
    if kind is None:
        return None, None
    engine = zlib.decompressobj(wbits=31 if kind == "gzip" else 15)
    try:
        out = engine.decompress(body, most + 1)
        if len(out) > most or not engine.eof or engine.unused_data:
            return None, None
        return kind, out.decode()
    except (zlib.error, UnicodeDecodeError):
        return None, None


def deflate(text: str, kind: str) -> bytes:
    engine = zlib.compressobj(wbits=31 if kind == "gzip" else 15)
    return engine.compress(text.encode()) + engine.flush()


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_locations", T.IntegerType()), T.StructField("is_json", T.BooleanType())]))
def _extracted(body: pd.Series) -> pd.DataFrame:
    def one(b):
        try:
            value = json.loads(b)
        except (ValueError, TypeError):
            return None, 0, False
        places = content_places(value)
        return ("\n".join(value_at(value, p) for p in places) if places else None), len(places), True

    return pd.DataFrame([one(b) for b in body], columns=["text", "n_locations", "is_json"])


def extract_content(df: DataFrame, body: str = "body") -> DataFrame:
    """df with text (to be scanned), n_locations and is_json.  Bodies that cannot be JSON reach Python as nulls."""
    maybe = F.rlike(F.col(body), F.lit(r'^\s*[\[{"0-9tfn-]'))
    out = df.withColumn("_x", _extracted(F.when(maybe, F.col(body))))
    return (
        out.withColumn("text", F.coalesce(F.col("_x.text"), url_decoded(F.col(body))))
        .withColumn("n_locations", F.coalesce(F.col("_x.n_locations"), F.lit(0)))
        .withColumn("is_json", F.coalesce(F.col("_x.is_json"), F.lit(False)))
        .drop("_x")
    )


@F.pandas_udf(T.StringType())
def substituted(body: pd.Series, sanitized: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else substitute(b, s) for b, s in zip(body, sanitized, strict=True)], dtype=object)


def join_parts(parts: DataFrame, request: str) -> DataFrame:
    """Texts of a request's parts (part_no, text) in their order, a line each."""
    ordered = F.array_sort(F.collect_list(F.struct("part_no", "text")))
    return parts.groupBy(request).agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))


def masked_location(url: Column) -> Column:
    """A database address without its password."""
    return F.regexp_replace(url, r"^(postgres(?:ql)?://[^:@]*):[^@]*@", "$1:***@")
