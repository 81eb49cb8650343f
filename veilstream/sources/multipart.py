"""Multipart bodies as rows, and compressed bodies that are written back in their own form."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilstream.operators.inspect import inspect
from veilstream.operators.lookups import upload_action
from veilstream.sources.bodies import content_places, deflate, inflate, substitute, value_at
from veilstream.sources.files import extension, extract_text, lossy_text

PARTS = "request_id string, part_no int, name string, filename string, mime string, content binary"
_PARAM = re.compile(r'([a-z]+)\*?="?([^";]*)"?', re.I)


def parts_of(body: bytes, boundary: str) -> Iterator[tuple[str | None, str | None, str | None, bytes]]:
    """(name, filename, type, content) of each part; a part that is damaged ends the body."""
    mark = b"--" + boundary.encode()
    pieces = body.split(mark)
    for piece in pieces[1:]:
        if piece.startswith(b"--"):
            return
        head, blank, content = piece.removeprefix(b"\r\n").partition(b"\r\n\r\n")
        if not blank:
            return
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))}
        about = dict(_PARAM.findall(headers.get("content-disposition", "").partition(";")[2]))
        yield about.get("name"), about.get("filename"), headers.get("content-type"), content.removesuffix(b"\r\n")


def parse_parts(requests: DataFrame) -> DataFrame:
    """requests (request_id, body, boundary) to one row a part."""

    def run(frames):
        for pdf in frames:
            rows = [(r.request_id, n, *part) for r in pdf.itertuples() for n, part in enumerate(parts_of(bytes(r.body), r.boundary))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")])

    return requests.select("request_id", "body", "boundary").mapInPandas(run, PARTS)


#: bodies above this size are refused
MOST_BYTES = 25 << 20


def scanned(requests: DataFrame, p: dict) -> DataFrame:
    """Multipart requests (request_id, body, boundary) with text and action: files by the policy for their extension
    (blocked, passed over, or read), text parts as they are, each with a line end; what would be masked is blocked, as
    the parts cannot be written back.  Bodies that are too large are blocked unread."""
    fits = F.octet_length("body") <= MOST_BYTES
    parts = parse_parts(requests.where(fits))
    is_file = F.col("filename").isNotNull()
    parts = parts.withColumn("ext", extension(F.col("filename")))
    parts = parts.withColumn("upload", F.when(is_file, upload_action(F.coalesce("ext", "filename"), p["uploads"])))
    files = extract_text(parts.where(is_file & (F.col("upload") == "inspect"))).select("request_id", "part_no", "text")
    plain = parts.where(~is_file).select("request_id", "part_no", lossy_text(F.col("content")).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("part_no", "text")))
    texts = files.union(plain).where("text IS NOT NULL").groupBy("request_id").agg(F.concat_ws("", F.transform(ordered, lambda x: F.concat(x["text"], F.lit("\n")))).alias("text"))
    stops = parts.groupBy("request_id").agg(F.bool_or(F.coalesce(F.col("upload") == "block", F.lit(False))).alias("stopped"))
    rows = requests.select("request_id", F.coalesce(fits, F.lit(True)).alias("fits")).join(texts, "request_id", "left").join(stops, "request_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    found = inspect(rows, p)
    blocked = F.coalesce("stopped", F.lit(False)) | ~F.col("fits")
    return found.select("request_id", "text", F.when(blocked | (F.col("action") == "Redact"), "Block").otherwise(F.col("action")).alias("action"), "findings")


def rewritten(body: bytes, mask) -> bytes | None:
    """A compressed JSON body with its content field masked, compressed as it was; None if there is nothing to scan."""
    kind, text = inflate(body)
    places = _places(text)
    return deflate(substitute(text, mask(value_at(json.loads(text), places[0]))), kind) if places else None


def _places(text: str | None) -> list[tuple]:
    try:
        return content_places(json.loads(text)) if text else []
    except (ValueError, RecursionError):
        return []


@F.pandas_udf(T.StructType().add("kind", "string").add("text", "string").add("fields", "integer"))
def _opened(body: pd.Series) -> pd.DataFrame:
    def one(b):
        kind, text = inflate(bytes(b)) if b is not None else (None, None)
        places = _places(text)
        value = json.loads(text) if places else None
        return kind, "\n".join(value_at(value, p) for p in places) if places else None, len(places)

    return pd.DataFrame([one(b) for b in body], columns=["kind", "text", "fields"])


def masked_bodies(bodies: DataFrame, p: dict, body: str = "content") -> DataFrame:
    """Rows with a binary body, with kind (gzip, zlib, or null for what is no compressed text), text (what a person wrote,
    null if there is none), action, findings, sent (null if it is stopped) and masked (whether sent is another body).

    JSON with content fields is inspected; where the action masks and there is one field, the body is written anew in its
    own form.  JSON with several fields cannot be written back: it is sent as it is and masked is false, as for plain
    bodies.  All others (no content field, no JSON, damaged, null) are sent byte for byte."""
    mine = [c for c in bodies.columns if c in ("text", "kind", "fields", "findings", "risk", "action", "matched_rules", "sanitized", "sent", "masked")]
    large = F.octet_length(body) > MOST_BYTES
    opened = bodies.drop(*mine).withColumn("_open", _opened(F.when(~large, F.col(body)))).withColumn("_scanned", F.col("_open.text").isNotNull()).withColumn("text", F.coalesce("_open.text", F.lit("")))
    found = inspect(opened, p).select("*", "_open.kind", "_open.fields").drop("risk", "matched_rules")
    kept = [f for f in found.schema.fields if f.name not in ("_open", "fields", "sanitized")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sent, masked = [], []
            for x, action, fields, text in zip(*(batch[c].to_pylist() for c in (body, "action", "fields", "sanitized")), strict=True):
                new = rewritten(x, lambda _, text=text: text) if action == "Redact" and fields == 1 else None
                masked.append(new is not None)
                sent.append(None if action in ("Block", "RequireApproval") else x if new is None else new)
            columns = [batch[f.name] for f in kept] + [pa.array(sent, pa.binary()), pa.array(masked, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + ["sent", "masked"])

    written = found.mapInArrow(run, T.StructType([*kept, T.StructField("sent", T.BinaryType()), T.StructField("masked", T.BooleanType())]))
    return written.withColumn("text", F.when(F.col("_scanned"), F.col("text"))).drop("_scanned")
