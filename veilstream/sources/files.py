"""Uploaded files as rows (filename, content): type by name, bytes or declared type; text out of them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.operators.redact import TEXT_EXTENSIONS
from veilstream.operators.rules import enforced
from veilstream.sources.packages import Package, open_document, sheets, slides
from veilstream.sources.pdf_text import pdf_text

IMAGES = ["png", "jpg", "jpeg", "bmp", "tiff", "tif", "webp", "gif"]
# Declared types and the extensions they stand for.
MIME_EXTENSION = {
    "image/png": "png", "image/jpeg": "jpg", "image/jpg": "jpg", "image/webp": "webp", "image/gif": "gif", "image/bmp": "bmp", "image/tiff": "tif", "image/tif": "tif",
    "application/pdf": "pdf", "text/plain": "txt", "text/csv": "csv", "text/markdown": "md", "application/json": "json",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/msword": "doc",
}


def extension(filename: Column) -> Column:
    """What follows the last dot, in lower case; null without a dot."""
    return F.when(F.contains(filename, F.lit(".")), F.lower(F.substring_index(filename, ".", -1)))


def sniffed(content: Column) -> Column:
    """Extension by the first bytes: images, PDF; null if they are not known."""
    head = F.hex(F.substring(content, 1, 12))
    starts = lambda *hexes: F.rlike(head, F.lit("^(?:" + "|".join(hexes) + ")"))
    return (
        F.when(starts("89504E470D0A1A0A"), "png")
        .when(starts("FFD8FF"), "jpg")
        .when(starts("474946383761", "474946383961"), "gif")
        .when(starts("255044462D"), "pdf")
        .when(starts("424D"), "bmp")
        .when(starts("49492A00", "4D4D002A"), "tif")
        .when(starts("52494646.{8}57454250"), "webp")
    )


def sniffed_office(content: Column) -> Column:
    """The same, and office documents by what their archive names near its beginning."""
    head = F.substring(content, 1, 4096)
    text = F.decode(head, "ISO-8859-1")
    names = [("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx"), ("mimetypeapplication/vnd.oasis.opendocument.text", "odt"), ("mimetypeapplication/vnd.oasis.opendocument.spreadsheet", "ods"), ("mimetypeapplication/vnd.oasis.opendocument.presentation", "odp")]
    kind = F.when(F.lit(False), F.lit(""))
    for mark, ext in names:
        kind = kind.when(F.contains(text, F.lit(mark)), F.lit(ext))
    start = F.hex(F.substring(content, 1, 4))
    return F.coalesce(sniffed(content), F.when(F.rlike(start, F.lit("^504B0[357]")), kind.otherwise(F.lit("zip"))).when(start == "D0CF11E0", F.lit("doc")))


def from_mime(mime: Column) -> Column:
    kind = F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))
    known = F.get(F.transform(F.array(kind), lambda k: F.element_at(F.create_map(*(F.lit(x) for kv in MIME_EXTENSION.items() for x in kv)), k)), F.lit(0))
    return F.coalesce(known, F.when(F.startswith(kind, F.lit("image/")), F.lit("png")).otherwise(F.lit("bin")))


def resolved_extension(filename: Column, content: Column, mime: Column) -> Column:
    """Own name first, then the bytes, then the declared type."""
    return F.coalesce(extension(filename), sniffed_office(content), from_mime(mime))


def lossy_text(content: Column) -> Column:
    """UTF-8 with U+FFFD for what is none."""
    return F.make_valid_utf8(content.cast("string"))


#: alphanumeric characters below which a PDF counts as scanned, and pages that are read by OCR then
MEANINGFUL, OCR_PAGES = 20, 20


def pdf_extractor(layer: Callable[[bytes], str], ocr: Callable[[bytes, int], str] | None = None) -> Callable[[bytes], str]:
    """An extractor for PDF out of a reader of the text layer and an OCR engine: scanned documents go through OCR, and
    what the layer holds stays if that fails or finds nothing."""

    def text(content: bytes) -> str:
        found = layer(content)
        if ocr is None or sum(c.isalnum() for c in found) >= MEANINGFUL:
            return found
        try:
            read = ocr(content, OCR_PAGES)
            return read if read.strip() else found
        except Exception:  # no engine on this machine, or a page that cannot be drawn
            return found

    return text


def uploads(requests: DataFrame) -> DataFrame:
    """requests (filename, data_base64, domain) with content, status (400 for what is no base64) and the event's label."""
    content = F.try_to_binary("data_base64", F.lit("base64"))
    label = F.when(F.length("domain") > 0, F.concat("domain", F.lit(" ("), "filename", F.lit(")"))).otherwise(F.col("filename"))
    return requests.withColumns({"content": content, "status": F.when(content.isNull(), 400).otherwise(200), "label": label})


def document_text(xml: str) -> str:
    """Text of the runs of a word-processor document, a blank after each."""
    out, at = [], 0
    while (m := re.compile(r"<w:t([^>]*)>").search(xml, at)) is not None:
        at = m.end()
        if m[1].endswith("/"):
            continue
        end = xml.find("</w:t>", at)
        if end < 0:
            break
        run = xml[at:end]
        for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
            run = run.replace(name, char)
        out.append(run + " ")
        at = end + len("</w:t>")
    return "".join(out)


def _docx(content: bytes) -> str:
    return document_text(Package(content).read("word/document.xml").decode())


#: extension -> text of the bytes; models (OCR, converters) register theirs here, as in pdf_extractor(pdf_text, ocr)
EXTRACTORS: dict[str, Callable[[bytes], str]] = {
    "docx": _docx, "docm": _docx, "xlsx": sheets, "xlsm": sheets, "pptx": slides, "pptm": slides,
    "odt": open_document, "ods": open_document, "odp": open_document, "pdf": pdf_text,
}


#: rows, and characters of their texts, that a worker holds before it hands them on
HELD_ROWS, HELD_CHARS = 64, 1 << 20
_FOUND = pa.struct([("text", pa.string()), ("error", pa.string())])


def extract_text(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None, most_bytes: int = 20 << 20) -> DataFrame:
    """files (filename, content, ext) with text and error: a format without extractor, a damaged file or one that is
    too large gives an error and no text.  Text formats stay in the JVM and are sent to Python as nulls.  Files are read
    one at a time and their texts handed on in small parts, so a worker holds one batch of Spark's (records and bytes are
    bounded by the session) and never its texts."""
    use = {**EXTRACTORS, **(extractors or {})}

    def one(name: str, ext: str, content: bytes) -> dict:
        if ext not in use:
            return {"error": f"{name}: no extractor for '{ext}'"}
        try:
            return {"text": use[ext](bytes(content))}
        except Exception as x:  # a damaged file is a result, not a failure of the job
            return {"error": f"{name}: {type(x).__name__}"}

    @F.arrow_udf("struct<text:string,error:string>")
    def other(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found, size = [], 0
            for file in batch:
                found.append(one(*(v.as_py() for v in file.values())) if file.is_valid else None)
                size += len((found[-1] or {}).get("text") or "")
                if len(found) >= HELD_ROWS or size >= HELD_CHARS:
                    yield pa.array(found, _FOUND)
                    found, size = [], 0
            if found:
                yield pa.array(found, _FOUND)

    is_text = F.coalesce(F.col("ext").isin(TEXT_EXTENSIONS), F.lit(False))
    large = F.coalesce(F.octet_length("content") > most_bytes, F.lit(False))
    read = files.withColumn("_x", other(F.when(~(is_text | large), F.struct("filename", "ext", "content"))))
    text = F.when(large, F.lit(None)).when(is_text, lossy_text(F.col("content"))).otherwise(F.col("_x.text"))
    error = F.when(large, F.concat(F.col("filename"), F.lit(": too large"))).otherwise(F.col("_x.error"))
    return read.withColumn("text", text).withColumn("error", error).drop("_x")


def unmaskable(scanned: DataFrame, p: dict) -> DataFrame:
    """For inspected files (action, ext): masking a format that is not text falls back to another action, with a reason."""
    fallback = enforced(F.lit(p["unmaskable_file_action"]))
    fallback = F.when(fallback == "Redact", F.lit("Block")).otherwise(fallback)
    needs = (F.col("action") == "Redact") & ~F.coalesce(F.col("ext").isin(TEXT_EXTENSIONS), F.lit(False))
    reason = F.concat(F.lit("files of type '"), F.coalesce("ext", F.lit("")), F.lit("' cannot be masked in place; applied instead: "), fallback)
    return scanned.withColumn("unmaskable_reason", F.when(needs, reason)).withColumn("action", F.when(needs, fallback).otherwise(F.col("action")))


def request_stops(files: DataFrame, request: str) -> DataFrame:
    """Per request of several files: whether any of them stops it, how many are masked, and how many were passed over
    (too large or unreadable: they have an error)."""
    failed = F.col("error").isNotNull() if "error" in files.columns else F.lit(False)
    stops = F.col("action").isin("Block", "RequireApproval") & ~failed
    return files.groupBy(request).agg(F.coalesce(F.bool_or(stops), F.lit(False)).alias("stopped"), F.count_if((F.col("action") == "Redact") & ~failed).alias("masked"), F.count_if(failed).alias("skipped"))
