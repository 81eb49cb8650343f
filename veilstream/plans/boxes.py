"""Files that hold the texts of a table, built row by row: inputs of the queries and tests of file readers."""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

LINES_PER_PAGE = 40
#: files, and bytes of them, that a worker holds before it hands them on
HELD_ROWS, HELD_BYTES = 64, 1 << 20


def _xml(text: str) -> str:
    return escape(text, {"\r": "&#13;", '"': "&quot;"})


def _zip(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _relations(targets: list[str]) -> str:
    return '<Relationships xmlns="r">' + "".join(f'<Relationship Id="rId{i}" Target="{t}"/>' for i, t in enumerate(targets)) + "</Relationships>"


def xlsx(text: str) -> bytes:
    """A row a line; its first word is a shared string in column A, the rest an inline one in column C; two sheets."""
    shared: dict[str, int] = {}
    rows = []
    for n, line in enumerate(text.split("\n")):
        first, _, rest = line.partition(" ")
        rows.append(f'<row r="{n}"><c r="A{n}" t="s"><v>{shared.setdefault(first, len(shared))}</v></c><c r="C{n}" t="inlineStr"><is><r><t xml:space="preserve">{_xml(rest)}</t></r></is></c></row>')
    half = len(rows) // 2
    sheet = '<worksheet xmlns="x"><sheetData>{}</sheetData></worksheet>'
    strings = "".join(f'<si><t xml:space="preserve">{_xml(s)}</t><rPh sb="0" eb="1"><t>reading</t></rPh></si>' for s in shared)
    return _zip(
        {
            "xl/workbook.xml": '<workbook xmlns="x" xmlns:r="o"><sheets><sheet name="b" sheetId="7" r:id="rId1"/><sheet name="a" sheetId="2" r:id="rId0"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": _relations(["worksheets/two.xml", "/xl/worksheets/one.xml"]),
            "xl/worksheets/one.xml": sheet.format("".join(rows[:half])),
            "xl/worksheets/two.xml": sheet.format("".join(rows[half:])),
            "xl/sharedStrings.xml": f'<sst xmlns="x">{strings}</sst>',
        }
    )


def pptx(text: str) -> bytes:
    """A paragraph a line, its words in two runs; slides are named against their order."""
    lines = text.split("\n")
    shown = [lines[i : i + LINES_PER_PAGE] for i in range(0, len(lines), LINES_PER_PAGE)]
    names = [f"slides/slide{len(shown) - i}.xml" for i in range(len(shown))]
    run = lambda x: f"<a:r><a:t>{_xml(x)}</a:t></a:r>"
    paragraph = lambda x: f"<a:p>{run(x[: len(x) // 2])}{run(x[len(x) // 2 :])}</a:p>"
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:txBody>{}</p:txBody></p:sld>'
    ids = "".join(f'<p:sldId id="{256 + i}" r:id="rId{i}"/>' for i in range(len(names)))
    members = {
        "ppt/presentation.xml": f'<p:presentation xmlns:p="p" xmlns:r="o"><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": _relations(names),
    }
    return _zip(members | {f"ppt/{n}": slide.format("".join(map(paragraph, s))) for n, s in zip(names, shown, strict=True)})


_ODF = '<o:document-content xmlns:o="o" xmlns:text="t" xmlns:table="b"><o:body>{}</o:body></o:document-content>'


def _odf_text(line: str) -> str:
    """Runs of blanks, and blanks at either end, as elements."""
    return re.sub(r"^ +| +$| {2,}|\t", lambda m: "<text:tab/>" if m[0] == "\t" else f'<text:s text:c="{len(m[0])}"/>', _xml(line))


def odt(text: str) -> bytes:
    """Lines in turn as a paragraph, a heading and a paragraph whose first word is in a span."""
    shapes = ["<text:p>{}</text:p>", "<text:h>\n  {}</text:h>", "<text:p><text:span>{}</text:span></text:p>"]
    return _zip({"content.xml": _ODF.format("\n".join(shapes[i % 3].format(_odf_text(x)) for i, x in enumerate(text.split("\n"))))})


def odp(text: str) -> bytes:
    frames = (f"<o:page><o:frame><text:p>{_odf_text(x)}</text:p></o:frame></o:page>" for x in text.split("\n"))
    return _zip({"content.xml": _ODF.format("".join(frames))})


def ods(text: str) -> bytes:
    """A row a line: the line in the second cell, and a thousand empty ones behind it."""
    cells = '<table:table-row><table:table-cell><text:p>row</text:p></table:table-cell><table:table-cell><text:p>{}</text:p></table:table-cell><table:table-cell table:number-columns-repeated="1000"/></table:table-row>'
    return _zip({"content.xml": _ODF.format("".join(cells.format(_odf_text(x)) for x in text.split("\n")))})


def _literal(codes: bytes) -> bytes:
    return b"(" + re.sub(rb"[()\\\r\n]", lambda m: b"\\%03o" % m[0][0], codes) + b")"


def _hexed(codes: bytes) -> bytes:
    return b"<" + codes.hex().encode() + b">"


def pdf(text: str, form: int) -> bytes:
    """form 0: a table, deflated contents, escaped strings; 1: a stream of references, objects in object streams, hex
    strings with gaps for blanks; 2: plain contents in two pieces, and a table that points nowhere."""
    lines = text.split("\n")
    shown = [lines[i : i + LINES_PER_PAGE] for i in range(0, len(lines), LINES_PER_PAGE)]
    letters = sorted(set(text) - {"\n"})
    code = {c: (i + 1).to_bytes(2) for i, c in enumerate(letters)}
    coded = lambda s: b"".join(code[c] for c in s)
    chars = [f"<{code[c].hex()}> <{c.encode('utf-16-be').hex()}>" for c in letters]
    cmap = "1 begincodespacerange <0000> <ffff> endcodespacerange\n" + "".join(f"{len(chars[i : i + 100])} beginbfchar\n" + "\n".join(chars[i : i + 100]) + "\nendbfchar\n" for i in range(0, len(chars), 100))

    def gaps(line: str) -> bytes:
        parts = [m[0] for m in re.finditer(r"(?:\S+ ){,3}\S+|\s+", line)] if re.fullmatch(r"\S+(?: \S+)*", line) else [line]
        parts = [p for p in parts if p != " "]
        return b"[" + b" -300 ".join(b"-20".join(_hexed(coded(p[i : i + 60])) for i in range(0, max(1, len(p)), 60)) for p in parts) + b"] TJ"

    def content(page: list[str]) -> bytes:
        show = gaps if form == 1 else lambda x: _literal(coded(x)) + b" Tj"
        return b"BT /F1 12 Tf 50 700 Td 14 TL " + b" T* ".join(map(show, page)) + b" ET"

    objects: dict[int, bytes] = {}

    def stream(n: int, data: bytes, about: bytes = b"", deflate: bool = form != 2) -> None:
        data, how = (zlib.compress(data), b"/Filter /FlateDecode") if deflate else (data, b"")
        objects[n] = b"<< %b %b /Length %d >>\nstream\n%b\nendstream" % (about, how, len(data), data)

    stream(3, cmap.encode())
    plain = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        4: b"<< /Type /Font /Subtype /Type0 /BaseFont /F /Encoding /Identity-H /ToUnicode 3 0 R >> % a font",
    }
    kids, n = [], 5
    for page in shown:
        data, halves = content(page), []
        cut = data.find(b" T* ") if form == 2 else -1
        for part in [data] if cut < 0 else [data[:cut], data[cut:]]:
            stream(n, part)
            halves.append(b"%d 0 R" % n)
            n += 1
        plain[n] = b"<< /Type /Page /Parent 2 0 R /Contents [%b] >>" % b" ".join(halves)
        kids.append(b"%d 0 R" % n)
        n += 1
    plain[2] = b"<< /Type /Pages /Resources << /Font << /F1 4 0 R >> >> /Count %d /Kids [%b] >>" % (len(kids), b" ".join(kids))
    inside: dict[int, tuple[int, int]] = {}
    if form == 1:
        held = sorted(plain)
        at, heads = 0, []
        for i, k in enumerate(held):
            heads.append(b"%d %d" % (k, at))
            at += len(plain[k]) + 1
            inside[k] = (n, i)
        head = b" ".join(heads) + b"\n"
        stream(n, head + b"\n".join(plain[k] for k in held), b"/Type /ObjStm /N %d /First %d" % (len(held), len(head)))
        n += 1
    else:
        objects |= plain
    out, places = bytearray(b"%PDF-1.7\n"), {}
    for k, body in sorted(objects.items()):
        places[k] = len(out)
        out += b"%d 0 obj\n%b\nendobj\n" % (k, body)
    table = len(out)
    if form == 1:
        rows = [bytes(7)] + [b"\x02" + inside[k][0].to_bytes(4) + inside[k][1].to_bytes(2) if k in inside else b"\x01" + (places[k] if k in places else table).to_bytes(4) + bytes(2) for k in range(1, n + 1)]
        up = b"".join(b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above)) for row, above in zip(rows, [bytes(7), *rows]))
        stream(n, up, b"/Type /XRef /Root 1 0 R /W [1 4 2] /Size %d /DecodeParms << /Predictor 12 /Columns 7 >>" % (n + 1))
        out += b"%d 0 obj\n%b\nendobj\n" % (n, objects[n])
    else:
        out += b"xref\n0 %d\n0000000000 65535 f \n" % n + b"".join(b"%010d 00000 n \n" % (places[k] + 7 * (form == 2)) for k in range(1, n))
        out += b"trailer\n<< /Size %d /Root 1 0 R >>\n" % n
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % table)


def compressed(text: str, form: int) -> bytes:
    """A JSON body that holds the text, plain, as gzip or as zlib; the last form holds it under a key that is not read."""
    body = json.dumps({"v": 1, "note" if form == 3 else "prompt": text}, ensure_ascii=False, separators=(",", ":")).encode()
    pack = zlib.compressobj(wbits=31 if form in (1, 3) else 15)
    return body if form == 0 else pack.compress(body) + pack.flush()


OFFICE: list[tuple[str, Callable[[str], bytes]]] = [("xlsx", xlsx), ("pptx", pptx), ("odt", odt), ("ods", ods), ("odp", odp)]
PDF: list[tuple[str, Callable[[str], bytes]]] = [("pdf", lambda t, f=f: pdf(t, f)) for f in range(3)]
BODIES: list[tuple[str, Callable[[str], bytes]]] = [("body", lambda t, f=f: compressed(t, f)) for f in range(4)]


def packed(docs: DataFrame, makers: list[tuple[str, Callable[[str], bytes]]]) -> DataFrame:
    """docs (doc_id, text) to doc_id, filename, ext, content: each row's text in one of the forms, in turn."""
    schema = pa.schema([("doc_id", pa.int64()), ("filename", pa.string()), ("ext", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for n, text in zip(*batch.columns, strict=True):
                n = n.as_py()
                ext, make = makers[n % len(makers)]
                held.append({"doc_id": n, "filename": f"d{n}.{ext}", "ext": ext, "content": make(text.as_py() or "")})
                size += len(held[-1]["content"])
                if len(held) >= HELD_ROWS or size >= HELD_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id long, filename string, ext string, content binary")
