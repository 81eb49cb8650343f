"""Readers of PDF and office files, compressed bodies, latency counters: round trips, damage, bounds."""

import time
import zlib

import pytest
from pyspark.sql import functions as F

from veilstream.operators import metrics as M
from veilstream.operators.policy import policy
from veilstream.plans import boxes
from veilstream.sources import bodies, files, multipart
from veilstream.sources.packages import TooLarge, open_document, sheets, slides
from veilstream.sources.pdf_text import Damaged, pdf_text

TEXTS = ["", "a", "\n\n", "hello (world) \\ end\nline two  double  \n\n  lead\té 😀 x", "x\n" * 90, " a b ", "long " * 30_000]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_round_trips(text):
    assert [pdf_text(boxes.pdf(text, f)) for f in range(3)] == [text] * 3
    assert [slides(boxes.pptx(text)), open_document(boxes.odt(text)), open_document(boxes.odp(text))] == [text] * 3
    assert open_document(boxes.ods(text)) == "\n".join("row" + ("\t" + x if x else "") for x in text.split("\n"))
    assert sheets(boxes.xlsx(text)) == "\n".join("\t\t".join([x.partition(" ")[0], x.partition(" ")[2]]) for x in text.split("\n"))


@pytest.mark.parametrize("n", [8180, 8190, 9000, 30_000])
def test_white_space_before_a_long_heading(n):
    # the parser hands on what it holds, blanks here, before a run that its buffer has no room for
    text = "first\n" + "a" * n + "\nend"
    assert open_document(boxes.odt(text)) == text


def _plain(content: bytes, font: bytes = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /Differences [65 /eacute /one /uni20AC /fi] >> >>", extra: bytes = b"") -> bytes:
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /Contents 4 0 R /Resources << /Font << /F 5 0 R >> /XObject << /X 6 0 R >> >> >>"]
    objects += [b"<< /Length %d >> stream\n%b\nendstream" % (len(content), content), font, b"<< /Subtype /Form /Length 32 >> stream\nBT /F 9 Tf (in a form) Tj ET /X Do\nendstream"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj %b endobj\n" % (i + 1, x) for i, x in enumerate(objects)) + extra + b"trailer << /Root 1 0 R >>"


def test_operators_of_a_page():
    shown = pdf_text(_plain(b"BT /F 9 Tf 1 0 0 1 10 700 Tm (one) Tj 1 0 0 1 60 700 Tm (two) Tj 0 -12 Td (a\\(b\\)\\101 (c)) Tj [(W) -900 (X) 50 (Y)] TJ (next) ' ET"))
    assert shown == "one two\na(b)é (c)W XY\nnext"
    assert pdf_text(_plain(b"BT /F 9 Tf (BCD) Tj ET")) == "1€fi"
    assert pdf_text(_plain(b"BT /F 9 Tf (a) Tj ET BI /W 1 ID \x00)( EI BT (b) Tj ET /X Do")) == "a\nb\nin a form"
    assert pdf_text(_plain(b"BT /F 9 Tf (a) Tj", extra=b"4 0 obj << /Length 3 >> stream\nBT /F 9 Tf (newer) Tj ET\nendstream endobj\n")) == "newer"


def test_damaged_and_hostile_files():
    for bad in (b"", b"text", b"%PDF-1.4 nothing"):
        with pytest.raises(Damaged):
            pdf_text(bad)
    with pytest.raises(Damaged, match="encrypted"):
        pdf_text(_plain(b"").replace(b"/Root", b"/Encrypt 9 0 R /Root"))
    with pytest.raises(Damaged, match="inflates"):
        pdf_text(boxes.pdf("x" * 100_000, 0), most=10_000)
    with pytest.raises(TooLarge):
        slides(boxes.pptx("x" * 100_000), most=10_000)
    with pytest.raises(TooLarge):
        open_document(boxes._zip({"content.xml": boxes._ODF.format('<text:p><text:s text:c="900000000"/></text:p>')}))
    with pytest.raises(TooLarge):
        open_document(boxes._zip({"content.xml": '<!DOCTYPE x [<!ENTITY e "ee">]><x>&e;</x>'}))
    shared = {"xl/workbook.xml": '<w xmlns:r="o"><sheet r:id="rId0"/></w>', "xl/_rels/workbook.xml.rels": boxes._relations(["s.xml"])}
    many = {"xl/s.xml": "<s>" + '<row><c t="s"><v>0</v></c></row>' * 200 + "</s>", "xl/sharedStrings.xml": f"<t><si><t>{'y' * 9000}</t></si></t>"}
    with pytest.raises(TooLarge):
        sheets(boxes._zip(shared | many), most=1_000_000)


def test_time_grows_with_the_file():
    def seconds(n):
        made, start = boxes.pdf("some words here\n" * n, 0), time.perf_counter()
        pdf_text(made)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(16_000) < 12 * seconds(4_000) + 0.5


def test_files_as_rows(spark):
    rows = [(1, "a.pdf", "pdf", boxes.pdf("of a pdf", 1)), (2, "b.xlsx", "xlsx", b"PK\x03\x04"), (3, "c.odt", "odt", boxes.odt("of odt")), (4, "d.pdf", "pdf", None), (5, "e.docx", "docx", boxes._zip({"word/document.xml": "<w:t>x</w:t>"}))]
    got = {r["n"]: (r["text"], r["error"]) for r in files.extract_text(spark.createDataFrame(rows, "n int, filename string, ext string, content binary")).collect()}
    assert got == {1: ("of a pdf", None), 2: (None, "b.xlsx: BadZipFile"), 3: ("of odt", None), 4: (None, "d.pdf: TypeError"), 5: ("x ", None)}
    empty = files.extract_text(spark.createDataFrame([], "n int, filename string, ext string, content binary"))
    assert empty.count() == 0


def _resident() -> str:
    return f"{int(open('/proc/self/statm').read().split()[1]) >> 8:08d}"  # MB, at 4 kB a page


def _growth(spark, rows) -> int:
    held = [int(x["mb"]) for x in rows.collect()]
    assert len(held) == 60
    return max(held) - min(held)


def test_a_worker_does_not_hold_its_texts(spark):
    """60 small files of 4 MB of text each, in one batch."""
    files_of = spark.range(60, numPartitions=1).selectExpr("id", "concat(id, '.pdf') AS filename", "'pdf' AS ext", "CAST('x' AS BINARY) AS content")
    read = files.extract_text(files_of, {"pdf": lambda b: _resident().ljust(4 << 20)})
    assert _growth(spark, read.select(F.left("text", F.lit(8)).alias("mb"))) < 120


def test_a_worker_does_not_hold_the_files_it_builds(spark):
    docs = spark.range(60, numPartitions=1).selectExpr("id AS doc_id", "'x' AS text")
    made = boxes.packed(docs, [("pdf", lambda t: _resident().encode().ljust(4 << 20))])
    assert _growth(spark, made.select(F.left(F.col("content").cast("string"), F.lit(8)).alias("mb"))) < 120


def test_files_are_made_once(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "doc_id long, text string")
    read = files.extract_text(boxes.packed(docs, [*boxes.PDF, ("txt", str.encode)]))
    assert read._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r["doc_id"]: (r["ext"], r["text"], r["error"]) for r in read.collect()} == {1: ("pdf", "a", None), 2: ("pdf", "", None), 3: ("txt", "b", None)}


def test_text_formats_and_large_files_do_not_reach_a_reader(spark):
    rows = [("a.txt", "txt", b"caf\xe9"), ("b.txt", "txt", b"x" * 9), ("c.pdf", "pdf", b"x" * 9), ("d.pdf", "pdf", b"x" * 8), ("e.txt", "txt", None), ("f", None, b"x"), ("g.txt", "txt", b"")]
    read = files.extract_text(spark.createDataFrame(rows, "filename string, ext string, content binary"), {"txt": lambda b: 1 / 0, "pdf": lambda b: str(len(b))}, most_bytes=8)
    got = {r["filename"]: (r["text"], r["error"]) for r in read.collect()}
    assert got == {"a.txt": ("caf\ufffd", None), "b.txt": (None, "b.txt: too large"), "c.pdf": (None, "c.pdf: too large"), "d.pdf": ("8", None), "e.txt": (None, None), "f": (None, "f: no extractor for 'None'"), "g.txt": ("", None)}


def test_inflated_bodies():
    whole = boxes.compressed("a", 1)
    assert bodies.inflate(whole) == ("gzip", '{"v":1,"prompt":"a"}') and bodies.inflate(whole, 5) == (None, None)
    assert bodies.inflate(whole[:-3]) == bodies.inflate(whole + b"x") == bodies.inflate(zlib.compress(b"\xff")) == (None, None)
    assert bodies.inflate(bodies.deflate("é", "zlib")) == ("zlib", "é")


def test_masked_bodies(spark):
    """Two fields, no JSON, damaged, null and repeated bodies; columns of the same names; a text of some megabytes."""
    two = bodies.deflate('{"parts":["mail ab@x.com","b"]}', "gzip")
    long = boxes.compressed("word " * 400_000 + "mail ab@x.com", 2)
    given = [(1, two), (2, bodies.deflate("ab@x.com", "zlib")), (3, two[:-2]), (4, None), (5, b"ab@x.com"), (6, boxes.compressed("mail ab@x.com", 1)), (6, boxes.compressed("mail ab@x.com", 1)), (7, long)]
    table = spark.createDataFrame(given, "n int, content binary").withColumn("text", F.lit("other")).withColumn("action", F.lit("other"))
    got = {r["n"]: r for r in multipart.masked_bodies(table, policy()).collect()}
    assert {n: (got[n]["kind"], got[n]["action"], got[n]["masked"]) for n in range(1, 6)} == {1: ("gzip", "Redact", False), 2: ("zlib", "Allow", False), 3: (None, "Allow", False), 4: (None, "Allow", False), 5: (None, "Allow", False)}
    assert all(got[n]["sent"] == x for n, x in given[:5]) and got[1]["text"] == "mail ab@x.com\nb"
    assert bodies.inflate(bytes(got[6]["sent"])) == ("gzip", '{"v":1,"prompt":"mail [REDACTED_EMAIL]"}')
    kind, text = bodies.inflate(bytes(got[7]["sent"]))
    assert kind == "zlib" and text.endswith('mail [REDACTED_EMAIL]"}') and len(text) > 2_000_000
    assert multipart.masked_bodies(table.where("n > 9"), policy()).count() == 0


def test_latency_counters_of_a_stream(spark, tmp_path):
    """Update mode: the last row of each combination is what the whole table gives; parts add up."""
    rows = spark.range(500).selectExpr("CAST(id % 3 AS STRING) AS provider", "id * id / 9000.0D AS seconds")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    last = {}
    stream = M.latency_counters(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")), ["provider"])

    def keep(batch, _):
        last.update({r["provider"]: (list(r["buckets"]), r["n"], round(r["total"], 6)) for r in batch.collect()})

    stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    whole = M.latency_counters(rows, ["provider"])
    shown = lambda frame: {r["provider"]: (list(r["buckets"]), r["n"], round(r["total"], 6)) for r in frame.collect()}
    parts = M.latency_counters(rows.withColumn("p", F.col("seconds") > 1), ["provider", "p"])
    assert last == shown(whole) == shown(M.merged_counters(parts, ["provider"]))
    none = M.latency_counters(rows.where("false"), ["provider"])
    assert none.select(M.quantile(0.5)).collect() == []
    beyond = M.latency_counters(spark.createDataFrame([("a", 99.0), ("b", None), ("c", 0.004)], "provider string, seconds double"), ["provider"])
    assert {r[0]: r[1] for r in beyond.select("provider", M.quantile(0.5)).collect()} == {"a": 10.0, "b": None, "c": 0.0025}
