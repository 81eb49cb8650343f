"""Every opN query over whole tables against brute force, and the pipeline stage by stage."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.helpers import docs_of
from tests.llm.test_dedup import brute_repeats, components
from tests.llm.test_text_ops import brute_license
from veilstream.llm import license_scan, media, toxicity
from veilstream.llm.common import ASCII_APART

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()


def result(spark, name, sf=DATA):
    frame = entry.queries()[name](spark, sf)
    return frame.columns, [r.asDict() for r in frame.collect()]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_op1(spark, documents):
    columns, rows = result(spark, "op1_simhash_near_dedup")
    prints = []
    for _, text, _ in documents:
        words = re.findall(r"[^ \t\n\x0b\x0c\r]+", lowered(text))
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = components(len(documents), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    assert columns[:3] == ["doc_id", "fingerprint", "component_id"]
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == [(d[0], f"{p:016x}", documents[k][0]) for d, p, k in zip(documents, prints, root, strict=True)]


def test_op2(spark):
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{DATA}/pages.parquet' ORDER BY page_id").fetchall()
    _, rows = result(spark, "op2_html_extraction")
    by = {r["page_id"]: r for r in rows}
    assert len(rows) == len(pages)
    for page, url, html in pages:  # these pages have one article of headings and paragraphs
        import html as H

        article = re.search(r"<article>(.*)</article>", html, re.S)[1]
        blocks = [" ".join(H.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1|h2|h3|ul|li|div)(?: [^>]*)?>", article)]
        assert by[page]["text"] == "\n\n".join(filter(None, blocks)) and by[page]["n_chars"] == len(by[page]["text"]) and by[page]["url"] == url


def test_op3(spark, documents):
    _, rows = result(spark, "op3_media_columns")
    by = {r["doc_id"]: r for r in rows}
    for doc, text, _ in documents:
        data = (text or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        r = by[doc]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.to_samples(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and media.from_samples(stored) == payload


def brute_spans(text):
    """Labels of merged diagonals, straight from their definition."""
    w = re.findall(license_scan.WORD, lowered(text))
    k, out = license_scan.K, []
    grams = {}
    for i in range(len(w) - k + 1):
        grams.setdefault(tuple(w[i : i + k]), []).append(i)
    for _, label, base, words in license_scan._notices():
        n = len(words) - k + 1
        lines: dict = {}
        for place in range(n):
            for word in grams.get(tuple(words[place : place + k]), ()):
                lines.setdefault(word - place, []).append((place, word))
        if base:
            out += [(label, 1.0)] * sum(len({p for p, _ in hits}) == n for hits in lines.values())
            continue
        spans, before = [], None
        for diagonal in sorted(lines):
            lo, hi = min(x for _, x in lines[diagonal]), max(x for _, x in lines[diagonal])
            if before is None or diagonal - before[0] > license_scan.DRIFT or lo > before[2] + n or hi + n < before[1]:
                spans.append(set())
            spans[-1] |= {p for p, _ in lines[diagonal]}
            before = diagonal, lo, hi
        out += [(label, len(held) / n) for held in spans if len(held) / n >= license_scan.COVER]
    return ",".join(sorted({label for label, _ in out})), max((c for _, c in out), default=0.0)


def test_op4(spark, documents):
    _, rows = result(spark, "op4_license_scan", "/root/testdata/sf0.01")
    texts = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) and any(r["labels"] != r["base_labels"] for r in rows)
    for doc, text in texts:
        r = by[doc]
        assert (doc, r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_license(doc, text)
        assert (r["labels"], round(r["score"], 9)) == (brute_spans(text)[0], round(brute_spans(text)[1], 9))
    texts = [" ".join(words) for _, _, base, words in license_scan._notices() if not base]
    mixed = [t.split() for t in texts]
    broken = [" ".join(x[: len(x) // 2] + extra + x[len(x) // 2 + cut :]) for x in mixed for extra, cut in (([], 0), (["new"], 0), (["a", "b"], 1), ([], 2), (["w"] * 9, 0))]
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in license_scan.scan(docs_of(spark, list(enumerate(broken)))).collect()}
    assert got == {i: (brute_spans(t)[0], round(brute_spans(t)[1], 9)) for i, t in enumerate(broken)}


def test_op6(spark):
    data = "/root/testdata/sf0.1"
    _, rows = result(spark, "op6_toxicity", data)
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{data}/labels.parquet'").fetchall())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    caught = [r["predicted"] for r in held if toxic[r["doc_id"]]]
    wrong = [r["predicted"] for r in held if not toxic[r["doc_id"]]]
    assert len(caught) > 100 and sum(caught) / len(caught) >= 0.9 and sum(wrong) / len(wrong) <= 0.01


def brute_base(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    kinds = [("assign", [m.span() for m in assign.finditer(text) if len(m[2]) >= 6]), ("access", [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]), ("hex", [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])]
    spans = sorted((a, k, b) for k, (_, own) in enumerate(kinds) for a, b in own)
    return (*(len(own) for _, own in kinds), ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans))


def test_op7(spark):
    _, rows = result(spark, "op7_secret_scan", "/root/testdata/sf0.01")
    texts = dict(duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    assert len(rows) == len(texts) and any(r["n_hex"] for r in rows)
    for r in rows:
        n_assign, n_access, n_hex, spans = brute_base(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (n_assign, n_access, n_hex)
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest() and set(filter(None, spans.split(","))) <= set(r["spans"].split(","))


def test_op8(spark, documents):
    _, rows = result(spark, "op8_token_id_output")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, expected = 0, []
    for doc, text, _ in documents:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append({"doc_id": doc, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())})
        start += len(ids)
    assert sorted(rows, key=lambda r: r["doc_id"]) == expected


def test_op9(spark, documents):
    _, rows = result(spark, "op9_suffix_array_dedup")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)
    assert got == brute_repeats([(d, t) for d, t, _ in documents])


def test_op10(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    columns, rows = result(spark, "op10_source_mixing")
    expected = c.sql(entry.oracle_sql()["op10_source_mixing"]).df()
    assert sorted(tuple(r[k] for k in sorted(columns)) for r in rows) == sorted(expected[sorted(columns)].itertuples(index=False, name=None))


# ---- pipeline -------------------------------------------------------------------------------------

def test_pipeline_runs_and_its_stages_chain(spark, documents):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES, 1):
        before = docs
        docs = stage(spark, before, DATA)
        if n < len(corpus_pipeline.STAGES):
            assert docs.columns == before.columns, name
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert docs.select("doc_id", "text").exceptAll(before.select("doc_id", "text")).count() == 0 or name == "mixing"
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, expected = 0, []
    for doc, text in sorted((r["doc_id"], r["text"]) for r in before.collect()):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == sorted(expected) and {d for d, *_ in got} <= {d for d, _, _ in documents}


ROWS = [(1, None), (2, ""), (3, "you are a stupid idiot, you worthless moron and pathetic loser"), (4, "plain words " * 30), (4, "plain words " * 30), (None, "nameless text of its own " * 10), (5, "b " * 60_000), (6, " \n\t ")]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, name):
    """Nulls, empty and long texts, ties, repeated rows, an empty table, extra columns of clashing names."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = docs_of(spark, ROWS)
    out = stage(spark, docs, DATA)
    n = out.count()
    if name == "token_output":
        assert n == len(ROWS) and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    else:
        assert out.columns == docs.columns
        ids = [r["doc_id"] for r in out.collect()]
        if name == "toxicity":
            assert 3 not in ids and n == len(ROWS) - 1
        elif name == "near_dedup":  # one wordless text stays, and one of the repeated rows
            assert sorted(map(str, ids)) == ["1", "3", "4", "5", "None"]
        elif name == "decontamination":
            assert n == len(ROWS)
        else:  # one source, all of it: what has words is taken once or so
            assert {1, 2, 6}.isdisjoint(ids) and 5 in ids
    assert stage(spark, docs.limit(0), DATA).count() == 0


def test_scores_rest_on_the_text_alone(spark):
    docs = docs_of(spark, [(1, "a quiet day"), (2, "a quiet day"), (None, "a quiet day")])
    scores = {r["score"] for r in toxicity.score(docs, toxicity.Model()).collect()}
    assert len(scores) == 1


def test_words_are_cut_as_defined(spark):
    from veilstream.llm.common import n_words

    texts = ["", " a  b\tc\x0b", "a b", "\r\n", "x"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(n_words(F.col("t")).alias("n"))
    assert [r["n"] for r in frame.collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts] and ASCII_APART
