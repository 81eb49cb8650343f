"""Fill-in-middle, piece codec and source divergence: against brute force over whole tables, odd rows, hot groups."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

import __spark_entry__ as entry
from tests.llm.helpers import DOCS, docs_of
from veilstream.llm import fill_middle, piece_codec, source_divergence

DATA = "/root/testdata/sf0.001"
MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
ODD = [None, "", " ", "  ", "\n", "a", " a", "a ", "  a  b ", "a\x00b \x00", "x▁y ▁ ▁▁z", "é漢字 🙂  \t\x0b\x0c\r q", "   w", "A<P>b c", "<S", "M> <M", "<p> d <s>", "word " * 40_000, "x" * 50_000, " " * 30_000, "Zé-ß'Z zé", "日本語" * 9_000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(spark, name):
    return [r.asDict() for r in entry.queries()[name](spark, DATA).collect()]


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()


# --- fill-in-middle


def brute_fill(doc_id, text, seed=42, cut=50, first=80):
    text = text or ""
    units = re.findall(r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+", text)
    h = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= cut:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < first:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_op11_whole_table(spark, documents):
    want = {}
    for i, text, _, _ in documents:
        n, form, p, m, out = brute_fill(i, text)
        want[i] = {"doc_id": i, "n": n, "form": form, "prefix_chars": p, "middle_chars": m, "output_sha256": sha(out), "restored_sha256": sha(text or "")}
    rows = rows_of(spark, "op11_fill_in_middle")
    assert {r["doc_id"]: r for r in rows} == want and len(rows) == len(documents)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_fill_odd_rows_and_parameters(spark):
    docs = docs_of(spark, [(i, t) for i, t in enumerate(ODD)] + [(None, "no name here"), (5, "a"), (5, "a"), (7, "other text")])
    key = lambda x: (x[0] is None, x[0] or 0, x[-1])
    for cut, first in ((100, 0), (100, 100), (0, 50), (60, 50)):
        out = fill_middle.transform(docs, cut=cut, suffix_first=first)
        got = sorted((tuple(r) for r in out.collect()), key=key)
        assert got == sorted(((d.doc_id, *brute_fill(d.doc_id, d.text, 42, cut, first)) for d in docs.collect()), key=key)
        restored = {r["restored_sha256"] for r in fill_middle.digest(out).collect()}
        assert restored == {sha(d.text or "") for d in docs.collect()}
    assert fill_middle.digest(fill_middle.transform(docs.where("false"))).collect() == []


def test_fill_slices_keep_order_and_content(spark, monkeypatch):
    docs = docs_of(spark, [(i, f"one {i} two\n{'z ' * (i % 7)}") for i in range(300)], parts=1)
    whole = sorted(fill_middle.transform(docs).collect())
    monkeypatch.setattr(fill_middle, "SLICE_BYTES", 64)
    assert sorted(fill_middle.transform(docs).collect()) == whole


def test_fill_other_markers(spark):
    docs = docs_of(spark, [(i, "it's a <P> and (a|b) " * 3) for i in range(40)])
    markers = ("<|it's|>", "(s)", "[m]")
    out = fill_middle.transform(docs, cut=100, markers=markers)
    rows = out.select(fill_middle.restore(out.output, out.form, markers).alias("t"), "form").collect()
    assert {r.t for r in rows} == {"it's a <P> and (a|b) " * 3} and "plain" not in {r.form for r in rows}


# --- pieces


def library(text, sp=SentencePieceProcessor(model_file=MODEL)):
    ids = sp.encode(text or "") + [2]
    return ids, sp.decode(ids)


def test_op13_whole_table(spark, documents):
    want = {}
    for i, text, _, _ in documents:
        ids, back = library(text)
        want[i] = {"doc_id": i, "n_tokens": len(ids), "ids_sha256": sha(" ".join(map(str, ids))), "decoded_sha256": sha(back)}
    rows = rows_of(spark, "op13_piece_codec")
    assert {r["doc_id"]: r for r in rows} == want and len(rows) == len(documents)


def test_pieces_of_odd_rows(spark):
    docs = docs_of(spark, [(i, t) for i, t in enumerate(ODD)] + [(None, "no name"), (3, "x"), (3, "x")])
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1:]))
    want = sorted(((d.doc_id, *library(d.text)) for d in docs.collect()), key=key)
    assert sorted((tuple(r) for r in piece_codec.round_trip(docs).collect()), key=key) == want
    apart = piece_codec.encode(docs)
    assert sorted((tuple(r) for r in apart.collect()), key=key) == sorted((w[:2] for w in want), key=key)
    assert sorted((tuple(r) for r in piece_codec.decode(apart).collect()), key=key) == sorted(((w[0], w[2]) for w in want), key=key)
    assert piece_codec.digest(piece_codec.round_trip(docs.where("false"))).collect() == []


_alphabet = st.sampled_from([*"abeinrst.,'<>0", " ", " ", " ", "▁", "\n", "\t", "\x00", "é", "漢", "🙂", "the ", " of", "́", "　"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(_alphabet, max_size=30).map("".join), max_size=6))
def test_pieces_equal_the_library(texts):
    c = piece_codec.codec(MODEL)
    assert c.by_words
    coded = c.encode(pa.array(texts, pa.string()), 2)
    assert coded.to_pylist() == [library(t)[0] for t in texts]
    assert c.decode(coded).to_pylist() == [library(t)[1] for t in texts]
    assert c.encode(pa.array(texts, pa.string())).to_pylist() == [library(t)[0][:-1] for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from([0, 1, 2, 28705, 259, 13, 264, 3, 229, 180]), st.integers(0, 31999)), max_size=12), max_size=4))
def test_decoding_of_any_ids(lists):
    c = piece_codec.codec(MODEL)
    want = [c.model.decode(x) if x else "" for x in lists]
    assert c.decode(pa.array(lists, pa.large_list(pa.int32()))).to_pylist() == want


def test_slices_of_a_longer_column():
    c = piece_codec.codec(MODEL)
    texts = pa.array(["left out", " a b", "", "c  d", "left out"], pa.string()).slice(1, 3)
    coded = c.encode(texts, 2)
    assert coded.to_pylist() == [library(t)[0] for t in [" a b", "", "c  d"]]
    assert c.decode(coded.slice(1)).to_pylist() == ["", "c  d"]


def test_models_whose_pieces_cross_markers_go_whole():
    c = piece_codec.PieceCodec(MODEL)
    c.by_words = False
    texts = ["a  b c", "", " x ▁"]
    coded = c.encode(pa.array(texts, pa.string()), 2)
    assert coded.to_pylist() == [library(t)[0] for t in texts] and c.decode(coded).to_pylist() == [library(t)[1] for t in texts]


# --- divergence


def brute_audit(docs, least=3, shown=200):
    """docs: (text, lang, source)"""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        found = [t.translate(low) for t in term.findall(text or "")]
        counts[lang, source].update(found)
        held[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        base = Counter()
        for s in sources:
            base.update({t: counts[lang, s][t] for t in kept})

        def probabilities(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p, q = {s: probabilities(counts[lang, s]) for s in sources}, probabilities(base)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(b, sum(f(p[s][t], p[b][t]) for t in kept)) for b in sources if b != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, shown)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, r) for r, (item, value) in enumerate(ranked[:limit], 1)]
    return sorted(out)


def test_op12_whole_table(spark, documents):
    rows = rows_of(spark, "op12_source_divergence")
    assert sorted(tuple(r.values()) for r in rows) == brute_audit([d[1:] for d in documents])


def _audited(spark, docs, **more):
    frame = spark.createDataFrame([(i, t, lang, source, 0) for i, (t, lang, source) in enumerate(docs)], DOCS).repartition(3)
    return sorted(tuple(r) for r in source_divergence.audit(frame.selectExpr("*", "1 AS term", "2 AS n", "3 AS total", "4 AS block"), **more).collect())


def test_audit_of_odd_rows(spark):
    r = random.Random(1)
    texts = [*ODD, *ODD, *ODD, *(" ".join(r.choice(["one", "Two", "ÉÈ", "three-four", "x9y"]) for _ in range(r.randrange(9))) for _ in range(60))]
    docs = [(t, r.choice(["en", "en", None, ""]), r.choice(["a", "b", None, "", "é", "Z"])) for t in texts]
    docs += [("only here", "fr", "a"), (None, "fr", "b"), ("42 !", "de", "a")]  # languages without kept terms, one source
    assert _audited(spark, docs) == brute_audit(docs)
    assert _audited(spark, docs, least_docs=1, shown=3) == brute_audit(docs, 1, 3)
    assert _audited(spark, []) == []


def test_audit_in_many_buckets_and_blocks(spark, monkeypatch):
    """One source holds a third of all rows; buckets of few counts, blocks of few sources."""
    r = random.Random(2)
    docs = [(" ".join(f"w{chr(97 + r.randrange(26))}{chr(97 + r.randrange(9))}" for _ in range(12)), "en", "hot" if r.random() < 0.34 else f"s{r.randrange(9)}") for _ in range(240)]
    whole = brute_audit(docs)
    monkeypatch.setattr(source_divergence, "BUCKET", 150)
    monkeypatch.setattr(source_divergence, "BLOCK", 3)
    assert _audited(spark, docs) == whole


def test_equal_hashes_are_parted_by_bytes():
    data = np.frombuffer(b"one two one three two ab", np.uint8)
    starts, stops = source_divergence.boundaries(data, np.array([0, len(data)]))
    words = [bytes(data[a:b]) for a, b in zip(starts, stops)]
    assert words == [b"one", b"two", b"one", b"three", b"two", b"ab"]
    for hash_ in (xxhash.xxh3_64_intdigest, lambda _: 7, len):
        group, first = source_divergence.grouped(data, starts, stops, hash_)
        assert [words[first[g]] for g in group] == words


def test_boundaries_between_texts():
    data = np.frombuffer("abcdéf g".encode(), np.uint8)  # texts "ab", "", "cdéf g"
    starts, stops = source_divergence.boundaries(data, np.array([0, 2, 2, 9]))
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, stops)] == ["ab", "cdéf", "g"]


def test_probability_steps_are_exact():
    r = random.Random(3)
    pairs = [(r.randrange(10**k), r.randrange(1, 9 * 10**15)) for k in range(1, 13) for _ in range(40)]
    pairs = [(n, max(total, n + 1)) for n, total in pairs]
    got = source_divergence.probability(np.array([n for n, _ in pairs]), np.array([t for _, t in pairs]))
    assert got.tolist() == [1 + 10**9 * (n + 1) // t for n, t in pairs]
