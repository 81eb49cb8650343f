import gzip
import hashlib
import io
import random
import struct
import time
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import docs_of
from veilstream.llm import media, mixing
from veilstream.llm.elias_fano import EliasFano
from veilstream.llm.token_store import NO_ID, Segment, encoder, store_and_read, write_segment

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("values", [[], [5], [0, 0, 0], [-50, -3, 7, 7, 900], [3, 7, NO_ID], list(range(0, 5000, 3))])
def test_elias_fano(values):
    code = EliasFano.from_bytes(EliasFano.encode(np.array(values, np.int64)).to_bytes())
    assert code.values().tolist() == values == [code.select(i) for i in range(len(values))]
    with pytest.raises(IndexError):
        code.select(len(values))


def test_elias_fano_is_small_and_rejects_disorder():
    values = np.sort(np.random.default_rng(1).integers(0, 10**6, 10_000))
    assert len(EliasFano.encode(values).to_bytes()) * 8 / len(values) < 2.1 + np.log2(100)
    with pytest.raises(ValueError):
        EliasFano.encode(np.array([2, 1]))


def test_segment():
    s = Segment(write_segment([3, 9], [struct.pack("<3H", 1, 2, 3), b""], 2))
    assert s.document(0).tolist() == [1, 2, 3] and s.document(1).tolist() == [] and s.doc_ids.values().tolist() == [3, 9]


ODD = ["it's Don'T 'S x'll <|endoftext|> a<|startoftext|>b", "é ́a Ǆ İstanbul ŒUVRE ß ẞ", "１２３ ½ 12.5% ª º µ ×÷ Àÿ", "\x1c a\x1db \x85c\xa0d　e", "a​b \x00 z 日本語 \U0001f600!?", "ΑΣ Σας", "A'b''s 's's"]


def test_token_store(spark):
    tokenizer = Tokenizer.from_file(PATH)
    assert encoder(PATH).by_runs
    rows = [(i * 3, x) for i, x in enumerate(ODD)] + [(1, None), (2, ""), (None, "no id"), (50, "long word " * 30_000)]
    expected, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in store_and_read(docs_of(spark, rows)).collect()), key=lambda r: (r[0] is None, r[0]))
    assert got == expected
    assert store_and_read(docs_of(spark, [])).count() == 0


def _png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0ab\0cd")) + chunk(b"IEND", b"")


def _zip(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


SAMPLES = {
    "image/png": _png(),
    "application/gzip": gzip.compress(b"hello" * 50),
    "application/zip": _zip(("a.txt", "hi")),
    "image/bmp": b"BM" + struct.pack("<IIII", 60, 0, 54, 40) + b"\0" * 42,
    "image/jpeg": b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04cdXX\xff\0YY\xff\xd9",
    "image/gif": b"GIF89a\1\0\1\0\x80\0\0" + b"\0" * 6 + b"\x2c" + b"\0" * 9 + b"\2\2\x44\1\0\x3b",
    "application/pdf": b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF",
    "audio/wav": media.to_samples(b"abcd"),
    "audio/ogg": b"OggS\0" + b"\0" * 21 + b"\1\3abc",
    "video/mp4": struct.pack(">I", 16) + b"ftypisom\0\0\0\0" + struct.pack(">I", 8) + b"moov",
}


@pytest.mark.parametrize("kind", SAMPLES)
def test_signatures(kind):
    data = SAMPLES[kind]
    assert media.sniff(data, "x/y")[:3] == (kind, True, len(data))
    assert (4, len(data), kind) in media.sniff(b"junk" + data + b"tail", "x/y")[3]
    assert media.sniff(data[:-1], "x/y")[:2] == ("x/y", False)


@pytest.mark.parametrize("piece", [b"%PDF-", b"%PDF-startxref", b"%%EOF%PDF-", b"PK\x03\x04", b"PK\x05\x06" + b"\0" * 18 + b"PK\x03\x04", b"\x1f\x8b\x08\0\0\0\0\0\0\xff", b"\xff\xd8\xff\xda\0\x02", b"\0\0\0\x08ftyp", b"OggS\0" + b"\0" * 22, b"RIFF", b"GIF89a", b"BM", b"fLaC"])
def test_long_values_take_time_in_proportion(piece):
    def took(n):
        began = time.perf_counter()
        media.sniff(piece * n, "a/b")
        return time.perf_counter() - began

    took(100)
    assert took(20_000) < 8 * took(5_000) + 0.3


def test_media_between_others():
    """Media of all kinds one after the other, with text that looks like media between them."""
    rng = random.Random(6)
    for _ in range(60):
        data, expected = b"", []
        for kind in rng.choices(list(SAMPLES), k=rng.randint(1, 6)):
            data += rng.choice([b"", b"text %PDF- BM RIFF PK\x03\x04 ", b"\xff\xd8\xff", b"\x1f\x8b\x08"]) + b"|"
            if kind not in ("application/pdf", "audio/ogg", "video/mp4"):  # those may go on behind
                expected.append((len(data), len(SAMPLES[kind]), kind))
                data += SAMPLES[kind]
        found = media.find_media(data)
        assert set(expected) <= set(found) or any(k == "image/jpeg" and n > len(SAMPLES[k]) for _, n, k in found)


def test_sniff_and_carve(spark):
    rows = [(1, _zip(("b.png", _png())), "image/png"), (2, None, "a"), (3, b"", None), (4, b"text BM RIFF GIF89a", "text/plain")]
    frame = spark.createDataFrame(rows, "id long, data binary, declared string")
    got = {r["id"]: r for r in media.sniff_column(frame, "data", "declared").collect()}
    assert (got[1]["media_type"], got[1]["declared_ok"]) == ("application/zip", False) and got[4]["embedded"] == []
    assert (got[2]["media_type"], got[3]["media_type"], got[4]["media_type"]) == (None, None, "text/plain")
    assert [bytes(r["carved"]) for r in media.carve(media.sniff_column(frame, "data", "declared"), "data").collect()] == [_png()]
    with pytest.raises(ValueError):
        media.sniff_column(frame.withColumnRenamed("id", "confirmed"), "data", "declared")


def test_stored_text(spark):
    rows = [(1, "é" * 300), (2, None), (3, ""), (4, "x" * 576), (5, "x" * 577), (None, "x" * 576)]
    got = {r["doc_id"]: r for r in media.store_and_read(docs_of(spark, rows)).collect()}
    for doc, text in rows:
        data = (text or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        r = got[doc]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_bytes"] == 44 + len(payload)
    assert got[4]["feature"] == got[None]["feature"] and got[4]["media_sha256"] == got[None]["media_sha256"]
    assert media.store_and_read(docs_of(spark, [])).count() == 0


def targets(totals, weights=(5, 2, 1)):
    keys = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(keys)}
    left, open_, out = float(sum(totals.values())), set(keys), {}
    while True:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 3 * totals[s] + 1e-9]
        if not over:
            return out | {s: left * weight[s] / w for s in open_}
        for s in over:
            out[s] = 3.0 * totals[s]
            left -= out[s]
            open_.discard(s)


def test_mix_reaches_its_targets(spark):
    rng = random.Random(4)
    rows = [(i if rng.random() > 0.02 else None, "w " * rng.randint(0, 400) if rng.random() > 0.05 else None, rng.choice(["a", "a", "a", "b", "c", None, "é", "z"])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS taken")
    size = lambda t: len((t or "").split())
    totals: dict = {}
    for _, t, s in rows:
        totals[s] = totals.get(s, 0) + size(t)
    expected = targets(totals)
    got = mixing.mix(docs, shard_words=5000).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = {n: s for s, n in totals.items()}
    taken: dict = {}
    for r in got:
        assert abs(r["target"] - expected[by[r["source_size"]]]) < 1e-6
        taken[by[r["source_size"]]] = taken.get(by[r["source_size"]], 0) + r["taken"]
    assert all(abs(taken[s] - t) <= 0.03 * t + 50 for s, t in expected.items())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5), shard_words=5000).collect()))


def test_mix_edges_and_documents(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {tuple(r) for r in mixing.mix(docs).collect()} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0
    many = docs_of(spark, [(i, f"word{i} " * (50 + i % 7)) for i in range(300)])
    out = mixing.mixed_documents(many)
    assert out.columns == many.columns and 285 <= out.count() <= 300  # one source: all of it, but for broken blocks


def test_seats_go_to_the_highest_quotients(spark):
    """One shard a source, blocks of one word: words taken are the seats."""
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(70, "a"), (41, "b"), (13, "c"), (29, "d"), (55, "e"), (8, "f")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, block=1).collect()}
    aim = targets({s: len(t.split()) for _, t, s in rows})
    quotients = sorted(((aim[s] / (2 * j + 1), -i, i) for i, (_, _, s) in enumerate(rows) for j in range(400)), reverse=True)[: sum(len(t.split()) for _, t, _ in rows)]
    seats = {i: sum(q[2] == i for q in quotients) for i in range(len(rows))}
    assert got == {i: min(n, 3 * len(rows[i][1].split())) for i, n in seats.items()}
