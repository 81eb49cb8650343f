"""Token-id store: texts encoded with a public tokenizer, ids concatenated, document boundaries in Elias-Fano code.

A store is a folder of segments.  A segment holds consecutive documents in ascending doc_id: a header, the
doc_ids and the document boundaries in Elias-Fano code, and the id array (2 bytes an id if every id of the
vocabulary fits, else 4).  Segments are numbered (part, seq); parts follow the ranges of doc_id.

White space parts the pre-tokens of the tokenizer used here, so the texts of a slice are cut there at once and only
distinct runs are encoded.  A run of plain letters, digits and signs is put together from the pieces of its lower
case, which repeat far more often and are remembered; any other goes through the tokenizer as it is.

Defined results: null text counts as empty; an empty text has the end id alone; a null doc_id sorts last and is
read back as null; documents that repeat a doc_id follow each other by text, equal rows each count; a text longer than
a slice is encoded by itself and may make a segment longer; other columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.llm.common import give_back, scratch, shuffle_partitions
from veilstream.llm.elias_fano import EliasFano

MAGIC = b"VSTOK2\0\0"
_HEAD = struct.Struct("<8sBQQQQ")
NO_ID = 2**63 - 1
SEGMENT_IDS = 1 << 20
#: bytes of text that are encoded at a time (a longer text goes by itself)
SLICE_BYTES = 4 << 20
#: entries of each of the two generations of remembered pieces
REMEMBERED = 150_000
SEGMENTS = "part int, seq int, n_docs long, n_ids long, data binary"

#: runs that may be cut into pieces, and the pieces of their lower case: letters, a digit, signs
_PLAIN = r"^[A-Za-z0-9!-&(-/:-@\[-`{-~À-ÖØ-öø-ÿ]+$"
_PIECE = r"([a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+)"
#: pieces that are encoded as one text
_TOGETHER = 200


class _Memory:
    """A map of bounded size: two generations, of which the older goes when the younger is full."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key):
        x = self.young.get(key)
        if x is None and (x := self.old.get(key)) is not None:
            self.put(key, x)
        return x

    def put(self, key, value):
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


class _Table:
    """Lists of ids laid end to end."""

    def __init__(self, ids: np.ndarray, size: np.ndarray):
        self.ids, self.size = ids, size

    @classmethod
    def of(cls, parts: list[bytes], kind: np.dtype) -> _Table:
        return cls(np.frombuffer(b"".join(parts), kind), np.fromiter(map(len, parts), np.int64, len(parts)) // kind.itemsize)

    def take(self, which: np.ndarray) -> _Table:
        size = self.size[which]
        total = int(size.sum())
        kind = np.int32 if max(total, len(self.ids)) < 1 << 31 else np.int64
        place = np.repeat(((np.cumsum(self.size) - self.size)[which] - (np.cumsum(size) - size)).astype(kind), size)
        place += np.arange(total, dtype=kind)
        return _Table(self.ids[place], size)

    def joined(self, offsets: np.ndarray) -> _Table:
        """Neighbouring lists made one, from each offset to the next."""
        return _Table(self.ids, np.diff(np.r_[0, np.cumsum(self.size)][offsets]))

    def __add__(self, other: _Table) -> _Table:
        return _Table(np.r_[self.ids, other.ids], np.r_[self.size, other.size])


class Encoder:
    """Ids of texts, equal to the tokenizer's own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known = _Memory(REMEMBERED)
        ends = [n for x, n in self.tokenizer.get_vocab().items() if x.endswith("</w>")]
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[ends] = True
        self.by_runs = self._splits_on_white_space()

    def _splits_on_white_space(self) -> bool:
        """Whether runs may be encoded apart: tested on a sample of shapes; else whole texts are encoded."""
        t = self.tokenizer
        probe = "Ab, c1's é́x\t́y  z!?\nÅngström<|x 42 don't"
        alone = [i for x in probe.encode().split() for i in t.encode(x.decode(), add_special_tokens=False).ids]
        pieces = [i for x in re.findall(_PIECE, "ab12,c!?é") for i in t.encode(x, add_special_tokens=False).ids]
        return alone == t.encode(probe, add_special_tokens=False).ids and pieces == t.encode("Ab12,C!?É", add_special_tokens=False).ids

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: pa.Array) -> _Table:
        if not self.by_runs:
            return _Table.of(self._bytes(texts.to_pylist()), self.kind)
        split = pc.ascii_split_whitespace(texts)
        coded = split.values.dictionary_encode()
        runs = coded.dictionary
        plain = pc.and_not(pc.match_substring_regex(runs, _PLAIN), pc.match_substring(runs, "<|"))
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(runs.filter(plain)), _PIECE, r"\1 "))
        pieces = cut.values.dictionary_encode()
        parted = self._pieces(pieces.dictionary.to_pylist()).take(pieces.indices.to_numpy()).joined(cut.offsets.to_numpy())
        table = parted + self._whole(runs.filter(pc.invert(plain)).to_pylist())
        place = plain.to_numpy(zero_copy_only=False)
        number = np.where(place, np.cumsum(place) - 1, place.sum() + np.cumsum(~place) - 1)
        return table.take(number[coded.indices.to_numpy()]).joined(split.offsets.to_numpy())

    def _remembered(self, texts: list[str], encode) -> _Table:
        found = {x: self.known.get(x) for x in texts}
        found[""] = b""  # what stands before leading and after trailing white space
        missing = [k for k, v in found.items() if v is None]
        for x, ids in zip(missing, encode(missing), strict=True):
            found[x] = ids
            self.known.put(x, ids)
        return _Table.of([found[x] for x in texts], self.kind)

    def _whole(self, runs: list[str]) -> _Table:
        return self._remembered(runs, self._bytes)

    def _pieces(self, pieces: list[str]) -> _Table:
        return self._remembered(pieces, self._one_word_each)

    def _one_word_each(self, pieces: list[str]) -> list[bytes]:
        """Pieces are one word each to the tokenizer, so many go as one text, cut at the ids that end a word."""
        parts = [pieces[i : i + _TOGETHER] for i in range(0, len(pieces), _TOGETHER)]
        out: list[bytes] = []
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join(x) for x in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * self.kind.itemsize
            if len(ends) == len(part) and ends[-1] == ids.nbytes:
                data, ends = ids.tobytes(), ends.tolist()
                out += [data[a:b] for a, b in zip([0, *ends], ends)]
            else:
                out += self._bytes(part)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a process, with what it remembers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_segment(doc_ids: list[int], ids: list[bytes], width: int) -> bytes:
    return pack_segment(np.array(doc_ids, np.int64), np.array([len(x) // width for x in ids], np.int64), np.frombuffer(b"".join(ids), f"<u{width}"))


def pack_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, nameless: int = 0) -> bytes:
    """nameless: how many documents at the end have no doc_id."""
    names = EliasFano.encode(doc_ids).to_bytes()
    ends = EliasFano.encode(np.r_[0, np.cumsum(lengths)]).to_bytes()
    return b"".join([_HEAD.pack(MAGIC, ids.itemsize, len(names), len(ends), len(ids), nameless), names, ends, ids.tobytes()])


class Segment:
    """A segment as read back: document i is ids[ends.select(i):ends.select(i + 1)]."""

    def __init__(self, data: bytes):
        magic, width, a, b, n, self.nameless = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment")
        at = _HEAD.size
        self.doc_ids = EliasFano.from_bytes(data[at : at + a])
        self.ends = EliasFano.from_bytes(data[at + a : at + a + b])
        self.ids = np.frombuffer(data, f"<u{width}", n, at + a + b)

    def document(self, i: int) -> np.ndarray:
        first, end = self.ends.select([i, i + 1])
        return self.ids[first:end]


def _slices(text: pa.Array, size: int = SLICE_BYTES):
    """Ranges of texts of bounded size."""
    ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, to
        at = to


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode docs (doc_id, text), append end_id to each, and write the segments under path."""
    spark = docs.sparkSession

    def run(batches):
        encode = encoder(tokenizer)
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def segment():
            nonlocal seq, held
            names, none, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            row = (part, seq, len(names), len(ids), pack_segment(names, lengths, ids, int(none.sum())))
            seq, held = seq + 1, []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seq", "n_docs", "n_ids", "data"])

        n = 0
        for batch in batches:
            doc, none = batch["doc"].to_numpy(), batch["none"].to_numpy(zero_copy_only=False)
            for a, b in _slices(batch["text"]):
                coded = encode(batch["text"].slice(a, b - a))
                ends = np.cumsum(coded.size)
                ids, lengths, ends = np.insert(coded.ids, ends, end_id), coded.size + 1, ends + np.arange(1, b - a + 1)
                at = 0
                while at < b - a:  # a segment ends with the document that fills it
                    first = ends[at - 1] if at else 0
                    to = min(b - a, int(np.searchsorted(ends, first + segment_ids - n)) + 1)
                    held.append((doc[a + at : a + to], none[a + at : a + to], lengths[at:to], ids[first : ends[to - 1]]))
                    n += int(ends[to - 1] - first)
                    at = to
                    if n >= segment_ids:
                        yield segment()
                        n = 0
        if held:
            yield segment()
        give_back()

    rows = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(shuffle_partitions(spark), "none", "doc").sortWithinPartitions("none", "doc", F.xxhash64("text"))
    ordered.mapInArrow(run, SEGMENTS).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    segments = spark.read.schema(SEGMENTS).parquet(path)

    def run(batches):
        for batch in batches:
            for part, seq, data in zip(batch["part"].to_pylist(), batch["seq"].to_pylist(), batch["data"].to_pylist(), strict=True):
                s = Segment(data)
                ends = s.ends.select(np.arange(s.ends.n))
                wide = s.ids.astype("<u4")
                view = memoryview(wide).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                n = len(crc)
                names = s.doc_ids.values()
                nameless = np.arange(n) >= n - s.nameless
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64(), mask=nameless), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())],
                    ["doc_id", "part", "seq", "here", "n_tokens", "ids_crc32"],
                )

    from pyspark.sql import Window

    sizes = segments.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("seq_start")).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("base"))
    docs = segments.select("part", "seq", "data").mapInArrow(run, "doc_id long, part int, seq int, here long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("here")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write docs as a store in the shared folder and return what reading it back gives."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_store(docs, path, str(tokenizer), end_id)
    return read_store(spark, path)
