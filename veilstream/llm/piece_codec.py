"""SentencePiece encoding and decoding with tables of distinct chunks.

Where no piece of the model holds a white-space marker behind another character, no merge can cross the start of a
marked word (a run of markers and what follows up to the next).  So the words of a slice of texts are cut at once in
their bytes, each distinct word is segmented once by the library, and the ids are joined back by position.  Decoding
goes the same way: ids are cut before pieces that begin with a marker, and each distinct run of ids is decoded once.
A model that does not allow it has its texts encoded whole.  Both are narrow stages over slices of bounded size.

Defined results: null text counts as empty; an empty text has the end id alone and decodes to the empty text; the marker
character itself (U+2581) in a text reads as a blank, as in the library; rows that repeat a doc_id and null doc_ids
each stay a row; a very long text is a slice by itself; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.common import give_back
from veilstream.llm.token_store import _slices

MARK = "▁"
BLANK = 0x20
#: bytes of text that are encoded at a time (a longer text goes by itself)
SLICE_BYTES = 4 << 20
CODED = "doc_id long, ids array<int>"


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists laid end to end, and where each starts and ends."""
    ends = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=ends[1:])
    return np.fromiter((i for x in lists for i in x), np.int32, ends[-1]), ends


def _strings(offsets: np.ndarray, data) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data))


def _bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the bytes of an array of large strings, without what a slice leaves out."""
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64, len(array) + 1, 8 * array.offset)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], held[at[0] : at[-1]]


class PieceCodec:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        self.by_words = not any(MARK in p.lstrip(MARK) for p in pieces) and self._keeps_blanks()
        #: the ids of a blank alone, which as a text of its own would get a second one
        self.blank = self._encode(["a "])[0][len(self._encode(["a"])[0]) :]

    def _keeps_blanks(self) -> bool:
        """Whether the model puts one marker before a text and one for each blank, and changes nothing else."""
        probe = "  Ａﬁ  é x́\t\n "
        return self.model.normalize(probe) == (MARK + probe).replace(" ", MARK)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []

    def encode(self, texts: pa.Array, end_id: int | None = None) -> pa.Array:
        """Lists of ids of texts without nulls, with end_id behind each."""
        texts = texts.cast(pa.large_string())
        ids, ends = self._by_words(texts) if self.by_words else _flat(self._encode(texts.to_pylist()))
        if end_id is not None:
            ids, ends = np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))
        return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(ids, pa.int32()))

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.replace_substring(texts, MARK, " ")
        first = pc.if_else(pc.greater(pc.binary_length(plain), 0), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
        at, data = _bytes_of(pc.binary_join_element_wise(first, plain, pa.scalar("", pa.large_string())))
        blank = data == BLANK
        starts = blank.copy()
        starts[1:] &= ~blank[:-1]
        starts[at[:-1][np.diff(at) > 0]] = True  # each text begins with a word of its own
        starts = np.flatnonzero(starts)
        coded = _strings(np.r_[starts, len(data)], np.ascontiguousarray(data)).dictionary_encode()
        words = coded.dictionary.to_pylist()
        segmented = [ids if w != " " else self.blank for w, ids in zip(words, self._encode([w[1:] for w in words]), strict=True)]
        ids, ends = _flat(segmented)
        joined = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(ids, pa.int32())).take(coded.indices)
        return joined.values.to_numpy(), joined.offsets.to_numpy()[np.searchsorted(starts, at)]

    def decode(self, coded: pa.Array) -> pa.Array:
        """Texts of lists of ids."""
        ids, at = coded.flatten().to_numpy(), coded.offsets.to_numpy()
        at = at - at[0]
        filled = at[:-1][np.diff(at) > 0]
        if not self.by_words or not self.marked[ids[filled]].all():
            return pa.array([self.model.decode(x) if x else "" for x in coded.to_pylist()], pa.large_string())
        starts = self.marked[ids]
        starts[filled] = True
        starts = np.flatnonzero(starts)
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(4 * np.r_[starts, len(ids)]), pa.py_buffer(np.ascontiguousarray(ids, np.int32))]).dictionary_encode()
        distinct = [np.frombuffer(x, np.int32).tolist() for x in runs.dictionary.to_pylist()]
        # the library takes the marker off that a text begins with, so each run lacks one
        texts = pa.array([" " + x for x in self.model.decode(distinct)] if distinct else [], pa.large_string())
        ends, data = _bytes_of(texts.take(runs.indices))
        joined = _strings(ends[np.searchsorted(starts, at)], np.ascontiguousarray(data))
        return pc.utf8_slice_codeunits(joined, 1)


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec a process."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def _model_path(model: str | None) -> str:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return str(model)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def encode(docs: DataFrame, model: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Per document of docs (doc_id, text): its ids."""
    path = _model_path(model)

    def run(batches):
        for batch in batches:
            for a, b in _slices(batch["text"], SLICE_BYTES):
                ids = codec(path).encode(batch["text"].slice(a, b - a), end_id)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), ids.cast(pa.list_(pa.int32()))], ["doc_id", "ids"])
        give_back()

    return _texts(docs).mapInArrow(run, CODED)


def decode(coded: DataFrame, model: str | None = None) -> DataFrame:
    """Per row of coded (doc_id, ids): the text of its ids (null ids: the empty text)."""
    path = _model_path(model)

    def run(batches):
        for batch in batches:
            size = pc.list_value_length(batch["ids"]).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, at = np.cumsum(size), 0
            while at < len(ends):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES // 4, "right")))
                text = codec(path).decode(batch["ids"].slice(at, to - at).cast(pa.large_list(pa.int32())))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, to - at), text.cast(pa.string())], ["doc_id", "text"])
                at = to
        give_back()

    return coded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Per document: its ids and the text decoded from these, in one stage."""
    path = _model_path(model)

    def run(batches):
        for batch in batches:
            for a, b in _slices(batch["text"], SLICE_BYTES):
                ids = codec(path).encode(batch["text"].slice(a, b - a), end_id)
                text = codec(path).decode(ids)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), ids.cast(pa.list_(pa.int32())), text.cast(pa.string())], ["doc_id", "ids", "decoded"])
        give_back()

    return _texts(docs).mapInArrow(run, f"{CODED}, decoded string")


def digest(coded: DataFrame) -> DataFrame:
    """Number and hash of the ids (decimal, one blank between), hash of the decoded text."""
    line = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(line.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
