"""Benchmark decontamination by SimHash of item-sized windows.

A document is compared with every benchmark item through windows of the item's own number of words, at every
place.  A window that shares no shingle with an item has similarity 0 to it, so fingerprints are computed only
for windows over a shared shingle.  Fingerprints of items of one size stand in a multi-index: 8 blocks of 8 bits,
each listing the items within 2 bits; two fingerprints that differ in at most 23 bits share a list in one block
at least, so no item within that radius is missed.  (Similarity 0.8 means about 10 differing bits, and 23 is
more than four standard deviations above.)  Candidates are verified by the exact weighted Jaccard similarity of
the shingle counts.

Words are runs of letters, digits and underscores in lower case; a shingle has five words, or all of an item
that has fewer.  Items are handled in blocks of bounded size; if there are several, only documents that share a shingle
with some item are looked at block by block.

Defined results: null and empty texts match nothing, null and wordless items are matched by nothing; a document
shorter than an item is one window; a text of any length is looked at whole, some thousands of windows at a time;
repeated rows are each reported; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from veilstream.llm.common import give_back, materialise, scratch

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
#: words of items that one pass holds in memory
BLOCK_WORDS = 1_000_000
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NEAR = np.array([x for x in range(256) if x.bit_count() <= 2], np.uint8)


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def similarity(a: list, b: list, k: int = SHINGLE) -> float:
    """Weighted Jaccard similarity of the shingle counts of two word lists."""
    x, y = (Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (a, b))
    both = sum((x & y).values())
    either = sum((x | y).values())
    return both / either if either else 0.0


def _shingle_hashes(word_hash: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(word_hash) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h ^ word_hash[j : j + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _window_fingerprints(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the n shingles from each start on."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=ones[1:])
    over = 2 * (ones[starts + n] - ones[starts]) > n
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()


def _stretches(at: np.ndarray, most: int = 1 << 14) -> list[np.ndarray]:
    """Neighbouring windows together, so many at a time: a long text may share shingles with an item all along."""
    return [x for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) for x in np.split(run, range(most, len(run), most))]


class _SizeIndex:
    """Items of one number of words."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        rows = fps.view(np.uint8).reshape(-1, 8)
        self.lists = []
        for block in range(8):
            lists: list[list[int]] = [[] for _ in range(256)]
            for item, x in enumerate(rows[:, block]):
                for y in x ^ _NEAR:
                    lists[y].append(item)
            self.lists.append([np.array(x, np.int32) for x in lists])

    def near(self, fps: np.ndarray) -> list[tuple[int, int]]:
        """(query, item) within the radius."""
        found = set()
        rows = fps.view(np.uint8).reshape(-1, 8)
        for block, lists in enumerate(self.lists):
            for q, x in enumerate(rows[:, block]):
                own = lists[x]
                close = own[np.bitwise_count(self.fps[own] ^ fps[q]) <= RADIUS]
                found.update((q, int(i)) for i in close)
        return sorted(found)


class Matcher:
    """A block of benchmark items, ready to be looked for in texts."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = SIMILARITY, shingle: int = SHINGLE):
        self.threshold, self.shingle = threshold, shingle
        self.items = [(i, w) for i, t in items if (w := words(t))]
        self.vocabulary = {w: n for n, w in enumerate(dict.fromkeys(w for _, ws in self.items for w in ws))}
        sizes: dict[int, list[int]] = {}
        self.ks = sorted({min(shingle, len(w)) for _, w in self.items})
        self.codes: dict[int, tuple[np.ndarray, list]] = {}
        for n, (_, w) in enumerate(self.items):
            sizes.setdefault(len(w), []).append(n)
        for k in self.ks:
            codes: dict[int, set[int]] = {}
            for _, w in self.items:
                if min(shingle, len(w)) == k:
                    for c in self._codes(np.array([self.vocabulary[x] for x in w], np.int64), k)[1]:
                        codes.setdefault(int(c), set()).add(len(w))
            names = np.array(sorted(codes), np.uint64)
            self.codes[k] = names, [sorted(codes[int(c)]) for c in names]
        self.sizes = {}
        for m, own in sizes.items():
            k = min(shingle, m)
            fps = np.concatenate([_window_fingerprints(_shingle_hashes(self._hashes(self.items[n][1]), k), np.array([0]), m - k + 1) for n in own])
            self.sizes[m] = own, _SizeIndex(fps)

    @staticmethod
    def _hashes(ws: list[str]) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(w) for w in ws], np.uint64)

    @staticmethod
    def _codes(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where k known words stand in a row, and a hash of them."""
        known = ids >= 0
        n = len(ids) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ok = known[:n].copy()
        for j in range(1, k):
            ok &= known[j : j + n]
        at = np.flatnonzero(ok)
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h = (h + ids[at + j].astype(np.uint64) + np.uint64(1)) * _MIX
            h ^= h >> np.uint64(31)
        return at, h

    def _starts(self, ids: np.ndarray) -> dict[int, set[int]]:
        """By item size, the window starts over a shared shingle."""
        out: dict[int, set[int]] = {}
        for k in self.ks:
            at, h = self._codes(ids, k)
            names, sizes = self.codes[k]
            if not len(at):
                continue
            where = np.minimum(np.searchsorted(names, h), len(names) - 1)
            for i in np.flatnonzero(names[where] == h).tolist():
                for m in sizes[where[i]]:
                    last = max(0, len(ids) - m)
                    lo, hi = max(0, int(at[i]) + k - m), min(int(at[i]), last)
                    out.setdefault(m, set()).update(range(lo, hi + 1))
        return out

    def hits(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item_id, best similarity, first word, words) of each item found in the text."""
        ws = words(text)
        ids = np.fromiter(map(self.vocabulary.get, ws, repeat(-1)), np.int64, len(ws))
        best: dict[int, tuple[float, int, int]] = {}
        for m, starts in self._starts(ids).items():
            k = min(self.shingle, m)
            width = min(m, len(ws))
            if width < k:
                continue
            at = np.array(sorted(starts), np.int64)
            for part in _stretches(at):
                region = ws[part[0] : part[-1] + width]
                fps = _window_fingerprints(_shingle_hashes(self._hashes(region), k), part - part[0], width - k + 1)
                own, index = self.sizes[m]
                for q, j in index.near(fps):
                    n = own[j]
                    s = int(part[q])
                    x = similarity(ws[s : s + width], self.items[n][1], k)
                    if x >= self.threshold and x > best.get(n, (0.0,))[0]:
                        best[n] = (x, s, width)
        return [(self.items[n][0], *v) for n, v in sorted(best.items())]


def matchers(benchmark: DataFrame, threshold: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> Iterator[Matcher]:
    """Blocks of items; each is collected by itself."""
    block, n = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        n += len(row["text"] or "") // 4 + 1
        if n >= block_words:
            yield Matcher(block, threshold)
            block, n = [], 0
    if block:
        yield Matcher(block, threshold)


#: bits of the map of item shingles (8 MB, whatever the size of the benchmark)
MAP_BITS = 26
_CHUNK = 1 << 13


def _slots(text: str | None, ks: list[int], bits: int) -> np.ndarray:
    """Places in the map of the text's shingles of these numbers of words."""
    hashes = Matcher._hashes(words(text))
    return np.concatenate([np.zeros(0, np.uint64), *(_shingle_hashes(hashes, k) for k in ks)]) >> np.uint64(64 - bits)


def _item_map(benchmark: DataFrame, shingle: int, bits: int) -> tuple[list[int], np.ndarray]:
    """The numbers of words of the items' shingles, and a map of bits in which all of these are set."""

    def run(batches):
        held, ks = np.zeros(1 << bits, bool), set()
        for batch in batches:
            for text in batch["text"].to_pylist():
                if n := len(words(text)):
                    ks.add(min(shingle, n))
                    held[_slots(text, [min(shingle, n)], bits)] = True
        packed = np.packbits(held).reshape(-1, min(_CHUNK, len(held) // 8))
        at = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), *(-k for k in ks)], pa.int32()), pa.array([*(x.tobytes() for x in packed[at]), *(b"" for _ in ks)], pa.binary())], ["at", "bits"])

    def joined(key, table):
        parts = table["bits"].to_pylist()
        return pa.table({"at": table["at"].slice(0, 1), "bits": pa.array([np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in parts]).tobytes()], pa.binary())})

    kind = "at int, bits binary"
    out, ks = np.zeros((1 << bits) // 8, np.uint8), []
    for row in benchmark.select("text").mapInArrow(run, kind).groupBy("at").applyInArrow(joined, kind).toLocalIterator():
        if row["at"] < 0:
            ks.append(-row["at"])
        else:
            part = np.frombuffer(bytes(row["bits"]), np.uint8)
            out[row["at"] * len(part) : (row["at"] + 1) * len(part)] = part
    return sorted(ks), out


def _sharing(docs: DataFrame, ks: list[int], item_map: np.ndarray, bits: int, shared: bool = True) -> DataFrame:
    """The rows of docs that share a shingle with some item (or none, if not shared); a few more may be among the first."""

    def run(batches):
        held = np.unpackbits(item_map).view(bool)
        for batch in batches:
            yield batch.filter(pa.array([bool(held[_slots(x, ks, bits)].any()) == shared for x in batch["text"].to_pylist()], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


_FOUND = {"doc_id": pa.int64(), "item_id": pa.int64(), "similarity": pa.float64(), "first_word": pa.int64(), "n_words": pa.int64()}
FOUND = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def _hits(docs: DataFrame, m: Matcher) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [(doc, i, round(x, 6), s, w) for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for i, x, s, w in m.hits(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(_FOUND.values())], list(_FOUND))

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def _without_hits(docs: DataFrame, m: Matcher) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([not m.hits(x) for x in batch["text"].to_pylist()], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, block_words: int = BLOCK_WORDS, map_bits: int = MAP_BITS) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words for every benchmark item that a document holds.

    A benchmark of one block is looked for in one pass.  Of a larger one the documents that share a shingle with any
    item are written down first, by a map of bits, and block after block is looked for in these: the driver holds
    two blocks at most, and the documents are read once.
    """
    spark = docs.sparkSession
    blocks = matchers(benchmark, threshold, block_words)
    held = [m for m in (next(blocks, None), next(blocks, None)) if m is not None]
    if len(held) < 2:
        return _hits(docs, held[0]) if held else spark.createDataFrame([], FOUND)
    near = materialise(_sharing(docs.select("doc_id", "text"), *_item_map(benchmark, SHINGLE, map_bits), map_bits), "sharing")
    paths = []
    while held:
        paths.append(scratch(spark, "leaks"))
        _hits(near, held.pop(0)).write.parquet(paths[-1])
        held += [m for m in [next(blocks, None)] if m is not None]
    return spark.read.schema(FOUND).parquet(*paths)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, block_words: int = BLOCK_WORDS, map_bits: int = MAP_BITS) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns."""
    blocks = matchers(benchmark, threshold, block_words)
    held = [m for m in (next(blocks, None), next(blocks, None)) if m is not None]
    if len(held) < 2:
        return _without_hits(docs, held[0]) if held else docs
    ks, item_map = _item_map(benchmark, SHINGLE, map_bits)
    near = materialise(_sharing(docs, ks, item_map, map_bits), "sharing")
    while held:
        near = materialise(_without_hits(near, held.pop(0)), "no-leaks")
        held += [m for m in [next(blocks, None)] if m is not None]
    return _sharing(docs, ks, item_map, map_bits, shared=False).unionByName(near)
