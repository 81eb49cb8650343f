"""Removal of repeated 50-byte windows by a depth-limited most-significant-digit sort of suffixes.

Two suffixes that agree in their first ``width`` bytes are the same repeated window, so no suffix is ever ordered
deeper than that.

1. Dealing.  A window's *anchor* is the ``gram``-byte string with the smallest hash inside it.  It depends on the
   window alone, so equal windows have equal anchors, and neighbouring windows mostly share theirs: such a run of
   windows is one stretch of text of up to 2 * width - gram bytes.  Each group of documents tells which anchors it
   has; windows whose anchor no other document has cannot repeat and go no further.
2. Sorting.  Each distinct stretch that is left goes, as its bytes, to the bucket of its anchor.  A bucket orders the
   suffixes that start in its stretches by most-significant-digit passes: two bytes first, then four more bytes a pass
   within the groups that still hold two suffixes, down to depth ``width``.  The groups left at that depth hold equal
   bytes, so they are exactly the repeated windows; nothing rests on a hash being unique.  The group's smallest
   doc_id goes back to each stretch.
3. Cutting.  A document loses the bytes of its windows whose smallest doc_id is less than its own.

Each group of documents sends a stretch once, with its smallest doc_id, however many documents share it, and a
bucket lists no documents.  An anchor that stands in more than ``hot`` runs of windows is refined by further digits
before it is dealt: its windows go out one by one, to the buckets of their own bytes.  Message rows grow with the
keys a group holds, never with groups times buckets.

Texts are first reduced to one row per distinct text and task; an exact copy of an earlier document is
settled by that alone.

Defined results: null text counts as empty; a text shorter than the window keeps everything; a text of any length is
handled whole, in the memory of one task; rows that repeat a doc_id do not count as earlier than each other; a null
doc_id comes after all others, as does 2^63 - 1, which counts as none; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.common import power_of_two, shuffle_partitions, text_bytes

WIDTH = 50
GRAM = 24
LAST = np.int64(2**63 - 1)
_CHUNK = 1 << 17
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_S = {n: np.uint64(n) for n in (29, 31, 32)}

#: runs of windows above which an anchor's windows are dealt one by one
HOT = 200_000
#: text that a partition of documents holds
PARTITION_BYTES = 64 << 20
#: suffixes that are ordered at a time
_SORTED = 1 << 20

#: kinds of message rows
ANCHORS, STRETCHES, RUNS, SINGLES = range(4)


# ---- kernels -------------------------------------------------------------------------------------

def _loads(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one integer."""
    n = len(buf) - 7
    out = np.empty(n, np.uint64)
    for off in range(8):
        part = buf[off : off + (n - off + 7) // 8 * 8]
        out[off::8] = part.view("<u8")
    return out


def _gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    n = len(buf) - gram + 1
    loads = _loads(buf)
    h = loads[:n] * _C[0]
    for off in [*range(8, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
        h ^= h >> _S[29]
        h += loads[off : off + n]
        h *= _C[1]
    h ^= h >> _S[32]
    h *= _C[2]
    h ^= h >> _S[29]
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    if n < width:
        x = np.minimum(x[: len(x) - (width - n)], x[width - n :])
    return x


def anchor_runs(buf: np.ndarray, ends: np.ndarray, starts: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """Runs of window starts that share their anchor: (anchor hash, anchor place, first, last window start)."""
    n = len(buf) - width + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    at = np.empty(n, np.int32)
    hashes = []
    keep = np.int64(0x7FFFFFFF)
    span = width - gram
    for s in range(0, n, _CHUNK):
        e = min(n, s + _CHUNK)
        h = _gram_hashes(buf[s : e + width - 1], gram)
        key = (h.view(np.int64) & keep) << np.int64(32)
        key |= np.arange(len(h), dtype=np.int64)
        best = _sliding_min(key, span + 1)
        at[s:e] = (best & keep).astype(np.int32) + np.int32(s)
        hashes.append((s, e, h))
    ok = np.ones(n + 1, bool)
    ok[n] = False
    for s, e in zip(starts, ends, strict=True):
        ok[max(s, e - width + 1) : e + 1] = False
    at[~ok[:n]] = -1
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.r_[0, cut]
    last = np.r_[cut, n] - 1
    good = at[first] >= 0
    first, last = first[good], last[good]
    place = at[first].astype(np.int64)
    value = np.empty(len(place), np.uint64)
    for s, e, h in hashes:  # an anchor of a window that starts in this chunk lies inside the chunk's hashes
        i, j = np.searchsorted(first, [s, e])
        value[i:j] = h[place[i:j] - s]
    return value, place, first, last


def _window_hashes(buf: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows at the given places; they only say which bucket a window goes to."""
    loads = _loads(buf)
    h = np.zeros(len(at), np.uint64)
    for off in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        h = (h ^ loads[at + off]) * _C[0]
        h ^= h >> _S[29]
    return h * _C[1]


def cut_out(buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """The given pieces of a buffer."""
    ends = np.r_[0, np.cumsum(size)].astype(np.int64)
    data = buf[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def equal_suffixes(buf: np.ndarray, at: np.ndarray, width: int):
    """Groups of two and more suffixes (places at) that agree in their first ``width`` bytes: (order, starts) pairs.

    order holds numbers of suffixes group by group, starts where each group begins.
    """
    digit = buf[at].astype(np.uint16) << np.uint16(8) | buf[at + 1]
    order = np.argsort(digit, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(digit[order]) != 0, True])
    lo = 0
    while lo < len(edge) - 1:  # whole groups of the first digit, as many as may be ordered at a time
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + _SORTED, "right")) - 1)
        part, starts = order[edge[lo] : edge[hi]], edge[lo:hi] - edge[lo]
        lo = hi
        depth = 2
        while True:
            size = np.diff(np.r_[starts, len(part)])
            many = size > 1
            part = part[np.repeat(many, size)]
            if not len(part):
                break
            group = np.repeat(np.arange(many.sum(), dtype=np.uint64), size[many])
            if depth >= width:
                yield part, np.flatnonzero(np.r_[True, np.diff(group) != 0])
                break
            key = group
            for k in range(4):  # beyond the width all suffixes agree
                key = key << np.uint64(8) | (buf[at[part] + depth + k].astype(np.uint64) if depth + k < width else np.uint64(0))
            ranked = np.argsort(key, kind="stable")
            part, key = part[ranked], key[ranked]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            depth += 4


# ---- a group of documents ------------------------------------------------------------------------

class _Docs:
    """Distinct texts of one group, laid end to end; byte 255, which UTF-8 never holds, parts them."""

    def __init__(self, t: pa.Table):
        seen: dict[bytes, list] = {}
        for key, doc, text in zip(t["th"].to_pylist(), t["doc"].to_pylist(), t["text"].to_pylist(), strict=True):
            x = seen.setdefault(key, [doc, text])
            x[0] = min(x[0], doc)
            x[1] = text if x[1] is None else x[1]
        rows = sorted((doc, key, text) for key, (doc, text) in seen.items())
        self.doc = np.array([r[0] for r in rows], np.int64)
        self.texts = [r[2] for r in rows]
        size = np.array([len(x) for x in self.texts], np.int64)
        self.start = np.cumsum(size + 1) - size - 1
        self.end = self.start + size
        self.buf = np.frombuffer(b"\xff".join(self.texts) + b"\xff" * 9, np.uint8)

    def of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, place, "right") - 1


def _rows(sender: int, to: list) -> pa.Table:
    return pa.table(
        {"to": pa.array([x[0] for x in to], pa.int64()), "sender": pa.array([sender] * len(to), pa.int64()), "kind": pa.array([x[1] for x in to], pa.int32()), "data": pa.array([x[2] for x in to], pa.binary())}
    )


MESSAGE = "to long, sender long, kind int, data binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, each as its byte planes: the planes that are zero compress away in the shuffle."""
    n = len(arrays[0])
    return np.int64(n).tobytes() + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(n, a.itemsize).T.tobytes() for a in arrays)


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(k).ravel())
        at += n * size
    return out


def _steps(rising: np.ndarray) -> np.ndarray:
    return np.diff(rising, prepend=rising.dtype.type(0))


def _sums(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)


def _by_bucket(bucket: np.ndarray):
    """(bucket, rows of it) for ascending bucket; the order inside a bucket stays."""
    order = np.argsort(bucket, kind="stable")
    names, edge = np.unique(bucket[order], return_index=True)
    return list(zip(names.tolist(), np.split(order, edge[1:]), strict=True)) if len(order) else []


def _pack_pieces(pieces: pa.Array, *arrays: np.ndarray) -> bytes:
    """Pieces of text, and arrays of their number."""
    size = np.diff(np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, pieces.offset * 8))
    data = b"".join(pieces.to_pylist())
    head = _pack(size.astype(np.uint32), *arrays)
    return np.int64([len(head), len(data)]).tobytes() + head + pa.compress(data, "zstd", asbytes=True)


def _unpack_pieces(data: bytes, *kinds) -> tuple[pa.Array, list[np.ndarray]]:
    n, full = np.frombuffer(data, np.int64, 2).tolist()
    size, *arrays = _unpack(data[16 : 16 + n], np.uint32, *kinds)
    whole = pa.decompress(data[16 + n :], full, "zstd") if full else pa.py_buffer(b"")
    ends = np.r_[0, np.cumsum(size, dtype=np.int64)]
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), whole]), arrays


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each pair of a first number and how many."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def _plan(width: int, gram: int, bits: int, hot: int):
    """The functions of the passes; bits: binary logarithm of the number of buckets."""
    low = np.uint64(0xFFFFFFFF)

    def short(value: np.ndarray) -> np.ndarray:
        """Key of an anchor: the bucket's number, then 32 more bits of the hash; the low 31 bits chose the anchor."""
        return value >> np.uint64(32 - bits)

    def top(key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(32)).astype(np.int64)

    def runs(d: _Docs):
        value, place, first, last = anchor_runs(d.buf[: len(d.buf) - 8], d.end, d.start, width, gram)
        return short(value), first, last, d.of(place)

    def rows_of(t: pa.Table, kind: int) -> list:
        """The messages of a kind, by ascending sender."""
        return sorted((who, x) for k, who, x in zip(t["kind"].to_pylist(), t["sender"].to_pylist(), t["data"].to_pylist(), strict=True) if k == kind)

    def ask_anchors(t: pa.Table) -> pa.Table:
        names, n = np.unique(runs(_Docs(t))[0], return_counts=True)
        n = np.minimum(n, 2**31).astype(np.uint32)
        return _rows(t["g"][0].as_py(), [(b, ANCHORS, _pack(_steps((names[i] & low).astype(np.uint32)), n[i])) for b, i in _by_bucket(top(names))])

    def answer_anchors(t: pa.Table) -> pa.Table:
        """To each group, which of its anchors another group has too, and which are hot."""
        b = t["to"][0].as_py()
        asked = [(g, *_unpack(x, np.uint32, np.uint32)) for g, x in rows_of(t, ANCHORS)]
        asked = [(g, _sums(steps), n) for g, steps, n in asked]
        names, back, askers = np.unique(np.concatenate([x for _, x, _ in asked]), return_inverse=True, return_counts=True)
        crowded = np.bincount(back, np.concatenate([n for _, _, n in asked])) > hot
        out, at = [], 0
        for g, x, _ in asked:
            own = back[at : at + len(x)]
            at += len(x)
            shared = askers[own] > 1
            if shared.any():
                out.append((g, ANCHORS, _pack(_steps(x[shared].astype(np.uint64) | np.uint64(b) << np.uint64(32)), crowded[own][shared])))
        return _rows(b, out)

    def stretches(d: _Docs, first: np.ndarray, last: np.ndarray, doc: np.ndarray):
        """The distinct stretches in order of their first place, the number of each run's, their smallest doc_ids."""
        coded = cut_out(d.buf, first, last - first + width).dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        lead = np.full(len(coded.dictionary), LAST)
        np.minimum.at(lead, which, d.doc[doc])
        return coded.dictionary, which, lead

    def ask_stretches(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows(0, [])
        d = _Docs(left)
        key, first, last, doc = runs(d)
        told = [_unpack(x, np.uint64, np.bool_) for _, x in rows_of(right, ANCHORS)]
        known = np.concatenate([np.zeros(0, np.uint64), *(_sums(x) for x, _ in told)])
        is_hot = np.concatenate([np.zeros(0, bool), *(x for _, x in told)])
        order = np.lexsort((doc, key))
        k, o = key[order], doc[order]
        here = np.unique(k[1:][(k[1:] == k[:-1]) & (o[1:] != o[:-1])])  # in two texts of this group
        keep = np.isin(key, np.union1d(known, here))
        key, first, last, doc = (x[keep] for x in (key, first, last, doc))
        one_by_one = np.isin(key, known[is_hot])
        bucket = top(key)
        if one_by_one.any():
            n = (last - first + 1)[one_by_one]
            single = _spread(first[one_by_one], n)
            more = (_window_hashes(d.buf, single, width) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(single), np.int64)
            rest = ~one_by_one
            first, last, doc, bucket = (np.r_[x[rest], y] for x, y in ((first, single), (last, single), (doc, np.repeat(doc[one_by_one], n)), (bucket, more)))
        pieces, which, lead = stretches(d, first, last, doc)
        to = np.zeros(len(lead), np.int64)
        to[which] = bucket
        g = left["g"][0].as_py()
        out = [(b, STRETCHES, _pack_pieces(pieces.take(pa.array(i)), lead[i])) for b, i in _by_bucket(to)]
        # the group's own note, which its bucket hands back
        out.append((g % (1 << bits), RUNS, _pack(first, (last - first).astype(np.uint16), doc.astype(np.uint32), to[which].astype(np.uint32))))
        return _rows(g, out)

    def answer_stretches(t: pa.Table) -> pa.Table:
        """The smallest doc_id of each stretch, and of single windows of it where that is less."""
        out = [(g, RUNS, x) for g, x in rows_of(t, RUNS)]
        asked = [(g, *_unpack_pieces(x, np.int64)) for g, x in rows_of(t, STRETCHES)]
        if asked:
            coded = pa.chunked_array([x for _, x, _ in asked]).combine_chunks().dictionary_encode()
            which = coded.indices.to_numpy().astype(np.int64)
            ends = np.frombuffer(coded.dictionary.buffers()[1], np.int64, len(coded.dictionary) + 1)
            buf = np.frombuffer(coded.dictionary.buffers()[2], np.uint8)
            least = np.full(len(ends) - 1, LAST)
            np.minimum.at(least, which, np.concatenate([x[0] for _, _, x in asked]))
            n = np.diff(ends) - width + 1
            at = _spread(ends[:-1], n)
            of = np.repeat(np.arange(len(n)), n)
            lower = []  # windows that an earlier document has in another stretch
            for part, starts in equal_suffixes(buf, at, width):
                first = np.repeat(np.minimum.reduceat(least[of[part]], starts), np.diff(np.r_[starts, len(part)]))
                less = first < least[of[part]]
                lower.append((part[less], first[less]))
            win, first = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*lower, strict=True)) if lower else (np.zeros(0, np.int64),) * 2
            order = np.argsort(win)
            win, first = win[order], first[order]
            edge = np.searchsorted(of[win], np.arange(len(n) + 1))
            done = 0
            for g, x, own in asked:
                mine = which[done : done + len(x)]
                done += len(x)
                out.append((g, STRETCHES, _pack(least[mine])))
                count = np.diff(edge)[mine]
                if count.any():
                    i = _spread(edge[mine], count)
                    out.append((g, SINGLES, _pack(np.repeat(np.arange(len(mine)), count).astype(np.uint32), (at[win[i]] - ends[of[win[i]]]).astype(np.uint16), first[i])))
        return _rows(t["to"][0].as_py(), out)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc", "th", "n_removed", "n_spans", "kept_sha256"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        if not left.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        d = _Docs(left)
        (_, note), = rows_of(right, RUNS)
        first, more, doc, bucket = _unpack(note, np.int64, np.uint16, np.uint32, np.uint32)
        last = first + more
        _, which, lead = stretches(d, first, last, doc)
        to = np.zeros(len(lead), np.int64)
        to[which] = bucket
        singles, told = dict(rows_of(right, SINGLES)), dict(rows_of(right, STRETCHES))
        where, offset, less = [], [], []
        for b, i in _by_bucket(to):
            lead[i] = _unpack(told[b], np.int64)[0]
            if b in singles:
                k, off, low_doc = _unpack(singles[b], np.uint32, np.uint16, np.int64)
                where.append(i[k])
                offset.append(off)
                less.append(low_doc)
        gone = lead[which] < d.doc[doc]
        step = np.zeros(len(d.buf) + width, np.int32)
        np.add.at(step, first[gone], 1)
        np.add.at(step, last[gone] + width, -1)
        if where:
            where, offset, less = np.concatenate(where), np.concatenate(offset).astype(np.int64), np.concatenate(less)
            order = np.argsort(where, kind="stable")
            where, offset, less = where[order], offset[order], less[order]
            edge = np.searchsorted(where, np.arange(len(lead) + 1))
            left_over = np.flatnonzero(~gone)
            n = np.diff(edge)[which[left_over]]
            i, run = _spread(edge[which[left_over]], n), np.repeat(left_over, n)
            p = (first[run] + offset[i])[less[i] < d.doc[doc[run]]]
            np.add.at(step, p, 1)
            np.add.at(step, p + width, -1)
        gone = np.cumsum(step) > 0
        out = []
        for i, text in enumerate(d.texts):
            own = gone[d.start[i] : d.end[i]]
            n = int(own.sum())
            kept = d.buf[d.start[i] : d.end[i]][~own].tobytes() if n else text
            spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0
            out.append((int(d.doc[i]), hashlib.sha256(text).hexdigest(), n, spans, hashlib.sha256(kept).hexdigest()))
        return pa.table([pa.array([r[k] for r in out], kinds[k]) for k in range(5)], names)

    return ask_anchors, answer_anchors, ask_stretches, answer_stretches, cut


def _distinct(groups: int):
    """Per task: each text once, and its smallest doc_id (a second row where a smaller one came later)."""

    def run(batches):
        first: dict[bytes, list] = {}
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc"].to_pylist(), batch["text"].to_pylist(), strict=True):
                x = xxhash.xxh128(text)
                key, g = x.digest(), x.intdigest() % groups
                if key in first:
                    first[key][1] = min(first[key][1], doc)
                else:
                    first[key] = [doc, doc, g]
                    out.append((g, key, doc, text))
            yield _texts(out)
        yield _texts([(g, key, least, None) for key, (sent, least, g) in first.items() if least < sent])

    return run


def _texts(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.binary()))], ["g", "th", "doc", "text"])


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group_bytes: int = 6 << 20, bucket_bytes: int = 16 << 20, hot: int = HOT) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    group_bytes, bucket_bytes: text that one group of documents holds, and that one bucket stands for.
    """
    if not 8 <= gram < width:
        raise ValueError("gram must be at least 8 and less than width")
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = text_bytes(docs)
    parts = max(shuffle_partitions(spark), -(-total // PARTITION_BYTES))
    groups = max(2 * parts, -(-total // group_bytes))
    bits = int(np.log2(min(1 << 24, power_of_two(max(16, total / bucket_bytes)))))
    ask_anchors, answer_anchors, ask_stretches, answer_stretches, cut = _plan(width, gram, bits, hot)

    bare = docs.select(F.coalesce("doc_id", F.lit(int(LAST))).alias("doc"), F.encode("text", "UTF-8").alias("text"))
    texts = bare.mapInArrow(_distinct(groups), "g long, th binary, doc long, text binary").repartition(parts, "g")
    anchors = texts.groupBy("g").applyInArrow(ask_anchors, MESSAGE).repartition(parts, "to").groupBy("to").applyInArrow(answer_anchors, MESSAGE)
    sorted_ = _answered(texts, anchors, parts).applyInArrow(ask_stretches, MESSAGE).repartition(parts, "to").groupBy("to").applyInArrow(answer_stretches, MESSAGE)
    done = _answered(texts, sorted_, parts).applyInArrow(cut, "doc long, th string, n_removed long, n_spans long, kept_sha256 string")

    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(int(LAST))).alias("doc"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("th"))
    copy = F.col("n_removed").isNull()
    whole = copy & (F.col("n_bytes") >= width)
    empty = hashlib.sha256(b"").hexdigest()
    return rows.join(done, ["doc", "th"], "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "th")).alias("kept_sha256"),
    )


def _answered(texts: DataFrame, answers: DataFrame, parts: int):
    """Documents of a group beside the answers that came back to it."""
    back = answers.select(F.col("to").alias("g"), "sender", "kind", "data").repartition(parts, "g")
    return texts.groupBy("g").cogroup(back.groupBy("g"))
