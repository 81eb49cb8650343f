"""SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into blocks, so few that fingerprints within the threshold agree up to ``slack`` bits in one
block at least.  In each block the anchors are a covering code of radius 1: a Hamming code on the low bits
(15 or 31 of them) with every pattern of the bits above.  A fingerprint has one home anchor per block and is
also sent to every anchor within 1 + slack of it, so two that must meet do meet at the home of either.
Each anchor compares the fingerprints at home with all that were sent there.

What an anchor finds is passed on as at most one link per fingerprint (to the smallest node it is connected to
there), not as all pairs.  An anchor that holds too many fingerprints is cut into tiles of homes by visitors,
which different tasks compare; the number of such anchors has a fixed bound by the choice of the tile size.

Defined results: null and empty texts have fingerprint zero and link like any other; a text of fewer words than
a shingle counts as one shingle; rows that repeat a doc_id are one document; a null doc_id can link others but
is never a component's name (null if it holds no other); an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.common import give_back, materialise, power_of_two, shuffle_partitions
from veilstream.llm.components import roots

SHINGLE = 4
THRESHOLD = 4
SEED = 42
#: Node names at and above this belong to fingerprints that only rows without doc_id have.
NAMELESS = 1 << 62
#: Above so many fingerprints the finer code (two blocks) is used; both find the same links.
FINE_FROM = 1 << 25
_STEP = 1 << 16
_PAIRS = 1 << 20
#: fingerprints that are sent to their anchors at a time
_ROWS = 2048
#: fingerprints of a chunk at most, and chunks of a table that is not small: their pairs are the tasks
CHUNK, LEAST_CHUNKS = 1 << 19, 8


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return two_fingerprints(text, shingle, seed, False)[0]


def two_fingerprints(text: str | None, shingle: int = SHINGLE, seed: int = SEED, second: bool = True) -> tuple[int, int]:
    """The fingerprint, and one of the same shingles under a second hash (0 unless asked for)."""
    return _folded(_hashes(text, shingle, seed), seed, second)


def _hashes(text: str | None, shingle: int, seed: int):
    """The hashes of a text's shingles in order, in arrays of bounded size."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    whole = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:n].tolist()
    end = end[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _STEP):
        yield np.array([digest(whole[s:e], seed) for s, e in zip(start[at : at + _STEP], end[at : at + _STEP], strict=True)], np.uint64)


def _folded(hashes, seed: int, second: bool) -> tuple[int, int]:
    ones, more, n = np.zeros(64, np.int64), np.zeros(64, np.int64), 0
    for h in hashes:
        n += len(h)
        ones += _bits(h)
        if second:
            more += _bits(_mixed(_mixed(h) + np.uint64(seed)))
    return tuple(int(np.packbits(2 * x > n, bitorder="little").view("<u8")[0]) for x in (ones, more))


def shingle_set(hashes: list[np.ndarray]) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)


def _set_key(own: np.ndarray) -> int:
    """A name for a set of shingles; 0 is kept for the empty one."""
    return (xxhash.xxh64_intdigest(own.tobytes(), SEED) | 1) - (1 << 63) if len(own) else 0


def _bits(h: np.ndarray) -> np.ndarray:
    """In how many of the hashes each bit is set."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, second: bool = False) -> DataFrame:
    """doc_id, text_key (hash of the text), fp and fp2 (64 bits each, as signed integers) for every row."""

    def run(batches):
        for batch in batches:
            both = np.array([two_fingerprints(x, shingle, seed, second) for x in batch["text"].to_pylist()], np.uint64).reshape(-1, 2)
            fps = [pa.array(np.ascontiguousarray(both[:, k]).view(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], *fps], ["doc_id", "text_key", "fp", "fp2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, text_key long, fp long, fp2 long")


class Code:
    """Blocks of the fingerprint, and for each syndrome the flips that lead to anchors within reach."""

    def __init__(self, blocks: int, threshold: int = THRESHOLD):
        self.slack = threshold // blocks
        r = 5 if blocks <= 2 else 4
        self.ham = (1 << r) - 1
        edges = [64 * i // blocks for i in range(blocks + 1)]
        self.blocks = list(zip(edges[:-1], edges[1:], strict=True))
        if min(b - a for a, b in self.blocks) < self.ham:
            raise ValueError("a block is narrower than the code")
        width = max(b - a for a, b in self.blocks)
        self.flips = {}
        for n in {b - a for a, b in self.blocks}:
            by: dict[int, list[int]] = {s: [] for s in range(1 << r)}
            for weight in range(self.slack + 2):
                for bits in combinations(range(n), weight):
                    s = 0
                    for b in bits:
                        s ^= b + 1 if b < self.ham else 0
                    by[s].append(sum(1 << b for b in bits))
            self.flips[n] = {s: np.array(v, np.uint64) for s, v in by.items()}
        # parity[b]: bits of a block whose number has bit b, for the syndrome
        self.parity = [np.uint64(sum(1 << i for i in range(self.ham) if (i + 1) >> b & 1)) for b in range(r)]
        self.width = width

    def anchors(self, fp: np.ndarray):
        """(row of fp, anchor name, whether it is the row's home), for all blocks."""
        rows, names, homes = [], [], []
        for k, (a, b) in enumerate(self.blocks):
            x = (fp >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
            syndrome = np.zeros(len(x), np.uint64)
            for i, m in enumerate(self.parity):
                syndrome |= (np.bitwise_count(x & m).astype(np.uint64) & np.uint64(1)) << np.uint64(i)
            for s, flips in self.flips[b - a].items():
                own = np.flatnonzero(syndrome == s)
                if not len(own):
                    continue
                name = (x[own][:, None] ^ flips) | np.uint64(k << (self.width + 1))
                # home: flip the one bit the syndrome names
                home = np.broadcast_to(flips == np.uint64(0 if s == 0 else 1 << (s - 1)), name.shape)
                rows.append(np.repeat(own, len(flips)))
                names.append(name.ravel())
                homes.append(home.ravel())
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        return np.concatenate(rows), np.concatenate(names), np.concatenate(homes)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


#: what is sent to a bucket; spot: 31 bits of the anchor's name, and whether this is the fingerprint's home.  Anchors of
#: one bucket that share their bits are compared as one, which finds no more and no less.
_RECORD = np.dtype([("spot", "<u4"), ("fp", "<u8"), ("id", "<i8")])


class Forest:
    """Union by smallest node over arrays of links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if (y == x).all():
                return x
            x = y

    def links(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(name, smallest name connected to it) of all that are connected to a smaller one."""
        root = self.find(np.arange(len(names)))
        moved = root != np.arange(len(names))
        return names[moved], names[root[moved]]


def _links_here(rec: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the records of some anchors: (node, smallest node connected to it here)."""
    rec = rec[np.argsort(rec["spot"] >> np.uint32(1), kind="stable")]
    anchor, at_home = rec["spot"] >> np.uint32(1), (rec["spot"] & np.uint32(1)).astype(bool)
    ids, node = np.unique(rec["id"], return_inverse=True)
    forest = Forest(len(ids))
    edge = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1], True])
    size = np.diff(edge)
    homes = np.add.reduceat(at_home.astype(np.int64), edge[:-1])
    fp = rec["fp"].copy()

    def tell(a, b):
        near = np.bitwise_count(fp[a] ^ fp[b]) <= threshold
        forest.join(node[a[near]], node[b[near]])

    # small anchors together: every home row against every row of its anchor
    work = homes * size
    big = work > _PAIRS
    lead, n = np.repeat(edge[:-1], size), np.repeat(size, size)
    small = np.flatnonzero(at_home & (np.repeat(work, size) > 1) & ~np.repeat(big, size))
    upto = np.cumsum(n[small])
    for part in np.split(small, np.searchsorted(upto, np.arange(_PAIRS, upto[-1] if len(upto) else 0, _PAIRS))):
        k = n[part]
        if len(part):
            b = np.arange(k.sum()) - np.repeat(np.r_[0, np.cumsum(k)[:-1]], k) + np.repeat(lead[part], k)
            tell(np.repeat(part, k), b)
    for g in np.flatnonzero(big):
        own = np.arange(edge[g], edge[g + 1])
        home = own[at_home[own]]
        step = max(1, _PAIRS // len(home))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            i, j = np.nonzero(np.bitwise_count(fp[home][:, None] ^ fp[part][None, :]) <= threshold)
            tell(home[i], part[j])
    return forest.links(ids)


def near_links(nodes: DataFrame, threshold: int = THRESHOLD, blocks: int | None = None, tile: int = 8192) -> DataFrame:
    """nodes: fp long, id long (one row per fingerprint).  Links a, b that connect all within the threshold."""
    spark = nodes.sparkSession
    n = nodes.count()
    code = Code(blocks or (3 if n <= FINE_FROM else 2), threshold)
    reach = max(len(x) for f in code.flips.values() for x in f.values())
    records_bound = n * reach * len(code.blocks)
    tile = max(tile, records_bound // 50_000)  # so at most 50,000 anchors are cut
    buckets = max(16, -(-records_bound // 300_000))
    parts = max(shuffle_partitions(spark), records_bound * _RECORD.itemsize // _PARTITION)
    spread = nodes.repartition(min(max(2 * shuffle_partitions(spark), n // 200_000), max(1, n)), "id")

    def counted(batches):
        count: list = []
        for batch in batches:
            fp = batch["fp"].to_numpy().view(np.uint64)
            for s in range(0, len(fp), _ROWS):
                count.append(np.unique(code.anchors(fp[s : s + _ROWS])[1], return_counts=True))
        if count:
            names, back = np.unique(np.concatenate([c[0] for c in count]), return_inverse=True)
            sums = np.bincount(back, np.concatenate([c[1] for c in count])).astype(np.int64)
            to = (_mixed(names) >> np.uint64(16)) % np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            cut = np.flatnonzero(np.r_[True, to[order][1:] != to[order][:-1]]) if len(order) else []
            parts = np.split(order, cut[1:])
            yield pa.RecordBatch.from_arrays([pa.array([int(to[p[0]]) for p in parts], pa.int64()), pa.array([names[p].tobytes() + sums[p].tobytes() for p in parts], pa.binary())], ["b", "data"])

    def crowded(t: pa.Table) -> pa.Table:
        both = [np.frombuffer(x, np.uint64) for x in t["data"].to_pylist()]
        names, back = np.unique(np.concatenate([x[: len(x) // 2] for x in both]), return_inverse=True)
        sums = np.bincount(back, np.concatenate([x[len(x) // 2 :] for x in both])).astype(np.int64)
        hot = sums > tile
        return pa.table({"anchor": pa.array(names[hot].view(np.int64)), "tiles": pa.array(-(-sums[hot] // tile))})

    hot = spread.mapInArrow(counted, "b long, data binary").groupBy("b").applyInArrow(crowded, "anchor long, tiles long").toArrow()
    order = np.argsort(hot["anchor"].to_numpy().view(np.uint64))
    hot_names, hot_tiles = hot["anchor"].to_numpy().view(np.uint64)[order], hot["tiles"].to_numpy()[order]

    def sent(batches):
        for batch in batches:
            fp, ids = batch["fp"].to_numpy().view(np.uint64), batch["id"].to_numpy()
            for s in range(0, len(fp), _ROWS):
                yield from send(fp[s : s + _ROWS], ids[s : s + _ROWS])
        give_back()

    def send(fp, ids):
        row, name, home = code.anchors(fp)
        tile_no = np.zeros(len(row), np.uint64)
        if len(hot_names):
            at = np.minimum(np.searchsorted(hot_names, name), len(hot_names) - 1)
            is_hot = hot_names[at] == name
            k = np.where(is_hot, hot_tiles[at], 1)
            parts = [(row[~is_hot], name[~is_hot], home[~is_hot], tile_no[~is_hot])]
            for tiles in np.unique(k[is_hot]):
                own = is_hot & (k == tiles)
                r, n, h = row[own], name[own], home[own]
                i = (_mixed(fp[r]) % np.uint64(tiles)).astype(np.int64)
                j = (_mixed(fp[r] ^ np.uint64(0x5BD1E995)) % np.uint64(tiles)).astype(np.int64)
                for x in range(tiles):  # as a visitor to tile (x, j); as a home also to (i, x)
                    parts.append((r, n, h & (i == x), (1 + x * tiles + j).astype(np.uint64)))
                    there = h & (j != x)
                    parts.append((r[there], n[there], h[there], (1 + i[there] * tiles + x).astype(np.uint64)))
            row, name, home, tile_no = (np.concatenate(x) for x in zip(*parts, strict=True))
        mixed = _mixed(name + (tile_no << np.uint64(40)))
        rec = np.empty(len(row), _RECORD)
        rec["spot"] = (mixed >> np.uint64(33)).astype(np.uint32) << np.uint32(1) | home.astype(np.uint32)
        rec["fp"], rec["id"] = fp[row], ids[row]
        to = ((mixed >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cut = np.flatnonzero(np.r_[True, to[order][1:] != to[order][:-1]]) if len(order) else np.zeros(0, int)
        parts = np.split(order, cut[1:])
        if len(order):
            yield pa.RecordBatch.from_arrays([pa.array([int(to[p[0]]) for p in parts], pa.int64()), pa.array([rec[p].tobytes() for p in parts], pa.binary())], ["b", "data"])

    def compared(t: pa.Table) -> pa.Table:
        rec = np.concatenate([np.frombuffer(x, _RECORD) for x in t["data"].to_pylist()])
        a, b = _links_here(rec, threshold)
        del rec
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return spread.mapInArrow(sent, "b long, data binary").repartition(parts, "b").groupBy("b").applyInArrow(compared, "a long, b long")


def _met(forest: Forest, ours: tuple, theirs: tuple, threshold: int, total: int, blocks: int, same: bool) -> None:
    """Join what is near in the first fingerprint and near enough in both; ours, theirs: fp, fp2, place in the forest.

    Two that differ in at most the threshold differ by at most slack in one block: there, every value that is so near
    to our own is looked up among theirs, which are in the order of that block.
    """
    slack = threshold // blocks
    edges = [64 * i // blocks for i in range(blocks + 1)]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        width, block = high - low, np.uint64((1 << (high - low)) - 1)
        value, there = (((x[0] >> np.uint64(low)) & block).astype(np.int64) for x in (ours, theirs))
        by = np.argsort(value, kind="stable")
        value, fp, fp2, place = value[by], *(x[by] for x in ours)
        by = np.argsort(there, kind="stable")
        their_fp, their_fp2, their_place = (x[by] for x in theirs)
        first = np.zeros((1 << width) + 1, np.int64)
        np.cumsum(np.bincount(there, minlength=1 << width), out=first[1:])
        for flip in (sum(1 << b for b in bits) for weight in range(slack + 1) for bits in combinations(range(width), weight)):
            asked = value ^ flip
            start = first[asked]
            n = first[asked + 1] - start
            own = np.flatnonzero(n if not same else (n > 0) & (value <= asked))  # within a chunk each pair of values once
            upto = np.cumsum(n[own])
            for part in np.split(own, np.searchsorted(upto, np.arange(_PAIRS, upto[-1] if len(upto) else 0, _PAIRS))):
                if not len(part):
                    continue
                k = n[part]
                end = np.cumsum(k)
                to = np.arange(end[-1]) + np.repeat(start[part] - (end - k), k)
                differ = np.bitwise_count(np.repeat(fp[part], k) ^ their_fp[to])
                hit = np.flatnonzero(differ <= threshold)
                if len(hit):
                    a, b = part[np.searchsorted(end, hit, "right")], to[hit]
                    near = differ[hit] + np.bitwise_count(fp2[a] ^ their_fp2[b]) <= total
                    forest.join(place[a[near]], their_place[b[near]])


def wide_links(nodes: DataFrame, threshold: int, total: int, blocks: int, chunk: int = CHUNK) -> DataFrame:
    """nodes: fp long, fp2 long, id long.  Links a, b that connect all of which one of the two fingerprints differs in at
    most threshold bits, and both together in at most total.

    A wide threshold leaves blocks of few bits, and so few anchors that each would be sent a share of all fingerprints.
    Instead the fingerprints are cut into chunks by hash, and a task looks one chunk up in another: a fingerprint
    is sent as often as there are chunks, which grow up to a bound before they become more.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    chunks = max(1, -(-n // chunk), min(LEAST_CHUNKS, n // _ROWS))
    own = F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda x: F.least(x, own) * chunks + F.greatest(x, own))
    placed = nodes.select("fp", "fp2", "id", own.alias("chunk"), F.explode(tiles).alias("tile"))

    def compared(t: pa.Table) -> pa.Table:
        fp, fp2 = (t[c].to_numpy().view(np.uint64) for c in ("fp", "fp2"))
        ids, place = np.unique(t["id"].to_numpy(), return_inverse=True)
        here, there = divmod(t["tile"][0].as_py(), chunks)
        at = t["chunk"].to_numpy()
        forest = Forest(len(ids))
        for x, y in ((fp, fp2), (fp2, fp)):  # either fingerprint may be the near one
            ours, theirs = ((x[own], y[own], place[own]) for own in (at == here, at == there))
            _met(forest, ours, theirs, threshold, total, blocks, here == there)
        a, b = forest.links(ids)
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    parts = max(shuffle_partitions(spark), chunks * (chunks + 1) // 2)
    return placed.repartition(parts, "tile").groupBy("tile").applyInArrow(compared, "a long, b long")


def groups(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE, seed: int = SEED, blocks: int | None = None, total: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, text_key, fp, component (smallest doc_id reachable, or a name from NAMELESS on)."""
    fps = materialise(fingerprints(docs, shingle, seed, total is not None), "fingerprints")
    bare = F.lit(NAMELESS) + F.xxhash64("fp", "fp2").bitwiseAND(F.lit(NAMELESS - 1))
    nodes = materialise(fps.groupBy("fp", "fp2").agg(F.min("doc_id").alias("id")).select("fp", "fp2", F.coalesce("id", bare).alias("id")), "nodes")
    up = roots(near_links(nodes, threshold, blocks) if total is None else wide_links(nodes, threshold, total, blocks))
    named = nodes.join(up.withColumnRenamed("node", "id"), "id", "left").select("fp", "fp2", F.coalesce("root", "id").alias("component"))
    return fps.join(materialise(named, "named"), ["fp", "fp2"]).select("doc_id", "text_key", "fp", "component")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    return groups(docs, threshold, shingle, seed).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component") < NAMELESS, F.col("component")).alias("component_id"),
    )


#: For dropping near copies: five-word shingles; similarity 0.8 differs in about 10 (deviation 3) of 64 bits and in 19
#: (deviation 4) of 128.  Two texts of nothing in common come that near with a chance of about 10^-10.
DROP_SHINGLE, DROP_THRESHOLD, DROP_TOTAL, DROP_BLOCKS = 5, 11, 28, 4
#: Shingles that one task holds when candidates are compared; larger groups are compared tile by tile.
TILE_SHINGLES = 4_000_000
#: Bytes of records that a shuffle partition holds.
_PARTITION = 64 << 20


#: Bits of the map that says which texts may be needed; it only saves reading others.
_MAP_BITS = 26


def _enough(common, a, b, similarity: float):
    """Whether sets of sizes a and b with so many common members are similar enough."""
    return common >= similarity * (a + b - common) - 1e-9


def similar_groups(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set, the first one that it is connected to over pairs of at least this Jaccard similarity.

    Two such sets share one of the few rarest members of either (the prefix), so only those are looked up.
    """
    size = np.array([len(x) for x in sets])
    members, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(members), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(members))
    edge = np.r_[0, np.cumsum(size)]
    own = [np.sort(x) for x in np.split(rank[token], edge[1:-1])]
    prefix = [x[: len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1] for x in own]
    where = np.repeat(np.arange(len(sets)), [len(x) for x in prefix])
    at = np.concatenate(prefix)
    order = np.argsort(at, kind="stable")
    where, first = where[order], np.searchsorted(at[order], np.arange(len(members) + 1))
    root, marked = np.full(len(sets), -1), np.zeros(len(members), bool)
    left = len(sets)
    for seed in range(len(sets)):
        if root[seed] >= 0:
            continue
        root[seed], queue, left = seed, [seed], left - 1
        while queue and left:
            a = queue.pop()
            near = np.unique(np.concatenate([where[first[t] : first[t + 1]] for t in prefix[a]]))
            near = near[root[near] < 0]
            near = near[np.minimum(size[near], size[a]) >= similarity * np.maximum(size[near], size[a]) - 1e-9]
            marked[own[a]] = True
            for part in np.split(near, np.searchsorted(np.cumsum(size[near]), np.arange(_PAIRS, size[near].sum(), _PAIRS))):
                if len(part):
                    common = np.add.reduceat(marked[np.concatenate([own[b] for b in part])].astype(np.int64), np.r_[0, np.cumsum(size[part])[:-1]])
                    found = part[_enough(common, size[part], size[a], similarity)]
                    root[found] = seed
                    queue += found.tolist()
                    left -= len(found)
            marked[own[a]] = False
    return root


def confirmed(docs: DataFrame, threshold: int, total: int, shingle: int, seed: int, blocks: int, similarity: float, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """Per row of docs: doc_id, text_key, component.

    Equal shingle sets are one.  Fingerprints say which sets are compared; those of one group of them that are
    connected over pairs of at least the similarity have one component.  A group too large for one task is cut into
    chunks by hash, and every pair of chunks is compared by a task of its own.  Sets so small that only equal ones can
    be similar enough (the empty one of wordless texts, too) have no part in that.
    """
    least = int(np.ceil(similarity / (1 - similarity) - 1e-9)) if similarity < 1 else 1 << 62
    row = F.xxhash64(F.col("doc_id").cast("long"), "text")

    def sketch(batches):
        for batch in batches:
            rows = []
            for x in batch["text"].to_pylist():
                hashes = list(_hashes(x, shingle, seed))
                own = shingle_set(hashes)
                rows.append((*_folded(hashes, seed, True), _set_key(own), len(own)))
            fps = np.array([r[:2] for r in rows], np.uint64).reshape(-1, 2)
            more = np.array([r[2:] for r in rows], np.int64).reshape(-1, 2)
            columns = [np.ascontiguousarray(fps[:, k]).view(np.int64) for k in (0, 1)] + [more[:, 0], more[:, 1]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], batch["row_key"], *map(pa.array, columns)], ["doc_id", "text_key", "row_key", "fp", "fp2", "set_key", "n"])
        give_back()

    kinds = "doc_id long, text_key long, row_key long, fp long, fp2 long, set_key long, n long"
    fps = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"), row.alias("row_key")).mapInArrow(sketch, kinds), "fingerprints")
    items = materialise(fps.where(F.col("n") >= least).groupBy("set_key", "fp", "fp2").agg(F.min("row_key").alias("row_key"), F.max("n").alias("n")), "items")
    nodes = materialise(items.groupBy("fp", "fp2").agg(F.min("set_key").alias("id"), F.count("*").alias("sets")), "nodes")
    up = roots(wide_links(nodes, threshold, total, blocks))
    linked = up.select("node", "root").union(up.select(F.col("root").alias("node"), "root").distinct())
    named = nodes.join(linked.withColumnRenamed("node", "id"), "id", "left").where("root is not null or sets > 1")
    wanted = materialise(items.join(named.select("fp", "fp2", F.coalesce("root", "id").alias("near")), ["fp", "fp2"]).select("set_key", "row_key", "near", "n"), "wanted")
    chunks = wanted.groupBy("near").agg(F.ceil(F.sum("n") / tile_shingles).cast("int").alias("chunks")).where("chunks > 1")
    chunks = materialise(chunks, "chunks")

    slot = F.shiftrightunsigned("row_key", 64 - _MAP_BITS)
    one = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(row_key, {64 - _MAP_BITS}) & 63 AS INT))")
    words = wanted.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    present = np.zeros(1 << (_MAP_BITS - 6), np.int64)
    present[words["at"].to_numpy()] = words["bits"].to_numpy()
    present = docs.sparkSession.sparkContext.broadcast(present)

    def gather(batches):
        there = present.value.view(np.uint64)
        for batch in batches:
            key = batch["row_key"].to_numpy().view(np.uint64) >> np.uint64(64 - _MAP_BITS)
            ask = there[(key >> np.uint64(6)).astype(np.int64)] >> (key & np.uint64(63)) & np.uint64(1)
            for s in range(0, len(ask), 256):
                sets = [shingle_set(list(_hashes(batch["text"][int(i)].as_py(), shingle, seed))) for i in s + np.flatnonzero(ask[s : s + 256])]
                yield pa.RecordBatch.from_arrays([pa.array([_set_key(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["set_key", "own"])
        give_back()

    def compare(t: pa.Table) -> pa.Table:
        keys, at = np.unique(t["set_key"].to_numpy(), return_index=True)
        root = similar_groups([np.frombuffer(t["own"][int(i)].as_py(), np.uint64) for i in at], similarity)
        moved = root != np.arange(len(root))
        out = pa.table({"set_key": pa.array(keys[moved]), "root": pa.array(keys[root[moved]])})
        give_back()
        return out

    sets = docs.select("text", row.alias("row_key")).mapInArrow(gather, "set_key long, own binary")
    cut = wanted.select("set_key", "near").join(chunks, "near", "left")
    own = F.pmod(F.xxhash64("set_key"), F.col("chunks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.least(x, own) * F.col("chunks") + F.greatest(x, own))
    placed = cut.select("set_key", "near", F.explode(F.coalesce(tiles, F.array(F.lit(0)))).alias("tile"))
    links = sets.join(placed, "set_key").groupBy("near", "tile").applyInArrow(lambda t: compare(t.select(["set_key", "own"])), "set_key long, root long")
    moved = materialise(links, "confirmed")
    if chunks.limit(1).count():  # else every group was compared as a whole
        moved = roots(moved.select(F.col("set_key").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("set_key"), "root")
    return fps.join(moved, "set_key", "left").select("doc_id", "text_key", F.coalesce("root", "set_key").alias("component"))


def drop_near_duplicates(docs: DataFrame, threshold: int = DROP_THRESHOLD, total: int = DROP_TOTAL, shingle: int = DROP_SHINGLE, seed: int = SEED, similarity: float | None = None) -> DataFrame:
    """One row of each group of near copies (that of the smallest doc_id), with all its columns.

    Texts have two fingerprints of the same shingles.  They link if one of the two differs in at most ``threshold``
    bits, and both together in at most ``total``.  Chance can do that to short texts: with ``similarity``, such links
    are candidates only, and texts are near copies over pairs of at least that Jaccard similarity of their shingles.
    """
    if similarity is None:
        found = groups(docs, threshold, shingle, seed, DROP_BLOCKS, total)
    else:
        found = confirmed(docs, threshold, total, shingle, seed, DROP_BLOCKS, similarity)
    found = materialise(found, "groups")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    stay = found.groupBy("component").agg(least.alias("x")).select(F.col("x.doc_id").alias("_stay_doc"), F.col("x.text_key").alias("_stay_key"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_stay_doc")) & F.xxhash64("text").eqNullSafe(F.col("_stay_key"))
    kept = docs.join(stay, same, "left_semi")
    if found.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count():  # equal rows: one of them
        kept = kept.withColumn("_key", F.xxhash64("text")).dropDuplicates(["doc_id", "_key"]).drop("_key")
    return kept
