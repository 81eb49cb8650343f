import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import docs_of
from veilstream.llm.components import roots
from veilstream.llm.simhash import DROP_BLOCKS, DROP_THRESHOLD, DROP_TOTAL, confirmed, drop_near_duplicates, fingerprint, near_duplicates, near_links, similar_groups, two_fingerprints, wide_links
from veilstream.llm.suffix_dedup import remove_repeats


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def components(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint_follows_its_definition(spark):
    text = "The Quick brown\tfox jumps over été lazy dog"
    words = "".join(c.lower() if c.isascii() else c for c in text).split()
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(g,) for g in grams], "g string").select(F.xxhash64("g")).collect()]
    assert fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert fingerprint(None) == fingerprint(" \n") == 0
    assert fingerprint("two words") == fingerprint("TWO  words")


@pytest.mark.parametrize(("blocks", "tile"), [(3, 8192), (2, 8192), (3, 40)])
def test_links_connect_exactly_what_is_near(spark, blocks, tile):
    rng = random.Random(3)
    fps = set()
    for _ in range(80):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randint(0, 3)):
            for b in rng.sample(range(64), rng.randint(1, 7)):
                x ^= 1 << b
            fps.add(x)
    base = rng.getrandbits(64)
    for _ in range(150):  # one crowded place, which the small tile size cuts
        y = base
        for b in rng.sample(range(64), rng.randint(1, 5)):
            y ^= 1 << b
        fps.add(y)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(signed(x), i) for i, x in enumerate(fps)], "fp long, id long")
    got = {r["node"]: r["root"] for r in roots(near_links(nodes, blocks=blocks, tile=tile)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)


@pytest.mark.parametrize("chunk", [1 << 19, 40])
def test_wide_links_against_all_pairs(spark, chunk):
    rng = random.Random(5)
    fps = set()
    for i in range(120):
        x, y = rng.getrandbits(64), rng.getrandbits(64)
        for _ in range(rng.randint(1, 4)):  # chains whose steps lie on either side of both bounds
            fps.add((x, y))
            x, y = (v ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 6, 11, 12, 17]))) for v in (x, y))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(signed(x), signed(y), i) for i, (x, y) in enumerate(fps)], "fp long, fp2 long, id long")

    def linked(i, j):
        differ = [(x ^ y).bit_count() for x, y in zip(fps[i], fps[j], strict=True)]
        return min(differ) <= DROP_THRESHOLD and sum(differ) <= DROP_TOTAL

    got = {r["node"]: r["root"] for r in roots(wide_links(nodes, DROP_THRESHOLD, DROP_TOTAL, DROP_BLOCKS, chunk)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == components(len(fps), linked)


def test_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(300, 300)]
    got = {r["node"]: r["root"] for r in roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{x: 100 for x in range(101, 160)}}


def test_near_duplicates_edges(spark):
    rows = [(1, "a b c d e"), (2, None), (3, ""), (4, "A B C D E"), (5, "x"), (None, "x"), (7, "only here"), (None, "far away from all other words"), (1, "a b c d e")]
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in near_duplicates(docs_of(spark, rows)).collect()}
    assert {(d, c) for d, _, c in got} == {(1, 1), (2, 2), (3, 2), (4, 1), (5, 5), (None, 5), (7, 7), (None, None)}
    assert (2, "0" * 16, 2) in got
    assert near_duplicates(docs_of(spark, [])).count() == 0


def test_dropping_near_copies(spark):
    rng = random.Random(7)
    words = [f"word{i}" for i in range(4000)]
    rows = []
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([60, 200, 500]))
        for c in range(rng.choice([1, 1, 3, 5])):
            x = list(base)
            for _ in range(c * max(1, len(x) // 200)):
                x[rng.randrange(len(x))] = rng.choice(words)
            rows.append((len(rows), " ".join(x)))
    rows += [(None, "lonely text of its own kind"), rows[0], (900, None), (901, "")]

    def linked(i, j):
        a, b = (two_fingerprints(rows[k][1], 5) for k in (i, j))
        differ = [(x ^ y).bit_count() for x, y in zip(a, b, strict=True)]
        return min(differ) <= DROP_THRESHOLD and sum(differ) <= DROP_TOTAL

    groups: dict = {}
    for i, root in enumerate(components(len(rows), linked)):
        groups.setdefault(root, []).append(rows[i][0])
    docs = docs_of(spark, rows)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(min(g, key=lambda d: (d is None, d))) for g in groups.values())


def test_near_copies_are_confirmed_by_their_shingles(spark):
    rng = random.Random(11)
    words = [f"word{i}" for i in range(4000)]
    rows = [(0, None), (1, ""), (2, " \n")]
    rows += [(10 + i, " ".join(rng.choices(words, k=rng.choice([1, 4, 5, 6, 7, 8])))) for i in range(400)]
    rows += [(1000, rows[5][1]), (1001, rows[6][1].upper()), (None, "lonely text of its own kind"), (None, rows[8][1])]
    for _ in range(15):
        base = rng.choices(words, k=rng.choice([60, 200]))
        for c in range(4):
            x = list(base)
            for _ in range(c):
                x[rng.randrange(len(x))] = rng.choice(words)
            rows.append((2000 + len(rows), " ".join(x)))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    prints = [two_fingerprints(t, 5) for _, t in rows]

    def near(i, j):
        differ = [(x ^ y).bit_count() for x, y in zip(prints[i], prints[j], strict=True)]
        return min(differ) <= DROP_THRESHOLD and sum(differ) <= DROP_TOTAL

    loose = components(len(rows), lambda i, j: bool(sets[i]) and bool(sets[j]) and min(map(len, (sets[i], sets[j]))) >= 4 and near(i, j))
    same = lambda i, j: sets[i] == sets[j] or loose[i] == loose[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    groups: dict = {}
    for i, root in enumerate(components(len(rows), same)):
        groups.setdefault(root, []).append(rows[i][0])
    docs = docs_of(spark, rows)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(min(g, key=lambda d: (d is None, d))) for g in groups.values())
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0
    for tile in (4_000_000, 300):  # groups of candidates as a whole, and cut into tiles
        by = confirmed(docs, DROP_THRESHOLD, DROP_TOTAL, 5, 42, DROP_BLOCKS, 0.8, tile).groupBy("component").agg(F.min(F.coalesce("doc_id", F.lit(10**9))).alias("d")).collect()
        assert sorted(r["d"] for r in by) == sorted(min(10**9 if d is None else d for d in g) for g in groups.values())


def test_similar_groups_are_exact():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        x = np.unique(rng.integers(0, 1 << 60, rng.integers(4, 40), dtype=np.uint64))
        for _ in range(rng.integers(1, 6)):
            x = np.unique(np.r_[x[rng.random(len(x)) > 0.08], rng.integers(0, 200, 1, dtype=np.uint64)])
            sets.append(x)
    s = [set(x.tolist()) for x in sets]
    assert similar_groups(sets, 0.8).tolist() == components(len(s), lambda i, j: 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]))


def brute_repeats(rows, width=50):
    first: dict = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            k = b[p : p + width]
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [0] * len(b)
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < d:
                gone[p : p + width] = [1] * width
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, x in zip(b, gone, strict=True) if not x)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    passages = [" ".join(rng.choices(words, k=rng.randint(10, 60))) for _ in range(6)]
    rows = []
    for i in range(150):
        t = " ".join(rng.choices(words, k=rng.randint(0, 80)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            t += p[a:b] + rng.choice(["", " ", "x"])
        if rng.random() < 0.1:
            t = "a" * rng.randint(0, 200)
        if rng.random() < 0.15 and rows:
            t = rng.choice(rows)[1]
        rows.append((i, t if rng.random() > 0.03 else None))
    rng.shuffle(rows)
    rows += [rows[3]]  # a repeated row is no earlier document
    got = sorted(tuple(r) for r in remove_repeats(docs_of(spark, rows), group_bytes=2000).collect())
    assert got == brute_repeats(rows)


def test_repeats_edges(spark):
    assert remove_repeats(docs_of(spark, [])).count() == 0
    long = " ".join(str(i) for i in range(60_000))  # one very long text
    rows = [(1, long), (2, "x" + long[1000:1100]), (None, long), (4, "y" * 49)]
    got = {r["doc_id"]: r for r in remove_repeats(docs_of(spark, rows)).collect()}
    assert got[1]["n_removed"] == got[4]["n_removed"] == 0
    assert (got[2]["n_removed"], got[2]["n_spans"]) == (100, 1)
    assert got[None]["n_removed"] == got[None]["n_bytes"] == len(long)


def test_other_widths(spark):
    rows = [(i, t) for i, t in enumerate(["abcdefghijklmnopqrstuvwxyz0123", "zzabcdefghijklmnopzz", "abcdefghijkl", ""])]
    got = sorted(tuple(r) for r in remove_repeats(docs_of(spark, rows), width=12, gram=8).collect())
    assert got == brute_repeats(rows, 12)
    assert np.all([g[2] >= 0 for g in got])


@pytest.mark.parametrize(("bucket_bytes", "hot"), [(300, 200_000), (300, 2), (1 << 24, 0)])
def test_repeats_in_many_buckets_and_of_hot_anchors(spark, bucket_bytes, hot):
    """Some 128 buckets; anchors whose windows are dealt one by one; suffixes that agree nearly to the window's width."""
    rng = random.Random(12)
    line = "the one common line that stands in nearly every document"
    rows = []
    for i in range(120):
        noise = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 160)))
        rows.append((i, noise + (line if rng.random() < 0.8 else "") + "".join(rng.choice("xyé") for _ in range(rng.randint(0, 120)))))
    stem = "".join(rng.choice("klmnop") for _ in range(49))
    rows += [(200 + i, stem + c + stem) for i, c in enumerate("qrstq")] + [(300, "z" * 300), (301, "z" * 120), (302, None)]
    got = sorted(tuple(r) for r in remove_repeats(docs_of(spark, rows), group_bytes=1500, bucket_bytes=bucket_bytes, hot=hot).collect())
    assert got == brute_repeats(rows)
