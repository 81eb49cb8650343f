"""Divergence of sources: by how much the term frequencies of a language's sources differ, exactly, in whole numbers.

Terms are found in bytes: a lookup table over the concatenated UTF-8 buffers of a slice of texts says which bytes
belong to terms and lower-cases A-Z, differences of it give the boundaries.  The slices are grouped by xxhash, and each
is compared with its group's first byte by byte (unequal ones are parted), so counts are exact.  Spark adds
counts and document numbers by (lang, source, term), keeps the terms that enough documents of the language hold, and
deals the terms of a language to buckets of bounded size.  A bucket is a CSR matrix of sources by terms; a source's
row is compared with all others by ``np.add.reduceat`` over the places of their counts; what terms without a count add
depends on the two totals alone.  Buckets' sums are added up.

Probabilities are p = 1 + floor(SCALE * (count + 1) / (N + V)), and a term adds floor((p - q)^2 / q).

Defined results: null text, lang and source count as ''; an empty table gives no rows; each row is a document, rows that
repeat a doc_id too; ties in a ranking go by the item's bytes; a language without kept terms has divergences 0 between
its sources; a very long text is a slice by itself; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilstream.llm.common import give_back, materialise
from veilstream.llm.token_store import _slices

SCALE = 1_000_000_000
#: documents of a language that must hold a term, and terms shown of each source
LEAST_DOCS, SHOWN = 3, 200
#: bytes of text that are counted at a time (a longer text goes by itself)
SLICE_BYTES = 8 << 20
#: counts of a bucket of terms, sources of a block of a bucket
BUCKET, BLOCK = 200_000, 1_000
#: parts that the rows of a source are dealt to when they meet its totals
SALTS = 16
COUNTS = "lang string, source string, term string, n long, docs long"

_TERM = np.zeros(256, bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 0x20


def boundaries(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms of texts start and end in their concatenated bytes; ends: where each text ends."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _TERM[data]
    step = np.diff(inside)
    starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # a border inside a run of term bytes parts it
    cut = np.unique(ends[(ends > 0) & (ends < len(data))])
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    return (np.sort(np.r_[starts, cut]), np.sort(np.r_[stops, cut])) if len(cut) else (starts, stops)


def grouped(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, hash_=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """For each slice of the bytes the number of its group of equal slices, and for each group its first slice."""
    view = memoryview(data)
    hashes = np.fromiter((hash_(view[a:b]) for a, b in zip(starts.tolist(), stops.tolist())), np.uint64, len(starts))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    size = stops - starts
    wrong = size != size[first[group]]
    alike = np.flatnonzero(~wrong)
    held = size[alike]
    here = np.repeat(starts[alike] - (np.cumsum(held) - held), held) + np.arange(held.sum())
    there = np.repeat(starts[first[group[alike]]] - (np.cumsum(held) - held), held) + np.arange(held.sum())
    unequal = data[here] != data[there]
    if unequal.any():
        wrong[alike] = np.add.reduceat(unequal, np.cumsum(held) - held) > 0
    if wrong.any():  # two strings of one hash: the rest is told apart by its bytes
        known: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(wrong).tolist():
            key = bytes(view[starts[i] : stops[i]])
            if key not in known:
                known[key] = len(first) + len(more)
                more.append(i)
            group[i] = known[key]
        first = np.r_[first, more]
    return group, first


def _counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """Counts of a slice of documents."""
    _, offsets, buffer = text.buffers()
    at = np.frombuffer(offsets, np.int64, len(text) + 1, 8 * text.offset)
    data = _LOW[np.frombuffer(buffer, np.uint8)[at[0] : at[-1]]] if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    at = at - at[0]
    starts, stops = boundaries(data, at)
    term, first = grouped(data, starts, stops)
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    of_doc = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    doc = np.searchsorted(at, starts, "right") - 1
    # one sort by document and term; from then on only distinct pairs
    width = max(1, len(first))
    pair, times = np.unique(doc * width + term, return_counts=True)
    key, back = np.unique(of_doc[pair // width] * width + pair % width, return_inverse=True)
    n = np.bincount(back, times, len(key)).astype(np.int64)
    held = np.bincount(back, minlength=len(key))
    group, which = key // width, first[key % width]
    size = stops[which] - starts[which]
    ends = np.r_[0, np.cumsum(size)]
    words = data[np.repeat(starts[which] - ends[:-1], size) + np.arange(ends[-1])]
    terms = pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(words))
    columns = [langs.dictionary.take(pa.array(group // max(1, len(sources.dictionary)))), sources.dictionary.take(pa.array(group % max(1, len(sources.dictionary)))), terms.cast(pa.string()), pa.array(n), pa.array(held.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def _named(docs: DataFrame, *names: str) -> DataFrame:
    return docs.select(*[F.coalesce(name, F.lit("")).alias(name) for name in names])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it): one row for each that occurs."""

    def run(batches):
        for batch in batches:
            for a, b in _slices(batch["text"], SLICE_BYTES):
                part = batch.slice(a, b - a)
                yield _counts(part["lang"], part["source"], part["text"].cast(pa.large_string()))
        give_back()

    return _named(docs, "lang", "source", "text").mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Of the counts those of kept terms, with lang_n (occurrences in the language); first: one row of each term."""
    of_term = Window.partitionBy("lang", "term")  # a row for each source at most
    wide = counts.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("held"), F.sum("n").over(of_term).alias("lang_n"), F.min("source").over(of_term).alias("one"))
    return wide.where(F.col("held") >= least_docs).select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("one")).alias("first"))


def totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """For every (lang, source) of the documents: total (its occurrences of kept terms), lang_total, vocabulary,
    buckets and blocks (how the language is dealt out)."""
    groups = _named(docs, "lang", "source").distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    languages = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("vocabulary"), F.count("*").alias("rows"))
    many = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(languages, "lang", "left")
    dealt = many.select("lang", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("lang_total", "vocabulary")], F.expr(f"1 + coalesce(rows, 0) div {BUCKET}").cast("int").alias("buckets"), F.expr(f"1 + (sources - 1) div {BLOCK}").cast("int").alias("blocks"))
    return groups.join(own, ["lang", "source"], "left").join(dealt, "lang").withColumn("total", F.coalesce("total", F.lit(0)))


def _p(count: str, total: str) -> str:
    """SQL of a probability; decimal, as SCALE times a count may pass 64 bits."""
    return f"1 + (CAST({count} + 1 AS DECIMAL(20, 0)) * {SCALE}BD) div CAST({total} + vocabulary AS DECIMAL(20, 0))"


def probability(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), in steps that stay within 64 bits (totals below 9 * 10^15)."""
    whole, rest = np.divmod(count + 1, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return 1 + whole


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of each row of a CSR matrix, rows without entries too."""
    out = np.zeros(len(ends) - 1, np.int64)
    filled = np.flatnonzero(np.diff(ends) > 0)
    if len(filled):
        out[filled] = np.add.reduceat(values, ends[filled])
    return out


def bucket_divergences(row: np.ndarray, column: np.ndarray, n: np.ndarray, total: np.ndarray, ours: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """What the terms of a bucket add to the divergence of each source (ours) from each other (theirs), beyond what each
    would add without any count.  row, column, n: the counts; total: N + V of each row; ours, theirs: rows."""
    order = np.lexsort((column, row))
    row, column, n = row[order], column[order], n[order]
    ends = np.searchsorted(row, np.arange(len(total) + 1))
    p, none = probability(n, total[row]), probability(np.zeros_like(total), total)
    mine = [slice(ends[r], ends[r + 1]) for r in theirs]
    at = np.concatenate([np.arange(s.start, s.stop) for s in mine]) if mine else np.zeros(0, np.int64)
    rows = np.r_[0, np.cumsum([s.stop - s.start for s in mine])].astype(np.int64)
    where, q, q_none = column[at], p[at], np.repeat(none[theirs], np.diff(rows))
    dense = np.empty(int(column.max()) + 1 if len(column) else 0, np.int64)
    out = np.empty((len(ours), len(theirs)), np.int64)
    for i, r in enumerate(ours):
        held = slice(ends[r], ends[r + 1])
        dense[:] = none[r]
        dense[column[held]] = p[held]
        over = dense[where]
        value, times = np.unique(p[held], return_counts=True)
        base = _distance(none[r], none[theirs])
        out[i] = _sums(_distance(over, q) - _distance(over, q_none), rows)
        for v, k in zip(value.tolist(), times.tolist()):
            out[i] += k * (_distance(v, none[theirs]) - base)
    return out


def _bucket(key, counts: pa.Table, sources: pa.Table) -> pa.Table:
    lang, bucket, i, j = (x.as_py() for x in key)
    names, block = sources["source"].combine_chunks(), sources["block"].to_numpy()
    vocabulary = sources["vocabulary"].to_numpy()
    total = sources["total"].to_numpy() + vocabulary
    ours, theirs = np.flatnonzero(block == i), np.flatnonzero(block == j)
    if len(total) and vocabulary[0] > 0:
        row = pc.index_in(counts["source"], names).combine_chunks().to_numpy().astype(np.int64)
        column = counts["term"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        values = bucket_divergences(row, column, counts["n"].to_numpy(), total, ours, theirs)
        if bucket == 0:  # and what every term of the language adds
            none = probability(np.zeros_like(total), total)
            values += vocabulary[0] * _distance(none[ours][:, None], none[theirs][None, :])
    else:
        values = np.zeros((len(ours), len(theirs)), np.int64)
    a, b = (x.ravel() for x in np.broadcast_arrays(ours[:, None], theirs[None, :]))
    other = a != b
    columns = [pa.array([lang] * int(other.sum()), pa.string()), names.take(pa.array(a[other])), names.take(pa.array(b[other])), pa.array(values.ravel()[other])]
    return pa.Table.from_arrays(columns, ["lang", "source", "item", "value"])


def pair_divergences(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the language), value."""
    block = F.expr("CAST(pmod(xxhash64(source), blocks) AS INT)")
    meets = "explode(array_distinct(concat(transform(sequence(0, blocks - 1), x -> struct(block AS i, x AS j)), transform(sequence(0, blocks - 1), x -> struct(x AS i, block AS j))))) AS at"
    languages = groups.groupBy("lang").agg(F.first("blocks").alias("blocks"), F.first("buckets").alias("buckets"))
    rows = kept.join(languages, "lang").withColumn("block", block).withColumn("bucket", F.expr("CAST(pmod(xxhash64(term), buckets) AS INT)"))
    rows = rows.selectExpr("lang", "bucket", "source", "term", "n", meets).select("lang", "bucket", "at.i", "at.j", "source", "term", "n")
    sources = groups.withColumn("block", block).selectExpr("*", meets).selectExpr("*", "explode(sequence(0, buckets - 1)) AS bucket")
    sources = sources.select("lang", "bucket", "at.i", "at.j", "source", "block", "total", "vocabulary")
    keys = ["lang", "bucket", "i", "j"]
    parts = rows.groupBy(*keys).cogroup(sources.groupBy(*keys)).applyInArrow(_bucket, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_divergences(kept: DataFrame, groups: DataFrame, shown: int = SHOWN) -> DataFrame:
    """lang, source, item (kept terms the source has more of than its language), value, rank: the first ``shown``."""
    many = groups.select("lang", "source", "total", "lang_total", "vocabulary", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = kept.withColumn("salt", F.expr(f"CAST(pmod(xxhash64(term), {SALTS}) AS INT)")).join(many, ["lang", "source", "salt"])
    told = met.select("lang", "source", F.col("term").alias("item"), F.expr(_p("n", "total")).alias("p"), F.expr(_p("lang_n", "lang_total")).alias("q")).where("p > q")
    valued = told.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    return valued.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= shown)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, shown: int = SHOWN) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank."""
    kept = materialise(kept_terms(term_counts(docs), least_docs), "kept-terms")
    groups = materialise(totals(docs, kept), "source-totals")
    pairs = pair_divergences(kept, groups)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return named(pairs, "pair").unionByName(named(term_divergences(kept, groups, shown), "term"))


def oracle() -> str:
    """DuckDB SQL for the audit of documents."""
    return r"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
        ), words AS (
            SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
        ), counts AS (
            SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS held FROM words GROUP BY ALL
        ), vocabulary AS (
            SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL HAVING sum(held) >= 3
        ), langs AS (
            SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM vocabulary GROUP BY ALL
        ), kept AS (
            SELECT c.lang, c.source, c.term, c.n FROM counts c JOIN vocabulary USING (lang, term)
        ), groups AS (
            SELECT g.lang, g.source, coalesce(l.v, 0) AS v, CAST(coalesce(t.total, 0) AS BIGINT) AS total
            FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs l USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM kept GROUP BY ALL) t USING (lang, source)
        ), dense AS (
            SELECT g.lang, g.source, w.term, coalesce(k.n, 0) AS n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(k.n, 0) + 1)) // (g.total + g.v) AS BIGINT) AS p
            FROM groups g JOIN vocabulary w USING (lang) LEFT JOIN kept k USING (lang, source, term)
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value
            FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), all_pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
        ), base AS (
            SELECT w.lang, w.term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (w.n + 1)) // (l.total + l.v) AS BIGINT) AS q FROM vocabulary w JOIN langs l USING (lang)
        ), terms AS (
            SELECT d.lang, d.source, 'term' AS part, d.term AS item, ((d.p - b.q) * (d.p - b.q)) // b.q AS value
            FROM dense d JOIN base b USING (lang, term) WHERE d.n > 0 AND d.p > b.q
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms)
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """
