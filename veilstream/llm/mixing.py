"""Mixing sources to target weights by Sainte-Lague apportionment of equal word blocks.

1. Every document's size in words, and the source's total, are counted.  Targets share the total by weight; a
   source is used at most ``most`` times over, and what is above that is reshared by weight (a water level).
2. The total in blocks of equal length is dealt to the sources by highest quotients target / (2 j + 1), then each
   source's blocks to its shards in the same way: an integer quota for each shard.  Only quotients near the
   cut can decide, so a few candidates a source (or shard) are ranked, not all.
3. In a shard the documents stand in seeded order as one run of words, cut into blocks.  Each block is taken
   quota div blocks times, and (quota mod blocks) of them, picked by a seeded permutation, once more.

A hot source is just a source of more shards, be it by words or by rows.  Everything is SQL; the same text runs on DuckDB as the oracle.

Defined results: null text has size 0 and nothing of it is taken; a null source is a source of its own and comes
last; rows that repeat a doc_id are documents of their own; with no words all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.llm.common import materialise, n_words

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 16
SHARD_WORDS = 2_000_000
#: rows of a shard: a source may hold mostly empty texts
SHARD_ROWS = 4096
SEED = 42
#: prime above any number of blocks a shard can have
_PRIME = 2147483647


def sizes(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size (words of the text), and what more is asked for."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.when(F.col("text").isNotNull(), n_words(F.col("text"))), F.lit(0)).cast("long").alias("size"), *more)


_SPARK = {
    "hex8": lambda x: f"CAST(conv(substr({x}, 1, 8), 16, 10) AS BIGINT)",
    "series": lambda a, b: f"explode(sequence({a}, {b}))",
    "total": lambda var, a, b, term: f"aggregate(sequence({a}, {b}), CAST(0 AS BIGINT), (total, {var}) -> total + {term})",
    "same": lambda a, b: f"{a} <=> {b}",
}
_DUCKDB = {
    "hex8": lambda x: f"CAST('0x' || substr({x}, 1, 8) AS BIGINT)",
    "series": lambda a, b: f"unnest(range({a}, {b} + 1))",
    "total": lambda var, a, b, term: f"CAST(list_sum(list_transform(range({a}, {b} + 1), lambda {var}: {term})) AS BIGINT)",
    "same": lambda a, b: f"{a} IS NOT DISTINCT FROM {b}",
}


def _weight(weights: tuple[int, ...]) -> str:
    return " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))


def mix_sql(dialect: dict, sized: str, weights=WEIGHTS, most=MOST, block=BLOCK, shard_words=SHARD_WORDS, seed=SEED, carry: str = "", shard_rows=SHARD_ROWS) -> str:
    """The whole mix over a relation (doc_id, source, size), and one more column that is carried along."""
    own, with_d = (f", {carry}", f", d.{carry}") if carry else ("", "")
    same, hex8, series = dialect["same"], dialect["hex8"], dialect["series"]
    taken = dialect["total"]("k", f"first_word // {block}", f"(first_word + size - 1) // {block}", f"CASE WHEN (k * {_PRIME} + turn) % blocks < quota % blocks THEN least(first_word + size, (k + 1) * {block}) - greatest(first_word, k * {block}) ELSE 0 END")
    sql = f"""
WITH sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS source_rows FROM {sized} GROUP BY source
), weighed AS (
  SELECT source, source_size, source_rows, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(weights)} {_weight(weights)} END AS weight,
    row_number() OVER (ORDER BY source IS NULL, source) AS rank, CAST(sum(source_size) OVER () AS BIGINT) AS total, count(*) OVER () AS n
  FROM sources
), levels AS (
  SELECT *, CAST(total - coalesce(sum({most} * source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, rank, n, total, least(CAST({most} * source_size AS DOUBLE), weight * max(level) OVER ()) AS target,
    CAST(floor(CAST(total AS DOUBLE) / {block} + 0.5) AS BIGINT) AS blocks,
    CAST(greatest(1, (source_size + {shard_words} - 1) // {shard_words}, (source_rows + {shard_rows} - 1) // {shard_rows}) AS BIGINT) AS shards
  FROM levels
), near AS (
  SELECT *, CAST(floor(target / total * blocks + 0.5) AS BIGINT) AS guess, CAST(ceil(target / total * n) AS BIGINT) + 2 AS slack FROM targets WHERE target > 0
), tries AS (
  SELECT source, rank, blocks, target, greatest(0, guess - slack) AS floor_seats, {series("greatest(0, guess - slack)", "guess + slack")} AS j FROM near
), ranked AS (
  SELECT source, floor_seats, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, rank, j) AS place,
    blocks - CAST(sum(CASE WHEN j = floor_seats THEN floor_seats ELSE 0 END) OVER () AS BIGINT) AS left_over
  FROM tries
), seats AS (
  SELECT source, max(floor_seats) + sum(CASE WHEN place <= left_over THEN 1 ELSE 0 END) AS seats FROM ranked GROUP BY source
), placed AS (
  SELECT d.doc_id{with_d}, d.source, d.size, md5('{seed}:' || coalesce(CAST(d.doc_id AS VARCHAR(20)), '')) AS turn_of, t.source_size, t.target, t.shards
  FROM {sized} d JOIN targets t ON {same("d.source", "t.source")}
), sharded AS (
  SELECT *, {hex8("turn_of")} % shards AS shard FROM placed
), units AS (
  SELECT source, shard, CAST(sum(size) AS BIGINT) AS shard_size, max(source_size) AS source_size FROM sharded GROUP BY source, shard
), aimed AS (
  SELECT u.source, u.shard, u.shard_size, u.source_size, s.seats, count(*) OVER (PARTITION BY u.source) AS n
  FROM units u JOIN seats s ON {same("u.source", "s.source")} WHERE u.shard_size > 0
), unit_near AS (
  SELECT *, CAST(floor(CAST(shard_size AS DOUBLE) / source_size * seats + 0.5) AS BIGINT) AS guess, CAST(ceil(CAST(shard_size AS DOUBLE) / source_size * n) AS BIGINT) + 2 AS slack FROM aimed
), unit_tries AS (
  SELECT source, shard, shard_size, seats, greatest(0, guess - slack) AS floor_seats, {series("greatest(0, guess - slack)", "guess + slack")} AS j FROM unit_near
), unit_ranked AS (
  SELECT source, shard, shard_size, floor_seats, row_number() OVER (PARTITION BY source ORDER BY CAST(shard_size AS DOUBLE) / (2 * j + 1) DESC, shard, j) AS place,
    seats - sum(CASE WHEN j = floor_seats THEN floor_seats ELSE 0 END) OVER (PARTITION BY source) AS left_over
  FROM unit_tries
), quotas AS (
  SELECT source, shard, CAST((max(shard_size) + {block - 1}) // {block} AS BIGINT) AS blocks,
    CAST(least(max(floor_seats) + sum(CASE WHEN place <= left_over THEN 1 ELSE 0 END), {most} * ((max(shard_size) + {block - 1}) // {block})) AS BIGINT) AS quota,
    {hex8(f"md5('{seed}:' || coalesce(source, '') || ':' || CAST(shard AS VARCHAR(20)))")} AS turn
  FROM unit_ranked GROUP BY source, shard
), ordered AS (
  SELECT doc_id{own}, source, size, source_size, target, shard,
    CAST(coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY turn_of, doc_id, size{own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_word
  FROM sharded
), joined AS (
  SELECT o.*, coalesce(q.quota, 0) AS quota, coalesce(q.blocks, 1) AS blocks, coalesce(q.turn, 0) AS turn
  FROM ordered o LEFT JOIN quotas q ON {same("o.source", "q.source")} AND o.shard = q.shard
)
SELECT doc_id{own}, size, source_size, target, CASE WHEN size = 0 THEN CAST(0 AS BIGINT) ELSE quota // blocks * size + {taken} END AS taken FROM joined
"""
    return sql


def _for_spark(sql: str) -> str:
    """Spark spells integer division div."""
    return sql.replace("//", "div").replace("VARCHAR(20)", "STRING")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target (of its source), taken (words the mix takes)."""
    sized = materialise(sizes(docs), "sizes")
    return docs.sparkSession.sql(_for_spark(mix_sql(_SPARK, "{sized}", weights, most, block, shard_words, seed)), sized=sized)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of docs as the mix takes them, with all their columns: a document stays whole, stands there as often
    as all of it is taken, and once more if its own seeded number is below the share that is left."""
    key = F.xxhash64("text")
    sized = materialise(sizes(docs, key.alias("text_key")), "sizes")
    taken = docs.sparkSession.sql(_for_spark(mix_sql(_SPARK, "{sized}", weights, most, block, shard_words, seed, "text_key")), sized=sized)
    # equal rows share one entry
    share = taken.groupBy("doc_id", "text_key").agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("share"))
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_key")), F.lit(1 << 20)) / F.lit(1 << 20)
    times = share.select(F.col("doc_id").alias("_mix_doc"), F.col("text_key").alias("_mix_key"), (F.floor("share") + F.when(chance < F.col("share") - F.floor("share"), 1).otherwise(0)).cast("int").alias("_mix_times")).where("_mix_times > 0")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_mix_doc")) & key.eqNullSafe(F.col("_mix_key"))
    # a text that is null has no words to take, and such rows would meet on one key
    return docs.where("text IS NOT NULL").join(times, same).select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col("_mix_times"))).alias("_mix_no")).select(*docs.columns)


def oracle() -> str:
    sized = "(SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents)"
    return "WITH sized AS " + sized + "," + mix_sql(_DUCKDB, "sized").strip()[len("WITH"):]
