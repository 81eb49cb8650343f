"""Regular-expression matches, where they stand and what stands around them, as Column expressions.

Cutting a text at its matches gives the gaps, taking the matches out gives the rest, and both in turn give all
places.  Nothing is put into the text, so no character of it is special, and the work grows with the text and its
matches, not with their product.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: bytes on either side of a match that count as its context
AROUND = 40
_BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums(values: Column, start: Column) -> Column:
    """struct<at, out>: the start and all values together, and the sum before each value."""
    zero = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, zero, lambda acc, x: F.struct((acc["at"] + x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))


def running(values: Column) -> Column:
    """The sum of all values before each; in blocks, as arrays grow by being copied."""

    def by_block(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)))
        totals = lambda bs: F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        return let(blocks, lambda bs: let(_sums(totals(bs), F.lit(0))["out"], lambda base: F.flatten(F.transform(bs, lambda b, k: _sums(b, F.get(base, k))["out"]))))

    return let(values, lambda v: F.when(F.size(v) > 0, by_block(v)).otherwise(F.array().cast("array<int>")))


def spans(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, snippet, before, after>> of all matches, leftmost first.

    Offsets are in characters from 0, end exclusive; before and after are up to 40 characters of the text around.
    """
    return spans_of(F.struct(F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0)).alias("hits")))


def spans_of(parts: Column) -> Column:
    """The same of a text cut at its matches: struct<gaps, hits>."""
    n = F.lit(AROUND)

    def placed(x: Column) -> Column:
        gaps, hits, at = x["gaps"], x["hits"], x["at"]
        # what stands before a match ends with the gap before it; a gap of 40 characters hides all that is further off
        ends = F.transform(gaps, lambda g, k: F.concat(F.when(k > 0, F.get(hits, k - 1)).otherwise(""), F.substring(g, -AROUND, AROUND)))
        heads = F.transform(gaps, lambda g, k: F.concat(F.substring(g, 1, AROUND), F.coalesce(F.get(hits, k), F.lit(""))))

        def one(ends: Column, heads: Column) -> Column:
            def span(hit: Column, i: Column) -> Column:
                first = F.greatest(i + 1 - AROUND, F.lit(1))
                start = (F.get(at, i) + F.length(F.get(gaps, i))).cast("int")
                return F.struct(
                    start.alias("start"),
                    (start + F.length(hit)).cast("int").alias("end"),
                    hit.alias("snippet"),
                    F.right(F.array_join(F.slice(ends, first, i + 2 - first), ""), n).alias("before"),
                    F.left(F.array_join(F.slice(heads, i + 2, n + 1), ""), n).alias("after"),
                )

            return F.transform(hits, span)

        return let(F.struct(ends.alias("ends"), heads.alias("heads")), lambda y: one(y["ends"], y["heads"]))

    def sized(x: Column) -> Column:
        at = running(F.transform(x["hits"], lambda h, i: F.length(F.get(x["gaps"], i)) + F.length(h)))
        return let(F.struct(x["gaps"].alias("gaps"), x["hits"].alias("hits"), at.alias("at")), placed)

    return let(parts, sized)


def context(span: Column, around: int = AROUND) -> Column:
    """The match with so many bytes (up to 40) before and after it, in lower case; a character that is cut becomes U+FFFD."""
    near = F.concat(F.substring(F.encode(span["before"], "UTF-8"), -around, around), F.encode(span["snippet"], "UTF-8"), F.substring(F.encode(span["after"], "UTF-8"), 1, around))
    return F.lower(F.make_valid_utf8(near.cast("string")))
