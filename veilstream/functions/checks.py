"""Check digits, entropy and other value tests as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def chars(x: Column) -> Column:
    """The characters of a string; none for the empty string."""
    return F.when(F.length(x) > 0, F.split(x, "")).otherwise(F.array().cast("array<string>"))


def digit_values(x: Column) -> Column:
    return F.transform(chars(x), lambda c: c.cast("int"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def luhn(x: Column) -> Column:
    """Every second digit from the right counts double, with its digits summed."""
    back = F.reverse(digit_values(only_digits(x)))
    parts = F.transform(back, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return total(parts) % 10 == 0


def routing_number(x: Column) -> Column:
    """Weights 3, 7, 1 in turn, modulo 10."""
    parts = F.transform(digit_values(x), lambda d, i: d * F.when(i % 3 == 0, 3).when(i % 3 == 1, 7).otherwise(1))
    return total(parts) % 10 == 0


def mod97(x: Column) -> Column:
    """Bank account numbers: the first four characters go last, letters become two digits, remainder 1."""
    up = F.upper(x)
    moved = F.concat(F.substr(up, F.lit(5)), F.substr(up, F.lit(1), F.lit(4)))
    values = F.transform(chars(moved), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    left = F.aggregate(values, F.lit(0), lambda r, v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97)
    return F.length(x).between(15, 34) & (left == 1)


def _dihedral(a: Column, b: Column) -> Column:
    """Product in the group of the ten symmetries of a pentagon, rotations 0-4 and reflections 5-9."""
    turn = F.pmod(F.when(a < 5, a + b).otherwise(a - b), F.lit(5))
    return turn + F.when((a < 5) == (b < 5), 0).otherwise(5)


# The permutation of the Verhoeff code; position i applies it i times.
VERHOEFF_STEP = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]


def verhoeff_rows() -> list[list[int]]:
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([VERHOEFF_STEP[x] for x in rows[-1]])
    return rows


def verhoeff(x: Column) -> Column:
    """Over the first twelve digits."""
    n = 12
    rows = F.array(*(F.array(*map(F.lit, r)) for r in verhoeff_rows()))
    back = F.reverse(F.slice(digit_values(only_digits(x)), 1, n))
    mapped = F.transform(back, lambda d, i: F.get(F.get(rows, i % 8), d))
    return (F.length(only_digits(x)) >= n) & (F.aggregate(mapped, F.lit(0), _dihedral) == 0)


def gst_number(x: Column) -> Column:
    """Fifteen base-36 characters; the last one makes the folded, alternately doubled sum a multiple of 36."""
    values = F.transform(chars(x), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    parts = F.transform(F.slice(values, 1, 14), lambda v, i: F.floor(v * (1 + i % 2) / 36).cast("int") + v * (1 + i % 2) % 36)
    return (F.length(x) == 15) & (F.get(values, F.lit(14)) == (36 - total(parts) % 36) % 36)


def mrz_digit(x: Column) -> Column:
    """Check digit of a travel document field: weights 7, 3, 1; '<' counts 0 and letters from 10 on."""
    parts = F.transform(chars(x), lambda c, i: F.greatest(F.instr(F.lit(ALPHABET), c) - 1, F.lit(0)) * F.when(i % 3 == 0, 7).when(i % 3 == 1, 3).otherwise(1))
    return total(parts) % 10


def mrz(x: Column) -> Column:
    """Both lines of a passport: number, birth and expiry each agree with their digit in line two."""
    line = F.element_at(F.split(x, "\r?\n"), -1)
    fields = [(1, 9), (14, 6), (22, 6)]
    return reduce(lambda a, b: a & b, [mrz_digit(F.substring(line, at, n)).cast("string") == F.substring(line, at + n, 1) for at, n in fields])


def entropy(x: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    all_ = chars(x)
    n = F.length(x)
    share = F.transform(F.array_distinct(all_), lambda c: F.size(F.filter(all_, lambda y: y == c)) / n)
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))
