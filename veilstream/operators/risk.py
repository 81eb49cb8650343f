"""Risk score of a text: weighted findings with decay for repeats, and points for its surroundings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstream.functions.spans import let

# Weights of categories and severities.
CATEGORY_WEIGHT = {"PromptInjection": 45, "Secret": 40, "Financial": 35, "Pii": 25, "Toxicity": 45, "CustomKeyword": 20, "Internal": 20}
OTHER_WEIGHT = 20
SEVERITY_FACTOR = {"LOW": 0.5, "HIGH": 1.0, "CRITICAL": 1.25}
OTHER_FACTOR = 0.75
DECAY = 0.5
PUBLIC_APP_POINTS, VIOLATION_POINTS, VIOLATION_LIMIT, FILE_FACTOR = 10, 3, 15, 0.15
BANDS = [(24, "Low"), (49, "Medium"), (74, "High")]


def _chosen(x: Column, values: dict, other) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(x == k, F.lit(v)) if out is None else out.when(x == k, F.lit(v))
    return out.otherwise(F.lit(other))


def points(category: Column, severity: Column, nth: Column) -> Column:
    """Points of the nth finding (from 0) of its category."""
    base = _chosen(category, CATEGORY_WEIGHT, OTHER_WEIGHT).cast("double")
    return F.round(base * _chosen(F.upper(severity), SEVERITY_FACTOR, OTHER_FACTOR) / (1 + DECAY * nth)).cast("int")


def band(total: Column) -> Column:
    out = F.when(total <= BANDS[0][0], F.lit(BANDS[0][1]))
    for upto, name in BANDS[1:]:
        out = out.when(total <= upto, F.lit(name))
    return out.otherwise(F.lit("Critical"))


def band_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ["Low", "Medium", "High", "Critical"])), name)


def context_points(public_app: Column | None = None, device: Column | None = None, user: Column | None = None, sensitivity: Column | None = None) -> Column:
    """array<struct<name, points>> of what surrounds a text; parts that give no points are left out."""
    zero = F.lit(0)
    before = ((F.coalesce(device, zero) if device is not None else zero) + (F.coalesce(user, zero) if user is not None else zero)) * VIOLATION_POINTS
    parts = [
        ("Public AI application", F.when(public_app, PUBLIC_APP_POINTS).otherwise(0) if public_app is not None else zero),
        ("Previous violations", F.least(before, F.lit(VIOLATION_LIMIT))),
        ("File sensitivity", F.round(F.coalesce(sensitivity, zero) * FILE_FACTOR) if sensitivity is not None else zero),
    ]
    return F.filter(F.array(*(F.struct(F.lit(n).alias("name"), p.cast("int").alias("points")) for n, p in parts)), lambda s: s["points"] > 0)


def _earlier(findings: Column) -> Column:
    """For each finding, how many of its category stand before it.  Sorted by category and place, that is the distance
    to where the category begins."""
    by_category = F.array_sort(F.transform(findings, lambda f, i: F.struct(f["category"].alias("c"), i.alias("i"))))

    def counted(rows: Column) -> Column:
        names = F.array_distinct(F.transform(rows, lambda r: r["c"]))
        begins = let(F.transform(rows, lambda r: r["c"]), lambda all_: F.transform(names, lambda n: F.struct(n.alias("c"), (F.array_position(all_, n) - 1).alias("at"))))
        return let(begins, lambda b: F.transform(F.array_sort(F.transform(rows, lambda r, k: F.struct(r["i"].alias("i"), (k - F.get(F.filter(b, lambda x: x["c"] == r["c"]), F.lit(0))["at"]).cast("int").alias("n")))), lambda x: x["n"]))

    return let(by_category, counted)


def score(findings: Column, surroundings: Column | None = None) -> Column:
    """struct<total, band, signals> of an array of findings, without leaving the row."""
    own = let(
        _earlier(findings),
        lambda nth: F.transform(
            findings,
            lambda f, i: F.struct(F.format_string("%s finding (%s): %s", f["category"], f["severity"], f["match_name"]).alias("name"), points(f["category"], f["severity"], F.get(nth, i)).alias("points")),
        ),
    )
    signals = F.concat(own, surroundings) if surroundings is not None else own
    total = F.greatest(F.least(F.aggregate(signals, F.lit(0), lambda a, s: a + s["points"]), F.lit(100)), F.lit(0))
    return F.struct(total.alias("total"), band(total).alias("band"), signals.alias("signals"))


def score_rows(findings: DataFrame, key: str) -> DataFrame:
    """The same over a table of findings (key, seq, category, severity): key, total, band.  One shuffle by key."""
    order = Window.partitionBy(key, "category").orderBy("seq")
    own = findings.withColumn("points", points(F.col("category"), F.col("severity"), F.row_number().over(order) - 1))
    total = F.least(F.sum("points"), F.lit(100)).cast("int")
    return own.groupBy(key).agg(total.alias("total")).withColumn("band", band(F.col("total")))
