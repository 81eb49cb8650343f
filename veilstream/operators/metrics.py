"""Counters, latency histograms and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the latency buckets, in seconds.
BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def requests_total(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type", "action_taken").agg(F.count("*").alias("requests"))


def provider_total(requests: DataFrame) -> DataFrame:
    return requests.groupBy("provider").agg(F.count("*").alias("requests"))


def latency_histogram(seconds: DataFrame, column: str = "seconds") -> DataFrame:
    """le (the last one +Inf), cumulative count; one pass, one row at the end that is turned on its side."""
    sums = seconds.agg(*(F.count_if(F.col(column) <= b).alias(f"b{i}") for i, b in enumerate(BOUNDS)), F.count(column).alias("b_all"))
    rows = F.array(*(F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BOUNDS)), F.struct(F.lit("+Inf").alias("le"), F.col("b_all").alias("n")))
    return sums.select(F.inline(rows))


def latency_counters(seconds: DataFrame, by: list[str], column: str = "seconds") -> DataFrame:
    """by, buckets (cumulative counts, one a bound), n, total: sums only, so counters of parts add up, and a stream keeps
    one small row a combination in output mode update."""
    x = F.col(column)
    sums = seconds.groupBy(*by).agg(*(F.count_if(x <= b).alias(f"_b{i}") for i, b in enumerate(BOUNDS)), F.count(x).alias("n"), F.coalesce(F.sum(x), F.lit(0.0)).alias("total"))
    return sums.select(*by, F.array(*(F.col(f"_b{i}") for i in range(len(BOUNDS)))).alias("buckets"), "n", "total")


def merged_counters(counters: DataFrame, by: list[str]) -> DataFrame:
    """Counters of several parts (machines, days) as one."""
    sums = counters.groupBy(*by).agg(*(F.sum(F.get("buckets", F.lit(i))).alias(f"_b{i}") for i in range(len(BOUNDS))), F.sum("n").alias("n"), F.sum("total").alias("total"))
    return sums.select(*by, F.array(*(F.col(f"_b{i}") for i in range(len(BOUNDS)))).alias("buckets"), "n", "total")


def quantile(q: float, buckets: str = "buckets", n: str = "n") -> Column:
    """The value below which a share q lies, even inside its bucket; the last bound beyond it, null without values."""
    bounds, counts, rank = F.array(*map(F.lit, BOUNDS)), F.col(buckets), F.col(n) * F.lit(q)
    i = F.size(F.filter(counts, lambda c: c < rank))  # cumulative: all below the one that is looked for
    low, below = F.coalesce(F.get(bounds, i - 1), F.lit(0.0)), F.coalesce(F.get(counts, i - 1), F.lit(0))
    inside = low + (F.get(bounds, i) - low) * F.try_divide(rank - below, F.get(counts, i) - below)
    return F.when(F.col(n) > 0, F.when(i == len(BOUNDS), F.lit(BOUNDS[-1])).otherwise(F.coalesce(inside, low)))


def latency_lines(seconds: DataFrame, name: str, column: str = "seconds") -> DataFrame:
    """ord, line: the whole histogram family: buckets, sum and count."""
    x = F.col(column)
    sums = seconds.agg(*(F.count_if(x <= b).alias(f"b{i}") for i, b in enumerate(BOUNDS)), F.count(x).alias("n"), F.coalesce(F.sum(x), F.lit(0.0)).alias("total"))
    text = lambda c: F.col(c).cast("string")
    lines = [F.concat(F.lit(f'{name}_bucket{{le="{b:g}"}} '), text(f"b{i}")) for i, b in enumerate(BOUNDS)]
    lines += [F.concat(F.lit(f'{name}_bucket{{le="+Inf"}} '), text("n")), F.concat(F.lit(f"{name}_sum "), text("total")), F.concat(F.lit(f"{name}_count "), text("n"))]
    return sums.select(F.posexplode(F.array(*lines)).alias("ord", "line")).select(F.col("ord").cast("long").alias("ord"), "line")


def all_families(events: DataFrame, requests: DataFrame, seconds: DataFrame) -> DataFrame:
    """family, ord, line: requests by type and action, requests by provider, latency; each family's lines in order."""
    from pyspark.sql import Window

    def numbered(n: int, lines: DataFrame) -> DataFrame:  # one line for each combination of labels
        return lines.select(F.lit(n).alias("family"), (F.row_number().over(Window.orderBy("line")) - 1).cast("long").alias("ord"), "line")

    first = numbered(0, exposition(requests_total(events), "requests_total", ["event_type", "action_taken"], "requests"))
    second = numbered(1, exposition(provider_total(requests), "provider_requests_total", ["provider"], "requests"))
    third = latency_lines(seconds, "request_duration_seconds").select(F.lit(2).alias("family"), "ord", "line")
    return first.unionByName(second).unionByName(third)


def exposition(counts: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Lines name{label="value",...} n, in the order of the labels."""
    pairs = F.concat_ws(",", *(F.format_string(f'{c}="%s"', F.col(c)) for c in labels))
    return counts.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line")).orderBy("line")


def last_seen(beats: DataFrame, profile: str = "profile_id", at: str = "ts") -> DataFrame:
    return beats.groupBy(profile).agg(F.max(at).alias("last_seen"))


def upserted(known: DataFrame, beats: DataFrame, profile: str = "profile_id", at: str = "last_seen") -> DataFrame:
    """Profiles with their last signs of life after some more; the others stay, and beats of no profile name none."""
    return known.select(profile, at).union(beats.where(F.col(profile).isNotNull()).select(profile, at)).groupBy(profile).agg(F.max(at).alias(at))


def fresh(last: Column, now: Column, seconds: int = 150, closed: bool = False) -> Column:
    """Seen less than so many seconds ago; closed: also exactly so many, but not in the future."""
    age = F.unix_timestamp(now) - F.unix_timestamp(last)
    return age.between(0, seconds) if closed else age < seconds


def violations_before(events: DataFrame, actor: str, at: str, violation: Column) -> DataFrame:
    """Each event with the number of its actor's violations before it (point in time)."""
    from pyspark.sql import Window

    # an actor may have most of the events: counts a day first, so that only days are ordered event by event
    day = F.to_date(at)
    marked = events.withColumn("_day", day).withColumn("_hit", F.coalesce(violation.cast("long"), F.lit(0)))
    days = marked.groupBy(F.col(actor).alias("_actor"), F.col("_day").alias("_on")).agg(F.sum("_hit").alias("_n"))
    days = days.withColumn("_earlier", F.coalesce(F.sum("_n").over(Window.partitionBy("_actor").orderBy("_on").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = Window.partitionBy(actor, "_day").orderBy(at, "event_id").rowsBetween(Window.unboundedPreceding, -1)
    joined = marked.join(days, F.col(actor).eqNullSafe(F.col("_actor")) & F.col("_day").eqNullSafe(F.col("_on")))
    return joined.withColumn("violations_before", F.col("_earlier") + F.coalesce(F.sum("_hit").over(within), F.lit(0))).drop("_day", "_hit", "_actor", "_on", "_earlier")
