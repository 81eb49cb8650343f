"""What was in force at an event's time: the latest earlier version, carried along without putting events in order.

Time falls into slots.  An event needs the versions that begin in its own slot, and one more: the last of all earlier
slots.  That one is carried over slots, not over events: within groups of slots, and from group to group, so that no
window is wider than FAN rows.  A slot's versions and events then stand in one order, so that neither is looked through
for each of the other; a slot that holds too many events is split, with its versions in each part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: slots of a group, and groups at most: 2^44 slots, be it of an hour or of ROWS whole numbers
FAN_BITS = 22
ROW_BITS = 20
HOUR = 3600
#: events of a slot that one window holds
MOST_EVENTS = 1 << 20


def _same(left: DataFrame, right: DataFrame, names: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in names])


def _floor_div(x: Column, by: int) -> Column:
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def carried(slots: DataFrame, keys: list[str]) -> DataFrame:
    """slots (keys, slot, value; one row each, value null where none is set) with before: the value of the latest earlier
    slot of the same keys that has one."""
    by = lambda *names: Window.partitionBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    rows = slots.withColumn("_group", F.shiftright("slot", FAN_BITS)).withColumn("_in", F.last("value", ignorenulls=True).over(by(*keys, "_group").orderBy("slot")))
    set_at = F.when(F.col("value").isNotNull(), F.col("slot"))
    groups = slots.groupBy(*keys, F.shiftright("slot", FAN_BITS).alias("_above")).agg(F.max_by("value", set_at).alias("_last"))
    named = {k: f"_of_{k}" for k in keys}
    # one row for each group of slots, and at most 2^22 of these: all of a key in one window
    above = groups.withColumn("_all", F.shiftright(F.col("_above") + (1 << 62), 63)).withColumn("_before", F.last("_last", ignorenulls=True).over(by(*keys, "_all").orderBy("_above")))
    above = above.select(*[F.col(k).alias(v) for k, v in named.items()], "_above", "_before")
    met = rows.join(above, _same(rows, above, [*named.items(), ("_group", "_above")]), "left")
    return met.withColumn("before", F.coalesce("_in", "_before")).drop("_group", "_in", "_above", "_before", *named.values())


def as_of(events: DataFrame, versions: DataFrame, at: str, since: str, order: str, keys: list[str], slot_seconds: int = HOUR, most: int = MOST_EVENTS) -> DataFrame:
    """events with in_force: a struct of the columns of the version (of the same keys) that was the last to begin by the
    event's time; null before the first.

    Of versions that begin together the one of the largest ``order`` counts.  Keys may be null and are then
    a key.  A version without a beginning never is in force, an event without a time has none.  A slot's events and
    versions are put in order together; one of more than ``most`` events is split, and its versions go to each part.
    """
    width = slot_seconds * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    named = {k: f"_of_{k}" for k in keys}
    of = list(named.values())
    begun = versions.where(F.col(since).isNotNull()).select(*[F.col(k).alias(v) for k, v in named.items()], micros(since).alias("_at"), F.struct(F.col(order).alias("order"), F.struct(*versions.columns).alias("version")).alias("v"))
    begun = begun.groupBy(*of, "_at").agg(F.max("v")["version"].alias("_version")).withColumn("slot", _floor_div(F.col("_at"), width))
    rows = events.select(F.struct(*events.columns).alias("_event"), *[F.col(k).alias(v) for k, v in named.items()], micros(at).alias("_at")).withColumn("slot", _floor_div(F.col("_at"), width))
    asked = rows.groupBy(*of, "slot").agg(F.count("*").alias("n"))
    last = begun.groupBy(*of, "slot").agg(F.max_by("_version", "_at").alias("value"))
    none = F.lit(None).cast(last.schema["value"].dataType)
    slots = asked.select(*of, "slot", none.alias("value")).unionByName(last).groupBy(*of, "slot").agg(F.first("value", ignorenulls=True).alias("value"))
    before = carried(slots, of).where(F.col("before").isNotNull()).select(*of, "slot", F.lit(None).cast("long").alias("_at"), F.col("before").alias("_version"))
    hashed = [F.col("_event")[c] for c, kind in events.dtypes if "map<" not in kind]
    # few: each stands for so many events
    hot = asked.where(F.col("n") > most).select(*[F.col(k).alias(f"_hot{k}") for k in of], F.col("slot").alias("_hot"), F.ceil(F.col("n") / most).cast("int").alias("_parts"))
    split = lambda df: df.join(F.broadcast(hot), _same(df, hot, [*((k, f"_hot{k}") for k in of), ("slot", "_hot")]), "left").drop(*[f"_hot{k}" for k in of], "_hot").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    known = split(before.unionByName(begun.select(*before.columns))).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn("_event", F.lit(None).cast(rows.schema["_event"].dataType))
    dealt = split(rows).withColumn("_part", F.pmod(F.xxhash64("_at", *hashed), F.col("_parts")).cast("int")).withColumn("_version", none)
    # what was in force before comes first in its slot, then a version before the events of its time
    by = Window.partitionBy(*of, "slot", "_part").orderBy(F.col("_at").asc_nulls_first(), F.col("_version").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = known.unionByName(dealt).withColumn("in_force", F.last("_version", ignorenulls=True).over(by))
    return met.where(F.col("_event").isNotNull()).select("_event.*", "in_force")


def with_previous(rows: DataFrame, order: str, value: Column, keys: list[str] | None = None) -> DataFrame:
    """rows with previous: the value (a struct, never null) of the row before, by a whole number, within the keys."""
    keys = keys or []
    slotted = rows.withColumn("_slot", F.shiftright(F.col(order).cast("long"), ROW_BITS)).withColumn("_value", value)
    slots = slotted.groupBy(*keys, F.col("_slot").alias("slot")).agg(F.max_by("_value", order).alias("value"))
    named = {k: f"_of_{k}" for k in keys}
    known = carried(slots, keys).select(*[F.col(k).alias(v) for k, v in named.items()], F.col("slot").alias("_known"), "before")
    inside = slotted.withColumn("_lag", F.lag("_value").over(Window.partitionBy(*keys, "_slot").orderBy(order)))
    met = inside.join(known, _same(inside, known, [*named.items(), ("_slot", "_known")]), "left")
    return met.withColumn("previous", F.coalesce("_lag", "before")).drop("_slot", "_value", "_lag", "_known", "before", *named.values())
