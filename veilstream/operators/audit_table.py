"""Changes of the stored audit table: only the folders (tenant, day) that a change touches are written again.

What a touched folder holds afterwards is written to a staging folder beside the table first, with the list of
touched folders last; then each staged folder is moved to the place of the table's, and folders with nothing left go.  A
job that is lost before its staging is complete has changed nothing; one that is lost afterwards is completed by
``recover``, which can be run any number of times.  All other folders keep their files.  One change at a time.
Folders, by tenant and day, are few enough to be named on the driver and broadcast; rows are not.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilstream.operators import audit as A

PARTS = ["tenant_id", "day"]
#: rows of a folder that one task writes when marks are set
FILE_ROWS = 500_000


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The table as it is stored, findings sealed; tenants are text and days are dates, whatever they look like."""
    kinds = {"tenant_id": T.StringType(), "day": T.DateType()}
    fields = [T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in spark.read.parquet(path).schema]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def _same(df: DataFrame, touched: DataFrame):
    return df["tenant_id"].eqNullSafe(touched["_tenant"]) & df["day"].eqNullSafe(touched["_day"])


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _staging(path: str) -> str:
    return path.rstrip("/") + ".staging"


def _replace(spark: SparkSession, path: str, touched: DataFrame, rows: DataFrame) -> None:
    """touched: _tenant, _day; rows: all that these folders hold from now on."""
    stage = f"{_staging(path)}/{uuid.uuid4().hex}"
    # written once: the rows must not depend on a table that is being changed
    rows.write.partitionBy(*PARTS).parquet(f"{stage}/rows")
    folder = lambda df: df.select(*PARTS, F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")).distinct()
    left = folder(spark.read.schema(stored(spark, path).schema).parquet(f"{stage}/rows")).select(*[F.col(c).alias(f"_left_{c}") for c in PARTS], F.col("folder").alias("staged"))
    held = folder(stored(spark, path))
    held = held.join(F.broadcast(touched), _same(held, touched), "left_semi")
    same = held["tenant_id"].eqNullSafe(left["_left_tenant_id"]) & held["day"].eqNullSafe(left["_left_day"])
    held.join(left, same, "left").select("folder", "staged").write.parquet(f"{stage}/touched")
    _apply(spark, path, stage)


def _together(rows: DataFrame) -> DataFrame:
    """A folder's rows come together, unless they are many: then they are split."""
    return rows.hint("rebalance", *PARTS)


def _exists(spark: SparkSession, path: str) -> bool:
    place, fs = _files(spark, path)
    return fs.exists(place)


def _apply(spark: SparkSession, path: str, stage: str) -> None:
    place, fs = _files(spark, stage)
    as_path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(x))
    touched = spark.read.schema("folder string, staged string").parquet(f"{stage}/touched")
    for row in touched.toLocalIterator():  # names of folders, not rows
        if row["staged"] is not None and not fs.exists(as_path(row["staged"])):
            continue  # moved before the job was lost
        fs.delete(as_path(row["folder"]), True)
        if row["staged"] is not None and not fs.rename(as_path(row["staged"]), as_path(row["folder"])):
            raise OSError(f"{row['staged']} cannot be moved")
    fs.delete(place, True)


def recover(spark: SparkSession, path: str) -> int:
    """Complete changes whose staging is complete, and forget the others.  How many were completed."""
    place, fs = _files(spark, _staging(path))
    done = 0
    for found in list(fs.listStatus(place)) if fs.exists(place) else []:
        stage = found.getPath().toString()
        if _exists(spark, f"{stage}/touched/_SUCCESS"):
            _apply(spark, path, stage)
            done += 1
        else:
            fs.delete(found.getPath(), True)
    return done


def _named(parts: DataFrame) -> DataFrame:
    return parts.select(F.col("tenant_id").alias("_tenant"), F.col("day").alias("_day")).distinct()


def _inside(table: DataFrame, touched: DataFrame) -> DataFrame:
    return table.join(F.broadcast(touched), _same(table, touched), "left_semi")


def mark_synced(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Events with the given ids (a table with a column id) are marked as sent."""
    table = stored(spark, path)
    asked = ids.select(F.col("id").alias("_asked")).distinct()
    marks = table.where("synced IS NULL OR synced <> 1").select("id", *PARTS).join(asked, F.col("id") == F.col("_asked"), "left_semi")
    touched = _named(marks)
    # rows and marks come to their folder together, so that all columns are shuffled once
    every = _inside(table, touched).withColumn("_mark", F.lit(0)).unionByName(marks.withColumn("_mark", F.lit(1)), allowMissingColumns=True)
    files = table.groupBy(*PARTS).agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("_files")).select(F.col("tenant_id").alias("_tenant"), F.col("day").alias("_day"), "_files")
    placed = every.join(F.broadcast(files), _same(every, files), "left").withColumn("_file", F.pmod(F.xxhash64("id"), F.coalesce("_files", F.lit(1))))
    placed = placed.repartition(*PARTS, "_file")
    marked = F.max("_mark").over(Window.partitionBy(*PARTS, "_file", "id")) == 1
    rows = placed.withColumn("synced", F.when(marked, 1).otherwise(F.col("synced"))).where("_mark = 0")
    _replace(spark, path, touched, rows.select(*table.columns))


def purge_before(spark: SparkSession, path: str, cutoff) -> None:
    """All tenants' events before a time go; days that end before it are not read."""
    table = stored(spark, path)
    at = F.lit(cutoff).cast("timestamp")
    old = table.where(F.col("day") <= F.to_date(at))
    touched = _named(old)
    _replace(spark, path, touched, _together(old.where((F.col("day") == F.to_date(at)) & (F.col("timestamp") >= at))))


def keep_newest(spark: SparkSession, path: str, most: int = A.KEEP_ROWS, tenant: str | None = None) -> None:
    """At most so many events a tenant (or of one tenant), the newest; days that stay whole are not written again."""
    table = stored(spark, path)
    kept = A.keep_newest(table, most, tenant, few_days=True)
    before, after = (df.groupBy(*PARTS).agg(F.count("*").alias(n)) for df, n in ((table, "_all"), (kept, "_kept")))
    after = after.select(F.col("tenant_id").alias("_tenant"), F.col("day").alias("_day"), "_kept")
    changed = before.join(after, _same(before, after), "left").where("coalesce(_kept, 0) < _all")
    touched = _named(changed.select(*PARTS))
    _replace(spark, path, touched, _together(_inside(kept, touched)))


def retain(spark: SparkSession, path: str, now, days: int = A.KEEP_DAYS, most: int = A.KEEP_ROWS) -> None:
    """The daily job: first by age, then by number."""
    cutoff = spark.range(1).select(F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))).first()[0]
    purge_before(spark, path, cutoff)
    keep_newest(spark, path, most)
