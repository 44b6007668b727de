"""Writing: directories, several targets in one pass, exports, compaction, loads."""

from __future__ import annotations

import bisect
import re
import uuid
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import CatalogError
from millrace.skew import checked_broadcast
from millrace.sources.scans import as_table, scan
from millrace.sources.text_formats import parse_delimited

TARGET = "_target"


def write_directory(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite", **options) -> None:
    """INSERT OVERWRITE DIRECTORY."""
    df.write.format(format).mode(mode).options(**options).save(path)


def split_write(df: DataFrame, targets: dict[str, str], path: str) -> dict[str, DataFrame]:
    """Route rows to several targets in one scan and one write; a row goes to
    every target whose condition holds."""
    chosen = [F.when(F.expr(cond), F.lit(name)) for name, cond in targets.items()]
    tagged = df.withColumn(TARGET, F.explode(F.array_compact(F.array(*chosen))))
    tagged.write.partitionBy(TARGET).parquet(path)
    schema = T.StructType([*df.schema.fields, T.StructField(TARGET, T.StringType())])
    written = df.sparkSession.read.schema(schema).parquet(path)
    return {name: written.where(F.col(TARGET) == name).drop(TARGET) for name in targets}


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """One row per data file: ``path`` and ``length``; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "[!_.]*").load(path).select("path", "length")
    )


def compact_files(spark: SparkSession, source: str, target: str, file_bytes: int = 512 * 1024 * 1024) -> int:
    """Rewrite a directory of small files into files of about ``file_bytes``.

    The reader already packs small files into even splits, so neighbouring
    splits are merged without a shuffle. A directory of partitions keeps them:
    the rows of each are brought together first. Returns the number of files
    aimed at, over all partitions.
    """
    sizes = file_sizes(spark, source).agg(F.sum("length").alias("total"), F.first("path").alias("path")).first()
    files = max(1, -(-(sizes["total"] or 0) // file_bytes))
    parts = partition_names(source, sizes["path"] or "")
    if not parts:
        scan(spark, source).coalesce(files).write.mode("errorifexists").parquet(target)
        return files
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")  # directory names stay as they are
    try:
        rows = scan(spark, source)
        gathered = rows.hint("rebalance", *[F.col(f"`{c}`") for c in parts])
        gathered.write.mode("errorifexists").partitionBy(*parts).parquet(target)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return files


# ---------------------------------------------------------------- compaction in place


@dataclass
class Compaction:
    """What a compaction did, and the files it replaced: readers that began before
    the swap may still read those until ``remove_old``."""

    before: int
    after: int
    old_files: list[str]
    spark: SparkSession

    def remove_old(self) -> None:
        for file in self.old_files:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, False)
        self.old_files = []


def best_fit(sizes: dict[str, int], capacity: int) -> dict[str, int]:
    """Files to bins of ``capacity`` bytes, largest first, each into the fullest
    bin that has room; a file above the capacity gets a bin of its own."""
    bins: dict[str, int] = {}
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    for file, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        i = bisect.bisect_left(room, (size, -1))
        left, number = room.pop(i) if i < len(room) else (max(capacity, size), len(set(bins.values())))
        bins[file] = number
        bisect.insort(room, (left - size, number))
    return bins


def compact_partition(spark: SparkSession, name: str, partition: dict[str, object] | None = None, file_bytes: int = 512 * 1024 * 1024) -> Compaction:
    """Merge the small files of a catalog table's partition (or of a table without
    partitions) into files of about ``file_bytes``, in place.

    Files are dealt to output tasks by size. The new files go into a new folder,
    are counted, and the table is pointed at that folder in one step; so a reader
    sees the old files or the new ones, and a failure before that step changes
    nothing. File names and sizes pass through the driver, rows do not.
    """
    spec = ", ".join(f"`{k}` = {_sql_literal(v)}" for k, v in (partition or {}).items())
    clause = f" PARTITION ({spec})" if partition else ""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}{clause}").where("col_name = 'Location'")
    location = described.first()["data_type"].rstrip("/")
    fields = [f for f in spark.table(name).schema.fields if f.name not in (partition or {})]
    rows = spark.read.schema(T.StructType(fields)).parquet(location)
    sizes = {r["path"]: r["length"] for r in file_sizes(spark, location).collect()}
    bins = best_fit(sizes, file_bytes)
    targets = len(set(bins.values()))
    if targets >= len(sizes):
        return Compaction(len(sizes), len(sizes), [], spark)
    folder = f"{location.rpartition('/')[0]}/_compacted-{uuid.uuid4().hex}" if partition else f"{location}-{uuid.uuid4().hex}"
    plan = spark.createDataFrame([(_plain_path(f), b) for f, b in bins.items()], "file string, bin int")  # one row per file
    plain = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), "^file:/+", "/")
    dealt = rows.select("*", plain.alias("_file")).join(checked_broadcast(plan.withColumnRenamed("file", "_file")), "_file")
    dealt.repartitionById(targets, F.col("bin")).drop("_file", "bin").write.mode("errorifexists").parquet(folder)
    written = spark.read.schema(T.StructType(fields)).parquet(folder)
    if written.count() != rows.count():
        raise CatalogError(f"{name}{clause}: the new files do not hold all rows; the old ones stay")
    spark.sql(f"ALTER TABLE {name}{clause} SET LOCATION '{folder}'")
    spark.catalog.refreshTable(name)
    return Compaction(len(sizes), file_sizes(spark, folder).count(), list(sizes), spark)


def _plain_path(file: str) -> str:
    return re.sub("^file:/+", "/", file)


def _sql_literal(value: object) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) and not isinstance(value, bool) else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def partition_names(directory: str, file: str) -> list[str]:
    """The partition columns that the path of a file below ``directory`` names."""
    below = urlparse(file).path.removeprefix(urlparse(directory).path.rstrip("/"))
    return [part.partition("=")[0] for part in below.split("/")[:-1] if "=" in part]


def export_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Data and schema under one directory."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/data")
    described = df.sparkSession.createDataFrame([(df.schema.json(),)], "value string")
    described.coalesce(1).write.text(f"{path}/schema")


def import_table(spark: SparkSession, path: str, **partition) -> DataFrame:
    """Read an export, whole or one partition of it."""
    import json

    text = spark.read.text(f"{path}/schema").first()["value"]
    df = spark.read.schema(T.StructType.fromJson(json.loads(text))).parquet(f"{path}/data")
    for k, v in partition.items():
        df = df.where(F.col(k) == v)
    return df


def load_data(
    spark: SparkSession,
    source: DataFrame | str,
    table: str,
    overwrite: bool = False,
    partition: dict[str, object] | None = None,
    format: str = "parquet",
) -> None:
    """LOAD DATA [OVERWRITE] INTO TABLE [PARTITION]: rows take the table's
    schema on the way; files with other or missing columns are accepted.
    ``format`` may also be ``delimited`` (see ``text_formats``)."""
    from millrace.catalog.tables import TableCatalog

    target = spark.table(table).schema
    unknown = set(partition or {}) - set(target.names)
    if unknown:
        raise CatalogError(f"{table} has no partition columns {sorted(unknown)}")
    if not isinstance(source, str):
        df = source
    elif format == "delimited":
        stored = T.StructType([f for f in target.fields if f.name not in (partition or {})])
        df = parse_delimited(spark.read.text(source), stored)
    else:
        df = scan(spark, source, format=format)
    catalog = TableCatalog(spark)
    if partition:
        data = T.StructType([f for f in target.fields if f.name not in partition])
        catalog.insert_partition(table, as_table(df, data), overwrite, **partition)
    elif overwrite:
        catalog.overwrite(table, as_table(df, target))
    else:
        catalog.insert(table, as_table(df, target))
