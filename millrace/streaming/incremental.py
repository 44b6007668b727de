"""Loading only the files that were not there before."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import batched

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.sinks import file_sizes

LOAD = "load"  # the partition column that tells the batches of a table apart


def load_new_files(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    format: str = "parquet",
    max_files: int | None = None,
) -> int:
    """Append the files of ``source`` that no earlier run has seen to ``target``
    and stop. The checkpoint remembers the files, so a run that is cut off is
    finished by the next one, each file once. Returns the rows of this run."""
    reader = spark.readStream.format(format).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    run = (
        reader.load(source).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start(target)
    )
    rows: dict[int, int] = {}  # by batch: the progress log keeps only the latest batches
    finished = False
    while not finished:
        finished = run.awaitTermination(1)
        rows.update({p["batchId"]: p["numInputRows"] for p in run.recentProgress})
    return sum(rows.values())


def file_listing(spark: SparkSession, source: str) -> DataFrame:
    """The data files of a directory (a column ``file``): the snapshot a later
    run compares with. No file is opened."""
    return file_sizes(spark, source).select(F.col("path").alias("file"))


def read_unseen(
    spark: SparkSession, source: str, schema: T.StructType, seen: DataFrame, format: str = "parquet"
) -> DataFrame:
    """Batch form: read only files that are not in the ``seen`` listing; partition
    columns come from the directories. File names pass through the driver, as in
    any file scan; rows do not."""
    new = file_listing(spark, source).join(seen.select("file").distinct(), "file", "left_anti")
    files = [r["file"] for r in new.toLocalIterator()]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.format(format).schema(schema).option("basePath", source).load(files)


# ---------------------------------------------------------------- into a table


class TableLoads:
    """Batches appended to a partitioned catalog table, each exactly once.

    A batch is written below its own value of the partition column ``load`` and
    shows when its partitions are registered: that is the commit, and the list of
    a table's loads is the ledger. A batch that was cut off in between is written
    again over what it left; one that is in the ledger changes nothing.
    """

    def __init__(self, spark: SparkSession, name: str, schema: T.StructType, location: str, partition_by: Sequence[str] = ()) -> None:
        self.spark, self.name, self.location, self.keys = spark, name, location.rstrip("/"), list(partition_by)
        if LOAD in schema.names:
            raise ValueError(f"the column {LOAD!r} is the table's own")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        parts = ", ".join(f"`{c}`" for c in [LOAD, *self.keys])
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, `{LOAD}` BIGINT) USING parquet PARTITIONED BY ({parts}) LOCATION '{self.location}'")

    def ledger(self) -> list[int]:
        """The numbers of the batches that the table shows."""
        rows = self.spark.sql(f"SHOW PARTITIONS {self.name}").select(F.regexp_extract("partition", f"^{LOAD}=([0-9]+)", 1).cast("long").alias("n"))
        return sorted(r["n"] for r in rows.distinct().collect())

    def write(self, batch: DataFrame, number: int) -> list[dict]:
        """Write a batch over whatever an earlier try left; nothing shows yet.
        Returns its partitions (names and folders only)."""
        path = f"{self.location}/{LOAD}={number}"
        rows = batch.repartition(*self.keys, F.spark_partition_id() % 8) if self.keys else batch  # few files to a partition
        rows.write.mode("overwrite").partitionBy(*self.keys).parquet(path)
        if not self.keys:
            return [{}]
        return [r.asDict() for r in self.spark.read.schema(batch.schema).parquet(path).select(*self.keys).distinct().collect()]

    def commit(self, number: int, partitions: list[dict]) -> None:
        if not partitions:  # a batch without rows is in the ledger all the same
            partitions = [dict.fromkeys(self.keys)]
        for some in batched(partitions, 1000):
            specs = []
            for p in some:
                cells = [f"`{LOAD}` = {number}", *[f"`{k}` = {_literal(v)}" for k, v in p.items()]]
                specs.append(f"PARTITION ({', '.join(cells)})")
            self.spark.sql(f"ALTER TABLE {self.name} ADD IF NOT EXISTS {' '.join(specs)}")
        self.spark.catalog.refreshTable(self.name)  # a cached table is computed again when it is read next

    def append(self, batch: DataFrame, number: int) -> bool:
        """Add a batch unless it is in the ledger; says whether it was added."""
        if number in self.ledger():
            return False
        self.commit(number, self.write(batch, number))
        return True


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) and not isinstance(value, bool) else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def load_into_table(
    spark: SparkSession, source: str, schema: T.StructType, target: TableLoads, checkpoint: str, format: str = "parquet",
    max_files: int | None = None, append: Callable[[DataFrame, int], object] | None = None,
) -> list[int]:
    """Load the files of ``source`` that no earlier run has seen into a table and
    stop. Spark repeats a batch that was not finished under the same number and
    with the same files, which ``TableLoads`` makes harmless. Returns the ledger."""
    reader = spark.readStream.format(format).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    run = (
        reader.load(source).writeStream.foreachBatch(append or target.append)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return target.ledger()
