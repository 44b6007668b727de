"""Table scans: columns and predicates go to the reader, which prunes and pushes down."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(
    spark: SparkSession,
    path: str,
    columns: list[str] | None = None,
    predicate: str | Column | None = None,
    format: str = "parquet",
    schema: str | T.StructType | None = None,
    **options: str,
) -> DataFrame:
    """Read a file table in any format Spark knows."""
    reader = spark.read.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if predicate is not None:
        df = df.where(predicate)
    return df.select(*columns) if columns else df


def scan_or_empty(spark: SparkSession, path: str, schema: str | T.StructType, **kwargs) -> DataFrame:
    """A table whose directory is missing has no rows."""
    try:
        return scan(spark, path, schema=schema, **kwargs)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def as_table(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of one partition in the table's schema: missing columns are NULL,
    present ones are cast (text that does not fit becomes NULL)."""
    have = {c.lower(): c for c in df.columns}
    cols = []
    for f in schema.fields:
        source = have.get(f.name.lower())
        col = F.col(f"`{source}`").try_cast(f.dataType) if source else F.lit(None).cast(f.dataType)
        cols.append(col.alias(f.name))
    return df.select(*cols)


def merge_partitions(parts: list[DataFrame], schema: str | T.StructType) -> DataFrame:
    """Union of partitions written under older schemas."""
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return reduce(DataFrame.union, [as_table(p, target) for p in parts])


def scan_partitions(
    spark: SparkSession, locations: dict[str, dict[str, object]], schema: T.StructType, format: str = "parquet"
) -> DataFrame:
    """Partitions given one by one as ``{path: {partition column: value}}``, as a
    metastore lists them. A missing directory skips that partition only."""
    data = T.StructType([f for f in schema.fields if all(f.name not in v for v in locations.values())])
    parts = []
    for path, values in locations.items():
        df = scan_or_empty(spark, path, data, format=format)
        parts.append(df.withColumns({k: F.lit(v) for k, v in values.items()}))
    return merge_partitions(parts, schema) if parts else spark.createDataFrame([], schema)


def spread_small(df: DataFrame, split_bytes: int = 128 * 1024 * 1024) -> DataFrame:
    """Give a small scan to all cores, for work that is heavy per row. Its size is
    the planner's estimate; with a core's worth of bytes per core it is left
    alone: there the reader's own splits suffice and nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size > cores * split_bytes else df.repartition(cores)


def spread_rows(df: DataFrame, rows: int) -> DataFrame:
    """Deal a scan to tasks of about ``rows`` rows, for work that needs memory per
    row: the reader's own splits hold whole row groups, up to 128 MB of compressed file."""
    tasks = -(-df.count() // rows)
    return df.repartition(tasks) if tasks > 1 else df
