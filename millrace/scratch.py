"""Shared scratch folders and unique names for tables a job writes on its way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []  # folders made in each open scope
CHECKPOINT_KEY = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be invisible to the other machines.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set(CHECKPOINT_KEY, root)
    return root


def remove_scratch(spark: SparkSession, path: str) -> bool:
    """Delete a folder made by ``new_dir`` once nothing reads it any more."""
    root = scratch_root(spark)
    if not path.startswith(f"{root}/") or ".." in path:
        raise ValueError(f"{path} is not in the scratch folder {root}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def new_dir(spark: SparkSession, label: str) -> str:
    """A path nobody else uses; it is not created."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Folders made inside are deleted at the end, but for those the caller has
    put into the list it is given: for work whose result is written by then."""
    keep: list[str] = []
    _scopes.append(made := [])
    try:
        yield keep
    finally:
        _scopes.remove(made)
        for path in made:
            if path not in keep:
                remove_scratch(spark, path)


def new_name(label: str) -> str:
    """A table or view name nobody else uses."""
    return f"{label}_{uuid.uuid4().hex[:12]}"


@contextmanager
def passing(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``df`` written once, as by ``materialize``, and deleted at the end: for rows
    that nothing reads once the work inside is written itself."""
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    yield df.sparkSession.read.schema(df.schema).parquet(path)
    remove_scratch(df.sparkSession, path)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends
    there, and a lost executor costs no recomputation of what came before."""
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
