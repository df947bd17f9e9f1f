"""Access to the parquet tables of a data folder, and to shared storage for cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder `sf_dir`, by a path that any Hadoop file system can hold."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, as --py-files would."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    if not getattr(context, "_lodestone_shipped", False):
        path = f"{tempfile.mkdtemp()}/lodestone.zip"
        with zipfile.ZipFile(path, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        context.addPyFile(path)
        context._lodestone_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a local session gets one below its warehouse;
    on a cluster that would be a folder of one machine, so it is an error there."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the application ends, or the block of `intermediates` around it."""
    context, path = spark.sparkContext, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)
    if getattr(context, "_lodestone_made", None) is not None:
        context._lodestone_made.append(path)
    return path


@contextlib.contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """What is written to new scratch paths inside goes when the block ends; the block's results lie elsewhere by then."""
    context = spark.sparkContext
    outer, context._lodestone_made = getattr(context, "_lodestone_made", None), []
    try:
        yield
    finally:
        made, context._lodestone_made = context._lodestone_made, outer
        for path in made:
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: lineage ends there, and a lost
    executor costs a reread of files, not the work before them. The files go when the application ends."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
