"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

ROWS_A_FILE, LEAST_FILES = 10_000, 8
#: Tables that this process has written and not yet deleted.
PATHS: set[str] = set()
#: Path and schema of the tables of ``once``.
KNOWN: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own, which only a single JVM can share."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quarrylink-")
        sc.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/quarrylink-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` there and read it back: cuts the lineage, and later steps survive lost executors.

    ``rows``, where the caller knows about how many there are, keeps small tables from many tiny files.
    """
    path = new_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // ROWS_A_FILE)))
    df.write.parquet(path)
    PATHS.add(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, name: str, of: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that every query of one application derives alike from ``of`` (a data folder): written at its first use."""
    key = (spark.sparkContext.applicationId, name, of)
    if key not in KNOWN:
        made, path = make(), new_path(spark, name)
        made.write.parquet(path)
        # Known only once it is whole: after a failed write the next query makes it anew.
        KNOWN[key] = (path, made.schema)
    path, schema = KNOWN[key]
    return spark.read.schema(schema).parquet(path)


def delete(spark: SparkSession, paths: set[str]) -> None:
    """Delete written tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    for path in paths & PATHS:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        PATHS.discard(path)
