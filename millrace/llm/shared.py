"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers (8 bytes each) that are broadcast; with more, a join shuffles.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset (tests), a new local folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
    return _local_dir()


@functools.cache
def _local_dir() -> str:
    """One folder for each driver process of local mode, where driver and executors are one."""
    return f"file://{tempfile.mkdtemp(prefix='millrace-')}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: computed once, with its lineage cut."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*stashed: DataFrame) -> None:
    """Delete the files of tables that ``stash`` has written, once nothing that is still to be computed reads them."""
    for df in stashed:
        spark = df.sparkSession
        own = f"{shared_dir(spark)}/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if _plain(folder).startswith(_plain(own)):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _plain(path: str) -> str:
    """A path without scheme and repeated slashes, as Spark names local folders in several ways."""
    return re.sub(r"/+", "/", re.sub(r"^\w+:", "", path))


def small_or_shuffled(stashed: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast in a join if it is counted to be small."""
    return F.broadcast(stashed) if stashed.count() <= BROADCAST_ROWS else stashed


def frugal(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``task`` for mapInArrow, giving what it has freed back to the system when it ends: Spark keeps its worker for other stages."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return run
