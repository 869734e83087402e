"""Reading the store's tables, and the shared folder in which intermediate tables are written."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normal(col: Column | str) -> Column:
    """Normal form of a hash or id: outer blanks dropped, lower case, a leading 0x dropped. Null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.lower(F.btrim(c, F.lit(BLANKS))), "^0x", "")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Only where that is unset
    (single-machine tests) a folder of its own is made."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="stratamem-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
        spark.sparkContext.setCheckpointDir(at)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()  # never without its scheme
    return full.rstrip("/").replace("file:/", "file:///") if full.startswith("file:/") and not full.startswith("file://") else full.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table, known to `release`."""
    _KEPT.add(path := f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    return path


_KEPT: set[str] = set()


def release(spark: SparkSession) -> None:
    """Deletes what this session's operators have written to the shared folder so far. For when their results were read: a
    DataFrame that an operator gave out reads from there."""
    while _KEPT:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_KEPT.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def keep(df: DataFrame, name: str, **options) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, and survives the loss of executors."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class SharedFiles:
    """Parquet below a path of the shared folder, read in a task."""

    def __init__(self, path: str):
        import pyarrow.fs as fs

        self.fs, self.path = fs.FileSystem.from_uri(path)

    def read(self, name: str, columns: list[str]):
        """The table in the folder `name`; None where nothing was written."""
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        at = f"{self.path}/{name}"
        if self.fs.get_file_info(at).type == fs.FileType.NotFound:
            return None
        return pq.read_table(at, filesystem=self.fs, columns=columns, partitioning=None)

    def batches(self, name: str, columns: list[str], rows: int):
        """The same rows in the same order, in batches of at most `rows`."""
        import pyarrow.dataset as ds

        return ds.dataset(f"{self.path}/{name}", filesystem=self.fs, format="parquet").to_batches(columns=columns, batch_size=rows, batch_readahead=1, fragment_readahead=1)


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its files give fewer partitions than there are cores, for maps that are heavy on CPU.
    Larger inputs have more partitions and are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
