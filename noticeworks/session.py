"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "noticeworks", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


#: Intermediate tables of this process.
_CUTS: list[str] = []


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="noticeworks-")


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: ``spark.checkpoint.dir``, a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return _local_folder(spark.sparkContext.applicationId)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from there.

    It is computed once, survives lost executors, and its real size lets later
    joins choose their strategy.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    _CUTS.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch, about; a batch holds one row at least.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of at most about ``BATCH_BYTES``: Spark counts 10,000 rows or 64 MB, which a task holds several times over.

    It stays so for the session, as plans are made late. A limit that the session was given is left alone.
    """
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


#: Tasks a core that rows which cost much are dealt to.
TASKS = 4


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Deal rows that are small but cost much to work on to several tasks a core.

    Adaptive execution joins tasks by their bytes and would leave such work to a few of them; a number that is asked for stays.
    """
    spark = rows.sparkSession
    return rows.repartition(max(TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def cut_bucketed(df: DataFrame, key: str) -> DataFrame:
    """As ``cut_lineage``, bucketed by ``key``: joins on it shuffle the other side only."""
    spark = df.sparkSession
    name = f"cut_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    _CUTS.append(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


class GrowingCut:
    """A cut table bucketed by ``key`` that rows are added to; joins on the key never shuffle what it holds."""

    def __init__(self, rows: DataFrame, key: str):
        self.spark, self.key = rows.sparkSession, key
        self.name = f"cut_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(self.spark)}/{self.name}"
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        _CUTS.append(self.path)
        self.add(rows)

    def add(self, rows: DataFrame) -> None:
        """Rows that come from a join or a grouping by the key are dealt to their buckets already."""
        dealt = rows.repartition(self.buckets, self.key)
        dealt.write.mode("append").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", self.path).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)


def drop_cuts(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far; for the end of a job, when its results are stored."""
    n = len(_CUTS)
    while _CUTS:
        name = _CUTS.pop()
        if (table := name.rsplit("/", 1)[-1]).startswith("cut_"):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
