"""Session defaults and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR = "spark.checkpoint.dir"


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("propago")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where it is unset (one machine), a temporary folder is set."""
    sc = spark.sparkContext
    where = sc.getConf().get(SHARED_DIR) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"set {SHARED_DIR} to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="propago-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


#: Bytes of rows that go to a Python worker at once; a batch is held several times over, outside the heap too.
ARROW_BYTES = 8 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches be of ARROW_BYTES at most, where the session has Spark's default, which is eight times that."""
    if int(spark.conf.get(_ARROW).rstrip("bB")) == 64 << 20:
        spark.conf.set(_ARROW, str(ARROW_BYTES))


_UNION = "spark.sql.unionOutputPartitioning"


def union(one: DataFrame, other: DataFrame, missing: bool = False) -> DataFrame:
    """The rows of both, by name; with ``missing``, columns that one side lacks are null there.

    Spark takes the union of two inputs dealt by one key to be dealt by it too, and leaves out the shuffle of a window or
    a repartition over it. But adaptive execution merges the partitions of each input on its own, so that a key's rows
    are in two tasks. So the session is told not to take unions for dealt.
    """
    one.sparkSession.conf.set(_UNION, "false")
    return one.unionByName(other, allowMissingColumns=missing)


#: Rows of a table that one task sorts by series, on average at most.
TASK_ROWS = 200_000


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """The rows of a table above TASK_ROWS dealt by the series' key to as many tasks as they need, a core one at least.

    Windows and groups by the key keep to it, so that a task's memory does not grow with the table. The number is given,
    whatever the session's: adaptive execution would merge the session's partitions to large ones.
    """
    rows = df.count()
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *by) if rows > TASK_ROWS else df


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a packed block of rows.
BLOCK_BYTES = 1 << 20
#: A reader holds all the blocks of a row group at once: it ends at so many bytes, looked at from the first block on.
_ROW_GROUPS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1}


def stored(df: DataFrame, packed: bool = False) -> tuple[DataFrame, str]:
    """Cut the lineage with a Parquet table in the shared folder, and give its path too, for ``discard``.

    Rows that are ``packed`` blocks go in small row groups.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**(_ROW_GROUPS if packed else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, packed: bool = False) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: compressed and by columns, for what is large."""
    return stored(df, packed)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared folder that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
