"""Session helpers shared by the whole library."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []
_WRITTEN: dict[str, SparkSession] = {}


def local_session(app: str = "inkwell", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is read from ``spark.checkpoint.dir``. Only in local mode, where there is one machine,
    a temporary folder stands in for it, and is removed when Python ends; on a cluster a missing
    setting is an error, as each executor would write to a disk that the others can't read.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    master = spark.conf.get("spark.master", "local")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _MADE:
        _MADE.append(tempfile.mkdtemp(prefix="inkwell-"))
        atexit.register(shutil.rmtree, _MADE[0], ignore_errors=True)
    return f"file://{_MADE[0]}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    This cuts the lineage and gives the planner true sizes; it survives the loss of
    executors, as the files aren't on their disks. Use it where a result is read more
    than once. The files are removed by ``release``, at the latest when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkwell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(release)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes what ``written`` wrote: the given tables, or all of them.

    A long session calls it once a result that reads such tables is consumed.
    """
    for path in [t._written for t in tables] or list(_WRITTEN):
        if (spark := _WRITTEN.pop(path, None)) is None:
            continue
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended before us
            pass


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores, for a Python stage over tables smaller than the cluster.

    Judged by the plan's own estimate of the size: a table that fills a read of full size on
    every core is left as it is, without listing its files, so no more than
    ``spark.sql.files.maxPartitionBytes`` a core is ever shuffled. A smaller one is left too if
    it has a file for every core.
    """
    spark = df.sparkSession
    if df.isStreaming:
        return df
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if size >= cores * most or len(df._jdf.inputFiles()) >= cores:  # the array stays in the JVM
        return df
    return df.repartition(cores, key)


def bounded(df: DataFrame, most: int, what: str) -> list:
    """The rows of a table that must be small; an error where it isn't.

    Driver-side tables (rules, vocabularies, limits) pass through here, so that nothing
    that grows with the data is ever collected.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows; it must be a small table")
    return rows
