"""Session helpers: configuration for local runs and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that ``durable`` has written in this process.
_WRITTEN: list[str] = []


def local_session(cores: int = 8, app: str = "saleslens") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set on first use.

    It is the one the session names in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a folder of its own; a cluster without it is an error, because a machine-local
    folder would be lost with the machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="saleslens-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new folder name under the checkpoint folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once: written as Parquet to a folder under the checkpoint folder and read back."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of input files for a task that holds groups of its rows.
INPUT_PER_TASK = 8 << 20


def pieces_for(*tables: DataFrame) -> int | None:
    """Partitions for a shuffle of tables whose files ask for more than the session has, so that what a task holds does
    not grow with them; none where they do not."""
    spark = tables[0].sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for t in tables for f in t.inputFiles()]
    pieces = -(-sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths) // INPUT_PER_TASK)
    return pieces if pieces > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def placed(df: DataFrame, key: str) -> DataFrame:
    """Rows placed by ``key``, in as many partitions as their files ask for."""
    pieces = pieces_for(df)
    return df.repartition(pieces, key) if pieces else df.repartition(key)


def evenly(df: DataFrame) -> DataFrame:
    """Rows dealt in turn over as many partitions as there are cores; for rows that are written and then passed over many
    times, where one file more than cores would double the time of each pass."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def release(spark: SparkSession) -> None:
    """Remove what ``durable`` has written; results that still read it must have been used up by then."""
    while _WRITTEN:
        delete(spark, _WRITTEN.pop())


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
