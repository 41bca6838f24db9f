"""Session settings, and the two things every multi-step job needs: a shared
work folder that survives lost executors, and enough input partitions."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # one Arrow batch of long reads must stay well below executor memory
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def local_session(cores: str | int = 8, partitions: int = 8, name: str = "helixframe"):
    """A local session for tests and the bench; clusters bring their own."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(name)
         .config("spark.driver.memory", "12g")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.bindAddress", "127.0.0.1")
         .config("spark.driver.host", "127.0.0.1")
         .config("spark.sql.shuffle.partitions", str(partitions)))
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Folder for step tables: ``spark.checkpoint.dir`` of the session. Only a
    local master may fall back to a temporary folder of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        path = tempfile.mkdtemp(prefix="helixframe-")
        _local_dirs[app] = path
        owner = os.getpid()
        atexit.register(lambda: os.getpid() == owner and shutil.rmtree(path, ignore_errors=True))
    return _local_dirs[app]


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write a step table to the work folder and read it back.

    This cuts the lineage of iterative programs. Unlike an RDD checkpoint the
    result has file statistics, so the planner knows when a later join side is
    small enough to broadcast, and columns can still be pruned.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/helixframe-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a step table that nothing reads any more. Only files
    under the work folder are touched."""
    spark = df.sparkSession
    plain = lambda path: path.removeprefix("file:").lstrip("/")
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if plain(path).startswith(plain(work_dir(spark)) + "/"):
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def spread(df: DataFrame) -> DataFrame:
    """Repartition only when the scan yields fewer partitions than there are
    cores (one unsplittable file, say); otherwise leave the plan alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores * 2)
    return df
