"""Session, table and lineage helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Adaptive settings under which skewed joins split and small partitions merge.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lorekeel")
    conf = {
        **ADAPTIVE,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes below which a table is not worth spreading.
SPREAD_BYTES = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """A scan over all cores: one that comes in fewer partitions than there are cores is dealt out.

    A file of one row group is one task however large it is; where texts are
    parsed that leaves the other cores idle. Scans of many files or row groups,
    as on a cluster, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < SPREAD_BYTES or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of texts, spread over all cores."""
    return spread(table(spark, folder, name))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir.

    Where it is unset a temporary folder serves on a local master only; on a
    cluster a machine-local folder would be lost with its executor, so that
    case is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    known = getattr(sc, "_lorekeel_dir", None)
    if known:
        return known
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lorekeel-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(made)
    sc._lorekeel_dir = made
    return made


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the shared folder; lineage ends here.

    Unlike a local checkpoint the files outlive any executor.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unordered_pair(a: str, b: str) -> list:
    """The columns id_a < id_b for two id columns."""
    return [F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")]
