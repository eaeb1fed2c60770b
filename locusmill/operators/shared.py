"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a temporary folder that goes when Python ends; on a
    cluster that is an error, as each executor would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.split("[")[0] == "local":
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="locusmill-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The plan above starts from files that survive a lost executor, both sides of a
    later join are plain exchanges that adaptive execution can split, and nothing is
    computed twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` in buckets of ``key``, so that a join or grouping on it doesn't shuffle these rows again.

    Nothing is shuffled to write: a task leaves a file for each bucket it meets, so this suits
    tables of few large rows. The other side should have as many partitions as there are buckets.
    The catalog's entry goes at once; the files stay in the shared folder.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.mode("error").bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{table}").format("parquet").saveAsTable(table)
    written = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return written


def forget(df: DataFrame) -> None:
    """Delete the files of a written table that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
