"""What the operators need of the session: a folder that all executors share, and tables in it."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where it is unset, a folder of this machine in local mode, and an error otherwise: executors of a cluster would each
    write to a folder of their own, and tables would come back without the rows of the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share; it is unset and the master is {master}")
        folder = f"file://{tempfile.gettempdir()}/hilite-shared"
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/hilite-{spark.sparkContext.applicationId}"


def _at(spark: SparkSession, folder: str):
    """The file system of a folder, and the folder as it knows it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    fs, path = _at(spark, folder)
    return fs.exists(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage is cut, and it survives lost executors.

    It goes with release(), or when the application ends.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, whole = _at(spark, own_folder(spark))
    fs.deleteOnExit(whole)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table of written() before release(), once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        fs, path = _at(df.sparkSession, folder)
        fs.delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the tables that this application's queries have written so far; to be called when their results are read or written, as these read them."""
    fs, path = _at(spark, own_folder(spark))
    fs.delete(path, True)
