"""Sessions, and tables kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that a query may change on a session it was given.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the JVM never compiles a method of more bytes, so a longer one is better run operator by operator
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def create_session(app: str = "rootline", master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the library expects: UTC, AQE and Arrow."""
    builder = SparkSession.builder.master(master).appName(app)
    conf = RUNTIME_CONF | {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    session = builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings that results depend on (time zone, Arrow)."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: ``spark.checkpoint.dir``.

    Only a session in local mode that names none gets a folder of its own, removed at exit.  A
    cluster without the setting is refused, as a machine-local folder would not be seen by all.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="rootline-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark)}/rootline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage and survives the loss of executors, unlike a local checkpoint.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame | None) -> None:
    """Delete tables made by ``materialize`` that nothing reads any more."""
    for table in tables:
        if table is None:
            continue
        spark = table.sparkSession
        root = f"{shared_dir(spark)}/rootline/"
        for file in table.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if root.split("://")[-1] not in folder:
                raise ValueError(f"{folder} is not a stage of this library")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cleanup(spark: SparkSession) -> None:
    """Delete all stages of this application; results that read them must have been used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/rootline/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
