"""Session set-up and the few helpers that every operator shares."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lectern", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under. On a cluster, use the cluster's own session."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("LECTERN_DRIVER_MEMORY", "8g"),
    }
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the session's Python workers, once for each application, wherever they run and were started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="lectern-package-"), "lectern.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset directory: a parquet file or a folder of them."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lanes(spark: SparkSession) -> int:
    """Partitions for stages whose work is far more than their bytes tell, which adaptive execution would merge into one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


#: Partitions from which on a table is left as it is read.
FEW = 32


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, if it comes in very few: a small file of long texts is one partition otherwise.

    Larger tables stay as read, so no text of them moves.
    """
    n, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return df if n >= min(cores, FEW) else df.repartition(cores)


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """df, a small table to be broadcast, counted: it raises if it has more than so many rows, so none is cut away unseen."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's spark.checkpoint.dir. Only a local session that names none gets one of this machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lectern-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared folder and cuts its lineage, so the data outlives any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
