"""Session building, table loading and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "brujula", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the plans assume (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session's executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="brujula-")) / "brujula.zip"  # read by the driver's own file server
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"brujula/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only the columns that a plan uses reach the scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only where the session names none and everything runs in this machine (master local, as in
    tests) a temporary folder of it is taken; on a cluster a missing folder is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="brujula-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


_folders: dict[str, str] = {}


def _cut_folder(spark: SparkSession) -> str:
    """This application's folder of cut tables; the file system drops it when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_dir(spark)}/brujula/{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders[app])
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
    return _folders[app]


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a compressed table in the shared folder and read it back.

    Cuts the lineage: what follows re-reads the table, so losing an executor costs no
    recomputation beyond it.
    """
    spark = df.sparkSession
    path = f"{_cut_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, of a scan, over as many tasks as there are cores where its files make fewer.

    A single small file is one task however much work its rows are; large inputs have far
    more splits than cores and aren't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
