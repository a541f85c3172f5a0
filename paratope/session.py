"""Session construction, and this package on the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def build_session(app: str = "paratope", cores: str = "8", **conf: str) -> SparkSession:
    """A local session with the settings that the operators rely on: UTC and adaptive execution."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": cores,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once a Spark application; operators with Python on the executors call it. Arrow batches are kept small where nobody chose their size, as rows may hold long texts."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="paratope-src-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / f"{top.name}.zip", "w") as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, source.relative_to(top.parent))
    sc.addPyFile(str(folder / f"{top.name}.zip"))
    _SHIPPED.add(sc.applicationId)


_OWN_DIR: list[str] = []


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def given_dir(spark: SparkSession) -> str | None:
    """The folder that spark.checkpoint.dir names."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one temporary folder of this process in a local session; on a cluster, where executors would write to disks of their own, an error."""
    if given := given_dir(spark):
        return given.rstrip("/")
    if not is_local(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="paratope-shared-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    return "file://" + _OWN_DIR[0]


def settled(df):
    """df with its lineage cut: by a checkpoint, or kept in memory and on disk in a local session without a checkpoint folder. For what later steps read several times."""
    spark = df.sparkSession
    if not given_dir(spark) and is_local(spark):
        return df.persist()
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


class Steps:
    """Tables of a loop whose steps feed themselves: each is written in the shared folder and read again, which cuts lineage, plan and inferred constraints; those of steps before the last are deleted."""

    def __init__(self):
        self.paths: list[str] = []
        self.old: list[str] = []

    def put(self, df):
        path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def turn(self, spark) -> None:
        """The step is done: what the one before it wrote isn't read any more."""
        delete(spark, self.old)
        self.old, self.paths = self.paths, []


def delete(spark, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


#: Rows that fitted() broadcasts at most; with rows of about 1 KB that is 200 MB, which an executor of a few GB holds.
BROADCAST_ROWS = 200_000


def fitted(df, most: int = BROADCAST_ROWS):
    """df settled, with a broadcast hint where it holds at most `most` rows; beyond that joins shuffle it."""
    from pyspark.sql import functions as F

    df = settled(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
