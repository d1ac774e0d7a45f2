"""Session helpers: local test session, and lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def local_session(cores: str = "8", app: str = "flowlens") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once for each application; Spark hands the archive to every executor."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "flowlens.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def cut_dir(spark: SparkSession) -> str:
    """This application's folder below the one the cluster names in spark.checkpoint.dir, or below the warehouse where unset."""
    shared = shared_dir(spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master)
    return f"{shared.rstrip('/')}/flowlens-{spark.sparkContext.applicationId}"


def shared_dir(named: str | None, warehouse: str, master: str) -> str:
    """Folder that the driver and all executors see: a named one is taken as it is; a warehouse on a local disk serves only
    a session that runs in one process."""
    if named:
        return named
    local_disk = warehouse.startswith("file:") or "://" not in warehouse and not warehouse.startswith("hdfs:")
    if local_disk and not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {warehouse} is local")
    return f"{warehouse.rstrip('/')}/_cuts"


def cut_counted(df: DataFrame, where: str = "true") -> tuple[DataFrame, int]:
    """Write the rows once to the shared folder and read them back: (rows, count of rows ``where``).

    Ends the lineage of an iteration, survives executor loss, and gives the optimizer real sizes.
    The count comes from the write itself, so a round needs no second job.
    """
    spark = df.sparkSession
    path = f"{cut_dir(spark)}/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count_if(F.expr(where)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]


def cut(df: DataFrame) -> DataFrame:
    return cut_counted(df)[0]


def off_driver(df: DataFrame) -> DataFrame:
    """The rows, shuffled by the join they take part in. A table that grows with the input would go through the driver in every
    round of an iteration, as long as it is just small enough for a broadcast."""
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over three partitions a core by their keys."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def clear_cuts(spark: SparkSession) -> None:
    """Drop this application's cuts; call when its results are no longer needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cut_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
