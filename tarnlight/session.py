"""Sessions, table reading and cutting of lineage."""

from __future__ import annotations

import tempfile
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "tarnlight", cpus: int | str = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus if cpus != "*" else 8))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="spark-")) / f"{home.name}.zip"
    with zipfile.ZipFile(packed, "w") as archive:
        for source in sorted(home.rglob("*.py")):
            archive.write(source, source.relative_to(home.parent))
    context.addPyFile(str(packed))
    _shipped.add(context.applicationId)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of a data folder; the first call of an application also ships this package."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of reliable checkpoints: the one the cluster names, or on a single machine a new temporary one."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, so that later jobs neither recompute them nor depend on one executor."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_parts(df: DataFrame, most: int = 10_000) -> list[DataFrame]:
    """The rows in parts of at most ``most``, counted, each marked for broadcast; a side of any size is worked off part by part."""
    rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    parts = max(1, -(-rows.count() // most))
    while parts > 1:
        part = F.pmod(F.xxhash64("_row"), F.lit(parts))
        if rows.groupBy(part).count().where(F.col("count") > most).isEmpty():
            break
        parts += 1 + parts // 4
    return [F.broadcast(rows.where(F.pmod(F.xxhash64("_row"), F.lit(parts)) == n).drop("_row")) for n in range(parts)]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
