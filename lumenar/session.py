"""Session helpers shared by all operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_CONF = "spark.checkpoint.dir"
_cuts: dict[str, list[str]] = {}


def build_session(cores: str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """Local session with the settings the operators expect (UTC, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lumenar")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    A session with executors on other machines must name it in ``spark.checkpoint.dir``, else RuntimeError; one is made
    only for a session that runs in a single process.
    """
    where = spark.conf.get(SHARED_DIR_CONF, None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{SHARED_DIR_CONF} must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lumenar-shared-")
        spark.conf.set(SHARED_DIR_CONF, where)
    return where


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several later stages: recomputing it would repeat the
    work, and a lost executor can read the files again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _cuts.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on all executors, once per session."""
    context = spark.sparkContext
    if getattr(context, "_lumenar_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lumenar-package-")) / "lumenar.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context._lumenar_shipped = True


def clear_cuts(spark: SparkSession) -> None:
    """Delete what ``cut_lineage`` has written in this session; results read from it can't be read again."""
    jvm = spark.sparkContext._jvm
    for path in _cuts.pop(spark.sparkContext.applicationId, []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
