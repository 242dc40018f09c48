"""A session with the settings the engine is written for."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_sidewind_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="sidewind-"), "sidewind_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(target))
    sc._sidewind_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local master may leave it unset, since a
    machine's own folder is not seen by other machines."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = Path(tempfile.gettempdir(), "sidewind-shared").as_uri()
    return root.rstrip("/")


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes df to a new folder below shared_root() and reads it back: what was sampled or drawn stays as it is, and a
    lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/sidewind-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """ANSI mode and adaptive execution stay on; times are UTC. On a cluster leave both arguments out
    and let the cluster's own settings hold."""
    b = SparkSession.builder.appName("sidewind")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
