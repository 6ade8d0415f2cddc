"""Spark session helpers.

Settings of the cluster (submit command, defaults file) win: only a local run
gets defaults here.  The checkpoint folder is read from ``spark.checkpoint.dir``
of the running session; a scratch folder is made only for a local master.
"""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

import rolefit

_LOCAL = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str | None = None, app: str = "rolefit",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """The session of a script: a master or setting that is already given (spark-submit, spark-defaults) is kept."""
    given = SparkConf()
    b = SparkSession.builder.appName(app)
    if not given.contains("spark.master"):
        cpus = os.environ.get("BENCH_CPUS", "8")
        local = _LOCAL | {"spark.master": master or f"local[{cpus}]",
                          "spark.sql.shuffle.partitions": str(shuffle_partitions or int(cpus)),
                          "spark.driver.memory": os.environ.get("ROLEFIT_DRIVER_MEM", "6g")}
        for k, v in local.items():
            if not given.contains(k):
                b = b.config(k, v)
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_rolefit_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="rolefit-package-")
    root = os.path.dirname(os.path.abspath(rolefit.__file__))
    copy = shutil.copytree(root, os.path.join(folder, "tree", "rolefit"), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "rolefit"), "zip", os.path.dirname(copy)))
    sc._rolefit_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a scratch one is made only if none is set and the master is local."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        d = tempfile.mkdtemp(prefix="rolefit-ckpt-", dir="/tmp")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d
