"""Session defaults and the place for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "symptomlake", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library counts on.

    Master, memory and number of shuffle partitions are left to ``spark-submit``
    unless asked for here. Adaptive execution sizes partitions and splits skewed
    joins; the zone is fixed because all times in the data model are UTC.
    """
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true"))
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def build_local_session(app: str, cpus: int = 8, **conf) -> SparkSession:
    """One process on this machine, for tests and benchmarks."""
    local = {"spark__sql__shuffle__partitions": str(cpus), "spark__driver__memory": "12g", "spark__ui__enabled": "false",
             "spark__sql__adaptive__coalescePartitions__minPartitionSize": "64k",
             "spark__checkpoint__dir": tempfile.mkdtemp(prefix="run-shared-")}
    return build_session(app, f"local[{cpus}]", **local | conf)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, below the shared folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a session inside one process takes a temporary folder;
    on a cluster that would leave each executor's rows on its own disk, so
    the setting is required there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="run-shared-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
