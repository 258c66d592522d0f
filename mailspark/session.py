"""Session settings and the shared folder for intermediate tables."""

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(cores="*", app_name="mailspark", **settings):
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_splits(spark):
    """Fix how files are cut into splits for the rest of the session.

    Spark sizes splits by the number of cores it sees at planning time, which
    moves when executors come and go. Byte extents are joined on split starts,
    so both reads of an archive must cut it alike.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))


def join_where_dealt(spark):
    """For the rest of the session a join of tables that are dealt alike by some of its keys shuffles neither again.

    Without this Spark deals both anew by all keys; results are the same.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def shared_dir(spark, purpose):
    """A new folder that every executor can reach, under ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="mailspark-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")
