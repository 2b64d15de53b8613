"""Session helpers: a configured session and the shared scratch location."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "postlens", conf: dict | None = None) -> SparkSession:
    """A session with AQE (runtime coalescing, skew-join splitting) and UTC.

    On a cluster leave ``master`` unset and let spark-submit decide."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession, folder: str | None = None) -> str:
    """The shared folder for intermediate tables: ``folder`` if given, else the
    one the cluster names in ``spark.checkpoint.dir`` (or as the context's
    checkpoint folder).

    Without either, a local master gets a folder of this application under the
    temporary folder; on a cluster that is an error, because each executor
    would write to a disk of its own."""
    root = folder or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    try:
        sc = spark.sparkContext
    except Exception:  # e.g. a Spark Connect session: no driver-side context
        sc = None
    root = sc.getCheckpointDir() if sc is not None else None
    if not root:
        if sc is None or not re.match(r"local(\[|$)", sc.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        root = os.path.join(tempfile.gettempdir(), f"postlens-{sc.applicationId}")
    return root


def scratch_path(spark: SparkSession, *parts: str, folder: str | None = None) -> str:
    """A fresh, unique path below the scratch root."""
    base = scratch_root(spark, folder)
    sep = "/" if "://" in base else os.sep
    return sep.join([base.rstrip("/"), "postlens", uuid.uuid4().hex, *parts])


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, and the path as it takes it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, on whatever file system."""
    fs, target = file_system(spark, path)
    return fs.exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate data on whatever file system it is."""
    fs, target = file_system(spark, path)
    fs.delete(target, True)
