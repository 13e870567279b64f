"""Session helpers: recommended settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every job assumes.  Shuffle partition count is left to the
# cluster (AQE coalesces small partitions and splits skewed ones).
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


FALLBACK_KEY = "tokenloom.checkpoint.dir"


def build_session(master: str = "local[*]", shuffle_partitions: int | None = 8,
                  app_name: str = "tokenloom") -> SparkSession:
    """Local session for tests and benchmarks (the UI stays off)."""
    builder = SparkSession.builder.master(master).appName(app_name)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.ui.enabled", "false")
    builder = builder.config("spark.driver.memory", os.environ.get("TOKENLOOM_DRIVER_MEM", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when the setting is absent (local tests) is a private folder
    created; it is registered with ``setCheckpointDir`` and remembered under
    a library key (core settings cannot be changed at runtime).  On any other
    master a missing setting is an error: executors can't see a private folder.
    """
    sc = spark.sparkContext
    root = (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
            or spark.conf.get(FALLBACK_KEY, None))
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tokenloom-ckpt-")
        spark.conf.set(FALLBACK_KEY, root)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique sub-folder of the checkpoint root for one run."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/tokenloom/{label}-{uuid.uuid4().hex[:12]}"


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per application, so
    that Python functions can be unpickled whatever their working directory."""
    sc = spark.sparkContext
    done = f"{FALLBACK_KEY}.shipped"
    if spark.conf.get(done, None) == sc.applicationId:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tokenloom-ship-"), "tokenloom-package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(home)))
    sc.addPyFile(path)
    spark.conf.set(done, sc.applicationId)
